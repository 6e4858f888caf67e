"""The tables of the store as Spark schemas, versioned, and what later versions filled in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions.text import default_provenance

VERSION = 3
KINDS = ("git_commit", "code_diff", "shell_command", "doc_section", "conversation_turn", "session_summary", "note")
TABLES = {
    "meta": "key string, value string",
    "projects": "id string, root string, origin_url string, created_at bigint, last_synced_at bigint",
    "nodes": "node_id string, kind string, project_id string, ts string, ts_epoch bigint, source string, title string, body string, signal_score double, meta string, created_at bigint, provenance string, supersedes string",
    "node_files": "node_id string, path string, previous_path string, insertions int, deletions int, is_binary boolean",
    "node_links": "from_id string, to_id string, relation string, created_ms bigint",
    "file_edges": "project_id string, from_path string, to_path string, kind string",
    "sync_state": "project_id string, source string, cursor string, last_run_at bigint",
    "deny_list": "rule_id bigint, project_id string, match_type string, pattern string, ignore_case boolean, reason string, created_at bigint",
    "mutation_audit": "audit_id bigint, action string, project_id string, detail string, affected_count bigint, succeeded boolean, error string, started_at bigint, finished_at bigint",
    "tombstones": "node_id string, project_id string, kind string, source string, body_sha256 string, title_sha256 string, body_length bigint, rule_id bigint, removed_at bigint",
    "contradiction_checks": "candidate_id string, against_id string, contradicts boolean, reason string, model string, checked_at bigint",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def migrated(nodes: DataFrame, version: int) -> DataFrame:
    """Nodes of an older version in the present one: provenance by kind from version 2, supersedes from 3."""
    if version < 2 and "provenance" not in nodes.columns:
        nodes = nodes.withColumn("provenance", default_provenance(F.col("kind")))
    if version < 3 and "supersedes" not in nodes.columns:
        nodes = nodes.withColumn("supersedes", F.lit(None).cast("string"))
    return nodes


def checked_kinds(nodes: DataFrame) -> DataFrame:
    """Rows whose kind isn't one of the seven; none in a sound table."""
    return nodes.where(~F.col("kind").isin(*KINDS) | F.col("kind").isNull())
