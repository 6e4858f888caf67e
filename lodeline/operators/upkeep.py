"""Upkeep of the store: clearing, forgetting with an audit, rule lists, registries, what is stale, counts and status."""

from __future__ import annotations

import json
import re
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions import signals
from lodeline.functions.text import approx_tokens, project_id
from lodeline.operators.correlate import chain_stats, open_verdicts, stale
from lodeline.operators.lexical import LIVE_SQL, live_nodes
from lodeline.operators.store import RULES, DenyRule, denied_by, pruned
from lodeline.operators.vectors import pending
from lodeline.sources.shell import hook_to_shell
from lodeline.tables import table


class Cleared(NamedTuple):
    nodes: DataFrame
    vectors: DataFrame
    cursors: DataFrame
    count: DataFrame


def cleared(nodes: DataFrame, vectors: DataFrame, cursors: DataFrame, project: str) -> Cleared:
    """The tables without a project's rows, vectors and cursors, and how many rows went; rules stay, and so do rows of no project."""
    mine = F.coalesce(F.col("project_id") == project, F.lit(False))
    gone = nodes.where(mine)
    return Cleared(
        nodes.where(~mine), vectors.join(gone.select("node_id"), "node_id", "left_anti"), cursors.where(~mine), gone.agg(F.count(F.lit(1)).alias("removed"))
    )


def without_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """No vectors at all, and how many there were."""
    return vectors.limit(0), vectors.agg(F.count(F.lit(1)).alias("removed"))


def vectors_kept(vectors: DataFrame, states: DataFrame) -> DataFrame:
    """Vectors but those of rows that were rewritten (``states``: node_id, state): a changed text has no vector until it is embedded again."""
    return vectors.join(states.where("state = 'updated'").select("node_id"), "node_id", "left_anti")


def judged_pairs(nodes: DataFrame, pairs: DataFrame, project: str | None = None) -> DataFrame:
    """(node_id, supersedes, refused) of ``pairs`` (node_id, supersedes): why a row can't stand for another, null where it can.

    Refused are a row that stands for itself, rows that don't exist, and rows of two projects (or of another than ``project``).
    """
    of = nodes.select("node_id", "project_id").distinct()
    new = of.select("node_id", F.col("project_id").alias("_new"), F.lit(True).alias("_has_new"))
    old = of.select(F.col("node_id").alias("supersedes"), F.col("project_id").alias("_old"), F.lit(True).alias("_has_old"))
    both = pairs.join(new, "node_id", "left").join(old, "supersedes", "left")
    elsewhere = ~F.col("_new").eqNullSafe(F.col("_old"))
    if project is not None:
        elsewhere = elsewhere | ~F.col("_new").eqNullSafe(F.lit(project))
    refused = (
        F.when(F.col("node_id") == F.col("supersedes"), "itself").when(F.col("_has_old").isNull(), "no old row").when(F.col("_has_new").isNull(), "no new row").when(elsewhere, "other project")
    )
    return both.select("node_id", "supersedes", refused.alias("refused"))


def with_supersedes(nodes: DataFrame, pairs: DataFrame, project: str | None = None) -> DataFrame:
    """``nodes`` with ``supersedes`` set by the pairs that aren't refused; of several for one row the greatest id."""
    fit = judged_pairs(nodes, pairs, project).where("refused is null").groupBy("node_id").agg(F.max("supersedes").alias("_set"))
    columns = [F.coalesce("_set", "supersedes").alias(c) if c == "supersedes" else F.col(c) for c in nodes.columns]
    return nodes.join(fit, "node_id", "left").select(*columns)


def mark_stale(nodes: DataFrame, old: str, new: str, project: str) -> DataFrame:
    """``nodes`` with the row ``new`` standing for ``old``; raises ValueError where that is refused."""
    pair = nodes.sparkSession.createDataFrame([(new, old)], "node_id string, supersedes string")
    refused = judged_pairs(nodes, pair, project).first()["refused"]
    if refused:
        raise ValueError(f"{new} can't stand for {old}: {refused}")
    return with_supersedes(nodes, pair, project)


class Forgotten(NamedTuple):
    nodes: DataFrame
    tombstones: DataFrame
    audit: DataFrame
    rules: DataFrame


def _rule_rows(spark: SparkSession, rules: list[DenyRule], project: str, at: int) -> DataFrame:
    rows = [(r.rule_id, project, "regex" if r.regex else "literal", r.pattern, r.ignore_case, None, at) for r in rules]
    return spark.createDataFrame(rows, "rule_id bigint, project_id string, match_type string, pattern string, ignore_case boolean, reason string, created_at bigint")


def forget(nodes: DataFrame, rules: list[DenyRule], projects: list[str], at: int) -> Forgotten:
    """What stays, the tombstones of what the rules remove from ``projects`` (this one first, then its earlier ids), an audit row per rule, and the rule rows.

    A row that several rules match belongs to the first, as if they came one after the other. Tombstones hold
    digests and lengths, no text. A rule that matches nothing leaves its row and its audit row, as it
    keeps later rows out. One scan for all rules: lists of rules are small and become part of the expression.
    """
    spark = nodes.sparkSession
    inside = F.col("project_id").isin(projects)
    hit = F.when(inside, denied_by(rules))
    marked = nodes.withColumn("_rule", hit)
    text = lambda c: F.coalesce(c, F.lit(""))
    stones = marked.where("_rule is not null").select(
        "node_id", "project_id", "kind", "source", "ts", F.col("signal_score").alias("signal"), F.sha2(text("body"), 256).alias("body_sha256"), F.sha2(text("title"), 256).alias("title_sha256"),
        F.length(text("body")).cast("bigint").alias("body_length"), F.col("_rule").alias("rule_id"), F.lit(at).cast("bigint").alias("removed_at"),
    )
    rows = _rule_rows(spark, rules, projects[0], at)
    counts = stones.groupBy("rule_id").agg(F.count(F.lit(1)).alias("affected_count"))
    detail = F.to_json(F.struct("pattern", F.col("match_type").alias("matchType"), F.col("ignore_case").alias("ignoreCase"), F.array(*map(F.lit, projects)).alias("scopeProjectIds")))
    audit = rows.join(counts, "rule_id", "left").select(
        F.col("rule_id").alias("audit_id"), F.lit("forget").alias("action"), "project_id", detail.alias("detail"), F.coalesce("affected_count", F.lit(0)).cast("bigint").alias("affected_count"),
        F.lit(True).alias("succeeded"), F.lit(None).cast("string").alias("error"), F.lit(at).cast("bigint").alias("started_at"), F.lit(at).cast("bigint").alias("finished_at"),
    )
    return Forgotten(marked.where("_rule is null").drop("_rule"), stones, audit, rows)


def _same_rule(stored: DataFrame) -> set[tuple]:
    """The rules stored, as (match_type, pattern, ignore_case): a list a person keeps."""
    return {(r.match_type, r.pattern, r.ignore_case) for r in stored.select("match_type", "pattern", "ignore_case").collect()}


def _fresh(stored: DataFrame, rules: list[DenyRule]) -> tuple[list[DenyRule], list[DenyRule]]:
    """Those of ``rules`` that are new, each once, and the others."""
    seen, new, old = _same_rule(stored), [], []
    for r in rules:
        key = ("regex" if r.regex else "literal", r.pattern, r.ignore_case)
        (old if key in seen else new).append(r)
        seen.add(key)
    return new, old


def import_rules(nodes: DataFrame, stored: DataFrame, rules: list[DenyRule], projects: list[str], at: int) -> tuple[Forgotten, DataFrame]:
    """Rules applied that aren't stored yet, each as ``forget`` does, and one row of counts: imported, skipped, removed_nodes."""
    new, old = _fresh(stored, rules)
    done = forget(nodes, new, projects, at)
    counts = done.tombstones.agg(F.lit(len(new)).alias("imported"), F.lit(len(old)).alias("skipped"), F.count(F.lit(1)).alias("removed_nodes"))
    return done, counts


def import_preview(nodes: DataFrame, stored: DataFrame, rules: list[DenyRule], projects: list[str]) -> DataFrame:
    """(rule_id, pattern, already_present, would_remove): what each rule alone would remove; nothing is written, one scan for all."""
    spark = nodes.sparkSession
    _, old = _fresh(stored, rules)
    mine = nodes.where(F.col("project_id").isin(projects))
    told = [F.struct(F.lit(r.rule_id).cast("bigint").alias("rule_id"), F.count(F.when(denied_by([r]).isNotNull(), 1)).alias("n")) for r in rules]
    if not rules:
        return spark.createDataFrame([], "rule_id bigint, pattern string, already_present boolean, would_remove bigint")
    counts = mine.agg(F.array(*told).alias("_t")).select(F.inline("_t"))
    known = spark.createDataFrame([(r.rule_id, r.pattern, r in old) for r in rules], "rule_id bigint, pattern string, already_present boolean")
    return known.join(counts, "rule_id").select("rule_id", "pattern", "already_present", F.when(F.col("already_present"), 0).otherwise(F.col("n")).cast("bigint").alias("would_remove"))


def exported_rules(rules: DataFrame) -> DataFrame:
    """(rule_id, json): each rule as one line of JSON, to write as text; reading such lines gives the rules back."""
    return rules.select("rule_id", F.to_json(F.struct(F.col("match_type").alias("matchType"), "pattern", F.col("ignore_case").alias("ignoreCase"), "reason")).alias("json"))


def read_rules(lines: list[str]) -> list[DenyRule]:
    """Rules from lines of JSON; raises ValueError for a rule that denies everything or has no pattern."""
    out = []
    for no, line in enumerate(x for x in lines if x.strip()):
        told = json.loads(line)
        out.append(DenyRule(no + 1, told.get("pattern", ""), told.get("matchType") == "regex", bool(told.get("ignoreCase", True))))
    return out


def source_counts(nodes: DataFrame, sources: list[str], projects: list[str]) -> DataFrame:
    """(source, project_id, prior, rows) of what pruning the sources would remove; ``projects`` begins with the present one."""
    kept = nodes.where(F.col("source").isin(sources) & F.col("project_id").isin(projects))
    return kept.groupBy("source", "project_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("prior", F.col("project_id") != projects[0])


def without_sources(nodes: DataFrame, sources: list[str], projects: list[str], yes: bool = False) -> DataFrame:
    """``nodes`` without the rows of the sources in the projects, but only if ``yes``: otherwise all of them."""
    if not yes:
        return nodes
    return nodes.where(~F.coalesce(F.col("source").isin(sources) & F.col("project_id").isin(projects), F.lit(False)))


# --- registries of projects: small lists in JSON -----------------------------------------------------

REGISTRY = "projects array<struct<projectId:string,root:string,dbPath:string,lastSeenAt:bigint>>"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(project_id, root, db_path, last_seen_at), last seen first; a missing or corrupt file is an empty registry."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        told = spark.createDataFrame([], REGISTRY)
    else:
        told = spark.read.schema(REGISTRY).option("mode", "PERMISSIVE").json(path, multiLine=True)
    each = told.where("projects is not null").select(F.inline("projects")).where("projectId is not null")
    return each.select(F.col("projectId").alias("project_id"), "root", F.col("dbPath").alias("db_path"), F.col("lastSeenAt").alias("last_seen_at")).orderBy(F.desc("last_seen_at"), "project_id")


def recorded(registry: DataFrame, entry: DataFrame) -> DataFrame:
    """The registry with the entries added, each replacing the one of its project."""
    return registry.join(entry.select("project_id"), "project_id", "left_anti").unionByName(entry)


def unregistered(registry: DataFrame, gone: DataFrame) -> DataFrame:
    return registry.join(gone.select("project_id"), "project_id", "left_anti")


def write_registry(registry: DataFrame, path: str) -> None:
    """Writes a registry, one entry per project, beside its place and then moves it there: a crash leaves the old one or the new one."""
    spark = registry.sparkSession
    rows = [{"projectId": r.project_id, "root": r.root, "dbPath": r.db_path, "lastSeenAt": r.last_seen_at} for r in registry.collect()]
    new, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.{uuid.uuid4().hex}.tmp", path))
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(new)
    out.write(bytearray(json.dumps({"version": 1, "projects": rows}, indent=2).encode()))
    out.close()
    system.delete(target, False)
    system.rename(new, target)


def live_projects(registry: DataFrame, present: DataFrame) -> DataFrame:
    """The registry with ``live``: whether a listing (db_path) still has its store; missing ones are told, not dropped."""
    there = present.select("db_path").distinct().withColumn("_there", F.lit(True))
    return registry.join(there, "db_path", "left").withColumn("live", F.coalesce("_there", F.lit(False))).drop("_there")


def initialised(spark: SparkSession, folder: str) -> bool:
    """Writes the empty tables of a new store into ``folder``; False, and nothing is written, where one is."""
    from lodeline import schema

    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/nodes")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return False
    for name in schema.TABLES:
        schema.empty(spark, name).write.parquet(f"{folder}/{name}")
    return True


# --- counts and status -------------------------------------------------------------------------------


def counts(nodes: DataFrame, vectors: DataFrame, verdicts: DataFrame, now_ms: int) -> DataFrame:
    """(name, n): rows, sources, rows without vector, stale rows, open verdicts."""
    one = lambda name, df: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    parts = [
        one("nodes", nodes), one("sources", nodes.select("project_id", "source").distinct()), one("pending vectors", pending(nodes, vectors)),
        one("stale", stale(nodes, now_ms)), one("open verdicts", open_verdicts(verdicts, nodes)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def status(nodes: DataFrame, failures: DataFrame, retry: DataFrame, discussion: DataFrame) -> DataFrame:
    """One row: rows in all, kinds as 'kind: n' by number, oldest and newest time as text, and the chains of failures."""
    kinds = nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "kind", "n"))), lambda x: F.concat(x["kind"], F.lit(": "), x["n"].cast("string"))), ", ")
    told = kinds.agg(F.sum("n").alias("total"), listed.alias("kinds"))
    span = nodes.agg(F.min("ts").alias("oldest"), F.max("ts").alias("newest"))
    return told.join(F.broadcast(span)).join(F.broadcast(chain_stats(failures, retry, discussion)))


def stale_listing(nodes: DataFrame, verdicts: DataFrame, now_ms: int, most: int = 50) -> DataFrame:
    """The oldest stale rows with the open verdict on each, the newest if there are several (against_id and reason null where there is none)."""
    top = stale(nodes, now_ms).orderBy("ts_epoch", "node_id").limit(most)
    newest = F.max_by(F.struct("against_id", "reason", "against_title"), F.struct("checked_at", "against_id"))
    open_ = open_verdicts(verdicts, nodes).groupBy(F.col("candidate_id").alias("node_id")).agg(newest.alias("_v"))
    return top.join(open_, "node_id", "left").select("node_id", "kind", "title", "age_days", F.col("_v.against_id").alias("against_id"), F.col("_v.against_title").alias("against_title"), F.col("_v.reason").alias("reason"))


def newest_verdicts(verdicts: DataFrame, nodes: DataFrame, most: int = 50) -> DataFrame:
    return open_verdicts(verdicts, nodes).orderBy(F.desc("checked_at"), "candidate_id", "against_id").limit(most)


def bounded_check(candidates: DataFrame, nearest: DataFrame, verdicts: DataFrame, most: int = 3) -> DataFrame:
    """(candidate_id, against_id): pairs a run may still judge, oldest candidate first (``candidates``: node_id, ts_epoch; ``nearest``: node_id, against_id), without those judged before."""
    pairs = candidates.join(nearest, "node_id").select(F.col("node_id").alias("candidate_id"), "against_id", "ts_epoch")
    left = pairs.join(verdicts.select("candidate_id", "against_id"), ["candidate_id", "against_id"], "left_anti")
    return left.orderBy("ts_epoch", "candidate_id").limit(most).select("candidate_id", "against_id")


def batch_summary(nodes: DataFrame, by: str = "kind") -> DataFrame:
    """(by, rows, oldest, newest, mean_signal, tokens): what a batch of rows is, by kind or another column."""
    tokens = F.sum(approx_tokens(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))))
    return nodes.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.round(F.avg("signal_score"), 6).alias("mean_signal"), tokens.alias("tokens"))


def path_counts(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project_id, paths): distinct paths of the files (node_id, path) of each project's rows."""
    return files.join(nodes.select("node_id", "project_id").distinct(), "node_id").groupBy("project_id").agg(F.countDistinct("path").alias("paths"))


def as_json(rows: DataFrame) -> DataFrame:
    """(json): each row as a line of JSON with every column, null ones too."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def relative_age(at_ms: Column, now_ms: int) -> Column:
    """How long ago in the largest whole unit, as 'just now', '5m ago', '3h ago', '2d ago'."""
    minutes = F.floor((F.lit(now_ms) - at_ms) / 60_000)
    told = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, told(minutes, "m")).when(minutes < 1440, told(F.floor(minutes / 60), "h")).otherwise(told(F.floor(minutes / 1440), "d"))


def without_colours(text: Column) -> Column:
    """Text without the marks that colour it on a terminal."""
    return F.regexp_replace(text, "\u001b\\[[0-9;]*[A-Za-z]", "")


# --- queries -----------------------------------------------------------------------------------------

NOW_MS = 1_767_225_600_000


def _projects(spark, folder) -> list[str]:
    """The ids of the projects table in order: a fixed number of them."""
    return [r[0] for r in table(spark, folder, "projects").select("project_id").orderBy("project_id").collect()]


def _verdicts(spark, folder):
    """Each row that replaces one judged against it, told by the signal of the new one."""
    n = live_nodes(spark, folder)
    late = n.where("kind = 'doc_section'").select(F.col("node_id").alias("candidate_id"), F.col("node_id").alias("against_id"), (F.col("signal_score") > 0.6).alias("contradicts"), F.col("title").alias("reason"), F.col("created_at").alias("checked_at"))
    old = n.where("supersedes is not null").select(F.col("supersedes").alias("candidate_id"), F.col("node_id").alias("against_id"), F.lit(True).alias("contradicts"), F.col("title").alias("reason"), F.col("created_at").alias("checked_at"))
    return late.unionByName(old)


def _vectors(spark, folder):
    """A vector for each row whose signal has an even third digit."""
    n = live_nodes(spark, folder)
    return n.where(F.pmod(F.round(F.col("signal_score") * 1000).cast("int"), F.lit(2)) == 0).select("node_id").distinct()


def q85_cleared(spark, folder):
    p = _projects(spark, folder)[0]
    n = live_nodes(spark, folder)
    cursors = n.select("project_id", "source").distinct()
    c = cleared(n, _vectors(spark, folder), cursors, p)
    one = lambda name, df: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    return one("nodes", c.nodes).unionByName(one("vectors", c.vectors)).unionByName(one("cursors", c.cursors)).unionByName(c.count.select(F.lit("removed").alias("name"), F.col("removed").alias("n")))


def _pairs(spark, folder):
    """Every row beside the next by id (often of another project), beside itself, and beside none."""
    n = live_nodes(spark, folder).select("node_id", "project_id", "kind").distinct()
    first = n.groupBy("project_id", "kind").agg(F.min("node_id").alias("node_id"), F.max("node_id").alias("supersedes")).select("node_id", "supersedes")
    over = n.groupBy("kind").agg(F.min("node_id").alias("node_id"), F.max("node_id").alias("supersedes")).select("node_id", "supersedes")
    none = n.groupBy("project_id").agg(F.max("node_id").alias("node_id")).select("node_id", F.lit("none").alias("supersedes"))
    return first.unionByName(over).unionByName(none)


def q86_judged_pairs(spark, folder):
    return judged_pairs(live_nodes(spark, folder), _pairs(spark, folder)).select("node_id", "supersedes", "refused")


def q86_marked(spark, folder):
    n = live_nodes(spark, folder)
    return with_supersedes(n, _pairs(spark, folder)).where("supersedes is not null").select("node_id", "supersedes")


def q87_forget_audit(spark, folder):
    """Three rules over the first twenty projects, all ids of one repository: what the audit tells."""
    done = forget(live_nodes(spark, folder), RULES, _projects(spark, folder)[:20], 0)
    return done.audit.select("audit_id", "action", "project_id", "affected_count", F.get_json_object("detail", "$.pattern").alias("pattern"))


def q87_forget_stones(spark, folder):
    done = forget(live_nodes(spark, folder), RULES, _projects(spark, folder)[:20], 0)
    return done.tombstones.drop("removed_at", "title_sha256")


def q87_forget_stays(spark, folder):
    done = forget(live_nodes(spark, folder), RULES, _projects(spark, folder)[:20], 0)
    return done.nodes.groupBy("project_id").agg(F.count(F.lit(1)).alias("rows"))


def _import(spark, folder):
    return live_nodes(spark, folder), _rule_rows(spark, RULES[:1], "p", 0), [*RULES, DenyRule(4, "tombstones")], _projects(spark, folder)


def q88_import_rules(spark, folder):
    return import_rules(*_import(spark, folder), 0)[1]


def q88_import_preview(spark, folder):
    return import_preview(*_import(spark, folder))


def q89_exported_rules(spark, folder):
    """The rules that removed rows, as lines of JSON, with how many."""
    done = forget(live_nodes(spark, folder), RULES, _projects(spark, folder), 0)
    return exported_rules(done.rules).join(done.audit.select(F.col("audit_id").alias("rule_id"), "affected_count"), "rule_id")


def q90_source_counts(spark, folder):
    return source_counts(live_nodes(spark, folder), ["shell:pwsh", "shell:bash", "shell:zsh", "docs"], _projects(spark, folder))


def q90_without_sources(spark, folder):
    left = without_sources(live_nodes(spark, folder), ["docs", "session"], _projects(spark, folder)[:30], yes=True)
    return left.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))


def q91_counts(spark, folder):
    return counts(live_nodes(spark, folder), _vectors(spark, folder), _verdicts(spark, folder), NOW_MS)


def q92_stale_listing(spark, folder):
    return stale_listing(live_nodes(spark, folder), _verdicts(spark, folder), NOW_MS).select("node_id", "age_days", "against_id", "reason")


def q92_newest_verdicts(spark, folder):
    return newest_verdicts(_verdicts(spark, folder), live_nodes(spark, folder)).select("candidate_id", "against_id", "checked_at")


def q93_bounded_check(spark, folder):
    """Stale rows, each with the newest row of its project and kind, but those whose candidate has a verdict against it."""
    n = live_nodes(spark, folder)
    s = stale(n, NOW_MS).select("node_id", "ts_epoch", "project_id", "kind")
    newest = n.groupBy("project_id", "kind").agg(F.max_by("node_id", F.struct("ts_epoch", "node_id")).alias("against_id"))
    near = s.join(newest, ["project_id", "kind"]).where("node_id <> against_id").select("node_id", "against_id")
    judged = near.where("node_id < '8'").select(F.col("node_id").alias("candidate_id"), "against_id")
    return bounded_check(s.select("node_id", "ts_epoch"), near, judged, 3)


def q94_status(spark, folder):
    from lodeline.operators.correlate import _failures, q21_retry_links, q23_discussion_links

    return status(live_nodes(spark, folder), _failures(spark, folder), q21_retry_links(spark, folder), q23_discussion_links(spark, folder)).select("total", "kinds", "oldest", "newest", "failures", "by_retry", "by_either")


def q95_registry(spark, folder):
    """Projects as a registry, of which those with documents are live, the half seen last recorded anew, one forgotten."""
    p = table(spark, folder, "projects").select("project_id", "root", F.concat("root", F.lit("/store")).alias("db_path"), F.col("last_synced_at").alias("last_seen_at"))
    ids = _projects(spark, folder)
    entry = p.where(F.col("project_id").isin(ids[:30])).withColumn("last_seen_at", F.lit(NOW_MS).cast("bigint"))
    gone = p.where(F.col("project_id") == ids[-1])
    present = table(spark, folder, "documents").select("project_id").distinct().join(p, "project_id").select("db_path")
    return live_projects(unregistered(recorded(p, entry), gone), present).select("project_id", "last_seen_at", "live")


def q96_project_identity(spark, folder):
    """Projects whose stored id isn't the one their address gives: the ids of one repository."""
    p = table(spark, folder, "projects").withColumn("derived_id", project_id(F.col("root"), F.col("origin_url")))
    return p.groupBy("derived_id").agg(F.count(F.lit(1)).alias("projects"), F.min("project_id").alias("first_id"))


def q97_ages(spark, folder):
    n = live_nodes(spark, folder).where("ts_epoch between 946684800000 and 1767225600000")
    return n.select("node_id", relative_age(F.col("ts_epoch"), NOW_MS).alias("age"), without_colours(F.concat(F.lit("\u001b[31m"), "kind", F.lit("\u001b[0m"))).alias("kind"))


def q98_pruned_keeping_paths(spark, folder):
    """Patches of low signal that a scan no longer gives, but those of paths that couldn't be read: all of one kind of file."""
    n = live_nodes(spark, folder).where("source = 'git-diff'")
    files = n.select("node_id", F.regexp_extract("body", r"^([^\n]*)", 1).alias("path"))
    unread = files.where(F.col("path").endswith(".ts")).select("path").distinct()
    return pruned(n, "git-diff", n.where("signal_score >= 0.45"), unread, files).select("node_id")


def q98_batch_summary(spark, folder):
    return batch_summary(live_nodes(spark, folder))


def q98_node_paths(spark, folder):
    """Paths that the first lines of patches' bodies name, by project."""
    n = live_nodes(spark, folder)
    return path_counts(n.where("kind = 'code_diff'").select("node_id", F.regexp_extract("body", r"^([^\n]*)", 1).alias("path")), n)


def q98_hook_keys(spark, folder):
    """Entries of the hook, made anew from what they say: all have the key they were stored with."""
    s = table(spark, folder, "shell_entries").where("shell = 'pwsh-hook' and ts is not null and command is not null")
    made = hook_to_shell(s.select("ts", "cwd", F.col("exit_code").alias("exitCode"), F.col("duration_ms").alias("durationMs"), "command"))
    return made.join(s.select("natural_key").distinct(), "natural_key", "left_semi").groupBy("shell", "exit_code").agg(F.count(F.lit(1)).alias("entries"))


def q98_bands(spark, folder):
    """Rows by the band of their signal, each judged as its source is."""
    n = live_nodes(spark, folder)
    return n.groupBy("source", signals.source_band(F.col("signal_score"), F.col("source")).alias("band")).agg(F.count(F.lit(1)).alias("rows"))


QUERIES = {k: f for k, f in list(globals().items()) if re.match(r"q\d+_", k)}


def _sql() -> dict[str, str]:
    from lodeline.operators import correlate
    from lodeline.operators.store import SQL as store_sql
    from lodeline.operators.store import _deny, _deny_id

    n = f"n as ({LIVE_SQL})"
    ids = "ids as (select project_id, row_number() over (order by project_id) as no from projects)"
    scope = f"{n}, {ids}, s as (select *, cast({_deny_id} as bigint) as rule_id from n where project_id in (select project_id from ids where no <= 20)), out_ as (select *, case when project_id in (select project_id from ids where no <= 20) then cast({_deny_id} as bigint) end as rule_id from n)"
    vectors = "v as (select distinct node_id from n where cast(round(signal_score * 1000) as int) % 2 = 0)"
    verdicts = "w as (select node_id as candidate_id, node_id as against_id, signal_score > 0.6 as contradicts, title as reason, created_at as checked_at from n where kind = 'doc_section' union all select supersedes, node_id, true, title, created_at from n where supersedes is not null)"
    open_ = "o as (select w.*, y.title as against_title from w join n x on candidate_id = x.node_id join n y on against_id = y.node_id where contradicts and candidate_id not in (select supersedes from n where supersedes is not null))"
    stale_ = f"""st as (select *, cast(round(({NOW_MS} - ts_epoch) / 86400000.0) as bigint) as age_days from n where coalesce(provenance, 'inferred') <> 'observed' and ts_epoch < {NOW_MS} - 45 * 86400000::bigint
 and (project_id, node_id) not in (select (project_id, supersedes) from n where supersedes is not null))"""
    pairs = """u as (select distinct node_id, project_id, kind from n), pairs as (select min(node_id) as node_id, max(node_id) as supersedes from u group by project_id, kind union all select min(node_id), max(node_id) from u group by kind
 union all select max(node_id), 'none' from u group by project_id), j as (select p.*, case when p.node_id = p.supersedes then 'itself' when b.node_id is null then 'no old row' when a.node_id is null then 'no new row' when a.project_id is distinct from b.project_id then 'other project' end as refused
 from pairs p left join (select distinct node_id, project_id from n) a on p.node_id = a.node_id left join (select distinct node_id, project_id from n) b on p.supersedes = b.node_id)"""
    rules = "r as (select * from (values (1::bigint, 'tombstones', false, true), (2, 'lock\\w* lost', true, true), (3, 'Exit-Code', false, false)) r(rule_id, pattern, regex, ignore_case))"
    each = "(select count(*) filter (contains(lower({d}), 'tombstones')) as c1, count(*) filter (regexp_matches({d}, '(?i)lock\\w* lost')) as c2, count(*) filter (contains({d}, 'Exit-Code')) as c3 from n where project_id in (select project_id from projects))".replace("{d}", _deny)
    bands = "case when source like 'git-diff%' then {} when source like 'git%' then {} when source like 'shell%' then {} when source like 'conversation%' or source like 'session%' then {} else {} end"
    high, medium = (bands.format(*(signals.BANDS[b][i] for b in ("diff", "git", "shell", "conversation", "docs"))) for i in (0, 1))
    return {
        "q85_cleared": f"""with {n}, {ids}, p as (select project_id from ids where no = 1), {vectors} select 'nodes' as name, count(*) as n from n where project_id is distinct from (select project_id from p)
 union all select 'vectors', count(*) from v where node_id not in (select node_id from n where project_id = (select project_id from p)) union all select 'cursors', count(*) from (select distinct project_id, source from n where project_id is distinct from (select project_id from p))
 union all select 'removed', count(*) from n where project_id = (select project_id from p)""",
        "q86_judged_pairs": f"with {n}, {pairs} select node_id, supersedes, refused from j",
        "q86_marked": f"with {n}, {pairs}, f as (select node_id, max(supersedes) as s from j where refused is null group by node_id) select n.node_id, coalesce(s, n.supersedes) as supersedes from n left join f using (node_id) where coalesce(s, n.supersedes) is not null",
        "q87_forget_audit": f"with {scope}, {rules} select rule_id as audit_id, 'forget' as action, (select project_id from ids where no = 1) as project_id, (select count(*) from s where s.rule_id = r.rule_id) as affected_count, pattern from r",
        "q87_forget_stones": f"with {scope} select node_id, project_id, kind, source, ts, signal_score as signal, sha256(coalesce(body, '')) as body_sha256, length(coalesce(body, '')) as body_length, rule_id from s where rule_id is not null",
        "q87_forget_stays": f"with {scope} select project_id, count(*) as rows from out_ where rule_id is null group by project_id",
        "q88_import_rules": f"with {n} select 2 as imported, 2 as skipped, count(*) as removed_nodes from n where project_id in (select project_id from projects) and (regexp_matches({_deny}, '(?i)lock\\w* lost') or contains({_deny}, 'Exit-Code'))",
        "q88_import_preview": f"with {n}, c as {each} select 1::bigint as rule_id, 'tombstones' as pattern, true as already_present, 0::bigint as would_remove union all select 2, 'lock\\w* lost', false, c2 from c union all select 3, 'Exit-Code', false, c3 from c union all select 4, 'tombstones', true, 0",
        "q89_exported_rules": f"""with {n}, {rules}, s as (select cast({_deny_id} as bigint) as rule_id from n where project_id in (select project_id from projects))
 select rule_id, '{{"matchType":"' || case when regex then 'regex' else 'literal' end || '","pattern":"' || replace(pattern, '\\', '\\\\') || '","ignoreCase":' || ignore_case || '}}' as json, (select count(*) from s where s.rule_id = r.rule_id) as affected_count from r""",
        "q90_source_counts": f"with {n}, {ids} select source, project_id, count(*) as rows, project_id <> (select project_id from ids where no = 1) as prior from n where source in ('shell:pwsh', 'shell:bash', 'shell:zsh', 'docs') and project_id in (select project_id from ids) group by source, project_id",
        "q90_without_sources": f"with {n}, {ids} select source, count(*) as rows from n where not coalesce(source in ('docs', 'session') and project_id in (select project_id from ids where no <= 30), false) group by source",
        "q91_counts": f"""with {n}, {vectors}, {verdicts}, {open_}, {stale_} select 'nodes' as name, count(*) as n from n union all select 'sources', count(*) from (select distinct project_id, source from n) union all select 'pending vectors', count(*) from n where node_id not in (select node_id from v)
 union all select 'stale', count(*) from st union all select 'open verdicts', count(*) from o""",
        "q92_stale_listing": f"""with {n}, {verdicts}, {open_}, {stale_}, t as (select * from st order by ts_epoch, node_id limit 50), b as (select candidate_id, arg_max({{'a': against_id, 'r': reason}}, (checked_at, against_id)) as v from o group by candidate_id)
 select node_id, age_days, v.a as against_id, v.r as reason from t left join b on node_id = candidate_id""",
        "q92_newest_verdicts": f"with {n}, {verdicts}, {open_} select candidate_id, against_id, checked_at from o order by checked_at desc, candidate_id, against_id limit 50",
        "q93_bounded_check": f"""with {n}, {stale_}, m as (select project_id, kind, arg_max(node_id, (ts_epoch, node_id)) as against_id from n group by project_id, kind)
 select s.node_id as candidate_id, against_id from st s join m on s.project_id = m.project_id and s.kind = m.kind where s.node_id <> against_id and s.node_id >= '8' order by s.ts_epoch, s.node_id limit 3""",
        "q94_status": f"""with {correlate._RUNS}, {correlate._RETRY}, {correlate._DISC}, {n}, k as (select kind, count(*) as c from n group by kind) select cast((select sum(c) from k) as bigint) as total, (select string_agg(kind || ': ' || c, ', ' order by -c, kind) from k) as kinds,
 (select min(ts) from n) as oldest, (select max(ts) from n) as newest, count(*) as failures, count(*) filter (entry_id in (select failure_id from links)) as by_retry, count(*) filter (entry_id in (select failure_id from links) or entry_id in (select failure_id from disc)) as by_either from runs where failed""",
        "q95_registry": f"""with {ids} select p.project_id, case when no <= 30 then {NOW_MS}::bigint else last_synced_at end as last_seen_at, root || '/store' in (select root || '/store' from projects where project_id in (select project_id from documents where project_id is not null)) as live
 from projects p join ids using (project_id) where no < (select max(no) from ids)""",
        "q96_project_identity": f"with u as ({store_sql['q58_urls']}) select derived_id, count(*) as projects, min(project_id) as first_id from u group by derived_id",
        "q97_ages": f"""with {n}, m as (select node_id, kind, ({NOW_MS} - ts_epoch) // 60000 as m from n where ts_epoch between 946684800000 and 1767225600000)
 select node_id, kind, case when m < 1 then 'just now' when m < 60 then m || 'm ago' when m < 1440 then (m // 60) || 'h ago' else (m // 1440) || 'd ago' end as age from m""",
        "q98_pruned_keeping_paths": f"with {n}, f as (select *, regexp_extract(body, '^([^\\n]*)', 1) as path from n where source = 'git-diff') select node_id from f where signal_score < 0.45 and not ends_with(path, '.ts')",
        "q98_batch_summary": f"with {n} select kind, count(*) as rows, min(ts) as oldest, max(ts) as newest, round(avg(signal_score), 6) as mean_signal, cast(sum(ceil(length(coalesce(title, '') || chr(10) || coalesce(body, '')) / 4)) as bigint) as tokens from n group by kind",
        "q98_node_paths": f"with {n} select project_id, count(distinct regexp_extract(body, '^([^\\n]*)', 1)) as paths from n where kind = 'code_diff' group by project_id",
        "q98_hook_keys": "select shell, exit_code, count(*) as entries from shell_entries where shell = 'pwsh-hook' and ts is not null and command is not null group by shell, exit_code",
        "q98_bands": f"with {n} select source, case when signal_score >= {high} then 'high' when signal_score >= {medium} then 'medium' else 'low' end as band, count(*) as rows from n group by all",
    }


SQL = _sql()
