"""The store's mutations as snapshots: each gives the new rows and what was done, as DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions.text import approx_tokens, node_id, normalised_url, project_id, truncated
from lodeline.operators.lexical import LIVE_SQL, live_nodes
from lodeline.tables import table

TIE = 1  # the last of rows with one key wins


@dataclass(frozen=True)
class DenyRule:
    """Rows whose title, body or meta contain ``pattern`` (a literal or a regular expression) are kept out, of one project or, if it names none, of all."""

    rule_id: int
    pattern: str
    regex: bool = False
    ignore_case: bool = True
    project: str | None = None

    def __post_init__(self):
        if not self.pattern:
            raise ValueError("an empty pattern denies everything")
        if self.regex and re.search(self.pattern, "") is not None:
            raise ValueError("the pattern matches the empty text")


def denied_by(rules: list[DenyRule], title: str = "title", body: str = "body", meta: str = "meta", project: str = "project_id") -> Column:
    """The id of the first rule, in order, that matches a row; null if none. A rule list is small and becomes part of the expression."""
    text = F.concat_ws("\n", title, body, meta)
    out = F.lit(None).cast("bigint")
    for rule in reversed(rules):
        if rule.regex:
            hit = text.rlike(("(?i)" if rule.ignore_case else "") + rule.pattern)
        else:
            hit = F.lower(text).contains(rule.pattern.lower()) if rule.ignore_case else text.contains(rule.pattern)
        if rule.project is not None:
            hit = hit & (F.col(project) == rule.project)
        out = F.when(hit, F.lit(rule.rule_id).cast("bigint")).otherwise(out)
    return out


def last_of(rows: DataFrame, *keys: str, order: str) -> DataFrame:
    """One row per key, the last by ``order``, by aggregation rather than a sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def upsert(stored: DataFrame, incoming: DataFrame, rules: list[DenyRule] | None = None, key: str = "node_id", order: str = "created_at") -> DataFrame:
    """The union of ``stored`` and ``incoming`` with ``state``: inserted, updated, unchanged, kept, denied.

    Incoming rows that equal the stored one in body, signal and title change nothing; rewritten rows
    keep the stored created_at, kind, project and supersedes. Of several incoming rows of a key the
    last by ``order`` counts. Denied rows are returned with their state and not stored. Null keys
    are denied, as they can't be found again.
    """
    fresh = last_of(incoming.withColumn("_in", F.lit(True)), key, order=order)
    old = stored.select(F.struct(*stored.columns).alias("_o"), F.col(key).alias("_key"))
    both = fresh.join(old, F.col(key) == F.col("_key"), "full_outer")
    same = F.lit(True)
    for c in ("body", "signal_score", "title"):
        same = same & F.col(c).eqNullSafe(F.col(f"_o.{c}"))
    state = (
        F.when(F.col("_in").isNull(), "kept")
        .when(denied_by(rules or []).isNotNull() | F.col(key).isNull(), "denied")
        .when(F.col("_key").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    )
    both = both.withColumn("state", state)
    sticky = {"created_at", "kind", "project_id", "supersedes"}
    columns = []
    for c in stored.columns:
        keep = F.col("state").isin("kept", "unchanged") | ((F.col("state") == "updated") & F.lit(c in sticky))
        columns.append(F.when(keep, F.col(f"_o.{c}")).otherwise(F.col(c)).alias(c))
    return both.select(*columns, "state")


def states(result: DataFrame) -> DataFrame:
    return result.groupBy("state").agg(F.count(F.lit(1)).alias("rows"))


def replaced_files(stored: DataFrame, incoming: DataFrame, rewritten: DataFrame) -> DataFrame:
    """File lists of rewritten nodes replaced; of a path named twice the last position stands."""
    fresh = last_of(incoming.join(rewritten.select("node_id"), "node_id", "left_semi"), "node_id", "path", order="position").drop("position")
    return stored.join(rewritten.select("node_id"), "node_id", "left_anti").unionByName(fresh)


def pruned(nodes: DataFrame, source: str, keep_ids: DataFrame, keep_paths: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """Rows of ``source`` that are neither in ``keep_ids`` nor touch a kept path: what a complete scan no longer found."""
    gone = nodes.where(F.col("source") == source).join(keep_ids.select("node_id"), "node_id", "left_anti")
    if keep_paths is not None and files is not None:
        gone = gone.join(files.join(keep_paths.select("path"), "path", "left_semi").select("node_id"), "node_id", "left_anti")
    return gone


def inserted_or_ignored(stored: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """``stored`` and the incoming rows whose key isn't there, each key once."""
    fresh = incoming.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")
    return stored.unionByName(fresh)


def put(stored: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """Insert or replace by key."""
    return stored.join(incoming.select(*keys), list(keys), "left_anti").unionByName(incoming)


def forgotten(nodes: DataFrame, rule: DenyRule, removed_at: int) -> tuple[DataFrame, DataFrame]:
    """What stays, and the tombstones of what a rule removes: digests and lengths, no text."""
    hit = denied_by([rule])
    stays = nodes.where(hit.isNull())
    stones = nodes.where(hit.isNotNull()).select(
        "node_id", "project_id", "kind", "source", F.sha2(F.coalesce("body", F.lit("")), 256).alias("body_sha256"),
        F.sha2(F.coalesce("title", F.lit("")), 256).alias("title_sha256"), F.length(F.coalesce("body", F.lit(""))).cast("bigint").alias("body_length"),
        F.lit(rule.rule_id).cast("bigint").alias("rule_id"), F.lit(removed_at).cast("bigint").alias("removed_at"),
    )
    return stays, stones


def rekeyed(nodes: DataFrame, old: str, new: str, natural_key: str = "natural_key") -> DataFrame:
    """(old_id, node_id, outcome) of the rows of project ``old`` that move to ``new``: moved, or dropped where the new id exists."""
    mine = nodes.where(F.col("project_id") == old).select(F.col("node_id").alias("old_id"), node_id(F.lit(new), F.col("kind"), F.col(natural_key)).alias("node_id"))
    there = nodes.where(F.col("project_id") == new).select("node_id", F.lit(True).alias("_there"))
    return mine.join(there, "node_id", "left").select("old_id", "node_id", F.when(F.col("_there"), "dropped").otherwise("moved").alias("outcome"))


def edge_snapshot(edges: DataFrame, fresh: DataFrame) -> DataFrame:
    """Import edges with those of every freshly scanned project replaced, each once."""
    return edges.join(fresh.select("project_id").distinct(), "project_id", "left_anti").unionByName(fresh.dropDuplicates(["project_id", "from_path", "to_path", "kind"]))


def labels(projects: DataFrame) -> DataFrame:
    """(project_id, label): the last part of the root, with the first six digits of the id where several share it."""
    name = F.regexp_extract(F.regexp_replace(F.regexp_replace("root", r"\\", "/"), r"/+\z", ""), r"([^/]*)\z", 1)
    named = projects.select("project_id", name.alias("_name"))
    shared = F.count(F.lit(1)).over(Window.partitionBy("_name")) > 1
    return named.select("project_id", F.when(shared, F.concat_ws("#", "_name", F.substring("project_id", 1, 6))).otherwise(F.col("_name")).alias("label"))


# --- queries ---------------------------------------------------------------------------------------

RULES = [DenyRule(1, "tombstones"), DenyRule(2, r"lock\w* lost", regex=True), DenyRule(3, "Exit-Code", ignore_case=False)]


def q01_kind_counts(spark, folder):
    return table(spark, folder, "nodes").groupBy("kind").agg(F.count(F.lit(1)).alias("nodes"))


def q02_text_range(spark, folder):
    """Oldest and newest as text, as they are written, not as instants."""
    return table(spark, folder, "nodes").groupBy("source").agg(F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def q03_distinct_paths(spark, folder):
    d = table(spark, folder, "file_diffs")
    return d.groupBy("project_id").agg(F.countDistinct("file_path").alias("paths"), F.countDistinct("sha").alias("commits"), F.count(F.lit(1)).alias("patches"))


def q04_node_ids(spark, folder):
    d = table(spark, folder, "file_diffs")
    key = F.concat_ws(":", "sha", "file_path")
    return d.select("diff_id", node_id(F.col("project_id"), F.lit("code_diff"), key).alias("node_id"))


def q31_denied(spark, folder):
    return live_nodes(spark, folder).select("node_id", denied_by(RULES).alias("rule_id")).where("rule_id is not null")


def q32_forget_preview(spark, folder):
    return live_nodes(spark, folder).where(denied_by(RULES[:1]).isNotNull()).groupBy("project_id", "source").agg(F.count(F.lit(1)).alias("rows"))


def q33_tombstones(spark, folder):
    return forgotten(live_nodes(spark, folder), RULES[0], 0)[1].drop("removed_at")


def q34_upsert_states(spark, folder):
    """Nodes of even signal digits changed, commits of one project new, some denied; the states of all."""
    stored, incoming = _upsert_inputs(spark, folder)
    return states(upsert(stored, incoming, RULES))


def _upsert_inputs(spark, folder):
    nodes = live_nodes(spark, folder)
    stored = nodes.where("kind <> 'git_commit' or signal_score >= 0.5")
    incoming = nodes.where("kind in ('git_commit', 'code_diff')").withColumn("title", F.when(F.col("signal_score") > 0.7, F.concat(F.col("title"), F.lit("!"))).otherwise(F.col("title")))
    return stored, incoming


def q34_upserted(spark, folder):
    stored, incoming = _upsert_inputs(spark, folder)
    return upsert(stored, incoming, RULES).where("state in ('inserted', 'updated')").select("node_id", "state", "title")


def q35_pruned(spark, folder):
    nodes = live_nodes(spark, folder)
    return pruned(nodes, "docs", nodes.where("signal_score >= 0.45")).select("node_id")


def q36_rekeyed(spark, folder):
    """Turns of a session key moved from their reader's project to another, which has some of them."""
    t = table(spark, folder, "conversation_turns").select("source", "natural_key", F.lit("conversation_turn").alias("kind")).distinct()
    p = t.withColumn("project_id", F.when(F.col("source") == "pairbot", "old").otherwise("new"))
    twice = p.where("project_id = 'old' and natural_key < 'pairbot:8'").withColumn("project_id", F.lit("new"))
    nodes = p.unionByName(twice).withColumn("node_id", node_id(F.col("project_id"), F.col("kind"), F.col("natural_key")))
    return rekeyed(nodes, "old", "new")


def q37_links(spark, folder):
    links = live_nodes(spark, folder).where("supersedes is not null").select(F.col("supersedes").alias("from_id"), F.col("node_id").alias("to_id"), F.lit("replaced_by").alias("relation"))
    return inserted_or_ignored(links.limit(0), links.unionByName(links), "from_id", "to_id", "relation")


def q57_labels(spark, folder):
    return labels(table(spark, folder, "projects"))


def q58_urls(spark, folder):
    p = table(spark, folder, "projects")
    return p.select("project_id", normalised_url(F.col("origin_url")).alias("url"), project_id(F.col("root"), F.col("origin_url")).alias("derived_id"))


def q62_recent(spark, folder):
    return live_nodes(spark, folder).where("ts_epoch is not null").orderBy(F.desc("ts_epoch"), "node_id").limit(20).select("node_id", "kind", "ts", "title")


def q63_live(spark, folder):
    """Projects with documents, and those that are missing."""
    p, d = table(spark, folder, "projects"), table(spark, folder, "documents").select("project_id").distinct().withColumn("_d", F.lit(True))
    return p.join(d, "project_id", "left").select("project_id", F.coalesce("_d", F.lit(False)).alias("live"))


def q67_replay(spark, folder):
    """The hook log replayed: one row per content, however often it was written."""
    h = table(spark, folder, "hook_log").where("ts is not null and command is not null")
    key = F.substring(F.sha2(F.concat_ws("\0", "ts", F.coalesce("cwd", F.lit("")), "command"), 256), 1, 24)
    return h.groupBy(key.alias("event_key")).agg(F.min("entry_id").alias("entry_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


def q68_null_safe_anti(spark, folder):
    """Commits that nothing supersedes; a null in the list must not hide them all."""
    n = live_nodes(spark, folder)
    return n.where("kind = 'git_commit'").join(n.select(F.col("supersedes").alias("node_id")), "node_id", "left_anti").select("node_id")


def q69_ingest_totals(spark, folder):
    n = table(spark, folder, "nodes")
    return n.groupBy("source").agg(F.count(F.lit(1)).alias("seen"), F.countDistinct("node_id").alias("stored")).withColumn("repeated", F.col("seen") - F.col("stored"))


def q70_truncate(spark, folder):
    d = table(spark, folder, "documents")
    return d.select("doc_id", truncated(F.col("text"), 80).alias("short"), approx_tokens(F.col("text")).alias("tokens"))


QUERIES = {k: f for k, f in list(globals().items()) if re.match(r"q\d+_", k)}
_deny = "coalesce(title || chr(10), '') || coalesce(body || chr(10), '') || coalesce(meta, '')"
_den1 = f"contains(lower({_deny}), 'tombstones')"
_deny_id = f"case when {_den1} then 1 when regexp_matches({_deny}, '(?i)lock\\w* lost') then 2 when contains({_deny}, 'Exit-Code') then 3 end"
_ups = f"""with n as ({LIVE_SQL}), s as (select * from n where kind <> 'git_commit' or signal_score >= 0.5),
i as (select * replace (case when signal_score > 0.7 then title || '!' else title end as title) from n where kind in ('git_commit', 'code_diff')),
st as (select coalesce(i.node_id, s.node_id) as node_id, i.title, case when i.node_id is null then 'kept' when (select 1 where ({_deny_id.replace('title', 'i.title').replace('body', 'i.body').replace('meta', 'i.meta')}) is not null) = 1 then 'denied' when s.node_id is null then 'inserted'
 when i.body is not distinct from s.body and i.signal_score is not distinct from s.signal_score and i.title is not distinct from s.title then 'unchanged' else 'updated' end as state from i full join s on i.node_id = s.node_id)"""
_id = "substr(sha256({} || chr(0) || {} || chr(0) || {}), 1, 24)"
_url = r"case when regexp_matches(trim(origin_url), '^(?:[^@/]+@)?([^/:]+):(.+)$') and not contains(origin_url, '://') then regexp_replace(trim(origin_url), '^(?:[^@/]+@)?([^/:]+):(.+)$', '\1/\2') else regexp_replace(regexp_replace(trim(origin_url), '^[a-z+]+://', '', 'i'), '^[^@/]+@', '') end"
_url = f"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_url}, '/+$', ''), '\\.git$', '', 'i'), '/+$', ''), '/{{2,}}', '/', 'g'))"
SQL = {
    "q01_kind_counts": "select kind, count(*) as nodes from nodes group by kind",
    "q02_text_range": "select source, min(ts) as oldest, max(ts) as newest from nodes group by source",
    "q03_distinct_paths": "select project_id, count(distinct file_path) as paths, count(distinct sha) as commits, count(*) as patches from file_diffs group by project_id",
    "q04_node_ids": f"select diff_id, {_id.format('project_id', chr(39) + 'code_diff' + chr(39), chr(40) + 'sha || ' + chr(39) + ':' + chr(39) + ' || file_path' + chr(41))} as node_id from file_diffs",
    "q31_denied": f"with n as ({LIVE_SQL}) select * from (select node_id, cast({_deny_id} as bigint) as rule_id from n) where rule_id is not null",
    "q32_forget_preview": f"with n as ({LIVE_SQL}) select project_id, source, count(*) as rows from n where {_den1} group by all",
    "q33_tombstones": f"with n as ({LIVE_SQL}) select node_id, project_id, kind, source, sha256(coalesce(body, '')) as body_sha256, sha256(coalesce(title, '')) as title_sha256, length(coalesce(body, '')) as body_length, 1::bigint as rule_id from n where {_den1}",
    "q34_upsert_states": _ups + " select state, count(*) as rows from st group by state",
    "q34_upserted": _ups + " select node_id, state, title from st where state in ('inserted', 'updated')",
    "q35_pruned": f"with n as ({LIVE_SQL}) select node_id from n where source = 'docs' and signal_score < 0.45",
    "q36_rekeyed": f"""with t as (select distinct source, natural_key from conversation_turns), p as (select natural_key, case when source = 'pairbot' then 'old' else 'new' end as project from t),
a as (select * from p union all select natural_key, 'new' from p where project = 'old' and natural_key < 'pairbot:8'), n as (select project, {_id.format('project', "'conversation_turn'", 'natural_key')} as id, {_id.format("'new'", "'conversation_turn'", 'natural_key')} as new_id from a)
select id as old_id, new_id as node_id, case when new_id in (select id from n where project = 'new') then 'dropped' else 'moved' end as outcome from n where project = 'old'""",
    "q37_links": "select distinct supersedes as from_id, node_id as to_id, 'replaced_by' as relation from nodes where supersedes is not null",
    "q57_labels": r"with n as (select project_id, regexp_extract(regexp_replace(replace(root, '\', '/'), '/+$', ''), '([^/]*)$', 1) as name from projects) select project_id, case when count(*) over (partition by name) > 1 then name || '#' || substr(project_id, 1, 6) else name end as label from n",
    "q58_urls": f"select project_id, {_url} as url, substr(sha256(case when coalesce(origin_url, '') <> '' then 'remote:' || {_url} else 'path:' || lower(replace(root, '\\', '/')) end), 1, 16) as derived_id from projects",
    "q62_recent": f"with n as ({LIVE_SQL}) select node_id, kind, ts, title from n where ts_epoch is not null order by ts_epoch desc, node_id limit 20",
    "q63_live": "select project_id, project_id in (select project_id from documents where project_id is not null) as live from projects",
    "q67_replay": "select substr(sha256(ts || chr(0) || coalesce(cwd, '') || chr(0) || command), 1, 24) as event_key, min(entry_id) as entry_id, count(*) as copies from hook_log where ts is not null and command is not null group by 1 having count(*) > 1",
    "q68_null_safe_anti": f"with n as ({LIVE_SQL}) select node_id from n where kind = 'git_commit' and node_id not in (select supersedes from n where supersedes is not null)",
    "q69_ingest_totals": "select source, count(*) as seen, count(distinct node_id) as stored, count(*) - count(distinct node_id) as repeated from nodes group by source",
    "q70_truncate": r"select doc_id, case when length(text) > 80 then regexp_replace(substr(text, 1, 79), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '') || '…' else text end as short, cast(ceil(length(text) / 4) as bigint) as tokens from documents",
}
