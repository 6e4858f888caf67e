"""The whole query: words and vectors, fused, ranked by trust and age, followed by resolutions, packed; over one project or all."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions.text import default_provenance
from lodeline.operators.correlate import DAY_MS, retry_links
from lodeline.operators.index import Index, fetched, nodes_index, search_index
from lodeline.operators.lexical import LIVE_SQL, search_sql
from lodeline.operators.retrieval import NOW_MS, _prov, packed, placed, ranked, reciprocal_ranks, summary, with_resolutions
from lodeline.operators.vectors import _query_vector, distance, nearest
from lodeline.tables import cut, table


def _rows(nodes: DataFrame, ids: list) -> DataFrame:
    """The hits as the ranking reads them."""
    return fetched(nodes, ids).select(
        "node_id", "kind", "project_id", "ts", F.when(F.col("ts_epoch") > 0, F.col("ts_epoch")).alias("ts_ms"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"),
        F.col("signal_score").alias("signal"), F.coalesce("provenance", default_provenance(F.col("kind"))).alias("provenance"),
    ).dropDuplicates(["node_id"])


def _finished(nodes: DataFrame, valued: DataFrame, links: DataFrame, budget: int, now_ms: int, summarise: Callable[[DataFrame], Column]) -> DataFrame:
    """From (node_id, value) of a bounded list of hits to the packed rows."""
    values = {r.node_id: r.value for r in valued.collect()}
    spark = nodes.sparkSession
    told = spark.createDataFrame(list(values.items()), "node_id string, value double")
    old = nodes.where(F.col("supersedes").isin(list(values))).select("supersedes") if values else nodes.select("supersedes").limit(0)
    best = ranked(_rows(nodes, list(values)).join(F.broadcast(told), "node_id"), "value", now_ms, old)
    best = cut(placed(best, F.desc("score"), F.desc("value"), F.col("node_id")).withColumnRenamed("place", "position"))
    # Only failed commands pull what resolved them, and only what isn't a hit itself; links of the hits alone are read.
    pulling = best.where("kind = 'shell_command'").select(F.col("node_id").alias("from_id"))
    near = links.join(F.broadcast(pulling), "from_id", "left_semi")
    order = with_resolutions(best.select("node_id", "position"), near, nodes.select("node_id"))
    order = cut(order)
    pulled = [r.node_id for r in order.where("pulled_by is not null").select("node_id").collect()]
    scores = best.select(F.col("node_id").alias("_by"), "score", "relevance")
    shown = best.select("node_id", "kind", "project_id", "ts", "title", "body").unionByName(_rows(nodes, pulled).select("node_id", "kind", "project_id", "ts", "title", "body"))
    listed = order.withColumn("_by", F.coalesce("pulled_by", "node_id")).join(scores, "_by").join(shown, "node_id").drop("_by")
    listed = listed.withColumn("summary", summarise(listed))
    taken = packed(listed, budget)
    return taken.select("node_id", "tokens").join(listed, "node_id").select("node_id", "kind", "project_id", "position", "score", "relevance", "pulled_by", "title", "summary", "tokens")


def _by_query(query: str) -> Callable[[DataFrame], Column]:
    return lambda hits: summary(F.col("kind"), F.col("title"), F.col("body"), query)


def hybrid_query(
    nodes: DataFrame, index: Index, links: DataFrame, query: str, project: str, budget: int, now_ms: int, vectors: DataFrame | None = None,
    query_vector: Column | None = None, candidates: int = 30, summarise: Callable[[DataFrame], Column] | None = None,
) -> DataFrame:
    """The packed rows of one project for ``query``, in order: (node_id, kind, project_id, position, score, relevance, pulled_by, title, summary, tokens).

    The best ``candidates`` by words and, if ``vectors`` (node_id, project_id, embedding) are given, by distance;
    with vectors the two lists are fused by their places, without the scores are rescaled. Rows pulled after
    a failure have its score. Everything behind the two searches is a list of at most twice ``candidates`` and
    what it pulls.
    """
    mine = F.col("project_id") == project
    lexical = search_index(index, query, candidates, where=mine)
    if vectors is None:
        valued = lexical.select("node_id", F.col("rank").alias("value"))
    else:
        near = nearest(vectors, query_vector, candidates, id_column="node_id", where=mine)
        lists = placed(lexical, F.desc("rank"), F.col("node_id")).select("node_id", "place").unionByName(placed(near, F.col("distance"), F.col("node_id")).select("node_id", "place"))
        valued = reciprocal_ranks(lists).select("node_id", F.col("fused").alias("value"))
    return _finished(nodes, valued, links, budget, now_ms, summarise or _by_query(query))


def cross_project_query(
    nodes: DataFrame, index: Index, links: DataFrame, query: str, budget: int, now_ms: int, vectors: DataFrame | None = None, query_vector: Column | None = None,
    candidates: int = 5, summarise: Callable[[DataFrame], Column] | None = None,
) -> DataFrame:
    """As ``hybrid_query``, over all projects: each is a corpus of its own with a list by words and one by distance, always fused by places.

    Scores of two corpora aren't compared, so a project's best hit counts as another's. Hits are at most
    twice ``candidates`` a project.
    """
    lists = search_index(index, query, candidates, by="project_id").select("node_id", "place")
    if vectors is not None:
        told = vectors.withColumn("distance", F.round(distance(F.col("embedding").cast("array<double>"), query_vector), 6)).where("distance is not null")
        near = told.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy("distance", "node_id"))).where(F.col("place") <= candidates)
        lists = lists.unionByName(near.select("node_id", "place"))
    valued = reciprocal_ranks(lists).select("node_id", F.col("fused").alias("value"))
    return _finished(nodes, valued, links, budget, now_ms, summarise or _by_query(query))


# --- queries -----------------------------------------------------------------------------------------

QUERY, BUDGET, VECTORS, WINDOW_DAYS = "packer restart lock", 700, 500, 400


def _node_vectors(spark, folder):
    """A vector for each row, by the digits of its id."""
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("_v"), "embedding")
    n = table(spark, folder, "nodes").select("node_id", "project_id").distinct()
    return n.withColumn("_v", F.pmod(F.conv(F.substring("node_id", 1, 6), 16, 10).cast("bigint"), F.lit(VECTORS))).join(e, "_v").drop("_v")


def _node_links(spark, folder):
    """Failed commands among the rows, each with the first success of the same command in its project."""
    n = table(spark, folder, "nodes").where("kind = 'shell_command' and ts_epoch > 0").select("node_id", "project_id", "ts_epoch", "body", "meta").distinct()
    code = F.get_json_object("meta", "$.exitCode").try_cast("int")
    runs = n.select(
        F.col("node_id").alias("entry_id"), F.col("ts_epoch").alias("at_ms"), F.col("project_id").alias("dir_key"), F.lower(F.regexp_extract("body", r"^\$ ([^\n]*)", 1)).alias("command_key"), (code != 0).alias("failed")
    ).where("failed is not null and command_key <> ''")
    found = retry_links(runs, WINDOW_DAYS * DAY_MS)
    return found.select(F.col("failure_id").alias("from_id"), F.col("success_id").alias("to_id"), F.lit("resolved_by_retry").alias("relation"), F.lit(0).cast("bigint").alias("created_ms"))


def _hottest(spark, folder) -> str:
    n = table(spark, folder, "nodes").where("project_id is not null").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "project_id").first()[0]


def _parts(spark, folder):
    return table(spark, folder, "nodes"), nodes_index(spark, folder), _node_links(spark, folder)


_TITLES = lambda hits: F.col("title")
_TOLD = ["node_id", "position", "score", "pulled_by", "tokens"]


def q19_hybrid_query(spark, folder):
    """One project by words and vectors to packed rows, whose summaries are their titles so that SQL can tell their sizes."""
    return hybrid_query(*_parts(spark, folder), QUERY, _hottest(spark, folder), BUDGET, NOW_MS, _node_vectors(spark, folder), _query_vector(spark, folder, 7), summarise=_TITLES).select(*_TOLD)


def q19_lexical_query(spark, folder):
    return hybrid_query(*_parts(spark, folder), QUERY, _hottest(spark, folder), BUDGET, NOW_MS, summarise=_TITLES).select(*_TOLD)


def q20_cross_query(spark, folder):
    return cross_project_query(*_parts(spark, folder), QUERY, 4 * BUDGET, NOW_MS, _node_vectors(spark, folder), _query_vector(spark, folder, 7), summarise=_TITLES).select("project_id", *_TOLD)


def q19_answer(spark, folder):
    """The same with summaries as they are shown."""
    return hybrid_query(*_parts(spark, folder), QUERY, _hottest(spark, folder), BUDGET, NOW_MS, _node_vectors(spark, folder), _query_vector(spark, folder, 7)).select(*_TOLD, "summary")


QUERIES = {k: f for k, f in list(globals().items()) if re.match(r"q\d+_", k)}

_LINKS = rf"""runs as (select distinct node_id, project_id, ts_epoch, lower(regexp_extract(body, '^\$ ([^\n]*)', 1)) as command, try_cast(json_extract_string(meta, '$.exitCode') as int) as code from nodes where kind = 'shell_command' and ts_epoch > 0),
links as (select f.node_id as from_id, arg_min(s.node_id, (s.ts_epoch, s.node_id)) as to_id from runs f join runs s on f.command = s.command and f.command <> '' and f.project_id is not distinct from s.project_id and s.ts_epoch > f.ts_epoch
 and s.ts_epoch <= f.ts_epoch + {WINDOW_DAYS} * {DAY_MS}::bigint where f.code <> 0 and s.code = 0 group by f.node_id)"""
_VECTORS = f"vec as (select distinct n.node_id, n.project_id, round(list_distance(cast(e.embedding as double[]), (select cast(embedding as double[]) from embeddings where vec_id = 7)), 6) as distance from nodes n join embeddings e on e.vec_id = ('0x' || substr(n.node_id, 1, 6))::bigint % {VECTORS})"


def _pack_sql(budget: int, columns: str) -> str:
    """From ``valued`` (node_id, value) to the packed rows."""
    return f"""live as ({LIVE_SQL}), h as (select l.*, value from valued v join live l on l.node_id = v.node_id),
rel as (select *, case when min(value) over () = max(value) over () then 1.0 else 0.15 + 0.85 * (value - min(value) over ()) / (max(value) over () - min(value) over ()) end as rel0,
  greatest(0.0, ({NOW_MS} - case when ts_epoch > 0 then ts_epoch else {NOW_MS} end) / 86400000.0) as age, case {_prov} when 'observed' then 1.0 when 'authored' then 0.75 when 'recorded' then 0.5 when 'derived' then 0.35 else 1.0 end as ratio from h),
old as (select distinct supersedes as gone from live where supersedes is not null),
sc as (select rel.*, round(rel0 * pow(0.2 + 0.8 * signal_score, ln(sqrt(2)) / ln(5)) * pow(0.3 + 0.7 * pow(2.0, -age / (30 * ratio)), ln(sqrt(2)) / ln(1 / 0.3)) * case when gone is null then 1.0 else 0.5 end, 6) as score from rel left join old on rel.node_id = gone),
pos as (select *, row_number() over (order by score desc, value desc, node_id) as p from sc), {_LINKS},
pull as (select to_id, arg_min(from_id, p) as from_id, min(p) as p, arg_min(score, p) as score from links join pos on from_id = node_id where kind = 'shell_command' and to_id not in (select node_id from pos) group by to_id),
al as (select node_id, p, 0 as sub, null as pulled_by, score from pos union all select to_id, p, 1, from_id, score from pull),
nu as (select al.*, row_number() over (order by p, sub, al.node_id) as position, l.project_id, cast(2 * ceil(length(coalesce(l.title, '')) / 4) + 8 as bigint) as tokens, case when l.kind in ('conversation_turn', 'doc_section') then l.kind || ':' || coalesce(l.ts, '') else '' end as fam from al join live l on al.node_id = l.node_id),
fold as (select 0::bigint as position, 0::bigint as used, []::varchar[] as fams, false as taken
 union all select f.position + 1, case when ok then f.used + i.tokens else f.used end, case when ok then list_append(f.fams, i.fam) else f.fams end, ok
 from fold f join nu i on i.position = f.position + 1, lateral (select not (i.fam <> '' and len(list_filter(f.fams, lambda x: x = i.fam)) >= 2) and f.used + i.tokens <= {budget} as ok) o)
select {columns} from fold join nu using (position) where taken"""


_PROJECT = "(select project_id from nodes where project_id is not null group by project_id order by count(*) desc, project_id limit 1)"
_ONE = f"select * from ({LIVE_SQL}) where project_id = {_PROJECT}"
_COLUMNS = "node_id, cast(position as int) as position, score, pulled_by, tokens"


def _per_project_sql() -> str:
    """The search with each project as its own corpus."""
    from lodeline.operators.lexical import B, K1, TITLE_WEIGHT, phrases, words_sql

    terms = [p[0] for p in phrases(QUERY)]
    tf = ", ".join(f"cast(len(list_filter(t, lambda w: starts_with(w, '{w}'))) * {TITLE_WEIGHT} + len(list_filter(b, lambda w: starts_with(w, '{w}'))) as double) as tf{i}" for i, w in enumerate(terms))
    dfs = ", ".join(f"count(*) filter (tf{i} > 0) as df{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * {K1 + 1} / (tf{i} + {K1} * (1 - {B} + {B} * len_ / avg_))" for i in range(len(terms)))
    found = " or ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""tok as (select *, {words_sql('title')} as t, {words_sql('body')} as b from ({LIVE_SQL})), counted as (select node_id, project_id, cast(len(t) + len(b) as double) as len_, {tf} from tok),
stats as (select project_id, count(*) as n, avg(len_) as avg_, {dfs} from counted group by project_id),
hits as (select node_id, row_number() over (partition by counted.project_id order by round({score}, 6) desc, node_id) as place from counted join stats on counted.project_id = stats.project_id where {found})"""


SQL = {
    "q19_hybrid_query": "with recursive " + search_sql(_ONE, QUERY, 30) + f""", {_VECTORS}, near as (select node_id, distance from vec where project_id = {_PROJECT} order by distance, node_id limit 30),
lists as (select node_id, row_number() over (order by rank desc, node_id) as place from hits union all select node_id, row_number() over (order by distance, node_id) from near),
valued as (select node_id, round(sum(1.0 / (60 + place)), 9) as value from lists group by node_id), {_pack_sql(BUDGET, _COLUMNS)}""",
    "q19_lexical_query": "with recursive " + search_sql(_ONE, QUERY, 30) + f", valued as (select node_id, rank as value from hits), {_pack_sql(BUDGET, _COLUMNS)}",
    "q20_cross_query": f"""with recursive {_per_project_sql()}, {_VECTORS}, lists as (select node_id, place from hits where place <= 5 union all
 select node_id, place from (select node_id, row_number() over (partition by project_id order by distance, node_id) as place from vec) where place <= 5),
valued as (select node_id, round(sum(1.0 / (60 + place)), 9) as value from lists group by node_id), {_pack_sql(4 * BUDGET, 'project_id, ' + _COLUMNS)}""",
}
