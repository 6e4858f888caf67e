"""From hits to a context block: fusion, ranking, linked resolutions, packing into a budget."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions.text import approx_tokens, default_provenance, trimmed, truncated
from lodeline.operators.lexical import LIVE_SQL, live_nodes, search_sql
from lodeline.operators.vectors import nearest
from lodeline.tables import cut, table

# Fixed values of the ranking.
RRF_K = 60
RELEVANCE_FLOOR, SIGNAL_FLOOR, RECENCY_FLOOR = 0.15, 0.2, 0.3
HALF_LIFE_DAYS = 30
HALF_LIFE_RATIO = {"observed": 1.0, "authored": 0.75, "recorded": 0.5, "derived": 0.35}
SUPERSEDED_PENALTY = 0.5
SIGNAL_EXPONENT = math.log(math.sqrt(2)) / math.log(1 / SIGNAL_FLOOR)
RECENCY_EXPONENT = math.log(math.sqrt(2)) / math.log(1 / RECENCY_FLOOR)
SUMMARY_CHARS, NODE_OVERHEAD, PER_FAMILY = 320, 8, 2
CHUNKED = ("conversation_turn", "doc_section")
STOPWORDS = (
    "the", "and", "for", "are", "was", "were", "that", "this", "with", "from", "into", "not", "but", "what", "why", "how", "when", "where", "which", "who",
    "does", "did", "has", "have", "had", "can", "could", "would", "should", "all", "any", "every", "each", "its", "our", "you", "your", "about",
)


def reciprocal_ranks(lists: DataFrame, id_column: str = "node_id") -> DataFrame:
    """(id, fused) from (list, id, place): the sum of 1 / (60 + place) over the lists; the place of the best is 1."""
    return lists.groupBy(id_column).agg(F.round(F.sum(1.0 / (RRF_K + F.col("place"))), 9).alias("fused"))


def placed(hits: DataFrame, *order: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds the place of each hit in its list."""
    return hits.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def merged_hits(lexical: DataFrame, vector: DataFrame, id_column: str = "node_id") -> DataFrame:
    """Hits of both searches by id; where both have one, the lexical copy stands; vector hits have rank 0."""
    return lexical.unionByName(vector.withColumn("rank", F.lit(0.0)).join(lexical.select(id_column), id_column, "left_anti").select(*lexical.columns))


def relevance(value: Column, over) -> Column:
    """Rescaled to the range from the floor to 1 within the result set; 1 where all are equal."""
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(low == high, F.lit(1.0)).otherwise(RELEVANCE_FLOOR + (1 - RELEVANCE_FLOOR) * (value - low) / (high - low))


def ranked(hits: DataFrame, value: str, now_ms: int, superseded: DataFrame | None = None, id_column: str = "node_id") -> DataFrame:
    """``hits`` (id, ts_ms, signal, provenance, ``value`` the higher the better) with relevance and score.

    A null time counts as new, an unknown provenance has the full half-life; superseded ids count half.
    Hits are a bounded top list, so one window over them is meant.
    """
    whole = Window.partitionBy(F.lit(0))
    ratio = F.lit(1.0)
    for name, part in HALF_LIFE_RATIO.items():
        ratio = F.when(F.col("provenance") == name, part).otherwise(ratio)
    age = F.greatest(F.lit(0.0), (F.lit(now_ms) - F.coalesce("ts_ms", F.lit(now_ms))) / 86_400_000)
    signal = SIGNAL_FLOOR + (1 - SIGNAL_FLOOR) * F.col("signal")
    recency = RECENCY_FLOOR + (1 - RECENCY_FLOOR) * F.pow(F.lit(2.0), -age / (HALF_LIFE_DAYS * ratio))
    out = hits.withColumn("relevance", relevance(F.col(value), whole))
    score = F.col("relevance") * F.pow(signal, F.lit(SIGNAL_EXPONENT)) * F.pow(recency, F.lit(RECENCY_EXPONENT))
    if superseded is not None:
        out = out.join(superseded.select(F.col("supersedes").alias(id_column), F.lit(True).alias("_old")).distinct(), id_column, "left")
        score = score * F.when(F.col("_old"), SUPERSEDED_PENALTY).otherwise(1.0)
    return out.withColumn("score", F.round(score, 6)).withColumn("relevance", F.round("relevance", 6)).drop("_old")


def with_resolutions(hits: DataFrame, links: DataFrame, resolutions: DataFrame, id_column: str = "node_id") -> DataFrame:
    """(id, position, pulled_by): hits in order, each failure followed by its resolutions that aren't hits themselves.

    ``hits`` has (id, position), ``links`` (from_id, to_id, relation, created_ms): retry before discussion,
    newest link first; a resolution of several failures goes to the first.
    """
    far = links.join(F.broadcast(hits.select(F.col(id_column).alias("from_id"), "position")), "from_id").join(
        F.broadcast(hits.select(F.col(id_column).alias("to_id"))), "to_id", "left_anti"
    )
    order = [F.col("position"), F.when(F.col("relation") == "resolved_by_retry", 0).otherwise(1), F.desc("created_ms"), F.col("to_id")]
    first = far.withColumn("_r", F.row_number().over(Window.partitionBy("to_id").orderBy(*order))).where("_r = 1")
    pulled = first.join(resolutions.select(F.col(id_column).alias("to_id")), "to_id", "left_semi")
    sub = F.row_number().over(Window.partitionBy("position").orderBy(*order))
    pulled = pulled.select(F.col("to_id").alias(id_column), "position", sub.alias("_sub"), F.col("from_id").alias("pulled_by"))
    both = hits.select(id_column, "position", F.lit(0).alias("_sub"), F.lit(None).cast("string").alias("pulled_by")).unionByName(pulled)
    return both.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("position", "_sub"))).drop("_sub")


def query_terms(query: str) -> list[str]:
    """Distinct words of three letters and more, without stop words, in the singular."""
    import re

    one = lambda w: w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w
    return list(dict.fromkeys(one(w) for w in re.findall(r"[a-z0-9_]{3,}", query.lower()) if w not in STOPWORDS))


def code_tokens(text: Column) -> Column:
    """Distinct lower-case parts of identifiers, split at case humps, in the singular."""
    spaced = F.lower(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"))
    one = lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, 1, F.length(w) - 1)).otherwise(w)
    return F.array_distinct(F.transform(F.regexp_extract_all(spaced, F.lit("[a-z0-9]{2,}"), F.lit(0)), one))


def best_hunk(patch: Column, query: str) -> Column:
    """The hunk that shares most tokens with the query, the first of equals, cut to one line before its first matching change."""
    terms = F.array(*[F.lit(t) for t in query_terms(query)]).cast("array<string>")
    hunks = F.transform(F.split(F.concat(F.lit("\n"), patch), r"\n(?=@@ )"), lambda h: h)
    hunks = F.filter(hunks, lambda h: h.startswith("@@ "))
    scored = F.transform(hunks, lambda h, i: F.struct(F.size(F.array_intersect(code_tokens(h), terms)).alias("s"), (-i).alias("i"), h.alias("h")))
    best = F.array_max(scored)["h"]
    lines = F.split(best, "\n")
    body = F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
    change = F.transform(body, lambda x, i: F.struct(x.rlike("^[+-]").alias("c"), F.arrays_overlap(code_tokens(x), terms).alias("m"), i.alias("i")))
    at = F.coalesce(F.get(F.filter(change, lambda c: c["c"] & c["m"]), 0)["i"], F.get(F.filter(change, lambda c: c["c"]), 0)["i"], F.lit(-1))
    focused = F.when(at > 1, F.concat_ws("\n", F.get(lines, 0), F.array_join(F.slice(body, F.greatest(at, F.lit(1)), F.greatest(F.size(body), F.lit(1))), "\n"))).otherwise(best)
    return F.when(F.size(hunks) == 0, patch).when(F.size(terms) == 0, F.get(hunks, 0)).otherwise(focused)


def summary(kind: Column, title: Column, body: Column, query: str = "", chars: int = SUMMARY_CHARS) -> Column:
    """The answer of an exchange, the head and best hunk of a patch, else the body without its title."""
    answer = trimmed(F.regexp_extract(body, r"(?s)\n\nA: (.*)", 1))
    at = F.instr(body, "\n@@ ")
    head = trimmed(F.substring(body, F.lit(1), at - 1))
    patch = F.concat(head, F.lit("\n"), best_hunk(F.substring(body, at + 1, F.length(body)), query))
    rest = F.when(body.startswith(title), trimmed(F.substring(body, F.length(title) + 1, F.length(body)))).otherwise(body)
    plain = F.when(rest == "", title).otherwise(rest)
    return truncated(F.when(body.contains("\n\nA: ") & (answer != ""), answer).when((kind == "code_diff") & (at > 0), patch).otherwise(plain), chars)


def packed(hits: DataFrame, budget: int, id_column: str = "node_id") -> DataFrame:
    """``hits`` (id, kind, ts, title, summary, position) that fit into ``budget`` tokens, in order, with ``tokens``.

    A hit that doesn't fit is skipped, the next may fit; of hits of one kind and time at most two are
    taken, for kinds that are stored in chunks. ``hits`` is one query's bounded list: it is folded in order.
    """
    tokens = approx_tokens(F.col("title")) + approx_tokens(F.col("summary")) + NODE_OVERHEAD
    family = F.when(F.col("kind").isin(*CHUNKED), F.concat_ws(":", "kind", F.coalesce("ts", F.lit("")))).otherwise("")
    items = hits.select(F.struct("position", F.col(id_column).cast("string").alias("id"), tokens.cast("bigint").alias("tokens"), family.alias("family")).alias("_i"))
    listed = items.agg(F.array_sort(F.collect_list("_i")).alias("_l"))
    state = "struct<used:bigint,families:array<string>,taken:array<struct<id:string,tokens:bigint,position:int>>>"
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("families"), F.array().cast("array<struct<id:string,tokens:bigint,position:int>>").alias("taken")).cast(state)

    def step(s, x):
        full = (x["family"] != "") & (F.size(F.filter(s["families"], lambda f: f == x["family"])) >= PER_FAMILY)
        fits = ~full & (s["used"] + x["tokens"] <= budget)
        return F.when(
            fits,
            F.struct(
                (s["used"] + x["tokens"]).alias("used"), F.concat(s["families"], F.array(x["family"])).alias("families"),
                F.concat(s["taken"], F.array(F.struct(x["id"].alias("id"), x["tokens"].alias("tokens"), x["position"].cast("int").alias("position")))).alias("taken"),
            ),
        ).otherwise(s)

    taken = listed.select(F.inline(F.aggregate("_l", start, step)["taken"]))
    return taken.select(F.col("id").alias(id_column), "tokens", "position")


def rendered(hits: DataFrame) -> DataFrame:
    """One row, the context block: a heading line and the summary of each packed hit in order."""
    line = F.concat(F.lit("## "), F.col("title"), F.lit("\n"), F.col("summary"))
    return hits.agg(F.array_sort(F.collect_list(F.struct("position", line.alias("text")))).alias("_l")).select(F.array_join(F.transform("_l", lambda x: x["text"]), "\n\n").alias("context"))


# --- queries ---------------------------------------------------------------------------------------

QUERY, NOW_MS, BUDGET = "packer restart lock", 1_767_225_600_000, 900


def _hits(spark, folder, n=30):
    """The best rows by the index; what follows is about this bounded list alone."""
    from lodeline.operators.index import fetched, nodes_index, search_index

    best = [(r.node_id, r.rank) for r in search_index(nodes_index(spark, folder), QUERY, n).collect()]
    rows = fetched(table(spark, folder, "nodes"), [i for i, _ in best]).join(F.broadcast(spark.createDataFrame(best, "node_id string, rank double")), "node_id")
    return rows.select(
        "node_id", "kind", "project_id", "ts", F.when(F.col("ts_epoch") > 0, F.col("ts_epoch")).alias("ts_ms"), F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("body", F.lit("")).alias("body"), F.col("signal_score").alias("signal"), F.coalesce("provenance", default_provenance(F.col("kind"))).alias("provenance"), "rank",
    )


def _superseded(spark, folder):
    return table(spark, folder, "nodes").where("supersedes is not null").select("supersedes").distinct()


def _ranked(spark, folder):
    return cut(ranked(_hits(spark, folder), "rank", NOW_MS, _superseded(spark, folder)))


def _positioned(spark, folder):
    return placed(_ranked(spark, folder), F.desc("score"), F.desc("rank"), F.col("node_id")).withColumnRenamed("place", "position").withColumn("summary", summary(F.col("kind"), F.col("title"), F.col("body"), QUERY))


def q14_relevance(spark, folder):
    return _ranked(spark, folder).select("node_id", "relevance")


def q15_score(spark, folder):
    return _ranked(spark, folder).select("node_id", "score")


def q16_superseded(spark, folder):
    """All nodes that something supersedes, with the penalised score of a full match."""
    old = live_nodes(spark, folder).join(_superseded(spark, folder).withColumnRenamed("supersedes", "node_id"), "node_id", "left_semi")
    return old.select("node_id", "kind", (F.lit(1.0) * SUPERSEDED_PENALTY).alias("factor"))


def q17_pack(spark, folder):
    return packed(_positioned(spark, folder), BUDGET)


def q18_pack_family(spark, folder):
    """Titles alone, and each kind one family, of which two are taken at most for kinds stored in chunks."""
    return packed(_positioned(spark, folder).withColumns({"summary": F.col("title"), "ts": F.lit("x")}), 260)


def q17_context(spark, folder):
    h = _positioned(spark, folder)
    return rendered(packed(h, BUDGET).join(h.select("node_id", "title", "summary"), "node_id"))


def q12_rrf(spark, folder):
    """Documents by words and vectors (a vector stands for the document of its number), fused."""
    return reciprocal_ranks(_both_lists(spark, folder))


def _lexical(spark, folder):
    from lodeline.operators.index import documents_index, search_index

    return search_index(documents_index(spark, folder), "retry lock", 20)


def _both_lists(spark, folder):
    from lodeline.operators.vectors import _query_vector

    lexical = placed(_lexical(spark, folder), F.desc("rank"), F.col("node_id")).select(F.lit("lexical").alias("list"), "node_id", "place")
    near = nearest(table(spark, folder, "embeddings"), _query_vector(spark, folder, 7), 20)
    vector = placed(near, F.col("distance"), F.col("vec_id")).select(F.lit("vector").alias("list"), F.col("vec_id").alias("node_id"), "place")
    return lexical.unionByName(vector)


def q13_merge(spark, folder):
    vector = _both_lists(spark, folder).where("list = 'vector'").select("node_id")
    return merged_hits(_lexical(spark, folder).select("node_id", "rank"), vector)


def q19_hybrid(spark, folder):
    """Lexical and vector hits of the documents, fused, rescaled and cut to the best 20."""
    fused = {r.node_id: r.fused for r in reciprocal_ranks(_both_lists(spark, folder)).collect()}
    told = spark.createDataFrame(list(fused.items()), "node_id bigint, fused double")
    docs = table(spark, folder, "documents").where(F.col("doc_id").isin(list(fused))).select(F.col("doc_id").alias("node_id"), "kind")
    hits = docs.join(F.broadcast(told), "node_id").withColumn("relevance", F.round(relevance(F.col("fused"), Window.partitionBy(F.lit(0))), 6))
    return hits.orderBy(F.desc("relevance"), "node_id").limit(20).select("node_id", "kind", "relevance")


def q20_cross_project(spark, folder):
    """One list per project, each with its own places, fused; ties to the smaller id."""
    from lodeline.operators.index import nodes_index, search_index

    hits = search_index(nodes_index(spark, folder), QUERY, None)
    lists = placed(hits, F.desc("rank"), F.col("node_id"), by=("project_id",)).where("place <= 10")
    return reciprocal_ranks(lists).join(lists.select("node_id", "project_id"), "node_id").orderBy(F.desc("fused"), "node_id").limit(30).select("node_id", "project_id", "fused")


def q20_project_hits(spark, folder):
    from lodeline.operators.index import nodes_index, search_index

    return search_index(nodes_index(spark, folder), QUERY, None).groupBy("project_id").agg(F.count(F.lit(1)).alias("hits"))


QUERIES = {f.__name__: f for f in (q12_rrf, q13_merge, q14_relevance, q15_score, q16_superseded, q17_pack, q18_pack_family, q17_context, q19_hybrid, q20_cross_project, q20_project_hits)}

_prov = "coalesce(provenance, case kind when 'git_commit' then 'observed' when 'code_diff' then 'observed' when 'shell_command' then 'observed' when 'doc_section' then 'authored' when 'note' then 'authored' when 'conversation_turn' then 'recorded' else 'derived' end)"
_RANKED = "with " + search_sql(LIVE_SQL, QUERY, 30) + f""",
rel as (select *, case when min(rank) over () = max(rank) over () then 1.0 else 0.15 + 0.85 * (rank - min(rank) over ()) / (max(rank) over () - min(rank) over ()) end as rel0,
  greatest(0.0, ({NOW_MS} - case when ts_epoch > 0 then ts_epoch else {NOW_MS} end) / 86400000.0) as age,
  case {_prov} when 'observed' then 1.0 when 'authored' then 0.75 when 'recorded' then 0.5 when 'derived' then 0.35 else 1.0 end as ratio from hits),
old as (select distinct supersedes from base where supersedes is not null),
ranked as (select rel.*, round(rel0, 6) as relevance, round(rel0 * pow(0.2 + 0.8 * signal_score, ln(sqrt(2)) / ln(5)) * pow(0.3 + 0.7 * pow(2.0, -age / (30 * ratio)), ln(sqrt(2)) / ln(1 / 0.3)) * case when old.supersedes is null then 1.0 else 0.5 end, 6) as score
  from rel left join old on rel.node_id = old.supersedes)"""
_both = "with recursive " + search_sql("select doc_id as node_id, kind, substr(coalesce(regexp_extract(text, '^([^\\n\\r]*)', 1), ''), 1, 60) as title, coalesce(text, '') as body from documents", "retry lock", 20) + f""",
near as (select b.vec_id, round(list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as distance from embeddings a, embeddings b where a.vec_id = 7 order by distance, b.vec_id limit 20),
lists as (select node_id, row_number() over (order by rank desc, node_id) as place from hits union all select vec_id, row_number() over (order by distance, vec_id) from near),
fused as (select node_id, round(sum(1.0 / (60 + place)), 9) as fused from lists group by node_id)"""
SQL = {
    "q12_rrf": _both + " select node_id, fused from fused",
    "q13_merge": _both + " select node_id, rank from hits union all select vec_id, 0.0 from near where vec_id not in (select node_id from hits)",
    "q14_relevance": _RANKED + " select node_id, relevance from ranked",
    "q15_score": _RANKED + " select node_id, score from ranked",
    "q16_superseded": f"with n as ({LIVE_SQL}) select node_id, kind, 0.5::double as factor from n where node_id in (select supersedes from n where supersedes is not null)",
    "q18_pack_family": _RANKED.replace("with ", "with recursive ", 1) + """,
it as (select row_number() over (order by score desc, rank desc, node_id) as position, node_id, cast(2 * ceil(length(coalesce(title, '')) / 4) + 8 as bigint) as tokens, case when kind in ('conversation_turn', 'doc_section') then kind else '' end as fam from ranked),
fold as (select 0::bigint as position, 0::bigint as used, []::varchar[] as fams, null::varchar as node_id, 0::bigint as tokens
 union all select it.position, case when ok then used + it.tokens else used end, case when ok then list_append(fams, fam) else fams end, case when ok then it.node_id end, it.tokens
 from (select f.position as p, f.used, f.fams, i.position as ip, not (i.fam <> '' and len(list_filter(f.fams, lambda x: x = i.fam)) >= 2) and f.used + i.tokens <= 260 as ok from fold f join it i on i.position = f.position + 1) j join it on it.position = j.ip)
select node_id, tokens, cast(position as int) as position from fold where node_id is not null""",
    "q19_hybrid": _both + """, h as (select f.node_id, kind, case when min(fused) over () = max(fused) over () then 1.0 else 0.15 + 0.85 * (fused - min(fused) over ()) / (max(fused) over () - min(fused) over ()) end as rel
 from fused f join base b on f.node_id = b.node_id) select node_id, kind, round(rel, 6) as relevance from h order by relevance desc, node_id limit 20""",
    "q20_cross_project": "with " + search_sql(LIVE_SQL, QUERY, None) + ", l as (select node_id, project_id, row_number() over (partition by project_id order by rank desc, node_id) as place from hits) select node_id, project_id, round(1.0 / (60 + place), 9) as fused from l where place <= 10 order by fused desc, node_id limit 30",
    "q20_project_hits": "with " + search_sql(LIVE_SQL, QUERY, None) + " select project_id, count(*) as hits from hits group by project_id",
}
