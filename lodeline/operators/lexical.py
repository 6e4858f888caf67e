"""Lexical search: BM25 over prefix terms and phrases, strict matches, document frequencies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.text import MARKED, PLAIN, words
from lodeline.tables import cut, once, table

K1, B, TITLE_WEIGHT = 1.2, 0.75, 10
_SYNTAX = re.compile(r"[\"'()*:^{}\[\]-]")
#: Longest share of documents a term may occur in before it counts as boilerplate, and the least corpus for that.
FREQUENT, LEAST_CORPUS = 0.2, 10


def significant_tokens(query: str) -> list[str]:
    """The query's tokens without search syntax; ``id`` only where there is nothing else."""
    tokens = _SYNTAX.sub(" ", query).split()
    return [t for t in tokens if t.lower() != "id"] or tokens


def phrases(query: str) -> list[list[str]]:
    """Each significant token as the words it falls into; the last of them is a prefix."""
    split = [re.split(r"[\W_]+", t.lower().translate(str.maketrans(MARKED, PLAIN))) for t in significant_tokens(query)]
    return [p for p in ([w for w in ws if w] for ws in split) if p]


def spaced(text: Column) -> Column:
    """The words of a text with one blank around each."""
    return F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))


def occurrences(text: Column, phrase: list[str]) -> Column:
    """How often the phrase occurs in spaced words, its last word as a prefix."""
    return F.regexp_count(text, F.lit(" " + " ".join(phrase) + "[^ ]*(?= )"))


def search(nodes: DataFrame, query: str, n: int | None = 30, id_column: str = "node_id", strict: bool = False) -> DataFrame:
    """``nodes`` (id_column, title, body, ...) that match any term of ``query`` (every one if ``strict``), with ``rank``, the BM25 score, best first.

    For tables without an index. Two scans and no shuffle of text: one aggregates the numbers of documents, words and matches to a
    single row, which is broadcast; the other scores. Titles weigh ten times. Statistics cover all
    of ``nodes``. Ties go to the smaller id. A query without terms, or an empty table, gives no rows;
    null titles and bodies are empty.
    """
    terms = phrases(query)
    if not terms:
        return nodes.withColumn("rank", F.lit(0.0)).limit(0)
    counted = nodes.withColumns({"_t": spaced(F.col("title")), "_b": spaced(F.col("body"))})
    tf = [(occurrences(F.col("_t"), p) * TITLE_WEIGHT + occurrences(F.col("_b"), p)).cast("double").alias(f"_tf{i}") for i, p in enumerate(terms)]
    counted = counted.select(*nodes.columns, (F.regexp_count("_t", F.lit("[^ ]+")) + F.regexp_count("_b", F.lit("[^ ]+"))).cast("double").alias("_len"), *tf)
    found = [F.col(f"_tf{i}") > 0 for i in range(len(terms))]
    stats = counted.agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *[F.count(F.when(f, 1)).alias(f"_df{i}") for i, f in enumerate(found)]
    )
    scored = counted.join(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(terms)):
        df, f = F.col(f"_df{i}"), F.col(f"_tf{i}")
        idf = F.greatest(F.log((F.col("_n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    matches = found[0]
    for f in found[1:]:
        matches = matches & f if strict else matches | f
    hits = scored.where(matches).withColumn("rank", F.round(score, 6)).select(*nodes.columns, "rank").orderBy(F.desc("rank"), id_column)
    return hits if n is None else hits.limit(n)


def document_frequency(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """(term, matching, total, boilerplate): in how many of ``nodes`` each prefix term occurs, by one scan."""
    tokens = F.concat(spaced(F.col("title")), spaced(F.col("body")))
    told = [F.struct(F.lit(t).alias("term"), F.count(F.when(occurrences(F.col("_w"), phrases(t)[0]) > 0, 1)).alias("matching")) for t in terms]
    counts = nodes.select(tokens.alias("_w")).agg(F.count(F.lit(1)).alias("total"), F.array(*told).alias("_terms"))
    each = counts.select("total", F.inline("_terms"))
    return each.withColumn("boilerplate", (F.col("total") >= LEAST_CORPUS) & (F.col("matching") / F.col("total") > FREQUENT)).select("term", "matching", "total", "boilerplate")


# --- queries ---------------------------------------------------------------------------------------

QUERY = "retry lock"


def documents_as_nodes(spark, folder: str) -> DataFrame:
    """Documents in the shape of nodes: the first line is the title."""
    d = table(spark, folder, "documents")
    title = F.substring(F.coalesce(F.regexp_extract("text", r"^([^\n\r]*)", 1), F.lit("")), 1, 60)
    return d.select(F.col("doc_id").alias("node_id"), "kind", "project_id", "source", title.alias("title"), F.coalesce("text", F.lit("")).alias("body"))


#: Ids that occur more than once are broadcast up to so many of them.
REPEATED = 1_000_000


def live_nodes(spark, folder: str) -> DataFrame:
    """The nodes, rows that occur twice once. Only rows whose id repeats are compared: the others, nearly all, aren't shuffled."""
    nodes = table(spark, folder, "nodes")

    def repeated() -> tuple[DataFrame, int]:
        ids = cut(nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and node_id is not null").select("node_id"))
        return ids, ids.count()

    ids, n = once(spark, folder, "repeated nodes", repeated)
    if n > REPEATED:
        return nodes.distinct()
    single = nodes.where("node_id is not null").join(F.broadcast(ids), "node_id", "left_anti")
    again = nodes.join(F.broadcast(ids), "node_id", "left_semi").unionByName(nodes.where("node_id is null")).distinct()
    return single.unionByName(again)


DOCS_SQL = "select doc_id as node_id, kind, project_id, source, substr(coalesce(regexp_extract(text, '^([^\\n\\r]*)', 1), ''), 1, 60) as title, coalesce(text, '') as body from documents"
LIVE_SQL = "select distinct * from nodes"


def words_sql(column: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(lower(coalesce({column}, '')), '{MARKED}', '{PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def search_sql(source: str, query: str, n: int | None, extra: str = "", strict: bool = False) -> str:
    """The same search in SQL; single-word terms only."""
    terms = [p[0] for p in phrases(query)]
    tf = ", ".join(f"cast(len(list_filter(t, lambda w: starts_with(w, '{w}'))) * {TITLE_WEIGHT} + len(list_filter(b, lambda w: starts_with(w, '{w}'))) as double) as tf{i}" for i, w in enumerate(terms))
    dfs = ", ".join(f"count(*) filter (tf{i} > 0) as df{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * {K1 + 1} / (tf{i} + {K1} * (1 - {B} + {B} * len_ / avg_))" for i in range(len(terms)))
    found = (" and " if strict else " or ").join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""base as ({source}), tok as (select *, {words_sql('title')} as t, {words_sql('body')} as b from base),
counted as (select *, cast(len(t) + len(b) as double) as len_, {tf} from tok),
stats as (select count(*) as n, avg(len_) as avg_, {dfs} from counted),
hits as (select counted.* exclude (t, b), round({score}, 6) as rank {extra} from counted, stats where {found} order by rank desc, node_id {'limit ' + str(n) if n else ''})"""


def _documents(spark, folder, query: str, n: int | None, **how):
    from lodeline.operators.index import documents_index, search_index

    return search_index(documents_index(spark, folder), query, n, **how)


def q05_bm25(spark, folder):
    """By the index: only the ranges of the query's terms are read."""
    return _documents(spark, folder, QUERY, 20, titles=False).select("node_id", "rank")


def q05_bm25_scan(spark, folder):
    """The same without an index, by two scans."""
    return search(documents_as_nodes(spark, folder).withColumn("title", F.lit("")), QUERY, 20).select("node_id", "rank")


def q06_bm25_fields(spark, folder):
    from lodeline.operators.index import nodes_index, search_index

    return search_index(nodes_index(spark, folder), "packer restart", 30).select("node_id", "kind", "rank")


def q07_all_terms(spark, folder):
    return _documents(spark, folder, "cursor restart walk", None, strict=True).select("node_id", "rank")


def q07_phrase(spark, folder):
    return _documents(spark, folder, "src/pack.ts", None).select("node_id")


_BOILERPLATE = ["lock", "the", "vector", "restart", "packer", "a", "zzz"]


def q08_boilerplate(spark, folder):
    kinds = documents_as_nodes(spark, folder).where(F.col("kind").isin("conversation_turn", "session_summary"))
    return document_frequency(kinds, _BOILERPLATE)


def q08_postings(spark, folder):
    from lodeline.operators.index import nodes_index

    posts = nodes_index(spark, folder).postings
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("t") + F.size("b")).alias("cf"))


QUERIES = {f.__name__: f for f in (q05_bm25, q05_bm25_scan, q06_bm25_fields, q07_all_terms, q07_phrase, q08_boilerplate, q08_postings)}
_each = " union all ".join(f"select '{t}' as term, count(*) filter (len(list_filter(w, lambda x: starts_with(x, '{t}'))) > 0) as matching, count(*) as total from k" for t in _BOILERPLATE)
SQL = {
    "q05_bm25": "with " + search_sql(DOCS_SQL.replace("substr(coalesce(regexp_extract(text, '^([^\\n\\r]*)', 1), ''), 1, 60)", "''"), QUERY, 20) + " select node_id, rank from hits",
    "q05_bm25_scan": "with " + search_sql(DOCS_SQL.replace("substr(coalesce(regexp_extract(text, '^([^\\n\\r]*)', 1), ''), 1, 60)", "''"), QUERY, 20) + " select node_id, rank from hits",
    "q06_bm25_fields": "with " + search_sql(LIVE_SQL, "packer restart", 30) + " select node_id, kind, rank from hits",
    "q07_all_terms": "with " + search_sql(DOCS_SQL, "cursor restart walk", None, strict=True) + " select node_id, rank from hits",
    "q07_phrase": f"""with k as (select node_id, {words_sql('title')} as t, {words_sql('body')} as b from ({DOCS_SQL}))
select node_id from k where regexp_matches(' ' || array_to_string(t, ' ') || ' ', ' src pack ts[^ ]* ') or regexp_matches(' ' || array_to_string(b, ' ') || ' ', ' src pack ts[^ ]* ')""",
    "q08_boilerplate": f"""with k as (select list_concat({words_sql('title')}, {words_sql('body')}) as w from ({DOCS_SQL}) where kind in ('conversation_turn', 'session_summary')), e as ({_each})
select term, matching, total, total >= {LEAST_CORPUS} and matching / total > {FREQUENT} as boilerplate from e""",
    "q08_postings": f"""with n as ({LIVE_SQL}), e as (select node_id, unnest(list_concat({words_sql('title')}, {words_sql('body')})) as term from n)
select term, count(distinct node_id) as df, count(*) as cf from e group by term""",
}
