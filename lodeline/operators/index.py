"""The inverted index: written once per table, sorted by term, and read by range for each search."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions.text import words
from lodeline.operators.lexical import B, K1, TITLE_WEIGHT, documents_as_nodes, live_nodes, phrases
from lodeline.tables import cut, once

KEPT = ("project_id", "kind")


class Index(NamedTuple):
    """``postings`` (term, id, project_id, kind, len_t, len_b, t, b): places of each term in title and body; ``sizes`` (project_id, kind, n, len_t, len_b)."""

    postings: DataFrame
    sizes: DataFrame
    id_column: str


def build_index(nodes: DataFrame, id_column: str = "node_id") -> Index:
    """The index of ``nodes`` (id_column, project_id, kind, title, body), written sorted by term.

    A term's rows are cut into ranges of ids as well, so a term of all rows is spread. Null titles and
    bodies have no words; rows without words count in the sizes; repeated ids are taken as one row twice.
    """
    base = nodes.select(F.col(id_column).alias("id"), *KEPT, words(F.col("title")).alias("_t"), words(F.col("body")).alias("_b"))
    told = base.select("id", *KEPT, F.size("_t").alias("len_t"), F.size("_b").alias("len_b"), "_t", "_b")
    place = lambda field: lambda w, i: F.struct(w.alias("term"), F.lit(field).alias("f"), i.alias("i"))
    each = told.select("id", *KEPT, "len_t", "len_b", F.inline(F.concat(F.transform("_t", place(0)), F.transform("_b", place(1)))))
    at = lambda field: F.sort_array(F.collect_list(F.when(F.col("f") == field, F.col("i"))))
    posts = each.groupBy("term", "id", *KEPT, "len_t", "len_b").agg(at(0).alias("t"), at(1).alias("b"))
    sizes = told.groupBy(*KEPT).agg(F.count(F.lit(1)).alias("n"), F.sum("len_t").alias("len_t"), F.sum("len_b").alias("len_b"))
    return Index(cut(posts.repartitionByRange("term", "id").sortWithinPartitions("term", "id")), cut(sizes.coalesce(1)), id_column)


def _is(word: str, last: bool) -> Column:
    return F.col("term").startswith(word) if last else F.col("term") == word


def _moved(places: Column, back: int) -> Column:
    return F.transform(places, lambda p: p - back)


def matches(index: Index, query: str, titles: bool = True, where: Column | None = None) -> tuple[DataFrame, int]:
    """(id, project_id, kind, len, tf0, tf1, ...) of the rows that hold a term of the query, and the number of terms.

    Only the ranges of the terms are read. A term of several words counts where they stand side by side, its
    last word is a prefix. Titles weigh ten times, or nothing if not ``titles``.
    """
    terms = phrases(query)
    wanted = F.lit(False)
    for phrase in terms:
        for i, word in enumerate(phrase):
            wanted = wanted | _is(word, i == len(phrase) - 1)
    found = index.postings.where(wanted)
    found = found if where is None else found.where(where)
    weighed = lambda t, b: t * TITLE_WEIGHT + b if titles else b
    parts, late = [], []
    for k, phrase in enumerate(terms):
        if len(phrase) == 1:
            parts.append(F.sum(F.when(_is(phrase[0], True), weighed(F.size("t"), F.size("b"))).otherwise(0)).alias(f"tf{k}"))
            late.append(F.col(f"tf{k}").cast("double").alias(f"tf{k}"))
            continue
        # Where each word of the phrase stands, moved back to where the phrase would begin.
        starts = {}
        for field in "tb":
            for i, word in enumerate(phrase):
                parts.append(F.flatten(F.collect_list(F.when(_is(word, i == len(phrase) - 1), _moved(F.col(field), i)))).alias(f"_{k}{field}{i}"))
            both = F.col(f"_{k}{field}0")
            for i in range(1, len(phrase)):
                both = F.array_intersect(both, F.col(f"_{k}{field}{i}"))
            starts[field] = F.size(both)
        late.append(weighed(starts["t"], starts["b"]).cast("double").alias(f"tf{k}"))
    length = (F.col("len_t") + F.col("len_b") if titles else F.col("len_b")).cast("double").alias("len")
    grouped = found.groupBy("id", *KEPT, "len_t", "len_b").agg(*parts) if parts else found.limit(0)
    return grouped.select("id", *KEPT, length, *late), len(terms)


def search_index(index: Index, query: str, n: int | None = 30, strict: bool = False, titles: bool = True, where: Column | None = None, by: str | None = None) -> DataFrame:
    """(id_column, project_id, kind, rank) of the rows that match any term of ``query`` (every one if ``strict``), best first, ties to the smaller id.

    BM25 over all rows of the index, or those of ``where`` (on project_id and kind); with ``by``, every value of that column
    is a corpus of its own and the best ``n`` of each are given, with ``place``. A query without terms gives no rows.
    """
    keys = [by] if by else []
    found, terms = matches(index, query, titles, where)
    if not terms:
        return index.postings.select(F.col("id").alias(index.id_column), *KEPT, F.lit(0.0).alias("rank")).limit(0)
    sizes = index.sizes if where is None else index.sizes.where(where)
    length = F.col("len_t") + F.col("len_b") if titles else F.col("len_b")
    whole = sizes.groupBy(*keys).agg(F.sum("n").cast("double").alias("_n"), (F.sum(length) / F.sum("n")).alias("_avg"))
    frequency = found.groupBy(*keys).agg(*[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"_df{i}") for i in range(terms)])
    if by:
        # as many rows as there are corpora
        scored = found.join(whole, by).join(frequency, by)
    else:
        scored = found.join(F.broadcast(whole)).join(F.broadcast(frequency))
    score, told = F.lit(0.0), None
    for i in range(terms):
        df, f = F.col(f"_df{i}"), F.col(f"tf{i}")
        idf = F.greatest(F.log((F.col("_n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("_avg")))
        told = f > 0 if told is None else told & (f > 0) if strict else told | (f > 0)
    hits = scored.where(told).select(F.col("id").alias(index.id_column), *KEPT, F.round(score, 6).alias("rank"))
    if by:
        place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("rank"), index.id_column))
        hits = hits.withColumn("place", place)
        return hits if n is None else hits.where(F.col("place") <= n)
    hits = hits.orderBy(F.desc("rank"), index.id_column)
    return hits if n is None else hits.limit(n)


def fetched(nodes: DataFrame, ids: list, id_column: str = "node_id") -> DataFrame:
    """The rows of a bounded list of ids, each once: the list reaches the scan, nothing else is shuffled."""
    return nodes.where(F.col(id_column).isin(ids)).distinct() if ids else nodes.limit(0)


def nodes_index(spark, folder: str) -> Index:
    return once(spark, folder, "nodes index", lambda: build_index(live_nodes(spark, folder)))


def documents_index(spark, folder: str) -> Index:
    return once(spark, folder, "documents index", lambda: build_index(documents_as_nodes(spark, folder)))


QUERIES: dict = {}
SQL: dict[str, str] = {}
