"""Exact vector search and what keeps vectors in step with rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.tables import table


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays; null if their sizes differ."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(squares))


def nearest(vectors: DataFrame, query: Column, n: int = 10, id_column: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """The ``n`` rows nearest to ``query``, filtered first, with ``distance``; ties to the smaller id. Spark keeps n rows per task."""
    rows = vectors if where is None else vectors.where(where)
    told = rows.withColumn("distance", F.round(distance(F.col(vector).cast("array<double>"), query), 6))
    return told.where("distance is not null").orderBy("distance", id_column).limit(n)


def nearest_of_queries(vectors: DataFrame, queries: DataFrame, n: int, id_column: str = "vec_id", vector: str = "embedding", block: int = 256, most_queries: int = 50_000) -> DataFrame:
    """(query_id, id, distance, place): for each row of ``queries`` its ``n`` nearest others, exactly.

    Queries are cut into sets of at most ``most_queries``, each broadcast by itself and met with all vectors,
    so what is broadcast is bounded however many there are; every task keeps only its ``n`` best per query
    before they are merged.
    """
    stated = queries.select(id_column, vector).where(f"{vector} is not null")
    sets = -(-stated.count() // most_queries)
    if sets > 1:
        # each set by the hash of its ids: all are read once a set, none is left out
        parts = [nearest_of_queries(vectors, stated.where(F.pmod(F.xxhash64(id_column), F.lit(sets)) == i), n, id_column, vector, block, 4 * most_queries) for i in range(sets)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    held = stated.toArrow()
    ids, matrix = held[id_column].to_pylist(), np.array(held[vector].to_pylist(), dtype=float)
    told = queries.sparkSession.sparkContext.broadcast((ids, matrix))

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = told.value
        for frame in frames:
            frame = frame[frame[vector].notna()]
            if not len(frame) or not len(ids):
                continue
            rows, keys = np.array(frame[vector].tolist(), dtype=float), frame[id_column].to_numpy()
            found = []
            for low in range(0, len(ids), block):
                d = np.sqrt(((matrix[low : low + block, None, :] - rows[None, :, :]) ** 2).sum(axis=2)) if len(rows) * block < 4_000_000 else np.stack([np.sqrt(((rows - q) ** 2).sum(axis=1)) for q in matrix[low : low + block]])
                for i, line in enumerate(d):
                    line = np.where(keys == ids[low + i], np.inf, line)
                    k = np.lexsort((keys, np.round(line, 6)))[:n]
                    found.append((np.full(len(k), ids[low + i], dtype=keys.dtype), keys[k], np.round(line[k], 6)))
            yield pd.DataFrame({"query_id": np.concatenate([f[0] for f in found]), "id": np.concatenate([f[1] for f in found]), "distance": np.concatenate([f[2] for f in found])})

    kind = vectors.schema[id_column].dataType.simpleString()
    some = vectors.select(id_column, vector).mapInPandas(best, f"query_id {kind}, id {kind}, distance double").where("distance < double('infinity')")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return some.withColumn("place", place).where(F.col("place") <= n)


def pending(rows: DataFrame, vectors: DataFrame, id_column: str = "node_id") -> DataFrame:
    """Rows that have no vector yet."""
    return rows.join(vectors.select(id_column), id_column, "left_anti")


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float] | None]], id_column: str = "node_id", text: str = "body", batch: int = 32) -> DataFrame:
    """(id_column, embedding) by batches of ``batch`` through a model; a text it gives None for has no row. Stops a partition after three dead batches."""

    def run(frames):
        dead = 0
        for frame in frames:
            for low in range(0, len(frame), batch):
                if dead >= 3:
                    return
                part = frame.iloc[low : low + batch]
                out = embed(part[text].fillna("").tolist())
                dead = dead + 1 if all(v is None for v in out) else 0
                kept = [v is not None for v in out]
                if not any(kept):
                    continue
                yield pd.DataFrame({id_column: part[id_column][kept].to_numpy(), "embedding": [v for v in out if v is not None]})

    kind = rows.schema[id_column].dataType.simpleString()
    return rows.select(id_column, text).mapInPandas(run, f"{id_column} {kind}, embedding array<double>")


def embedding_pass(rows: DataFrame, vectors: DataFrame, embed: Callable[[list[str]], list[list[float] | None]], stored_identity: str | None, identity: str, most: int | None = None, id_column: str = "node_id", text: str = "body") -> tuple[DataFrame, DataFrame]:
    """The vectors after one run of a model over rows that have none, and (remaining): how many are still without.

    Vectors of another provider are dropped first; at most ``most`` rows are taken, by id; a text the model gives nothing
    for remains, and is asked again by the next run.
    """
    valid = still_valid(vectors, stored_identity, identity)
    todo = pending(rows, valid, id_column)
    told = embedded(todo if most is None else todo.orderBy(id_column).limit(most), embed, id_column, text)
    after = valid.select(id_column, F.col("embedding").cast("array<double>").alias("embedding")).unionByName(told)
    return after, pending(rows, after, id_column).agg(F.count(F.lit(1)).alias("remaining"))


def fake_embedding(texts: list[str], size: int = 16) -> list[list[float] | None]:
    """A stand-in for a model: letters counted by place. None for blank texts."""
    out: list[list[float] | None] = []
    for t in texts:
        v = [0.0] * size
        for i, c in enumerate(t):
            v[(ord(c) * 31 + i) % size] += 1.0
        norm = sum(x * x for x in v) ** 0.5
        out.append([x / norm for x in v] if t.strip() and norm else None)
    return out


def still_valid(vectors: DataFrame, stored_identity: str | None, identity: str) -> DataFrame:
    """All vectors if they were made by the provider of this identity, else none."""
    return vectors if stored_identity == identity else vectors.limit(0)


# --- queries ---------------------------------------------------------------------------------------


def _query_vector(spark, folder: str, vec_id: int) -> Column:
    row = table(spark, folder, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return F.array(*[F.lit(float(x)) for x in row[0]])


def q09_knn(spark, folder):
    return nearest(table(spark, folder, "embeddings"), _query_vector(spark, folder, 7), 20).select("vec_id", "label", "distance")


def q10_knn_project(spark, folder):
    return nearest(table(spark, folder, "embeddings"), _query_vector(spark, folder, 7), 10, where=F.col("label") == 3).select("vec_id", "distance")


def q11_nearest_newer(spark, folder):
    """For each twentieth vector the nearest of those that came later (a larger id)."""
    v = table(spark, folder, "embeddings")
    pairs = nearest_of_queries(v, v.where("vec_id % 20 = 0"), 25).where("id > query_id")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return pairs.withColumn("_r", first).where("_r = 1").select("query_id", F.col("id").alias("newer_id"), "distance")


QUERIES = {f.__name__: f for f in (q09_knn, q10_knn_project, q11_nearest_newer)}
_d = "round(list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])), 6)"
SQL = {
    "q09_knn": f"select b.vec_id, b.label, {_d} as distance from embeddings a, embeddings b where a.vec_id = 7 order by distance, b.vec_id limit 20",
    "q10_knn_project": f"select b.vec_id, {_d} as distance from embeddings a, embeddings b where a.vec_id = 7 and b.label = 3 order by distance, b.vec_id limit 10",
    "q11_nearest_newer": f"""with p as (select a.vec_id as query_id, b.vec_id as id, {_d} as distance from embeddings a, embeddings b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
k as (select *, row_number() over (partition by query_id order by distance, id) as place from p),
f as (select *, row_number() over (partition by query_id order by place) as r from k where place <= 25 and id > query_id)
select query_id, id as newer_id, distance from f where r = 1""",
}
