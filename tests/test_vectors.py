from lodeline.operators.vectors import embedding_pass, fake_embedding, nearest, nearest_of_queries, still_valid
from pyspark.sql import functions as F


def test_queries_in_sets_give_what_one_set_gives(spark, folder):
    v = spark.read.parquet(f"{folder}/embeddings.parquet")
    q = v.where("vec_id % 20 = 0")
    one = {tuple(r) for r in nearest_of_queries(v, q, 3).collect()}
    assert {tuple(r) for r in nearest_of_queries(v, q, 3, most_queries=1).collect()} == one and len(one) == 3 * q.count()
    r = q.first()
    alone = nearest(v.where(F.col("vec_id") != r.vec_id), F.array(*[F.lit(float(x)) for x in r.embedding]), 3).collect()
    assert sorted((x.vec_id, x.distance) for x in alone) == sorted(t[1:3] for t in one if t[0] == r.vec_id)
    assert nearest_of_queries(v, q.limit(0), 3).count() == 0 and nearest_of_queries(v.limit(0), q, 3).count() == 0


def test_nulls_and_ties(spark):
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 1.0]), (5, [1.0])], "vec_id bigint, embedding array<double>")
    assert [r.vec_id for r in nearest(v, F.array(F.lit(0.0), F.lit(1.0)), 2).collect()] == [1, 2]
    same = v.where("size(embedding) = 2")
    assert {(r.query_id, r.id) for r in nearest_of_queries(same, same, 1).collect()} == {(1, 2), (2, 1), (4, 1)}


def test_embedding_pass(spark):
    rows = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", " "), ("d", "four")], "node_id string, body string")
    vectors = spark.createDataFrame([("a", [1.0])], "node_id string, embedding array<double>")
    after, left = embedding_pass(rows, vectors, fake_embedding, "m", "m", most=1)
    assert sorted(r.node_id for r in after.collect()) == ["a", "b"] and left.first().remaining == 2
    after, left = embedding_pass(rows, vectors, fake_embedding, "old", "m")
    assert sorted(r.node_id for r in after.collect()) == ["a", "b", "d"] and left.first().remaining == 1
    assert still_valid(vectors, None, "m").count() == 0
    dead = embedding_pass(rows, vectors, lambda texts: [None] * len(texts), "m", "m")
    assert dead[0].count() == 1 and dead[1].first().remaining == 3
