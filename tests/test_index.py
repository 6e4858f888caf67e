import random

import pytest
from lodeline.operators.index import build_index, fetched, search_index
from lodeline.operators.lexical import search
from pyspark.sql import functions as F

WORDS = "lock locked retry retries queue a src pack ts packer café id".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = [(f"n{i:03}", rng.choice("pq"), rng.choice(["note", "doc_section"]), " ".join(rng.choices(WORDS, k=3)), " ".join(rng.choices(WORDS, k=rng.randrange(12)))) for i in range(120)]
    rows += [("z1", "p", "note", None, None), ("z2", None, "note", "", "lock"), ("z3", "q", None, "x", "lock " * 5000)]
    df = spark.createDataFrame(rows, "node_id string, project_id string, kind string, title string, body string")
    return df, build_index(df)


@pytest.mark.parametrize("query", ["lock", "retry lock", "src/pack.ts", "Café", "id", "nothing here", "pack.ts lock"])
@pytest.mark.parametrize("strict", [False, True])
def test_the_index_finds_what_a_scan_finds(corpus, query, strict):
    df, index = corpus
    want = [(r.node_id, r.rank) for r in search(df, query, None, strict=strict).collect()]
    assert [(r.node_id, pytest.approx(r.rank, abs=2e-6)) for r in search_index(index, query, None, strict=strict).collect()] == want


def test_one_project_and_each_as_its_own_corpus(corpus):
    df, index = corpus
    want = [(r.node_id, r.rank) for r in search(df.where("project_id = 'p'"), "retry lock", 5).collect()]
    assert [(r.node_id, r.rank) for r in search_index(index, "retry lock", 5, where=F.col("project_id") == "p").collect()] == want
    each = search_index(index, "retry lock", 5, by="project_id").where("project_id = 'p'").orderBy("place").collect()
    assert [(r.node_id, r.rank) for r in each] == want


def test_only_ranges_are_read_and_nothing_is_shuffled_whole(corpus):
    _, index = corpus
    plan = search_index(index, "retry lock", 5)._jdf.queryExecution().toString()
    assert "StringStartsWith(term,retry)" in plan


def test_empty(spark, corpus):
    df, index = corpus
    assert search_index(index, "", 5).count() == 0 and search_index(index, "()", 5).count() == 0
    assert search_index(build_index(df.limit(0)), "lock", 5).count() == 0
    assert fetched(df, []).count() == 0 and fetched(df.unionByName(df), ["z1"]).count() == 1
