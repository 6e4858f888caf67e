import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodeline.llm.splitting import RangeMax, pieces, split_items, strengths

ITEM = "item_set string, item_key string, heading string, text string, size_unit string"
LIMIT = "item_set string, size_unit string, max_size bigint, overlap_size bigint"


@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.data())
@settings(max_examples=60, deadline=None)
def test_range_max_breaks_ties_rightward(values, data):
    low = data.draw(st.integers(0, len(values) - 1))
    high = data.draw(st.integers(low, len(values) - 1))
    best = max(range(low, high + 1), key=lambda i: (values[i], i))
    assert RangeMax(np.array(values, dtype=np.int8)).query(low, high) == best


@given(st.text(alphabet=st.sampled_from("ab .\n\r。é字👩‍"), max_size=300), st.integers(1, 40), st.integers(0, 50), st.sampled_from(["chars", "bytes"]))
@settings(max_examples=300, deadline=None)
def test_pieces_cover_overlap_and_keep_the_limit(text, limit, overlap, unit):
    overlap = min(overlap, limit - 1)
    size = len if unit == "chars" else lambda s: len(s.encode())
    cut = pieces(text, limit, overlap, unit)
    assert cut[0][0] == 0 and cut[-1][1] == len(text)
    for a, b in cut:
        assert size(text[a:b]) <= limit or b - a == 1
    for (a, b), (c, d) in zip(cut, cut[1:], strict=False):
        assert a < c <= b < d
        assert size(text[c:b]) <= overlap
        if unit == "chars":
            assert b - c == overlap


def test_cuts_at_the_strongest_boundary():
    text = "one two. " * 6 + "\n\n" + "three four five. " * 6
    (a, b), *_ = pieces(text, 80, 0, "chars")
    assert text[:b].endswith("\n\n")
    assert strengths("ab")[1] == 1 and strengths("a\r\n")[2] == 0


def test_long_text_without_boundary():
    text = "x" * 200_000
    cut = pieces(text, 1000, 10, "chars")
    assert len(cut) == -(-(len(text) - 10) // 990) and all(b - a <= 1000 for a, b in cut)


def test_items(spark):
    items = spark.createDataFrame([("s", "1", None, "aaaa bbbb", "clash"), ("s", "1", None, "aaaa bbbb", "clash"), ("s", "2", "h", None, ""), ("s", "3", "h", "", ""), ("s", "4", "h", "short", ""), ("t", "5", "h", "x" * 99, ""), ("b", "6", "h", "字字字", "")], ITEM)
    limits = spark.createDataFrame([("s", "chars", 5, 0), ("b", "bytes", 6, 3)], LIMIT)
    out = sorted((r.item_set, r.item_key, r.piece_no, r.start_pos, r.end_pos, r.piece_text) for r in split_items(items, limits).collect())
    assert out == [("b", "6", 0, 0, 2, "字字"), ("b", "6", 1, 1, 3, "字字"), ("s", "1", 0, 0, 5, "aaaa "), ("s", "1", 1, 5, 9, "bbbb")]
    assert split_items(items.limit(0), limits).count() == 0 and split_items(items, limits.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["p5_found"])
def test_sql(spark, folder, name):
    import glob
    import os

    import duckdb
    from lodeline.llm import queries

    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    assert sorted(con.execute(queries.SQL[name]).fetchall()) == sorted(tuple(r) for r in queries.QUERIES[name](spark, folder).select("item_set", "item_key").collect())


@pytest.mark.parametrize("unit", ["chars", "bytes"])
def test_a_strong_boundary_early_in_the_window_wins(unit):
    """A blank line in the first third isn't lost to a plain blank later."""
    text = "one two\n\n" + "three four five " * 10
    (a, b), (c, d), *_ = pieces(text, 60, 0, unit)
    assert (a, text[a:b]) == (0, "one two\n\n") and c == b and d - c <= 60
