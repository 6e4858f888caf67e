import pytest
from lodeline.llm.mixing import mix, p8_shares, solve
from lodeline.tables import table
from pyspark.sql import functions as F


def test_shares_of_the_tables(spark, folder):
    """Shares of all tokens come within a hundredth of their targets, among the sources that have documents; caps hold."""
    rows = p8_shares(spark, "/root/testdata/sf0.01").collect()
    had = sum(r.target_share for r in rows if r.tokens)
    assert all(abs(r.actual_share - r.target_share / had) < 0.01 for r in rows if r.tokens) and all(r.actual_share == 0 for r in rows if not r.tokens)
    assert all(r.most_repeats <= r.max_repeats for r in rows)
    assert {r.source for r in rows} == {r.source for r in table(spark, "/root/testdata/sf0.01", "mix_targets").collect()}


def test_no_silent_miss(spark):
    histogram = spark.createDataFrame([("a", 10, 5), ("a", 900, 2), ("b", 3, 100)], "source string, n_tokens bigint, n bigint")
    targets = [{"source": "a", "target_share": 0.99, "max_repeats": 9}, {"source": "b", "target_share": 0.01, "max_repeats": 3}]
    solved = {r[0]: r for r in solve(histogram, targets)}
    assert set(solved) == {"a", "b"}
    with pytest.raises(ArithmeticError):
        solve(histogram, targets, rounds=1)
    assert histogram.where(F.lit(False)).count() == 0


def test_shares(spark):
    counts = [(i, "a", 10 + i % 7) for i in range(300)] + [(1000 + i, "b", 30) for i in range(20)] + [(2000, "c", 5), (3000, None, 9), (4000, "a", 0)]
    df = spark.createDataFrame(counts, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.7, 2), ("b", 0.2, 3), ("none", 0.1, 2), (None, 0.5, 1), ("b", 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mix(df, targets)
    shares = {r.source: r for r in report.collect()}
    assert set(shares) == {"a", "b", "none"}
    assert shares["a"].actual_share == pytest.approx(7 / 9, abs=0.005) and shares["b"].actual_share == pytest.approx(2 / 9, abs=0.005)
    assert shares["none"].actual_share == 0 and shares["a"].most_repeats <= 2 and shares["b"].most_repeats <= 3
    rows = chosen.collect()
    assert all(r.copies >= 1 and r.source in "ab" and r.n_tokens > 0 for r in rows)
    assert sum(r.copies * r.n_tokens for r in rows) == sum(r.mixed_tokens for r in shares.values())
    assert {(r.doc_id, r.copies) for r in rows} == {(r.doc_id, r.copies) for r in mix(df, targets)[0].collect()}
    small, _ = mix(df, targets, total_tokens=900)
    assert sum(r.copies * r.n_tokens for r in small.collect()) == pytest.approx(900, rel=0.03)


def test_empty_mix(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mix(df, targets)
    assert chosen.count() == 0 and [r.actual_share for r in report.collect()] == [0.0]
    assert mix(df, targets.limit(0))[0].count() == 0
