import random

from lodeline.functions.times import with_instant
from lodeline.operators.sessions import directory_key, sessions
from pyspark.sql import functions as F


def brute(events, gap):
    out, by = set(), {}
    for k, t in events:
        if k is not None and t is not None:
            by.setdefault(k, []).append(t)
    for k, ts in by.items():
        ts.sort()
        start = last = ts[0]
        n = 1
        for t in ts[1:]:
            if t - last > gap:
                out.add((k, start, last, last - start, n))
                start, n = t, 0
            last, n = t, n + 1
        out.add((k, start, last, last - start, n))
    return out


def got(spark, events, gap, chunk_slots=64):
    df = spark.createDataFrame(events, "who string, at bigint")
    return {tuple(r) for r in sessions(df, "who", "at", gap, chunk_slots).collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    events = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice([None, rng.randrange(-4000, 40_000)])) for _ in range(900)]
    for gap, slots in ((10, 2), (37, 64), (200, 3)):
        assert got(spark, events, gap, slots) == brute(events, gap)


def test_gap_is_inclusive_ties_and_repeats(spark):
    assert got(spark, [("a", 0), ("a", 10), ("a", 10), ("a", 21)], 10) == {("a", 0, 10, 10, 3), ("a", 21, 21, 0, 1)}
    assert got(spark, [("a", 9), ("a", 19)], 10) == {("a", 9, 19, 10, 2)}
    assert got(spark, [], 10) == set()


def test_clashing_columns_are_not_read(spark):
    df = spark.createDataFrame([("a", 1, "x", 5, 6, 7)], "who string, at bigint, _key string, start_ms int, _slot int, n_events int")
    assert [tuple(r) for r in sessions(df, "who", "at").collect()] == [("a", 1, 1, 0, 1)]


def test_instants_and_directories(spark):
    rows = [
        ("2018-03-01T02:08:06.8079Z", 1519870086807), ("2018-03-01T02:08:06+05:45", 1519849386000), ("2018-02-28t22:35:12,9-0330", 1519869912900), (" 2018-03-01T02:08:06Z ", 1519870086000),
        ("2018-03-01T02:08:06", None), ("2018-13-01T02:08:06Z", None), ("2018-03-01T02:08Z", None), ("", None), (None, None), ("1970-01-01T00:00:00Z", 0), ("2018-03-01T02:08:06+19:00", None), ("2018-03-01 02:08:06 EST", 1519888086000),
    ]
    df = with_instant(spark.createDataFrame(rows, "t string, want bigint"), F.col("t"), "ms")
    assert [(r.t, r.ms) for r in df.collect()] == rows
    keys = spark.createDataFrame([("C:\\Work\\A\\",), ("c:/work/a",), ("/",), (None,)], "p string").select(directory_key(F.col("p"))).collect()
    assert [r[0] for r in keys] == ["c:/work/a", "c:/work/a", "", None]
