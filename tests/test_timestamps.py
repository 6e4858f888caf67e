import itertools
import random

import pytest
from lodeline.operators.timestamps import Rules, _Path, choose, epoch_ms, with_readings
from pyspark.sql import functions as F

SCHEMA = "source string, ord bigint, key string, readings array<struct<fmt:string,instant_ms:bigint,cost:double>>"


def read(spark, rows, rules=Rules()):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, z string, f bigint")
    out = with_readings(df, F.col("t"), F.col("z"), F.col("f"), rules).orderBy("i").collect()
    return [[(x["instant_ms"], x["cost"]) for x in r.readings] for r in out]


def agreed(spark, text, zone=None, fallback=None):
    kept = [ms for ms, cost in read(spark, [(text, zone, fallback)])[0] if cost == 0]
    return kept[0] if kept else None


@pytest.mark.parametrize(
    ("text", "zone", "fallback", "want"),
    [
        ("2024-05-01T10:00:00.1239Z", None, None, 1714557600123),
        ("20240501T100000Z", None, None, 1714557600000),
        ("01.05.2024 10:00:00", "UTC", None, 1714557600000),
        ("5/1/2024 10:00:00 AM", "UTC", None, 1714557600000),
        ("13/1/2024 10:00:00 AM", "UTC", None, None),
        ("5/1/2024 12:00:00 AM", "UTC", None, 1714521600000),
        ("2024-05-01 10:00 ", "UTC", None, 1714557600000),
        ("Wed, 01 May 2024 10:00:00 +0200", None, None, 1714550400000),
        ("Wed May  1 10:00:00 2024 -0400", None, None, 1714572000000),
        ("2024-05-01T10:00:00+02:00[Europe/Berlin]", None, None, 1714550400000),
        ("2024-05-01 10:00:00 AEST", None, None, 1714521600000),
        ("1714557600", None, None, 1714557600000),
        ("1714557600.5", None, None, 1714557600500),
        ("1714557600123 -0500", None, None, 1714557600123),
        ("1714557600123456", None, None, 1714557600123),
        ("17145576", None, 7, 7),
        ("2024-10-27T02:30:00", "Europe/Berlin", None, 1729989000000),
        ("2024-03-31T02:30:00", "Europe/Berlin", None, 1711848600000),
        ("2024-05-01T10:00:00", None, None, None),
        ("2024-05-01T10:00:00", None, 42, 42),
        ("2024-13-05T08:00:00Z", "UTC", None, None),
        ("yesterday 14:10", "UTC", 5, 5),
        (None, "UTC", None, None),
        ("", None, 9, 9),
        ("2024-05-01T10:00:00", "No/Where", None, None),
    ],
)
def test_readings(spark, text, zone, fallback, want):
    assert agreed(spark, text, zone, fallback) == want


def test_repeated_wall_time_has_two_readings(spark):
    (both,) = read(spark, [("2024-10-27T02:30:00", "Europe/Berlin", None)])
    assert [ms for ms, _ in both] == [1729989000000, 1729992600000]


def test_epochs(spark):
    rows = [("946684799",), ("946684800",), ("4133980799",), ("0",), ("-5",), ("abc",), (None,)]
    out = [r[0] for r in spark.createDataFrame(rows, "n string").select(epoch_ms(F.col("n"))).collect()]
    assert out == [None, 946684800000, 4133980799000, None, None, None, None]


def total(path, states, pick):
    cost = states[0][pick[0]][2]
    for i in range(1, len(states)):
        a, b = states[i - 1][pick[i - 1]], states[i][pick[i]]
        cost += path.step(a, b) + b[2]
    return cost


def test_viterbi_over_blocks_equals_all_paths(spark):
    rng, rules = random.Random(5), Rules(switch=1.0, back=2.0, unread=3.0)
    path = _Path(rules)
    rows, want = [], {}
    for s in range(12):
        n = rng.randrange(1, 8)
        records = [[(rng.choice("xy"), rng.randrange(100), float(rng.choice([0, 0, 1.5]))) for _ in range(rng.randrange(3))] for _ in range(n)]
        rows += [(f"s{s}", i, f"{s}-{i}", r) for i, r in enumerate(records)]
        states = [path.states([x[0] for x in r], [x[1] for x in r], [x[2] for x in r]) for r in records]
        want[s] = min(total(path, states, p) for p in itertools.product(*(range(len(x)) for x in states)))
    df = spark.createDataFrame(rows, SCHEMA)
    for partitions, bits in ((1, 16), (3, 16), (17, 16), (2, 1), (1, 0)):
        got = {r.key: r.instant_ms for r in choose(df, rules, partitions, bits).collect()}
        assert len(got) == len(rows)
        for s in range(12):
            mine = [r for r in rows if r[0] == f"s{s}"]
            best = [[]]
            states = [path.states([x[0] for x in r[3]], [x[1] for x in r[3]], [x[2] for x in r[3]]) for r in mine]
            options = [[k for k, st in enumerate(states[i]) if st[1] == got[r[2]]] for i, r in enumerate(mine)]
            assert min(total(path, states, p) for p in itertools.product(*options)) == pytest.approx(want[s]), (s, best)


def test_order_decides_where_nothing_is_agreed(spark):
    open_ = Rules(slashes=None, switch=0.1)
    texts = ["1/2/2024 10:00", "2/2/2024 10:00", "13/2/2024 10:00", "14/2/2024 10:00"]
    df = spark.createDataFrame([("s", i, str(i), t) for i, t in enumerate(texts)], "source string, ord bigint, key string, t string")
    out = choose(with_readings(df, F.col("t"), F.lit("UTC"), F.lit(None), open_), open_, 2).orderBy("key").collect()
    assert [r.instant_ms for r in out] == [1706781600000, 1706868000000, 1707818400000, 1707904800000]


def test_empty_and_null(spark):
    assert choose(spark.createDataFrame([], SCHEMA)).count() == 0
    out = choose(spark.createDataFrame([(None, None, "k", None), (None, 1, None, [("f", 5, 0.0)]), (None, 1, None, [("f", 5, 0.0)])], SCHEMA)).collect()
    assert sorted((r.key or "", r.instant_ms or 0) for r in out) == [("", 5), ("", 5), ("k", 0)]
