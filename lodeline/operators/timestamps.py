"""Mixed time formats to one UTC instant: every valid reading per value, chosen by Viterbi over record order."""

from __future__ import annotations

import zoneinfo
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.times import ABBREVIATIONS, ZONE, offset_ms, stripped, wall_ms
from lodeline.tables import cut, discard, kept_in_order, table

EXACT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z\z"
#: Milliseconds of 2000-01-01 and 2101-01-01: an epoch count must lie between them in its unit.
EPOCH_FROM, EPOCH_TO = 946_684_800_000, 4_133_980_800_000
#: Records of one block of a source's order: what a task holds at a time. Two to the power of BLOCK_BITS.
BLOCK_BITS = 16
#: Blocks whose entries and exits are broadcast; more of them are joined.
BROADCAST_BLOCKS = 500_000
#: Records of one range partition, as many as are worth a task.
PARTITION_RECORDS = 1_000_000
MONTHS = {m: i + 1 for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))}

_Z = rf"(?: ?{ZONE})?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
#: name, pattern, and its groups put into the order year|month|day|hour|minute|second|fraction|half|zone|region
_SHAPES = (
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[Tt ]{_TIME}{_Z}(?:\[([^\]]+)\])?\z", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    ("basic", rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})?{_Z}\z", "$1|$2|$3|$4|$5|$6|||$7|"),
    ("dots", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? {_TIME}{_Z}\z", "$3|$2|$1|$4|$5|$6|$7||$8|"),
    ("slashes", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? {_TIME}(?: ?([AaPp])[Mm])?{_Z}\z", "$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
    ("mail", rf"^(?:[A-Za-z]{{3}}, ?)?(\d{{1,2}}) ([A-Za-z]{{3}}) (\d{{4}}) {_TIME}{_Z}\z", "$3|$2|$1|$4|$5|$6|$7||$8|"),
    ("ctime", rf"^[A-Za-z]{{3}} ([A-Za-z]{{3}}) +(\d{{1,2}}) {_TIME} (\d{{4}}){_Z}\z", "$7|$1|$2|$3|$4|$5|$6||$8|"),
)
_EPOCH = r"^(\d{9,17})(?:[.,](\d+))?(?: ?(?:Z|[+-]\d{2}:?\d{2}))?\z"

READING = "struct<fmt:string,instant_ms:bigint,cost:double>"


@dataclass(frozen=True)
class Rules:
    """What is agreed about ambiguous values; a reading against it costs ``against``.

    ``slashes`` and ``dots`` are 'mdy' or 'dmy', or None where nothing is agreed; ``fold`` is the
    agreed one of the two instants of a repeated wall time (0 the first), or None. ``unread`` is what
    it costs to leave a value unread, ``switch`` what a change of format from one record to the next
    costs, ``back`` what a step back in time costs.
    """

    slashes: str | None = "mdy"
    dots: str | None = "dmy"
    fold: int | None = 0
    switch: float = 1.0
    back: float = 2.0
    unread: float = 1e6
    against: float = 2e6


def _reading(fmt: str, instant: Column, cost: float) -> Column:
    name = F.lit(fmt) if fmt not in ("written", "written+") else F.concat(F.col("__shape"), F.lit(fmt[7:]))
    return F.struct(name.alias("fmt"), instant.cast("bigint").alias("instant_ms"), F.lit(float(cost)).alias("cost"))


def _zones() -> list[str]:
    return sorted(zoneinfo.available_timezones())


def epoch_ms(count: Column, fraction: Column | None = None) -> Column:
    """Milliseconds of an epoch count in seconds, milliseconds or microseconds, whichever lies in 2000-2100."""
    n = count.try_cast("bigint")
    digits = F.lit(0) if fraction is None else F.substring(F.rpad(F.coalesce(fraction, F.lit("")), 3, "0"), 1, 3).try_cast("bigint")
    known = lambda ms: (ms >= EPOCH_FROM) & (ms < EPOCH_TO)
    seconds = F.when(n.between(EPOCH_FROM // 1000, EPOCH_TO // 1000 - 1), n * 1000 + digits)
    return F.coalesce(seconds, F.when(known(n), n), F.when(known(F.floor(n / 1000)), F.floor(n / 1000)))


def with_readings(df: DataFrame, text: Column, zone: Column, fallback_ms: Column, rules: Rules = Rules()) -> DataFrame:
    """Adds ``readings``: the array of every valid reading of a written time, none if it is unreadable.

    A zone in the text decides; without one, ``zone`` (an IANA name) is applied, in which a skipped
    wall time counts with the offset before the change and a repeated one has two instants; where
    ``zone`` is null, ``fallback_ms`` (may be null) settles it, as it does for unreadable text.
    Numbers are epoch counts. Impossible dates are unreadable. The steps are columns of their own,
    so that Spark evaluates each pattern once a row.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c != "readings"]
    t = F.col("__t")
    put = F.lit(None).cast("string")
    for shape, pattern, order in _SHAPES:
        put = F.when(t.rlike(pattern), F.concat(F.lit(shape + "|"), F.regexp_replace(t, pattern, order))).otherwise(put)
    df = df.select(*kept, stripped(text).alias("__t"), zone.cast("string").alias("__zone"), fallback_ms.cast("bigint").alias("__fallback"))
    counted = F.when(t.rlike(_EPOCH), epoch_ms(F.regexp_extract(t, _EPOCH, 1), F.regexp_extract(t, _EPOCH, 2)))
    df = df.select(*kept, "__zone", "__fallback", F.split(put, r"\|", -1).alias("__p"), counted.alias("__counted"))

    get = lambda i: F.col("__p")[i + 1]
    month = get(1)
    for name, no in MONTHS.items():
        month = F.when(F.lower(get(1)) == name, F.lit(str(no))).otherwise(month)
    hour, half = get(3).try_cast("int"), F.lower(get(7))
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    zones = _zones()
    machine = F.coalesce(F.when(get(9).isin(zones), get(9)), F.when(F.col("__zone").isin(zones), F.col("__zone")))
    two = lambda c: F.lpad(c, 2, "0")
    clock = F.concat(F.lit("T"), two(hour.cast("string")), F.lit(":"), two(get(4)), F.lit(":"), F.when(get(5) == "", "00").otherwise(get(5)))
    df = df.select(
        *kept, "__fallback", "__counted", get(-1).alias("__shape"), F.lpad(get(0), 4, "0").alias("__year"), two(month).alias("__month"),
        two(get(2)).alias("__day"), clock.alias("__clock"), get(6).alias("__fraction"), (get(8) != "").alias("__told"),
        offset_ms(get(8)).alias("__offset"), machine.alias("__machine"),
    )
    wall = lambda m, d: wall_ms(F.concat("__year", F.lit("-"), m, F.lit("-"), d, "__clock"), F.col("__fraction"))
    swaps = F.col("__shape").isin("slashes", "dots")
    df = df.withColumn("__wall", wall(F.col("__month"), F.col("__day"))).withColumn("__swapped", F.when(swaps, wall(F.col("__day"), F.col("__month"))))

    at = F.col("__machine")
    to_utc = lambda ms: F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(ms), at))
    to_wall = lambda ms: F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(ms), at))
    for local in ("__wall", "__swapped"):
        df = df.withColumn(f"{local}_first", F.when(~F.col("__told"), to_utc(F.col(local))))
    found: list[Column] = []
    against = lambda agreed, order: rules.against if agreed not in (None, order) else 0.0

    def both(fmt: str, local: str, when: Column, cost: float) -> None:
        """The told or first instant, and the second one of a repeated wall time."""
        wall_at, first = F.col(local), F.col(f"{local}_first")
        instant = F.when(F.col("__told"), wall_at - F.col("__offset")).when(at.isNotNull(), first).otherwise(F.col("__fallback"))
        later = F.coalesce(*[F.when(to_wall(first + d) == wall_at, first + d) for d in (1_800_000, 3_600_000)])
        usable = when & wall_at.isNotNull()
        found.append(F.when(usable, _reading(fmt, instant, cost + (rules.against if rules.fold == 1 else 0))))
        found.append(F.when(usable & ~F.col("__told") & at.isNotNull(), _reading(fmt + "+", later, cost + (rules.against if rules.fold == 0 else 0))))

    both("written", "__wall", ~swaps, 0.0)
    for shape, agreed, told, other in (("slashes", rules.slashes, "mdy", "dmy"), ("dots", rules.dots, "dmy", "mdy")):
        both(f"{shape} {told}", "__wall", F.col("__shape") == shape, against(agreed, told))
        both(f"{shape} {other}", "__swapped", F.col("__shape") == shape, against(agreed, other))
    found.append(F.when(F.col("__counted").isNotNull(), _reading("epoch", F.col("__counted"), 0.0)))
    df = df.select(*kept, "__fallback", F.filter(F.array(*found), lambda r: r.isNotNull() & r["instant_ms"].isNotNull()).alias("__valid"))
    agreed = F.exists("__valid", lambda r: r["cost"] < rules.against)
    rest = F.when(~agreed & F.col("__fallback").isNotNull(), F.array(_reading("fallback", F.col("__fallback"), 0.0)))
    return df.select(*kept, F.concat("__valid", F.coalesce(rest, F.array().cast(f"array<{READING}>"))).alias("readings"))


class _Path:
    """Least cost to each reading of the last record, from each reading of an entry record."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def states(self, fmts, ms, costs):
        """The record's readings, and last the state of leaving it unread."""
        n = 0 if fmts is None else len(fmts)
        return [(fmts[i], int(ms[i]), float(costs[i])) for i in range(n)] + [(None, None, self.rules.unread)]

    def step(self, a, b) -> float:
        if a[1] is None or b[1] is None:
            return 0.0
        return self.rules.switch * (a[0] != b[0]) + self.rules.back * (b[1] < a[1])

    def steps(self, before, after) -> np.ndarray:
        return np.array([[self.step(a, b) + b[2] for b in after] for a in before])


def _minplus(m: np.ndarray, s: np.ndarray) -> np.ndarray:
    return (m[:, :, None] + s[None, :, :]).min(axis=1)


def _runs(frames, columns):
    """(source, block, rows) of one block in this partition, in order; every row as the tuple of ``columns``, which begin with both."""
    key, rows = None, []
    for frame in frames:
        for row in zip(*(frame[c] for c in columns), strict=True):
            if row[:2] != key and rows:
                yield *key, rows
                rows = []
            key = row[:2]
            rows.append(row)
    if rows:
        yield *key, rows


def choose(records: DataFrame, rules: Rules = Rules(), partitions: int | None = None, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(source, key, instant_ms) of every row of ``records`` (source, ord, key, readings).

    Within each source, in the order of ``ord`` and ``key``, the cheapest sequence of readings is
    chosen by Viterbi. The order is cut into range partitions, as many as the records need, and these into
    blocks of at most 2 ** ``block_bits`` records, so that a source with a third of all rows is spread
    like any other and a task holds one block at a time. Each block folds its rows into a min-plus matrix
    from the readings of its first record to those of its last, the small matrices of a source's blocks
    are chained, and each block is then traced back by itself from the exit so found. The result is
    that of one pass over the whole source.

    Records without readings get a null instant; ties take the reading generated first; an empty table
    gives no rows; null sources form one source of their own; records with a null ``ord`` come first.
    """
    spark = records.sparkSession
    # Readings are made once: their range bounds are sampled from the written table.
    read = cut(
        records.select(
            F.coalesce("source", F.lit("")).alias("source"), "ord", F.col("key").cast("string").alias("key"),
            F.col("readings")["fmt"].alias("fmts"), F.col("readings")["instant_ms"].alias("ms"), F.col("readings")["cost"].alias("costs"),
        )
    )
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read.count() // PARTITION_RECORDS))
    place = F.monotonically_increasing_id()  # partition, and place in it
    blocks = kept_in_order(read.repartitionByRange(n, "source", "ord", "key").sortWithinPartitions("source", "ord", "key").withColumn("block", F.shiftright(place, block_bits)))
    discard(read)
    columns = ["source", "block", "key", "fmts", "ms", "costs"]

    def fold(frames):
        path = _Path(rules)
        for source, block, rows in _runs(frames, columns):
            first = before = path.states(*rows[0][3:])
            total = np.where(np.eye(len(first), dtype=bool), [s[2] for s in first], np.inf)
            for row in rows[1:]:
                after = path.states(*row[3:])
                total = _minplus(total, path.steps(before, after))
                before = after
            pack = lambda states: ([s[0] for s in states], [s[1] for s in states], [s[2] for s in states])
            yield pd.DataFrame([(source, int(block), len(first), len(before), total.ravel().tolist(), *pack(first), *pack(before))], columns=_FOLDED)

    _FOLDED = ["source", "block", "n_first", "n_last", "costs", "f_fmt", "f_ms", "f_cost", "l_fmt", "l_ms", "l_cost"]
    folded = blocks.mapInPandas(
        fold,
        "source string, block bigint, n_first int, n_last int, costs array<double>, f_fmt array<string>, f_ms array<bigint>, f_cost array<double>,"
        " l_fmt array<string>, l_ms array<bigint>, l_cost array<double>",
    )

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        """Entry and exit reading of each block of one source."""
        path, frame = _Path(rules), frame.sort_values("block")
        rows = frame.to_dict("records")
        clean = lambda r, k: [(f, None if m is None or m != m else int(m), c) for f, m, c in zip(r[f"{k}_fmt"], r[f"{k}_ms"], r[f"{k}_cost"], strict=True)]
        inner = [np.array(r["costs"], dtype=float).reshape(r["n_first"], r["n_last"]) for r in rows]
        best, back = inner[0].min(axis=0), [inner[0].argmin(axis=0)]
        joins = []
        for i in range(1, len(rows)):
            link = np.array([[path.step(a, b) for b in clean(rows[i], "f")] for a in clean(rows[i - 1], "l")])
            entry_cost = (best[:, None] + link).min(axis=0)
            joins.append((best[:, None] + link).argmin(axis=0))
            reach = entry_cost[:, None] + inner[i]
            best = reach.min(axis=0)
            back.append(reach.argmin(axis=0))
        leave = int(best.argmin())
        out = []
        for i in range(len(rows) - 1, -1, -1):
            enter = int(back[i][leave])
            out.append((rows[i]["source"], int(rows[i]["block"]), enter, leave))
            if i:
                leave = int(joins[i - 1][enter])
        return pd.DataFrame(out, columns=["source", "block", "enter", "leave"])

    # Sources that lie in several blocks; one row each, and a source's rows are a few numbers a block.
    spans = cut(
        folded.groupBy("source").applyInPandas(
            lambda frame: chain(frame) if len(frame) > 1 else pd.DataFrame(columns=["source", "block", "enter", "leave"]),
            "source string, block bigint, enter int, leave int",
        )
    )
    if spans.count() <= BROADCAST_BLOCKS:
        told = blocks.join(F.broadcast(spans), ["source", "block"], "left")  # the order of the rows stays
    else:
        told = blocks.join(spans, ["source", "block"], "left").repartition("source", "block").sortWithinPartitions("source", "block", "ord", "key")

    def trace(frames):
        path = _Path(rules)
        for source, _, rows in _runs(frames, [*columns, "enter", "leave"]):
            before = path.states(*rows[0][3:6])
            enter, leave = rows[0][6], rows[0][7]
            cost = np.array([s[2] for s in before])
            if enter is not None and enter == enter:
                cost = np.where(np.arange(len(before)) == int(enter), cost, np.inf)
            seen, backs = [before], []
            for row in rows[1:]:
                after = path.states(*row[3:6])
                reach = cost[:, None] + path.steps(before, after)
                backs.append(reach.argmin(axis=0))
                cost, before = reach.min(axis=0), after
                seen.append(after)
            at = int(leave) if leave is not None and leave == leave else int(cost.argmin())
            chosen = [None] * len(rows)
            for i in range(len(rows) - 1, -1, -1):
                chosen[i] = seen[i][at][1]
                if i:
                    at = int(backs[i - 1][at])
            yield pd.DataFrame({"source": source, "key": [r[2] for r in rows], "instant_ms": pd.array(chosen, dtype="Int64")})

    return told.mapInPandas(trace, "source string, key string, instant_ms bigint")


def record_readings(spark, folder: str, rules: Rules = Rules()) -> DataFrame:
    """(source, ord, key, record_set, exact, ts_epoch, readings) of the shell entries and the nodes."""
    null = lambda kind: F.lit(None).cast(kind)
    shell = table(spark, folder, "shell_entries").select(
        F.lit("shell_entries").alias("record_set"), F.col("shell").alias("origin"), F.col("entry_id").alias("ord"),
        F.col("entry_id").cast("string").alias("key"), "ts", F.col("host_zone").alias("zone"), null("bigint").alias("ts_epoch"),
    )
    nodes = table(spark, folder, "nodes").select(
        F.lit("nodes").alias("record_set"), F.col("source").alias("origin"), F.col("created_at").alias("ord"),
        F.col("node_id").alias("key"), "ts", null("string").alias("zone"), "ts_epoch",
    )
    records = with_readings(shell.unionByName(nodes), F.col("ts"), F.col("zone"), epoch_ms(F.col("ts_epoch")), rules)
    return records.select(
        F.concat_ws("/", "record_set", F.coalesce("origin", F.lit(""))).alias("source"), "ord", "key", "record_set", "ts_epoch",
        F.coalesce(F.col("ts").rlike(EXACT), F.lit(False)).alias("exact"), "readings",
    )


def p3_free(spark, folder: str) -> DataFrame:
    """(record_set, record_key, instant_ms) where nothing is agreed about slashes and dots: the path through each source's order decides."""
    chosen = choose(record_readings(spark, folder, Rules(slashes=None, dots=None)))
    told = chosen.where("instant_ms is not null").select(F.substring_index("source", "/", 1).alias("record_set"), F.col("key").alias("record_key"), "instant_ms")
    return told.groupBy("record_set", "record_key").agg(F.min("instant_ms").alias("instant_ms"))


def p3_instants(spark, folder: str) -> DataFrame:
    """(record_set, record_key, instant_ms) of every record whose instant is known."""
    chosen = choose(record_readings(spark, folder))
    return (
        chosen.where("instant_ms is not null")
        .select(F.substring_index("source", "/", 1).alias("record_set"), F.col("key").alias("record_key"), "instant_ms")
        .groupBy("record_set", "record_key")
        .agg(F.min("instant_ms").alias("instant_ms"))
    )


def p3_found(spark, folder: str) -> DataFrame:
    records = record_readings(spark, folder)
    # A record that is exact and whose count agrees needs no repair; it still takes part in its source's order.
    marked = records.withColumn(
        "key", F.concat(F.when(F.col("exact") & ((F.col("record_set") != "nodes") | F.coalesce(F.col("ts_epoch") == F.col("readings")[0]["instant_ms"], F.lit(False))), F.lit("=")).otherwise(F.lit("~")), "key")
    )
    chosen = choose(marked)
    return (
        chosen.where("instant_ms is not null and key like '~%'")
        .select(F.substring_index("source", "/", 1).alias("record_set"), F.expr("substr(key, 2)").alias("record_key"), "instant_ms")
        .groupBy("record_set", "record_key")
        .agg(F.min("instant_ms").alias("instant_ms"))
    )


QUERIES = {"p3_found": p3_found, "p3_instants": p3_instants, "p3_free": p3_free}
_FIELDS = ("year", "month", "day", "hour", "minute", "second", "fraction", "half", "zone_told", "region")
_LISTED_MONTHS = "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"


def _shape_sql(pattern: str, order: str) -> str:
    taken = [f"regexp_extract(t, '{pattern}', {part[1:]}) as {name}" if part else f"'' as {name}" for part, name in zip(order.split("|"), _FIELDS, strict=True)]
    return f"select record_set, record_key, ts, t, te, zone, {', '.join(taken)} from r where regexp_matches(t, '{pattern}')"


def _epoch_sql(count: str, fraction: str = "0") -> str:
    low, high = EPOCH_FROM, EPOCH_TO
    return f"case when {count} >= {low // 1000} and {count} < {high // 1000} then {count} * 1000 + {fraction} when {count} >= {low} and {count} < {high} then {count} when {count} // 1000 >= {low} and {count} // 1000 < {high} then {count} // 1000 end"


_digits = "cast(substr(rpad({}, 3, '0'), 1, 3) as bigint)"
_named = " ".join(f"when '{name}' then {minutes}" for name, minutes in ABBREVIATIONS.items())
_bare = r"regexp_replace(ts, '^[\s\x{a0}\x{feff}]+|[\s\x{a0}\x{feff}]+$', '', 'g')"
_INSTANTS = f"""with r as (
    select 'shell_entries' as record_set, cast(entry_id as varchar) as record_key, ts, {_bare} as t, host_zone as zone, null::bigint as te from shell_entries
    union all select 'nodes', node_id, ts, {_bare}, null, ts_epoch from nodes),
shaped as ({" union all ".join(_shape_sql(pattern, order) for _, pattern, order in _SHAPES)}),
clock as (select *, try_cast(lpad(year, 4, '0') || '-' || lpad(coalesce(cast(list_position({_LISTED_MONTHS}, lower(month)) as varchar), month), 2, '0') || '-' || lpad(day, 2, '0') || ' '
    || lpad(cast(case lower(half) when '' then cast(hour as int) when 'p' then cast(hour as int) % 12 + 12 else cast(hour as int) % 12 end as varchar), 2, '0') || ':' || minute || ':' || coalesce(nullif(second, ''), '00') as timestamp) as wall,
    {_digits.format("fraction")} as ms, case when region in (select name from pg_timezone_names()) then region when zone in (select name from pg_timezone_names()) then zone end as machine from shaped),
placed as (select *, epoch_ms(wall) + ms as wall_ms, case when zone_told = '' then null when regexp_matches(zone_told, '^[+-]') then
    (case when zone_told[1] = '-' then -1 else 1 end) * (cast(substr(zone_told, 2, 2) as int) * 60 + cast(right(zone_told, 2) as int)) else case upper(zone_told) {_named} end end as minutes,
    epoch_ms(timezone(machine, wall)) as at_ms from clock where wall is not null),
written as (select record_set, record_key, ts, te, case when minutes is not null then wall_ms - minutes * 60000 when machine is not null then
    (case when timezone(machine, make_timestamptz((at_ms - 3600000) * 1000)) = wall then at_ms - 3600000 when timezone(machine, make_timestamptz((at_ms - 1800000) * 1000)) = wall then at_ms - 1800000 else at_ms end) + ms
    else {_epoch_sql("te")} end as instant_ms from placed),
counted as (select record_set, record_key, ts, te, {_epoch_sql("n", "f")} as instant_ms from (select *, try_cast(regexp_extract(t, '{_EPOCH}', 1) as bigint) as n, {_digits.format(f"regexp_extract(t, '{_EPOCH}', 2)")} as f from r where regexp_matches(t, '{_EPOCH}'))),
told as (select * from written where instant_ms is not null union all select * from counted where instant_ms is not null),
rest as (select record_set, record_key, ts, te, {_epoch_sql("te")} as instant_ms from r where (record_set, record_key, coalesce(ts, '')) not in (select (record_set, record_key, coalesce(ts, '')) from told)),
every as (select *, regexp_matches(coalesce(ts, ''), '{EXACT}') as exact from (select * from told union all select * from rest where instant_ms is not null))
"""
SQL = {
    "p3_instants": _INSTANTS + "select record_set, record_key, min(instant_ms) as instant_ms from every group by record_set, record_key",
    "p3_found": _INSTANTS + "select record_set, record_key, min(instant_ms) as instant_ms from every where not exact or record_set = 'nodes' and te is distinct from instant_ms group by record_set, record_key",
}
