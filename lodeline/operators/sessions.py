"""Sessions of activity separated by gaps, merged from partial sessions of time chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions.times import with_instant
from lodeline.tables import table

GAP_MS = 1_800_000
CHUNK_SLOTS = 64


def directory_key(path: Column) -> Column:
    """Lower case, forward slashes, none at the end (of a path of slashes only, nothing remains)."""
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/+\z", ""))


def _merged(parts: DataFrame, keys: list[str], gap_ms: int) -> DataFrame:
    """Neighbouring partial sessions of one group joined; adds first_part and last_part of the group."""
    ordered = Window.partitionBy(*keys).orderBy("start_ms")
    opens = F.col("start_ms") - F.lag("end_ms").over(ordered) > gap_ms
    numbered = parts.withColumn("_new", F.coalesce(opens, F.lit(True)).cast("int")).withColumn(
        "_no", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    return numbered.groupBy(*keys, "_no").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n_events").alias("n_events")
    )


def sessions(events: DataFrame, key: str, at_ms: str, gap_ms: int = GAP_MS, chunk_slots: int = CHUNK_SLOTS) -> DataFrame:
    """(key, start_ms, end_ms, duration_ms, n_events), one row per session.

    A gap of more than ``gap_ms`` between neighbouring events of a key starts a new session.
    Time is divided into slots as wide as the gap; two events of a slot are never further
    apart than that, so a slot's partial session is its minimum, maximum and count, which
    Spark aggregates before it shuffles: a key with a third of all rows costs no more than its
    slots. Slots are merged within chunks of ``chunk_slots``, and only the first and the last
    partial session of a chunk, which alone can touch another chunk, are merged per key: at
    most two rows per chunk of the time span, whatever the number of events.

    Rows with a null key or time belong to no session; events at the same time and repeated
    rows count as often as they occur; an empty table gives no sessions; other columns of
    ``events`` are not read, whatever their names.
    """
    at, slot, chunk = F.col("_at"), F.col("_slot"), F.col("_chunk")
    slots = (
        events.select(F.col(key).alias("_key"), F.col(at_ms).cast("bigint").alias("_at"))
        .where("_key is not null and _at is not null")
        .withColumn("_slot", F.floor(at / gap_ms))
        .groupBy("_key", "_slot")
        .agg(F.min("_at").alias("start_ms"), F.max("_at").alias("end_ms"), F.count(F.lit(1)).alias("n_events"))
        .withColumn("_chunk", F.floor(slot / chunk_slots))
    )
    group = Window.partitionBy("_key", "_chunk")
    local = _merged(slots, ["_key", "_chunk"], gap_ms).withColumn("_last", F.max("_no").over(group))
    edge = (F.col("_no") == 1) | (F.col("_no") == F.col("_last"))
    columns = ["_key", "start_ms", "end_ms", "n_events"]
    whole = local.where(~edge).select(*columns)
    joined = _merged(local.where(edge).select(*columns), ["_key"], gap_ms).select(*columns)
    return whole.unionByName(joined).select(
        F.col("_key").alias(key), "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "n_events"
    )


def directory_events(spark, folder: str) -> DataFrame:
    """(dir_key, at_ms) of the hook log and the conversation turns that have a directory and an instant."""
    both = table(spark, folder, "hook_log").select("cwd", "ts").unionByName(table(spark, folder, "conversation_turns").select("cwd", "ts"))
    dated = with_instant(both.where("cwd is not null"), F.col("ts"), "at_ms").where("at_ms is not null and at_ms <> 0")
    return dated.select(directory_key(F.col("cwd")).alias("dir_key"), "at_ms")


def p1_found(spark, folder: str) -> DataFrame:
    return sessions(directory_events(spark, folder), "dir_key", "at_ms").select("dir_key", "start_ms", "end_ms")


def p1_sessions(spark, folder: str) -> DataFrame:
    return sessions(directory_events(spark, folder), "dir_key", "at_ms")


_SQL = r"""
with raw as (
    select cwd, ts from hook_log union all select cwd, ts from conversation_turns
), read as (
    select lower(regexp_replace(replace(cwd, '\', '/'), '/+$', '')) as dir_key, trim(ts) as t,
           '^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(?:[.,](\d+))? ?(Z|z|[+-]\d{2}:?\d{2})$' as p
    from raw where cwd is not null and ts is not null
), parts as (
    select dir_key, try_cast(regexp_extract(t, p, 1) || ' ' || regexp_extract(t, p, 2) as timestamp) as wall,
           cast(substr(rpad(regexp_extract(t, p, 3), 3, '0'), 1, 3) as bigint) as ms, regexp_extract(t, p, 4) as z
    from read where regexp_matches(t, p)
), zoned as (
    select dir_key, epoch_ms(wall) + ms as wall_ms,
           case when lower(z) = 'z' then 0 else
               (case when z[1] = '-' then -1 else 1 end) * (cast(substr(z, 2, 2) as bigint) * 60 + cast(right(z, 2) as bigint)) * 60000 end as off_ms
    from parts where wall is not null
), events_ms as (
    select dir_key, wall_ms - off_ms as at_ms from zoned where wall_ms - off_ms <> 0
), flagged as (
    select dir_key, at_ms, case when at_ms - lag(at_ms) over w > 1800000 or lag(at_ms) over w is null then 1 else 0 end as opens
    from events_ms window w as (partition by dir_key order by at_ms)
), numbered as (
    select dir_key, at_ms, sum(opens) over (partition by dir_key order by at_ms rows unbounded preceding) as no from flagged
), agg as (
    select dir_key, no, min(at_ms) as start_ms, max(at_ms) as end_ms, count(*) as n_events from numbered group by dir_key, no
)
"""
SQL = {
    "p1_found": _SQL + "select dir_key, start_ms, end_ms from agg",
    "p1_sessions": _SQL + "select dir_key, start_ms, end_ms, end_ms - start_ms as duration_ms, n_events from agg",
}
QUERIES = {"p1_found": p1_found, "p1_sessions": p1_sessions}
