"""Column expressions that read written times without the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Minutes east of UTC of the zone abbreviations that are read.
ABBREVIATIONS = {
    "UTC": 0,
    "GMT": 0,
    "Z": 0,
    "CET": 60,
    "CEST": 120,
    "EST": -300,
    "EDT": -240,
    "AEST": 600,
    "AEDT": 660,
}

ZONE = r"(Z|z|[+-]\d{2}:?\d{2}|UTC|GMT|CEST|CET|EST|EDT|AEST|AEDT)"
INSTANT = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(?:[.,](\d+))? ?" + ZONE + r"\z"


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^[\s ﻿]+|[\s ﻿]+\z", "")


def wall_ms(date_and_time: Column, fraction: Column) -> Column:
    """Milliseconds of ``YYYY-MM-DDTHH:MM:SS`` told as if in UTC; null for impossible ones.

    ``fraction`` holds the digits after the second; those finer than milliseconds are cut off.
    """
    seconds = F.unix_seconds(F.concat(date_and_time, F.lit("Z")).try_cast("timestamp"))
    digits = F.substring(F.rpad(F.coalesce(fraction, F.lit("")), 3, "0"), 1, 3)
    return seconds * 1000 + digits.try_cast("bigint")


def offset_ms(zone: Column) -> Column:
    """Offset of ``+hh:mm``, ``+hhmm`` or an abbreviation; null for anything else or beyond 18 hours."""
    named = F.create_map(*[F.lit(x) for name, value in ABBREVIATIONS.items() for x in (name, value)])
    digits = F.concat(F.substring(zone, 1, 1), F.lpad(F.regexp_replace(zone, r"\D", ""), 4, "x")).try_cast("int")
    told = F.when(zone.rlike(r"^[+-](?:0\d|1[0-7]):?[0-5]\d\z|^[+-]18:?00\z"), F.floor(digits / 100) * 60 + F.pmod(digits, F.lit(100)))
    early = F.when(zone.rlike(r"^-(?:0\d|1[0-7]):?[0-5]\d\z|^-18:?00\z"), -(F.floor(-digits / 100) * 60 + F.pmod(-digits, F.lit(100))))
    return F.coalesce(early, told, named[F.upper(zone)]).cast("bigint") * 60_000


def with_instant(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds ``name``: UTC milliseconds of an ISO time with date, time to the second and zone; null for all else.

    The steps are columns of their own, so that the pattern is matched once a row.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    t = F.col("__t")
    put = F.when(t.rlike(INSTANT), F.split(F.regexp_replace(t, INSTANT, "$1T$2|$3|$4"), r"\|", -1))
    parts = df.select(*kept, stripped(text).alias("__t")).select(*kept, put.alias("__p"))
    read = parts.select(*kept, F.col("__p")[0].alias("__wall"), F.col("__p")[1].alias("__fraction"), F.col("__p")[2].alias("__zone"))
    stages = read.select(*kept, wall_ms(F.col("__wall"), F.col("__fraction")).alias("__ms"), offset_ms(F.col("__zone")).alias("__offset"))
    # An array and its explosion keep Spark from repeating the whole expression in every filter on the result.
    return stages.select(*kept, F.explode(F.array(F.col("__ms") - F.col("__offset"))).alias(name))
