"""Hook logs as they are written: landed files to a table, each event once, and sessions of a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeline.functions.times import with_instant
from lodeline.operators.sessions import directory_key
from lodeline.operators.sessions import _SQL as _SESSIONS
from lodeline.sources.shell import hook_entry
from lodeline.tables import shared_folder


DAY = "event_day"


def day_of(ts: Column) -> Column:
    """The day as written, 'none' where a time doesn't begin with one."""
    return F.when(ts.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(ts, 1, 10)).otherwise("none")


def hook_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Entries of the JSON lines of a folder in which whole files land; torn lines are left out."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return keyed(lines.withColumn("e", hook_entry(F.col("value"))).where("e is not null").select("e.*"))


def keyed(entries: DataFrame) -> DataFrame:
    """Adds event_key, the digest of what an entry says: a replay has the same keys."""
    key = F.substring(F.sha2(F.concat_ws("\0", "ts", "cwd", "command"), 256), 1, 24)
    return entries.withColumn("event_key", key)


def ingest(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends entries whose key isn't in the Parquet table at ``table``, partitioned by day, and ends when all that has landed is read.

    The cursor is the stream's checkpoint, which moves on only after a batch is written; a batch that is
    written twice after a failure finds its own keys and adds nothing.
    """

    def write(batch: DataFrame, _no: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in ("event_key", DAY)]
        # Of copies that differ in what the key leaves out, the smallest: the same one whatever the order.
        fresh = batch.groupBy("event_key").agg(F.min(F.struct(*rest)).alias("_r")).select("event_key", "_r.*").withColumn(DAY, day_of(F.col("ts")))
        if _exists(spark, table):
            # A copy has the same time as written, so only the days at hand are looked at.
            days = [r[0] for r in fresh.select(DAY).distinct().collect()]
            stored = spark.read.schema(f"event_key string, {DAY} string").parquet(table).where(F.col(DAY).isin(days)).select("event_key")
            fresh = fresh.join(stored, "event_key", "left_anti")
        fresh.write.mode("append").partitionBy(DAY).parquet(table)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path))


def session_stream(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(dir_key, start, end, n_events) by Spark's session windows, for a stream; events later than ``late`` are left out."""
    dated = with_instant(stream, F.col("ts"), "at_ms").where("at_ms is not null")
    timed = dated.select(directory_key(F.col("cwd")).alias("dir_key"), F.timestamp_millis("at_ms").alias("at")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap), "dir_key").agg(F.count(F.lit(1)).alias("n_events")).select("dir_key", "session_window.start", "session_window.end", "n_events")


def live_failures(stream: DataFrame) -> DataFrame:
    """Entries worth a look into the store: they failed, say so with any confidence (a column, if there is one), and have a command. An unknown exit code is none."""
    sure = F.col("confidence") > 0 if "confidence" in stream.columns else F.lit(True)
    return stream.where((F.col("exitCode") != 0) & sure & (F.trim(F.coalesce("command", F.lit(""))) != ""))


def worth_telling(matched: Column, text: Column) -> Column:
    """Whether what was found is worth a message: something matched, and there is text to show."""
    return (matched > 0) & (F.trim(F.coalesce(text, F.lit(""))) != "")


def _landed(spark: SparkSession, folder: str) -> str:
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    log = spark.read.parquet(f"{folder}/hook_log.parquet").where("ts is not null and cwd is not null and command is not null")
    log.select("ts", "cwd", F.col("exit_code").alias("exitCode"), F.col("duration_ms").alias("durationMs"), "command").write.json(f"{place}/landed/0")
    return place


def q74_stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of the hook log as a stream, written when it has ended: those that started and ended before the latest hour."""
    place = _landed(spark, folder)
    stream = session_stream(hook_stream(spark, f"{place}/landed/*"), late="3650 days")
    stream.writeStream.format("memory").queryName(name := f"sessions_{uuid.uuid4().hex}").outputMode("complete").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("dir_key", F.unix_millis("start").alias("start_ms"), "n_events")


def q74_live_failures(spark: SparkSession, folder: str) -> DataFrame:
    """What of the hook log, streamed, is worth a look, by exit code."""
    place = _landed(spark, folder)
    stream = live_failures(hook_stream(spark, f"{place}/landed/*")).groupBy("exitCode").agg(F.count(F.lit(1)).alias("entries"))
    stream.writeStream.format("memory").queryName(name := f"failures_{uuid.uuid4().hex}").outputMode("complete").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def q74_stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """The hook log of ``folder`` landed as JSON lines, streamed in, replayed, and read again: each event once."""
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    log = spark.read.parquet(f"{folder}/hook_log.parquet").where("ts is not null and cwd is not null and command is not null")
    rows = log.select("ts", "cwd", F.col("exit_code").alias("exitCode"), F.col("duration_ms").alias("durationMs"), "command")
    for again in range(2):
        rows.write.json(f"{place}/landed/{again}")
        stream = hook_stream(spark, f"{place}/landed/*")
        ingest(stream, f"{place}/table", f"{place}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{place}/table").select("event_key", "ts", F.col("exitCode").alias("exit_code"))


QUERIES = {"q74_stream_ingest": q74_stream_ingest, "q74_stream_sessions": q74_stream_sessions, "q74_live_failures": q74_live_failures}
SQL = {
    "q74_stream_sessions": _SESSIONS.replace("select cwd, ts from hook_log union all select cwd, ts from conversation_turns", "select cwd, ts from hook_log where ts is not null and cwd is not null and command is not null").replace("where wall_ms - off_ms <> 0", "")
    + "select dir_key, start_ms, n_events from agg",
    "q74_live_failures": 'select exit_code as "exitCode", count(*) as entries from hook_log where ts is not null and cwd is not null and exit_code <> 0 and trim(command) <> \'\' group by exit_code',
    "q74_stream_ingest": "select substr(sha256(ts || chr(0) || cwd || chr(0) || command), 1, 24) as event_key, ts, min(exit_code) as exit_code from hook_log where ts is not null and cwd is not null and command is not null group by ts, cwd, command"
}
