"""Files as tables: documents, source trees and transcripts, with what couldn't be read told apart."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.operators.structure import import_edges
from lodeline.tables import shared_folder, table

DOCUMENTS = "*.{md,mdx,markdown}"
SOURCES = "*.{ts,tsx,js,jsx,mts,mjs,cts,cjs,py,go,rs,java,php,mod}"
LINE = "type string, uuid string, parentUuid string, isSidechain boolean, timestamp string, cwd string, sessionId string, message string"


def read_files(spark: SparkSession, root: str, pattern: str = DOCUMENTS, tracked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, content, ts_ms) of the files under ``root`` that match, and (path) of the ``tracked`` ones that weren't read.

    Paths are relative, with forward slashes. A file is one row, so it must fit into a task; bytes that are no
    UTF-8 become replacement characters. Without ``tracked`` nothing is missing; with it only tracked files
    are given. What wasn't read must not be taken for empty: its rows in the store are kept.
    """
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(base)
    plain = F.regexp_replace(F.col("path"), r"^[a-z]+:/+", "/")
    inside = F.substring(plain, F.length(F.lit(re.sub(r"^[a-z]+:/+", "/", base))) + 2, F.length(plain))
    files = found.select(inside.alias("path"), F.col("content").cast("string").alias("content"), F.unix_millis("modificationTime").alias("ts_ms"))
    if tracked is None:
        return files, files.select("path").limit(0)
    listed = tracked.select(F.regexp_replace("path", r"\\", "/").alias("path")).distinct()
    return files.join(listed, "path", "left_semi"), listed.join(files.select("path"), "path", "left_anti")


def read_imports(spark: SparkSession, root: str, project: str, tracked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Import edges of a source tree, and the tracked paths that weren't read; the Go module is that of its go.mod at the root."""
    files, missing = read_files(spark, root, SOURCES, tracked)
    texts = files.select(F.lit(project).alias("project_id"), "path", F.col("content").alias("text"))
    module = texts.where("path = 'go.mod'").select(F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1)).first()
    return import_edges(texts, module[0] or None if module else None), missing


def read_transcripts(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """The lines of all transcripts under ``root`` as (session_id, line_no, line_type, uuid, parent_uuid, is_sidechain, line_ts, cwd, msg_role, msg_content).

    ``line_no`` counts from 0 within a file, torn lines included; a torn line has nulls only. The session is the
    line's own, else the file's name. A file is read whole by one task, as its lines have no number otherwise.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True).withColumn("_file", F.input_file_name())
    lines = files.select("_file", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("line_no", "_line"))
    told = lines.withColumn("_e", F.from_json("_line", LINE)).withColumn("_m", F.from_json("_e.message", "role string, content string"))
    named = F.regexp_extract(F.col("_file"), r"([^/]*)\.[^./]*\z", 1)
    return told.select(
        F.coalesce("_e.sessionId", named).alias("session_id"), F.col("line_no").cast("bigint").alias("line_no"), F.col("_e.type").alias("line_type"), F.col("_e.uuid").alias("uuid"), F.col("_e.parentUuid").alias("parent_uuid"),
        F.col("_e.isSidechain").alias("is_sidechain"), F.col("_e.timestamp").alias("line_ts"), F.col("_e.cwd").alias("cwd"), F.col("_m.role").alias("msg_role"), F.col("_m.content").alias("msg_content"),
    )


def transcript_folder(root: str) -> str:
    """The name an assistant gives the folder of a project's transcripts: its path with all but letters and digits as dashes."""
    return re.sub(r"[^A-Za-z0-9]", "-", root)


def append_hook_entries(entries: DataFrame, folder: str) -> None:
    """Adds entries (ts, cwd, exitCode, durationMs, command) to a hook log as lines of JSON in a new file."""
    entries.select(F.to_json(F.struct("ts", "cwd", "exitCode", "durationMs", "command"))).write.mode("append").text(folder)


# --- queries -----------------------------------------------------------------------------------------


def _landed(spark) -> str:
    return f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"


def q99_transcripts(spark, folder):
    """All transcript lines landed as JSON, a file per task, and read again: lines, messages and side work by session."""
    place = _landed(spark)
    t = table(spark, folder, "transcript_lines")
    message = F.struct(F.col("msg_role").alias("role"), F.col("msg_content").alias("content"))
    line = F.to_json(F.struct(
        F.col("line_type").alias("type"), "uuid", F.col("parent_uuid").alias("parentUuid"), F.col("is_sidechain").alias("isSidechain"), F.col("line_ts").alias("timestamp"), "cwd", F.col("session_id").alias("sessionId"), message.alias("message"),
    ))
    t.select(line).write.text(place, lineSep="\n")
    back = read_transcripts(spark, place, "*.txt")
    return back.groupBy("session_id").agg(F.count(F.lit(1)).alias("lines"), F.count("uuid").alias("uuids"), F.count(F.when(F.col("is_sidechain"), 1)).alias("side"), F.sum(F.length(F.coalesce("msg_content", F.lit("")))).alias("chars"), F.max("line_ts").alias("latest"))


def q99_hook_log(spark, folder):
    """The hook log appended twice as lines of JSON, and read again as a shell's entries under one root."""
    from lodeline.sources.shell import hook_entry, under_root

    place = _landed(spark)
    h = table(spark, folder, "hook_log").where("ts is not null and cwd is not null and command is not null").select("ts", "cwd", F.col("exit_code").alias("exitCode"), F.col("duration_ms").alias("durationMs"), "command")
    for half in (h.where("exitCode = 0"), h.where("exitCode <> 0 or exitCode is null")):
        append_hook_entries(half, place)
    entries = spark.read.text(place).select(hook_entry(F.col("value")).alias("e")).where("e is not null").select("e.*")
    return entries.withColumn("inside", under_root(F.col("cwd"), F.lit("/SRV/work/"))).groupBy("inside", "exitCode").agg(F.count(F.lit(1)).alias("entries"))


QUERIES = {k: f for k, f in list(globals().items()) if re.match(r"q\d+_", k)}
SQL = {
    "q99_transcripts": "select session_id, count(*) as lines, count(uuid) as uuids, count(*) filter (is_sidechain) as side, cast(sum(length(coalesce(msg_content, ''))) as bigint) as chars, max(line_ts) as latest from transcript_lines group by session_id",
    "q99_hook_log": r"""with h as (select lower(regexp_replace(replace(cwd, '\', '/'), '/+$', '')) as d, exit_code from hook_log where ts is not null and cwd is not null and command is not null)
select d = '/srv/work' or starts_with(d, '/srv/work/') as inside, exit_code as "exitCode", count(*) as entries from h group by all""",
}
