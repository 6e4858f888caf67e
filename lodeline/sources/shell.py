"""Shell histories and hook logs: lines of files to entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions.text import trimmed

HOOK = "struct<ts:string,cwd:string,exitCode:int,durationMs:bigint,command:string>"


def lines_of(files: DataFrame) -> DataFrame:
    """(path, mtime_ms, line_no, line) of history files (path, mtime_ms, content); one file is one history and stays together."""
    return files.select("path", "mtime_ms", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "line"))


def _entries(commands: DataFrame, shell: str, tail: int | None) -> DataFrame:
    """Numbered, cut to the last ``tail``, undated ones a second apart back from the file's time."""
    by = Window.partitionBy("path")
    numbered = commands.withColumns({"_n": F.row_number().over(by.orderBy("line_no")) - 1, "_end": F.row_number().over(by.orderBy(F.desc("line_no"))) - 1})
    kept = numbered if tail is None else numbered.where(F.col("_end") < tail)
    key = F.concat_ws(":", F.lit(shell), F.col("_n").cast("string"), F.substring(F.sha2("command", 256), 1, 12))
    return kept.select(
        "path", key.alias("natural_key"), "command", F.coalesce("at_ms", F.col("mtime_ms") - F.col("_end") * 1000).alias("at_ms"),
        F.col("at_ms").isNull().alias("ts_approx"), "duration_ms", F.lit(shell).alias("shell"),
    )


def pwsh_history(files: DataFrame, tail: int | None = None) -> DataFrame:
    """Plain lines, blank ones left out."""
    told = lines_of(files).where(trimmed(F.col("line")) != "").select("path", "mtime_ms", "line_no", F.col("line").alias("command"), F.lit(None).cast("bigint").alias("at_ms"), F.lit(None).cast("bigint").alias("duration_ms"))
    return _entries(told, "pwsh", tail)


def bash_history(files: DataFrame, tail: int | None = None) -> DataFrame:
    """A ``#epoch`` line dates the command after it."""
    told = lines_of(files).where(trimmed(F.col("line")) != "")
    stamp = F.regexp_extract(trimmed(F.col("line")), r"^#(\d{9,})\z", 1).try_cast("bigint")
    order = Window.partitionBy("path").orderBy("line_no")
    told = told.withColumn("_s", stamp).withColumn("_p", F.lag("_s").over(order)).where("_s is null")
    return _entries(told.select("path", "mtime_ms", "line_no", F.col("line").alias("command"), (F.col("_p") * 1000).alias("at_ms"), F.lit(None).cast("bigint").alias("duration_ms")), "bash", tail)


def zsh_history(files: DataFrame, tail: int | None = None) -> DataFrame:
    """``: epoch:seconds;`` before a command; a line that ends in a backslash goes on in the next."""
    told = lines_of(files)
    order = Window.partitionBy("path").orderBy("line_no")
    goes_on = F.coalesce(F.lag("line").over(order).endswith("\\"), F.lit(False))
    told = told.withColumn("_c", goes_on).where(F.col("_c") | (trimmed(F.col("line")) != ""))
    told = told.withColumn("_g", F.sum((~F.col("_c")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = told.groupBy("path", "mtime_ms", "_g").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("_t"))
    text = F.regexp_replace("_t", r"\\\n", "\n")
    prefix = r"(?s)^: (\d+):(\d+);(.*)$"
    part = lambda i: F.when(text.rlike(prefix), F.regexp_extract(text, prefix, i))
    return _entries(joined.select("path", "mtime_ms", "line_no", F.coalesce(part(3), text).alias("command"), (part(1).try_cast("bigint") * 1000).alias("at_ms"), part(2).try_cast("bigint").alias("duration_ms")), "zsh", tail)


def hook_entry(line: Column) -> Column:
    """The entry of one hook log line; null where it is torn or lacks time, directory or command."""
    e = F.from_json(trimmed(line), HOOK)
    return F.when(e["ts"].isNotNull() & e["cwd"].isNotNull() & e["command"].isNotNull(), e)


def hook_lines(lines: DataFrame, cursor: int) -> DataFrame:
    """Entries of the lines (line_no from 0, line) from the cursor on; a cursor beyond the end reads all again."""
    total = lines.agg(F.count(F.lit(1)).alias("_total"))
    kept = lines.join(F.broadcast(total)).where((F.lit(cursor) > F.col("_total")) | (F.col("line_no") >= cursor))
    return kept.withColumn("e", hook_entry(F.col("line"))).where("e is not null").select("line_no", "e.*")


def hook_to_shell(entries: DataFrame, shell: str = "pwsh-hook") -> DataFrame:
    """Hook entries (ts, cwd, exitCode, durationMs, command) as shell entries: the key is the time and a digest of the command, so a replay has the same keys."""
    key = F.concat(F.col("ts"), F.lit(":"), F.substring(F.sha2("command", 256), 1, 12))
    return entries.select(
        key.alias("natural_key"), "command", "ts", F.lit(False).alias("ts_approx"), F.col("exitCode").alias("exit_code"), "cwd", F.col("durationMs").alias("duration_ms"), F.lit(shell).alias("shell")
    )


def chosen_sources(present: set[str]) -> list[str]:
    """Which shell sources are read of those that are there: a hook tells what the scraped history of its shell would, and better."""
    kept = [s for s in ("pwsh-hook", "pwsh", "bash", "zsh") if s in present]
    return [s for s in kept if s != "pwsh" or "pwsh-hook" not in kept]


def under_root(cwd: Column, root: Column) -> Column:
    """Whether a directory is the root or lies beneath it, whatever its slashes and letter case."""
    plain = lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, r"\\", "/")), r"/+\z", "")
    return (plain(cwd) == plain(root)) | plain(cwd).startswith(F.concat(plain(root), F.lit("/")))
