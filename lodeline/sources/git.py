"""Git history and patches as text landed by a thin reader, parsed by DataFrame expressions."""

from __future__ import annotations

import codecs
import subprocess
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodeline.functions.text import trimmed

RECORD, UNIT = "\x1e", "\x1f"
FORMAT = RECORD + UNIT.join(["%H", "%h", "%P", "%an", "%ae", "%aI", "%cI", "%s", "%B"]) + UNIT
PATCH_FORMAT = RECORD + UNIT.join(["%H", "%h", "%aI", "%s"]) + UNIT
HUNK = r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"


def log_arguments(after: str | None = None, since: str | None = None, most: int | None = None, merges: bool = True, paths: tuple[str, ...] = (), rev: str = "HEAD") -> list[str]:
    """Arguments of git with what can be asked of it: a range, a date, a number, no merges, paths."""
    args = ["log", f"--format={FORMAT}", "--numstat", "-M"]
    args += [f"--since={since}"] * bool(since) + [f"--max-count={most}"] * (most is not None) + ["--no-merges"] * (not merges)
    return [*args, f"{after}..{rev}" if after else rev, "--", *paths]


def patch_arguments(after: str | None = None, most: int | None = None, context: int = 3, paths: tuple[str, ...] = (), rev: str = "HEAD") -> list[str]:
    """Arguments of git for the patches of all commits but merges, with renames told and files as they are kept."""
    args = ["log", f"--format={PATCH_FORMAT}", "-p", "--no-merges", "-M", "--no-textconv", "--no-ext-diff", f"-U{context}"]
    return [*args, *([f"--max-count={most}"] if most is not None else []), f"{after}..{rev}" if after else rev, "--", *paths]


def git(repository: str, *args: str) -> str:
    """What git answers; raises RuntimeError with git's own words where it fails."""
    run = subprocess.run(["git", "-C", repository, *args], capture_output=True, check=False)
    if run.returncode:
        raise RuntimeError(f"git {args[0]}: {run.stderr.decode('utf-8', 'replace').strip()}")
    return run.stdout.decode("utf-8", "replace")


def facts(repository: str) -> dict[str, str | None]:
    """Root, branch, head and origin of a repository; null where it has none yet. Raises RuntimeError where there is no repository."""

    def ask(*args: str) -> str | None:
        try:
            return git(repository, *args).strip() or None
        except RuntimeError:
            return None

    return {"root": git(repository, "rev-parse", "--show-toplevel").strip(), "branch": ask("symbolic-ref", "--short", "HEAD"), "head": ask("rev-parse", "--verify", "HEAD"), "origin": ask("remote", "get-url", "origin")}


def tracked(spark: SparkSession, repository: str, *specs: str) -> DataFrame:
    """(path) of the files a repository tracks."""
    return spark.createDataFrame([(p,) for p in git(repository, "ls-files", "-z", "--", *specs).split("\0") if p], "path string")


def changed(spark: SparkSession, repository: str, staged: bool = True) -> DataFrame:
    """(path) of the files staged, or changed in the working tree."""
    args = ["diff", "--name-only", "-z", *(["--cached"] if staged else [])]
    return spark.createDataFrame([(p,) for p in git(repository, *args).split("\0") if p], "path string")


def _streamed(repository: str, args: list[str], tries: int = 3) -> Iterator[str]:
    """Records as git writes them; a run that fails before its first record is tried again, and git is ended when nobody reads on."""
    for attempt in range(tries):
        process = subprocess.Popen(["git", "-C", repository, *args], stdout=subprocess.PIPE, stderr=subprocess.PIPE)
        seen = False
        try:
            chunks = iter(lambda p=process: p.stdout.read(1 << 16), b"")
            decoder = codecs.getincrementaldecoder("utf-8")("replace")
            for record in record_batches(decoder.decode(c) for c in chunks):
                seen = True
                yield record
            error = process.stderr.read().decode("utf-8", "replace")
            if process.wait() == 0:
                return
        finally:
            if process.poll() is None:
                process.kill()
            process.wait()
        if "does not have any commits yet" in error or "bad revision 'HEAD'" in error:
            return
        if seen or attempt == tries - 1:
            raise RuntimeError(f"git {args[0]}: {error.strip()}")
        time.sleep(0.2 * 4**attempt)


def _records(spark: SparkSession, repositories: list[str], args: list[str], batch: int = 500) -> DataFrame:
    """(repository, record): git runs in the tasks, one repository each, and its output passes through in batches."""

    def read(frames):
        for frame in frames:
            for repository in frame["repository"]:
                held = []
                for record in _streamed(repository, args):
                    held.append(record)
                    if len(held) == batch:
                        yield pd.DataFrame({"repository": repository, "record": held})
                        held = []
                if held:
                    yield pd.DataFrame({"repository": repository, "record": held})

    listed = spark.createDataFrame([(r,) for r in repositories], "repository string").repartition(len(repositories))
    return listed.mapInPandas(read, "repository string, record string")


def read_log(spark: SparkSession, repository: str, **options) -> DataFrame:
    """(record): the raw records of a repository; an empty history has none. A git that fails fails the query."""
    return _records(spark, [repository], log_arguments(**options)).select("record")


def read_patches(spark: SparkSession, repository: str, **options) -> DataFrame:
    """(record): the raw patch records of a repository, for ``patches``."""
    return _records(spark, [repository], patch_arguments(**options)).select("record")


def patches(records: DataFrame) -> DataFrame:
    """(sha, short_sha, authored_at, subject, block) of patch records; those cut short, null or without a name give no row."""
    p = records.select(F.split(F.regexp_replace("record", f"^{RECORD}+", ""), UNIT, 5).alias("p")).where((F.size("p") >= 5) & F.get(F.col("p"), 0).rlike(r"(?i)^[0-9a-f]{7,64}\z"))
    get = lambda i: F.get(F.col("p"), i)
    return p.select(get(0).alias("sha"), get(1).alias("short_sha"), get(2).alias("authored_at"), trimmed(get(3)).alias("subject"), get(4).alias("block"))


def walk_from(repository: str, cursor: str | None, rev: str = "HEAD") -> str | None:
    """The cursor if it is still an ancestor of the head; null, for a full walk, where history was rewritten or there is no cursor."""
    if cursor is None:
        return None
    run = subprocess.run(["git", "-C", repository, "merge-base", "--is-ancestor", cursor, rev], capture_output=True, check=False)
    return cursor if run.returncode == 0 else None


def moved(cursors: DataFrame, project: str, source: str, head: str, at: int) -> DataFrame:
    """The cursors with the one of a source set, to be written once the rows of the walk are: each source has its own."""
    new = cursors.sparkSession.createDataFrame([(project, source, head, at)], "project_id string, source string, cursor string, last_run_at bigint")
    return cursors.join(new.select("project_id", "source"), ["project_id", "source"], "left_anti").unionByName(new)


@F.pandas_udf(StringType())
def unquoted(paths: pd.Series) -> pd.Series:
    """Quoted paths with octal bytes and escapes as they are on disk; others unchanged."""
    letters = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "a": "\a"}

    def one(p):
        if p is None or len(p) < 2 or p[0] != '"' or p[-1] != '"':
            return p
        out, i, body = bytearray(), 0, p[1:-1]
        while i < len(body):
            c = body[i]
            if c == "\\" and body[i + 1 : i + 4].isdigit() and len(body[i + 1 : i + 4]) == 3:
                out.append(int(body[i + 1 : i + 4], 8) & 255)
                i += 4
            elif c == "\\" and i + 1 < len(body):
                out += letters.get(body[i + 1], body[i + 1]).encode()
                i += 2
            else:
                out += c.encode()
                i += 1
        return out.decode("utf-8", "replace")

    return paths.map(one)


def renamed(path: Column) -> Column:
    """path and previous_path of a name with an arrow, braced or plain."""
    braced = r"^(.*)\{(.*?) => (.*?)\}(.*)$"
    tidy = lambda p: F.regexp_replace(F.regexp_replace(p, "/{2,}", "/"), "^/", "")
    halves = F.split(path, " => ")
    now = F.when(path.rlike(braced), tidy(F.regexp_replace(path, braced, "$1$3$4"))).when(F.size(halves) == 2, F.trim(F.get(halves, 1))).otherwise(path)
    before = F.when(path.rlike(braced), tidy(F.regexp_replace(path, braced, "$1$2$4"))).when(F.size(halves) == 2, F.trim(F.get(halves, 0)))
    return F.struct(now.alias("path"), before.alias("previous_path"))


def commits(records: DataFrame) -> DataFrame:
    """One row per record with nine fields and a hexadecimal name: its fields, message body, and files as an array.

    A message may itself hold the separator. Records cut short, null or without a name give no row.
    """
    parts = F.split(F.regexp_replace("record", f"^{RECORD}+", ""), UNIT, -1)
    p = records.select(parts.alias("p")).where((F.size("p") >= 10) & F.get(F.col("p"), 0).rlike(r"(?i)^[0-9a-f]{7,64}\z"))
    get = lambda i: F.get(F.col("p"), i)
    subject = trimmed(get(7))
    message = trimmed(F.array_join(F.slice("p", 9, F.size("p") - 9), UNIT))
    lines = F.split(F.element_at("p", -1), r"\r?\n")
    stat = r"^(\d+|-)\t(\d+|-)\t(.*)$"
    touch = lambda x: F.struct(
        F.regexp_extract(x, stat, 3).alias("raw"), F.regexp_extract(x, stat, 1).try_cast("int").alias("insertions"), F.regexp_extract(x, stat, 2).try_cast("int").alias("deletions")
    )
    told = p.select(
        get(0).alias("sha"), get(1).alias("short_sha"), F.filter(F.split(trimmed(get(2)), r"\s+"), lambda x: x != "").alias("parents"), get(3).alias("author_name"), get(4).alias("author_email"),
        get(5).alias("authored_at"), get(6).alias("committed_at"), subject.alias("subject"), message.alias("message"), F.transform(F.filter(lines, lambda x: x.rlike(stat)), touch).alias("files"),
    )
    body = F.when((F.col("subject") != "") & F.col("message").startswith(F.col("subject")), trimmed(F.substring("message", F.length("subject") + 1, F.length("message")))).otherwise(F.col("message"))
    return told.withColumn("message_body", body).withColumn("is_merge", F.size("parents") > 1)


def touches(commit_rows: DataFrame) -> DataFrame:
    """(sha, position, path, previous_path, insertions, deletions, is_binary) of the files of commits."""
    each = commit_rows.select("sha", F.posexplode("files").alias("position", "f"))
    return each.withColumn("_r", renamed(unquoted(F.col("f.raw")))).select(
        "sha", "position", "_r.path", "_r.previous_path", "f.insertions", "f.deletions", (F.col("f.insertions").isNull() | F.col("f.deletions").isNull()).alias("is_binary")
    )


def file_diffs(blocks: DataFrame) -> DataFrame:
    """(sha, position, path, previous_path, status, is_binary, insertions, deletions, hunk_count, patch) of patch blocks (sha, block).

    A block is cut at its ``diff --git`` lines; each file's patch is folded within its own section.
    """
    plain = F.regexp_replace(F.concat(F.lit("\n"), F.col("block")), r"\r\n", "\n")
    sections = blocks.select("sha", F.posexplode(F.filter(F.split(plain, r"\n(?=diff --git )"), lambda s: s.startswith("diff --git "))).alias("position", "section"))
    cut = sections.withColumn("_at", F.regexp_instr("section", F.lit(r"(?m)" + HUNK)))
    head = F.when(F.col("_at") > 0, F.substring("section", F.lit(1), F.col("_at") - 1)).otherwise(F.col("section"))
    cut = cut.withColumn("_head", head).withColumn("_body", F.when(F.col("_at") > 0, F.regexp_replace(F.substring("section", F.col("_at"), F.length("section")), r"\s+\z", "")))
    line = lambda start: F.nullif(F.regexp_extract("_head", rf"(?m)^{start}(.*)$", 1), F.lit(""))
    clean = lambda c: F.nullif(F.regexp_replace(F.regexp_replace(F.trim(c), r"^/dev/null\z", ""), r"^[ab]/", ""), F.lit(""))
    raw = cut.select(
        "sha", "position", "_head", "_body", unquoted(line(r"\+\+\+ ")).alias("_to"), unquoted(line("--- ")).alias("_from"), unquoted(F.coalesce(line("rename from "), line("copy from "))).alias("_old"),
        unquoted(F.coalesce(F.nullif(F.regexp_extract("_head", r'^diff --git .* ("b/[^\n]*")', 1), F.lit("")), F.regexp_extract("_head", r"^diff --git .*? (b/[^\n]*)", 1))).alias("_b"),
        unquoted(F.regexp_extract("_head", r'^diff --git ("a/(?:[^"\\]|\\.)*"|a/.*?) (?:"b/|b/)', 1)).alias("_a"),
    )
    has = lambda p: F.col("_head").rlike(rf"(?m)^{p}")
    status = F.when(has("rename to "), "renamed").when(has("deleted file mode"), "deleted").when(has("new file mode"), "added").otherwise("modified")
    path = F.coalesce(clean(F.col("_to")), clean(F.col("_b")), clean(F.col("_from")), clean(F.col("_a")))
    binary = has("Binary files ") | has("GIT binary patch")
    lines = F.split(F.coalesce("_body", F.lit("")), "\n")
    count = lambda p, q=None: F.size(F.filter(lines, lambda x: x.rlike(p)))
    body = F.col("_body").isNotNull() & ~binary
    number = lambda c: F.when(body, c).otherwise(0)
    out = raw.select(
        "sha", "position", path.alias("path"), F.coalesce(F.col("_old"), F.when(status == "renamed", F.coalesce(clean(F.col("_from")), clean(F.col("_a"))))).alias("previous_path"), status.alias("status"),
        (binary & F.col("_head").isNotNull()).alias("is_binary"), number(count(r"^\+")).alias("insertions"), number(count("^-")).alias("deletions"), number(count(HUNK)).alias("hunk_count"),
        F.when(body, F.col("_body")).otherwise("").alias("patch"),
    )
    return out.where("path is not null").withColumn("previous_path", F.when(F.col("previous_path") != F.col("path"), F.col("previous_path")))


def valid_cursor(cursor: str | None, ancestors: set[str]) -> str | None:
    """A cursor that is still an ancestor of the head; rewritten history is walked in full."""
    return cursor if cursor in ancestors else None


def record_batches(chunks: Iterator[str]) -> Iterator[str]:
    """Whole records from pieces of text, the tail carried on."""
    rest = ""
    for chunk in chunks:
        *whole, rest = (rest + chunk).split(RECORD)
        yield from (r for r in whole if r)
    if rest:
        yield rest


def top_touched(touch_rows: DataFrame, most: int) -> DataFrame:
    """The files of each commit that changed most, the first of equals."""
    churn = F.coalesce("insertions", F.lit(0)) + F.coalesce("deletions", F.lit(0))
    return touch_rows.withColumn("place", F.row_number().over(Window.partitionBy("sha").orderBy(F.desc(churn), "position"))).where(F.col("place") <= most)
