"""Rows of the store from commits, patches, shell entries, conversation turns and sessions."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions import signals
from lodeline.functions.redaction import redacted, redactions
from lodeline.functions.text import default_provenance, node_id, truncated
from lodeline.functions.times import with_instant
from lodeline.operators.collect import _turns, chunks, mentioned_files, parsed_summary, settled
from lodeline.operators.store import pruned
from lodeline.tables import table

# Most characters of titles and bodies by kind, most files of a row.
TITLE = 200
BODY = {"git_commit": 4000, "code_diff": 2000, "shell_command": 1000, "conversation_turn": 2500, "session_summary": 2500}
FILES = {"git_commit": 40, "code_diff": 20}
REPLY_CHUNK = 900
PROMPT_CHARS, USER_CHARS, REPLY_CHARS, JUDGED_CHARS = 12_000, 400, 700, 1500

NODE_COLUMNS = ["node_id", "kind", "project_id", "ts", "source", "title", "body", "files", "signal_score", "provenance", "meta"]


def generated(path: Column) -> Column:
    """Whether a path's content is written by machines."""
    return path.rlike(signals.GENERATED)


def indexable(diffs: DataFrame) -> DataFrame:
    """Patches worth a row: text with hunks, in files written by hand; unknown flags count as text, unknown hunks as none."""
    return diffs.where(~F.coalesce("is_binary", F.lit(False)) & (F.coalesce("hunk_count", F.lit(0)) > 0) & ~generated(F.col("path")))


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def _node(rows: DataFrame, kind: str, key: Column, source: Column, title: Column, body: Column, files: Column, signal: Column, meta: list) -> DataFrame:
    return rows.select(
        node_id(F.col("project_id"), F.lit(kind), key).alias("node_id"), F.lit(kind).alias("kind"), "project_id", "ts", source.alias("source"), title.alias("title"), truncated(body, BODY[kind]).alias("body"),
        files.alias("files"), signal.alias("signal_score"), default_provenance(F.lit(kind)).alias("provenance"), F.to_json(F.struct(*meta), {"ignoreNullFields": "false"}).alias("meta"),
    )


def _churn(f: Column) -> Column:
    return F.coalesce(f["insertions"], F.lit(0)) + F.coalesce(f["deletions"], F.lit(0))


def commit_nodes(commits: DataFrame, most: int = FILES["git_commit"]) -> DataFrame:
    """One row of the store per commit of ``commits`` (project_id, sha, short_sha, authored_at, subject, message_body, is_merge, files).

    ``files`` is an array of (path, previous_path, insertions, deletions, is_binary): the ``most`` changed are
    named in the body, the first of equals, and told how many more there are. An empty subject gives a
    title with the short name; a null body or list of files counts as empty.
    """
    files = F.coalesce(F.col("files"), F.array().cast(commits.schema["files"].dataType))
    ordered = F.array_sort(F.transform(files, lambda f, i: F.struct((-_churn(f)).alias("c"), i.alias("i"), f.alias("f"))))
    kept = F.slice(F.transform(ordered, lambda x: x["f"]), 1, most)
    total = lambda name: F.aggregate(files, F.lit(0).cast("bigint"), lambda s, f: s + F.coalesce(f[name], F.lit(0)))
    rows = commits.select(
        "*", files.alias("_files"), kept.alias("_kept"), total("insertions").alias("_ins"), total("deletions").alias("_del"), F.coalesce("subject", F.lit("")).alias("_subject"), F.coalesce("message_body", F.lit("")).alias("_message"),
    ).withColumn("ts", F.col("authored_at"))
    n = F.size("_files")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    churn = lambda f: F.when(F.coalesce(f["is_binary"], F.lit(False)), "binary").otherwise(F.concat(F.lit("+"), count(f["insertions"]), F.lit("/-"), count(f["deletions"])))
    line = lambda f: F.concat(F.lit("  "), f["path"], F.lit(" ("), churn(f), F.when(f["previous_path"].isNotNull(), F.concat(F.lit(", renamed from "), f["previous_path"])).otherwise(""), F.lit(")"))
    more = F.when(n > most, F.concat(F.lit("  ...and "), (n - most).cast("string"), F.lit(" more file(s)")))
    listed = F.when(n > 0, _lines(F.lit("\nFiles changed:"), F.array_join(F.transform("_kept", line), "\n"), more))
    body = _lines(F.col("_subject"), F.when(F.col("_message") != "", F.concat(F.lit("\n"), F.col("_message"))), listed)
    title = truncated(F.when(F.col("_subject") != "", F.col("_subject")).otherwise(F.concat(F.lit("(no subject) "), "short_sha")), TITLE)
    h = signals.header(F.col("_subject"))
    signal = signals.commit_signal(F.col("_subject"), F.length("_message"), F.coalesce("is_merge", F.lit(False)), n, F.col("_ins") + F.col("_del"))
    meta = ["sha", F.col("short_sha").alias("shortSha"), F.coalesce("is_merge", F.lit(False)).alias("isMerge"), n.alias("filesChanged"), F.col("_ins").alias("insertions"), F.col("_del").alias("deletions"),
            h["type"].alias("conventionalType"), h["scope"].alias("conventionalScope"), h["breaking"].alias("breaking")]
    return _node(rows, "git_commit", F.col("sha"), F.lit("git"), title, body, F.transform("_kept", lambda f: f["path"]), signal, meta)


def patch_nodes(diffs: DataFrame, most: int = FILES["code_diff"]) -> DataFrame:
    """One row of the store per file kept of each commit's patches ``diffs`` (project_id, sha, short_sha, subject, authored_at, path, previous_path, status, insertions, deletions, hunk_count, is_binary, patch).

    Kept are the ``most`` changed indexable files of a commit, by path where equal; places are counted within a commit.
    """
    churn = F.coalesce("insertions", F.lit(0)) + F.coalesce("deletions", F.lit(0))
    place = F.row_number().over(Window.partitionBy("project_id", "sha").orderBy(F.desc("_churn"), "path", "patch"))
    rows = indexable(diffs).withColumn("_churn", churn).withColumn("_place", place).where(F.col("_place") <= most).withColumn("ts", F.col("authored_at"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    told = F.concat(
        F.col("status"), F.lit(" "), F.col("path"), F.lit(" (+"), count("insertions"), F.lit("/-"), count("deletions"), F.lit(", "), count("hunk_count"), F.when(F.col("hunk_count") == 1, " hunk").otherwise(" hunks"),
        F.when(F.col("previous_path").isNotNull(), F.concat(F.lit(", renamed from "), "previous_path")).otherwise(""), F.lit(")"),
    )
    head = F.concat(F.col("subject"), F.lit(" ("), F.col("short_sha"), F.lit(")\n"), told, F.lit("\n"))
    title = truncated(F.concat(F.col("path"), F.lit(" @ "), F.col("short_sha"), F.lit(" — "), F.col("subject")), TITLE)
    meta = ["sha", F.col("short_sha").alias("shortSha"), "path", "status", F.col("hunk_count").alias("hunkCount"), "insertions", "deletions", "subject"]
    body = F.concat(head, redacted(F.coalesce("patch", F.lit("")), code=True))
    signal = signals.patch_signal(F.col("subject"), F.col("path"), F.col("status"), F.col("_churn"))
    return _node(rows, "code_diff", F.concat_ws(":", "sha", "path"), F.lit("git-diff"), title, body, F.array("path"), signal, meta)


def shell_nodes(entries: DataFrame) -> DataFrame:
    """One row of the store per shell entry (project_id, natural_key, command, ts, ts_approx, exit_code, duration_ms, cwd, shell); null commands give none."""
    rows = entries.where("command is not null")
    told = F.concat_ws("  ", F.when(F.col("cwd") != "", F.concat(F.lit("cwd: "), "cwd")), F.concat(F.lit("exit: "), F.col("exit_code").cast("string")), F.concat(F.lit("duration: "), F.col("duration_ms").cast("string"), F.lit("ms")))
    body = _lines(F.concat(F.lit("$ "), "command"), F.when(told != "", F.concat(F.lit("\n"), told)))
    title = truncated(F.regexp_extract("command", r"^([^\r\n]*)", 1), TITLE)
    meta = ["command", "cwd", F.col("exit_code").alias("exitCode"), F.col("duration_ms").alias("durationMs"), F.col("ts_approx").alias("tsApprox"), "shell"]
    return _node(rows, "shell_command", F.col("natural_key"), F.concat(F.lit("shell:"), "shell"), title, body, F.array().cast("array<string>"), signals.command_signal(F.col("command"), F.col("exit_code")), meta)


def turn_nodes(turns: DataFrame, most: int = REPLY_CHUNK) -> DataFrame:
    """One row of the store per chunk of each turn's reply (project_id, natural_key, user_text, assistant_text, ts, cwd, source), with the question.

    Turns with an empty or null reply give none; secrets are taken out before the reply is cut; a title keeps its
    heading or part, whatever the length of the question.
    """
    asked = F.coalesce("user_text", F.lit(""))
    rows = turns.where("assistant_text <> ''").select(
        "*", redacted(asked).alias("_q"), chunks(redacted(F.col("assistant_text")), most).alias("_chunks"), (redactions(asked) + redactions(F.col("assistant_text"))).alias("_redactions")
    )
    rows = rows.select("*", F.posexplode("_chunks").alias("_i", "_c"), F.size("_chunks").alias("_n"))
    first = F.regexp_extract("_q", r"^([^\r\n]*)", 1)
    suffix = F.when(F.coalesce("_c.heading", F.lit("")) != "", F.concat(F.lit(" — "), "_c.heading")).when(F.col("_n") > 1, F.concat(F.lit(" (part "), F.col("_i") + 1, F.lit("/"), "_n", F.lit(")"))).otherwise("")
    room = F.when(suffix == "", F.lit(TITLE)).otherwise(F.greatest(F.lit(20), TITLE - F.length(suffix)))
    cut = F.regexp_replace(F.substring(first, F.lit(1), room - 1), r"(?U)\s+\z", "")
    title = F.concat(F.when(F.length(first) > room, F.concat(cut, F.lit("…"))).otherwise(first), suffix)
    body = F.concat(F.lit("Q: "), "_q", F.lit("\n\nA: "), "_c.text")
    meta = ["cwd", "source", F.col("_i").alias("chunkIndex"), F.col("_n").alias("chunkCount"), F.col("_c.heading").alias("heading"), F.col("_redactions").alias("redactedCount")]
    files = mentioned_files(_lines(F.col("_q"), F.col("_c.text")))
    return _node(rows, "conversation_turn", F.concat_ws(":", "natural_key", "_i"), F.concat(F.lit("conversation:"), "source"), title, body, files, signals.turn_signal(F.col("_q"), F.col("_c.text")), meta)


def session_prompts(turns: DataFrame, instructions: str, most: int = PROMPT_CHARS) -> DataFrame:
    """(session_key, prompt, hash, included, turns): what a model is asked about each session of ``turns`` (session_key, turn_id, ts, user_text, assistant_text).

    Each exchange is cut, the ones of highest signal kept while they fit into ``most`` characters with the
    instructions, the first of equals by time and id, and put back into order of time. A session's
    exchanges are cut to about a thousand characters before they are gathered, and only their lengths and
    signals are folded.
    """
    q, a = redacted(F.coalesce("user_text", F.lit(""))), redacted(F.coalesce("assistant_text", F.lit("")))
    text = F.concat(F.lit("["), F.coalesce("ts", F.lit("")), F.lit("] developer: "), truncated(q, USER_CHARS), F.lit("\nassistant: "), truncated(a, REPLY_CHARS))
    item = F.struct((-signals.turn_signal(q, a)).alias("s"), F.coalesce("ts", F.lit("")).alias("ts"), F.col("turn_id").alias("id"), text.alias("text"))
    listed = turns.where("session_key is not null").groupBy("session_key").agg(F.array_sort(F.collect_list(item)).alias("_l"))
    state = "struct<used:int,kept:array<boolean>>"
    start = F.from_json(F.lit('{"used": 0, "kept": []}'), state)
    room = most - len(instructions)

    def step(s, n):
        fits = s["used"] + n <= room
        return F.struct((s["used"] + F.when(fits, n).otherwise(0)).alias("used"), F.concat(s["kept"], F.array(fits)).alias("kept")).cast(state)

    fits = F.aggregate(F.transform("_l", lambda x: F.length(x["text"])), start, step)["kept"]
    kept = F.filter("_l", lambda x, i: F.get(F.col("_fits"), i))
    order = F.array_sort(F.transform(kept, lambda x: F.struct(x["ts"].alias("ts"), x["id"].alias("id"), x["text"].alias("text"))))
    body = F.array_join(F.transform(order, lambda x: x["text"]), "\n\n")
    prompt = F.concat(F.lit(instructions + "\n\n---\n\n"), body, F.lit("\n\n---\n\nSummary:"))
    out = listed.withColumn("_fits", fits).select("session_key", prompt.alias("prompt"), F.size(kept).alias("included"), F.size("_l").alias("turns"))
    return out.withColumn("hash", F.sha2("prompt", 256))


def sessions_to_summarise(sessions: DataFrame, prompts: DataFrame, known: DataFrame, now_ms: int, most: int = 10) -> DataFrame:
    """The settled sessions whose prompt isn't the one already stored (``known``: session_key, hash), the newest first, at most ``most``."""
    due = settled(sessions, now_ms).join(prompts, "session_key").join(known.select("session_key", "hash"), ["session_key", "hash"], "left_anti")
    return due.orderBy(F.desc("ended_at"), "session_key").limit(most)


def completed(prompts: DataFrame, complete: Callable[[str], str | None], key: str = "session_key", prompt: str = "prompt") -> DataFrame:
    """(key, raw): a model's answer to each prompt; none where it gives None, so that the next run asks again. A provider that fails twice in a row isn't asked further in that task."""

    def run(frames):
        nulls = 0
        for frame in frames:
            told = []
            for k, p in zip(frame[key], frame[prompt], strict=True):
                if nulls >= 2:
                    break
                answer = complete(p)
                nulls = nulls + 1 if answer is None else 0
                if answer is not None:
                    told.append((k, answer))
            yield pd.DataFrame(told, columns=[key, "raw"])

    return prompts.select(key, prompt).mapInPandas(run, f"`{key}` {prompts.schema[key].dataType.simpleString()}, raw string")


def session_nodes(sessions: DataFrame, answers: DataFrame) -> DataFrame:
    """One row of the store per session (project_id, session_key, turns, started_at, ended_at, cwd, source, hash, included, fallback) with an answer (session_key, raw)."""
    rows = sessions.join(answers, "session_key").withColumn("_s", parsed_summary(F.col("raw"), F.col("fallback"))).where("_s is not null").withColumn("ts", F.col("ended_at"))
    header = F.concat(F.lit("Session of "), F.substring("started_at", 1, 10), F.lit(" — "), F.col("turns").cast("string"), F.lit(" exchange(s)"))
    meta = [F.col("session_key").alias("sessionKey"), "source", F.col("turns").alias("turnCount"), F.col("included").alias("summarizedTurns"), F.col("started_at").alias("startedAt"), F.col("ended_at").alias("endedAt"), "cwd", F.col("hash").alias("contentHash")]
    body = F.concat(header, F.lit("\n\n"), "_s.body")
    return _node(rows, "session_summary", F.col("session_key"), F.concat(F.lit("session:"), "source"), F.col("_s.title"), body, mentioned_files(body), signals.session_signal(F.col("turns")), meta)


def contradiction_prompt(older_title: Column, older_body: Column, newer_title: Column, newer_body: Column, instructions: str) -> Column:
    """What a model is asked about two rows: titles whole, bodies cut."""
    half = lambda name, title, body: F.concat(F.lit(f"{name} ("), F.coalesce(title, F.lit("")), F.lit("):\n"), truncated(F.coalesce(body, F.lit("")), JUDGED_CHARS))
    return F.concat(F.lit(instructions + "\n\n---\n\n"), half("OLDER", older_title, older_body), F.lit("\n\n"), half("NEWER", newer_title, newer_body), F.lit("\n\n---\n\nAnswer:"))


def refreshed(stored: DataFrame, scanned: DataFrame, source: str, unreadable: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """Ids of ``source`` that a complete scan no longer gives; rows of files that couldn't be read stay."""
    return pruned(stored, source, scanned, unreadable, files).select("node_id")


# --- queries ---------------------------------------------------------------------------------------

INSTRUCTIONS = "Summarise the session."
_TYPES = {"added": "feat", "deleted": "chore", "renamed": "refactor"}


def _diffs(spark, folder):
    """The patches with a subject made of what they did, as the tables hold none; one row of a file told twice."""
    kind = F.lit("fix")
    for status, name in _TYPES.items():
        kind = F.when(F.col("change_status") == status, name).otherwise(kind)
    d = table(spark, folder, "file_diffs")
    one = d.groupBy("project_id", "sha", "file_path").agg(F.min_by(F.struct(*[c for c in d.columns if c not in ("project_id", "sha", "file_path")]), "diff_id").alias("r")).select("project_id", "sha", "file_path", "r.*")
    return one.select(
        "project_id", "sha", F.substring("sha", 1, 7).alias("short_sha"), "authored_at", F.col("file_path").alias("path"), "previous_path", F.col("change_status").alias("status"), "insertions", "deletions", "hunk_count", "is_binary", "patch",
        F.concat(kind, F.lit(": "), F.regexp_extract("file_path", r"([^/]*)\z", 1)).alias("subject"), "diff_id",
    )


def _commits(spark, folder):
    d = _diffs(spark, folder)
    item = F.struct("diff_id", F.struct("path", "previous_path", "insertions", "deletions", "is_binary").alias("f"))
    return d.groupBy("project_id", "sha", "short_sha").agg(
        F.min("authored_at").alias("authored_at"), F.min_by("subject", "diff_id").alias("subject"), F.lit("").alias("message_body"), F.lit(False).alias("is_merge"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x["f"]).alias("files")
    )


def q77_commit_nodes(spark, folder):
    n = commit_nodes(_commits(spark, folder))
    return n.select("node_id", "ts", "title", "body", "signal_score", F.size("files").alias("files"), F.get_json_object("meta", "$.conventionalType").alias("type"), F.get_json_object("meta", "$.insertions").cast("bigint").alias("insertions"))


def q78_patch_nodes(spark, folder):
    n = patch_nodes(_diffs(spark, folder))
    return n.select("node_id", "title", "source", "provenance", "signal_score", F.length("body").alias("chars"), F.substring("body", 1, 40).alias("head"), F.get_json_object("meta", "$.hunkCount").cast("int").alias("hunks"))


def q79_shell_nodes(spark, folder):
    s = table(spark, folder, "shell_entries").withColumn("project_id", F.lit("p"))
    return shell_nodes(s).select("node_id", "source", "title", "body", "signal_score", F.get_json_object("meta", "$.exitCode").cast("int").alias("exit_code"), F.get_json_object("meta", "$.shell").alias("shell"))


def q80_turn_nodes(spark, folder):
    """Turns whose replies are one chunk or more, with sizes told of each."""
    n = turn_nodes(_turns(spark, folder).withColumn("project_id", F.lit("p")))
    return n.select("node_id", "source", "title", "signal_score", F.get_json_object("meta", "$.chunkCount").cast("int").alias("chunks"), F.length("body").alias("chars"))


def _one_chunk(spark, folder):
    t = _turns(spark, folder).where("assistant_text is not null and user_text is not null and length(trim(assistant_text)) between 1 and 800")
    return t.where(~F.col("assistant_text").rlike(r"\n\s*\n|\r|(?m)^#{1,6}\s|^\*\*|^\s|\s\z"))


def q80_short_turn_nodes(spark, folder):
    """Turns with a reply of one paragraph, whose rows SQL can tell."""
    n = turn_nodes(_one_chunk(spark, folder).withColumn("project_id", F.lit("p")))
    return n.select("node_id", "source", "title", F.sha2("body", 256).alias("body"), "signal_score", F.get_json_object("meta", "$.redactedCount").cast("int").alias("redactions"))


def q81_prompts(spark, folder):
    t = _turns(spark, folder).where("length(coalesce(user_text, '')) <= 400 and length(coalesce(assistant_text, '')) <= 700")
    p = session_prompts(t, INSTRUCTIONS, 3000)
    return p.select("session_key", "included", "turns", F.length("prompt").alias("chars"))


def _sessions(spark, folder):
    from lodeline.operators.collect import session_groups

    t = _turns(spark, folder)
    source = t.groupBy("session_key").agg(F.min("source").alias("source"))
    return session_groups(t).join(source, "session_key").withColumn("project_id", F.lit("p"))


def q82_session_memo(spark, folder):
    """Settled sessions not summarised yet, where those of an even number of turns are: the newest ten."""
    prompts = session_prompts(_turns(spark, folder), INSTRUCTIONS).drop("turns")
    sessions = _sessions(spark, folder)
    known = sessions.where("turns % 2 = 0").join(prompts, "session_key").select("session_key", "hash")
    return sessions_to_summarise(sessions, prompts, known, 1_767_225_600_000).select("session_key", "ended_at", "turns")


def q83_session_nodes(spark, folder):
    """Every session with a summary made of its key: the rows it gives."""
    s = _sessions(spark, folder).withColumns({"hash": F.lit("h"), "included": F.col("turns"), "fallback": F.lit("a session")})
    answers = s.select("session_key", F.concat(F.lit("TITLE: Work on "), "session_key", F.lit("\n- done")).alias("raw"))
    return session_nodes(s, answers).select("node_id", "ts", "source", "title", "body", "signal_score")


def q84_contradiction_prompts(spark, folder):
    """What is asked about each replaced row and the one that replaces it."""
    n = table(spark, folder, "nodes").select("node_id", "title", "body", "supersedes").distinct()
    old = n.select(F.col("node_id").alias("supersedes"), F.col("title").alias("old_title"), F.col("body").alias("old_body"))
    p = contradiction_prompt(F.col("old_title"), F.col("old_body"), F.col("title"), F.col("body"), "Do they contradict?")
    return n.where("supersedes is not null").join(old, "supersedes").select("node_id", "supersedes", F.sha2(p, 256).alias("prompt_hash"), F.length(p).alias("chars"))


QUERIES = {k: f for k, f in list(globals().items()) if re.match(r"q\d+_", k)}
_ws = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_cut = lambda c, n: f"case when length({c}) > {n} then regexp_replace(substr({c}, 1, {n} - 1), '{_ws}+$', '') || '…' else {c} end"
_id = lambda kind, key, project="project_id": f"substr(sha256({project} || chr(0) || '{kind}' || chr(0) || {key}), 1, 24)"
_q = lambda s: s.replace("'", "''")


def _first_sql(column: str) -> str:
    return f"regexp_extract({column}, '^([^\\r\\n]*)', 1)"


def _sql() -> dict[str, str]:
    from lodeline.functions.redaction import KEY_VALUE, SHAPES
    from lodeline.operators import collect

    clamp, weight, turn = collect._clamp, collect._weight, collect._turn
    status = "case change_status " + " ".join(f"when '{k}' then '{v}'" for k, v in _TYPES.items()) + " else 'fix' end"
    diffs = f"""d as (select *, substr(sha, 1, 7) as short_sha, {status} || ': ' || regexp_extract(file_path, '([^/]*)$', 1) as subject, coalesce(insertions, 0) + coalesce(deletions, 0) as churn
 from file_diffs qualify row_number() over (partition by project_id, sha, file_path order by diff_id) = 1)"""
    churn = "case when coalesce(is_binary, false) then 'binary' else '+' || coalesce(insertions, 0) || '/-' || coalesce(deletions, 0) end"

    def high(c: str) -> str:
        for s in SHAPES:
            c = f"regexp_replace({c}, '{_q(s)}', '[redacted]', 'g')"
        return c

    red = lambda c: f"regexp_replace({high(c)}, '{_q(KEY_VALUE)}', '\\1: [redacted]', 'g')"
    count = lambda c: collect._count.replace("user_text", c)
    noise = signals
    command = clamp(
        f"case when regexp_matches(trim(command), '{noise.NOISE}') then 0.1 when regexp_matches(trim(command), '{noise.RISKY}') or regexp_matches(trim(command), '{noise.DESTRUCTIVE}') then 0.75 when regexp_matches(trim(command), '{noise.INSTALL}') then 0.6"
        f" when regexp_matches(trim(command), '{noise.BUILD_TEST}') then 0.55 when regexp_matches(trim(command), '{noise.GIT}') then 0.2 else 0.35 end + case when exit_code is null then 0 when exit_code <> 0 then 0.25 else 0.05 end"
        " + case when length(trim(command)) > 60 then 0.05 when length(trim(command)) <= 3 then -0.05 else 0 end"
    )
    one = collect._one
    told = "concat_ws('  ', case when cwd <> '' then 'cwd: ' || cwd end, 'exit: ' || exit_code, 'duration: ' || duration_ms || 'ms')"
    short = f"""{one}, s as (select *, {red('user_text')} as q, {red('assistant_text')} as reply from t where user_text is not null and assistant_text is not null and length(trim(assistant_text)) between 1 and 800
 and not regexp_matches(assistant_text, '\\n\\s*\\n|\\r|(?m:^#{{1,6}}\\s)|^\\*\\*|^\\s|\\s$'))"""
    fold = f"""{one}, p as (select session_key, ts, turn_id, '[' || coalesce(ts, '') || '] developer: ' || q || chr(10) || 'assistant: ' || reply as text, {turn.replace('user_text', 'q')} as signal
  from (select *, {red("coalesce(user_text, '')")} as q, {red("coalesce(assistant_text, '')")} as reply from t where session_key is not null and length(coalesce(user_text, '')) <= 400 and length(coalesce(assistant_text, '')) <= 700)),
 o as (select session_key, length(text) as n, row_number() over (partition by session_key order by signal desc, coalesce(ts, ''), turn_id) as i, count(*) over (partition by session_key) as turns from p),
 f as (select session_key, 0::bigint as i, 0::bigint as used, 0::bigint as included from (select distinct session_key from o)
  union all select f.session_key, o.i, case when used + n <= {3000 - len(INSTRUCTIONS)} then used + n else used end, included + case when used + n <= {3000 - len(INSTRUCTIONS)} then 1 else 0 end from f join o on f.session_key = o.session_key and o.i = f.i + 1)"""
    return {
        "q77_commit_nodes": f"""with {diffs}, p as (select *, row_number() over (partition by project_id, sha order by churn desc, diff_id) as place, '  ' || file_path || ' (' || {churn} || coalesce(', renamed from ' || previous_path, '') || ')' as line from d),
 c as (select project_id, sha, short_sha, min(authored_at) as ts, arg_min(subject, diff_id) as subject, count(*) as n, sum(coalesce(insertions, 0)) as ins, sum(churn) as churn, string_agg(line, chr(10) order by place) filter (place <= 40) as lines from p group by all),
 b as (select *, subject || chr(10) || chr(10) || 'Files changed:' || chr(10) || lines || case when n > 40 then chr(10) || '  ...and ' || (n - 40) || ' more file(s)' else '' end as body from c)
 select {_id('git_commit', 'sha')} as node_id, ts, {_cut('subject', 200)} as title, {_cut('body', 4000)} as body, {clamp(f"({weight.format(t='subject')}) * case when n > 100 or churn > 5000 then 0.75 else 1 end - case when n <= 1 and churn <= 3 then 0.05 else 0 end")} as signal_score,
 cast(least(n, 40) as int) as files, lower(regexp_extract(subject, '{signals.HEADER}', 1)) as type, cast(ins as bigint) as insertions from b""",
        "q78_patch_nodes": f"""with {diffs}, k as (select * from d where not coalesce(is_binary, false) and coalesce(hunk_count, 0) > 0 and not regexp_matches(file_path, '{signals.GENERATED}') qualify row_number() over (partition by project_id, sha order by churn desc, file_path) <= 20),
 b as (select *, subject || ' (' || short_sha || ')' || chr(10) || change_status || ' ' || file_path || ' (+' || coalesce(insertions, 0) || '/-' || coalesce(deletions, 0) || ', ' || hunk_count || case when hunk_count = 1 then ' hunk' else ' hunks' end
  || coalesce(', renamed from ' || previous_path, '') || ')' || chr(10) || {high("coalesce(patch, '')")} as body0, file_path || ' @ ' || short_sha || ' — ' || subject as title0 from k)
 select {_id('code_diff', "(sha || ':' || file_path)")} as node_id, {_cut('title0', 200)} as title, 'git-diff' as source, 'observed' as provenance,
 {clamp(f"({weight.format(t='subject')} - case when regexp_matches(file_path, '{signals.TEST_PATH}') then 0.1 else 0 end + case change_status when 'added' then 0.05 when 'deleted' then -0.1 else 0 end - case when churn <= 2 then 0.05 else 0 end) * case when churn > 400 then 0.75 else 1 end")} as signal_score,
 cast(length({_cut('body0', 2000)}) as int) as chars, substr(body0, 1, 40) as head, hunk_count as hunks from b""",
        "q79_shell_nodes": f"""with b as (select *, '$ ' || command || case when {told} <> '' then chr(10) || chr(10) || {told} else '' end as body0, {_first_sql('command')} as title0 from shell_entries where command is not null)
 select {_id('shell_command', 'natural_key', "'p'")} as node_id, 'shell:' || shell as source, {_cut('title0', 200)} as title, {_cut('body0', 1000)} as body, {command} as signal_score, exit_code, shell from b""",
        "q80_short_turn_nodes": f"""with recursive {short.removeprefix('with ')} select {_id('conversation_turn', "(natural_key || ':0')", "'p'")} as node_id, 'conversation:' || source as source, {_cut(_first_sql('q'), 200)} as title,
 sha256({_cut("('Q: ' || q || chr(10) || chr(10) || 'A: ' || reply)", 2500)}) as body, {turn.replace('user_text', 'q')} as signal_score, cast({count('user_text')} + {count('assistant_text')} as int) as redactions from s""",
        "q81_prompts": fold.replace("with t as", "with recursive t as") + f""", e as (select session_key, max(included) as included, max(used) as used from f group by session_key)
 select e.session_key, cast(included as int) as included, cast(turns as int) as turns, cast(used + 2 * greatest(included - 1, 0) + {len(INSTRUCTIONS) + 7 + 7 + 8} as int) as chars from e join (select distinct session_key, turns from o) using (session_key)""",
        "q82_session_memo": f"""{one}, s as (select session_key, count(*) as turns, max(ts) as ended_at from t group by session_key) select session_key, ended_at, turns from s where turns % 2 = 1 and session_key is not null order by ended_at desc, session_key limit 10""",
        "q83_session_nodes": f"""{one}, s as (select session_key, count(*) as turns, min(ts) as started_at, max(ts) as ended_at, min(source) as source from t where session_key is not null group by session_key)
 select {_id('session_summary', 'session_key', "'p'")} as node_id, ended_at as ts, 'session:' || source as source, {_cut("('Work on ' || session_key)", 200)} as title, 'Session of ' || substr(started_at, 1, 10) || ' — ' || turns || ' exchange(s)' || chr(10) || chr(10) || '- done' as body,
 {clamp('0.6 + least(0.25, turns / 100)')} as signal_score from s""",
        "q84_contradiction_prompts": f"""with n as (select distinct node_id, coalesce(title, '') as title, coalesce(body, '') as body, supersedes from nodes),
 p as (select a.node_id, a.supersedes, 'Do they contradict?' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'OLDER (' || o.title || '):' || chr(10) || {_cut('o.body', 1500)} || chr(10) || chr(10) || 'NEWER (' || a.title || '):' || chr(10) || {_cut('a.body', 1500)}
  || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Answer:' as prompt from n a join n o on a.supersedes = o.node_id) select node_id, supersedes, sha256(prompt) as prompt_hash, cast(length(prompt) as int) as chars from p""",
    }


SQL = _sql()
