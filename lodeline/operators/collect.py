"""Raw records to rows of the store: turns, sessions, sections, patches, and what is read out of texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions import signals
from lodeline.functions.redaction import KEY_VALUE, SHAPES, redacted, redactions
from lodeline.functions.text import approx_tokens, let, trimmed, truncated
from lodeline.functions.times import with_instant
from lodeline.operators.lexical import LIVE_SQL, live_nodes
from lodeline.tables import cut, table

# Names of files, headings, and titles that tell nothing.
_NAMES = r"(?:[\w.-]+/)*[\w-]+\.(?:ts|tsx|js|jsx|json|md|py|rs|go|java|c|cpp|h|hpp|css|html|ya?ml|toml|sql|sh|ps1)"
#: Word borders are those of plain letters and digits, also next to other scripts.
FILE_PATH = rf"(?<![A-Za-z0-9_]){_NAMES}(?![A-Za-z0-9_])"
CHUNK_CHARS, SECTION_HEADING, BOLD_LEAD = 1500, r"^#{1,6}\s+(.+)$", r"^\*\*([^*]+?)\*\*"
GENERIC_TITLE = r"(?i)^(a |the )?(session |conversation |project |work )?(summary|update|overview|recap|status)\b"
ROLE_TITLE = r"(?i)^(role\s*[:：]|you\s*(?:'re|are)\s+(acting as|serving as|playing the role of|a\b)|i\s*(?:'m|am)\s+(acting as|a\b)|acting as\b)"


def mentioned_files(text: Column, most: int = 20) -> Column:
    """The first distinct file names of a text."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(FILE_PATH), F.lit(0))), 1, most)


def chunks(text: Column, most: int = CHUNK_CHARS) -> Column:
    """array<struct<heading, text>>: paragraphs gathered up to ``most`` characters; a heading or a bold lead opens a section.

    One fold over a text's own paragraphs. After an overflow the rest of a section has no heading.
    """
    plain = F.regexp_replace(text, r"\r\n?", "\n")
    paragraphs = F.filter(F.transform(F.split(plain, r"\n{2,}"), trimmed), lambda p: p != "")
    empty = "struct<done:array<struct<heading:string,text:string>>,buf:string,heading:string>"
    start = F.from_json(F.lit('{"done": []}'), empty)
    piece = lambda s: F.struct(s["heading"].alias("heading"), truncated(s["buf"], most).alias("text"))

    def step(s, p):
        first = F.regexp_extract(p, r"^([^\n]*)", 1)
        found = F.when(first.rlike(SECTION_HEADING), trimmed(F.regexp_extract(first, SECTION_HEADING, 1))).when(p.rlike(BOLD_LEAD), trimmed(F.regexp_extract(p, BOLD_LEAD, 1)))
        close = s["buf"].isNotNull() & (found.isNotNull() | (F.length(s["buf"]) + 2 + F.length(p) > most))
        done = F.when(close, F.concat(s["done"], F.array(piece(s)))).otherwise(s["done"])
        buf = F.when(close | s["buf"].isNull(), p).otherwise(F.concat_ws("\n\n", s["buf"], p))
        heading = F.coalesce(found, F.when(close, F.lit(None)).otherwise(s["heading"]))
        return F.struct(done.alias("done"), buf.alias("buf"), heading.alias("heading")).cast(empty)

    last = lambda s: F.when(s["buf"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(piece(s))))
    return F.aggregate(paragraphs, start, step, last)


def sections(files: DataFrame, most: int = CHUNK_CHARS) -> DataFrame:
    """(path, index, natural_key, title, heading, text, signal) of the sections of ``files`` (path, content).

    A section's key is its heading in letters and digits; the second of equal ones ends in ``:1``, and so on.
    """
    each = files.select("path", F.posexplode(chunks(F.col("content"), most)).alias("index", "_c"))
    slug = F.regexp_replace(F.regexp_replace(F.lower("_c.heading"), r"[^a-z0-9]+", "-"), r"^-+|-+\z", "")
    slug = F.when(F.col("_c.heading").isNull(), F.concat(F.lit("_preamble-"), "index")).when(slug == "", F.concat(F.lit("_section-"), "index")).otherwise(slug)
    each = each.withColumn("_slug", slug)
    again = F.row_number().over(Window.partitionBy("path", "_slug").orderBy("index")) - 1
    key = F.concat(F.col("path"), F.lit("#"), F.col("_slug"), F.when(F.col("_again") > 0, F.concat(F.lit(":"), F.col("_again"))).otherwise(""))
    count = F.count(F.lit(1)).over(Window.partitionBy("path"))
    title = F.when(F.col("_c.heading").isNotNull(), F.concat("path", F.lit(" — "), "_c.heading")).when(F.col("_n") > 1, F.concat("path", F.lit(" (part "), F.col("index") + 1, F.lit("/"), "_n", F.lit(")"))).otherwise(F.col("path"))
    return each.withColumn("_again", again).withColumn("_n", count).select(
        "path", "index", key.alias("natural_key"), truncated(title, 200).alias("title"), F.col("_c.heading").alias("heading"), F.col("_c.text").alias("text"),
        signals.section_signal(F.col("path"), F.col("_c.heading"), F.col("_c.text")).alias("signal"),
    )


def turns_of(lines: DataFrame) -> DataFrame:
    """(session_id, turn_no, user_text, assistant_text): each user line with the assistant text that follows, in line order.

    Side work, tool results and text before the first user line are left out; the texts of one line are
    joined by line breaks, those of several by blank lines. A session's lines are bounded by its
    transcript file.
    """
    blocks = F.from_json("msg_content", "array<struct<type:string,text:string>>")
    listed = F.coalesce(F.exists(blocks, lambda b: b["type"].isNotNull()), F.lit(False))
    texts = trimmed(F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n"))
    result = F.coalesce(F.exists(blocks, lambda b: F.coalesce(b["type"] == "tool_result", F.lit(False))), F.lit(False))
    user = F.when((F.col("line_type") == "user") & ~result, F.when(listed, texts).otherwise(trimmed(F.col("msg_content"))))
    reply = F.when((F.col("line_type") == "assistant") & listed, texts)
    told = lines.where("session_id is not null and not coalesce(is_sidechain, false)").select("session_id", "line_no", F.when(user != "", user).alias("u"), F.when(reply != "", reply).alias("a"))
    told = told.where("u is not null or a is not null")
    order = Window.partitionBy("session_id").orderBy("line_no", F.col("u").isNull(), "u", "a")
    numbered = told.withColumn("turn_no", F.sum(F.col("u").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_o", F.row_number().over(order))
    replies = F.transform(F.array_sort(F.collect_list(F.when(F.col("a").isNotNull(), F.struct("_o", "a")))), lambda x: x["a"])
    return numbered.where("turn_no > 0").groupBy("session_id", "turn_no").agg(F.max("u").alias("user_text"), F.array_join(replies, "\n\n").alias("assistant_text"))


def session_groups(turns: DataFrame) -> DataFrame:
    """(session_key, turns, started_at, ended_at, cwd, signal): grouped by key; first and last time as text."""
    first = F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.struct("ts", "turn_id")))
    told = turns.groupBy("session_key").agg(F.count(F.lit(1)).alias("turns"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), first.alias("cwd"))
    return told.withColumn("signal", signals.session_signal(F.col("turns")))


def settled(sessions: DataFrame, now_ms: int, minutes: int = 30) -> DataFrame:
    """Sessions that ended at least so many minutes ago; an unreadable end counts as settled."""
    dated = with_instant(sessions, F.col("ended_at"), "_end")
    return dated.where(F.coalesce(F.col("_end") <= now_ms - minutes * 60_000, F.lit(True))).drop("_end")


def within_budget(rows: DataFrame, key: str, budget: int) -> DataFrame:
    """Of each key's rows (key, ts, id, text, signal) those kept by signal while they fit into ``budget`` characters."""
    item = F.struct((-F.col("signal")).alias("s"), "ts", "id", F.length("text").alias("n"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_l"))
    state = "struct<used:int,ids:array<bigint>>"
    start = F.from_json(F.lit('{"used": 0, "ids": []}'), state)
    step = lambda s, x: F.when(s["used"] + x["n"] > budget, s).otherwise(F.struct((s["used"] + x["n"]).alias("used"), F.concat(s["ids"], F.array(x["id"].cast("bigint"))).alias("ids")).cast(state))
    return listed.select(key, F.explode(F.aggregate("_l", start, step)["ids"]).alias("id"))


def parsed_summary(raw: Column, fallback: Column) -> Column:
    """title and body of a model's summary: the TITLE line unless it is generic or tells a role, else the fallback."""
    clean = lambda t: trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^[-*#>\s]+", ""), r"\*+", ""), r"\s*:\s*\z", ""))

    def told(text):
        first = F.regexp_extract(text, r"^([^\r\n]*)", 1)
        rest = trimmed(F.regexp_replace(text, r"^[^\r\n]*", ""))
        return F.struct(text.alias("text"), first.rlike(r"(?i)^TITLE:\s*\S").alias("labelled"), clean(F.regexp_extract(first, r"(?i)^TITLE:\s*(.+)$", 1)).alias("title"), rest.alias("rest"), clean(fallback).alias("spare"))

    def put(p):
        good = p["labelled"] & (p["title"] != "") & ~p["title"].rlike(GENERIC_TITLE) & ~p["title"].rlike(ROLE_TITLE)
        title = F.when(good, p["title"]).when(p["spare"] == "", "Working session").otherwise(p["spare"])
        body = F.when(~p["labelled"], p["text"]).when(p["rest"] != "", p["rest"]).otherwise(p["title"])
        return F.when(p["text"] != "", F.struct(let(title, lambda t: truncated(t, 200)).alias("title"), body.alias("body")))

    return let(let(trimmed(redacted(raw)), told), put)


def parsed_verdict(raw: Column) -> Column:
    """contradicts and reason of a model's verdict; null where there is no readable VERDICT line."""
    verdict = F.upper(F.regexp_extract(raw, r"(?im)^\s*VERDICT:\s*(YES|NO)\b", 1))
    reason = trimmed(F.regexp_extract(raw, r"(?im)^\s*REASON:[ \t]*([^\r\n]*)", 1))
    return F.when(verdict != "", F.struct((verdict == "YES").alias("contradicts"), truncated(reason, 300).alias("reason")))


def even_sample(rows: DataFrame, order: str, k: int) -> DataFrame:
    """``k`` rows at even distances of the order, the first and the last among them; all where there are no more than ``k``.

    Rows are numbered within range partitions, whose sizes alone come to the driver.
    """
    spread = cut(rows.orderBy(order).withColumn("_p", F.spark_partition_id()))
    sizes = sorted((r["_p"], r["count"]) for r in spread.groupBy("_p").count().collect())
    n = sum(c for _, c in sizes)
    if n <= k:
        return spread.drop("_p")
    wanted = sorted({int((i * (n - 1)) / (k - 1) + 0.5) for i in range(k)}) if k > 1 else [0]
    places, before = [], 0
    for p, c in sizes:
        places += [(p, w - before) for w in wanted if before <= w < before + c]
        before += c
    numbered = spread.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1)
    return numbered.join(F.broadcast(rows.sparkSession.createDataFrame(places, "_p int, _i int")), ["_p", "_i"]).drop("_p", "_i")


# --- queries ---------------------------------------------------------------------------------------


def _turns(spark, folder):
    """One row per turn: of a natural key told twice, the smaller id."""
    t = table(spark, folder, "conversation_turns")
    rest = [c for c in t.columns if c != "natural_key"]
    return t.groupBy("natural_key").agg(F.min_by(F.struct(*rest), "turn_id").alias("r")).select("natural_key", "r.*")


def q26_top_files(spark, folder):
    d = table(spark, folder, "file_diffs")
    churn = F.coalesce("insertions", F.lit(0)) + F.coalesce("deletions", F.lit(0))
    place = F.row_number().over(Window.partitionBy("sha").orderBy(F.desc("churn"), "diff_id"))
    return d.select("sha", "diff_id", "file_path", churn.cast("bigint").alias("churn")).withColumn("place", place).where("place <= 3")


def q27_churn(spark, folder):
    d = table(spark, folder, "file_diffs")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return d.groupBy("sha").agg(F.count(F.lit(1)).alias("files"), total("insertions").alias("insertions"), total("deletions").alias("deletions"))


def q38_redacted(spark, folder):
    return table(spark, folder, "file_diffs").select("diff_id", redacted(F.col("patch"), code=True).alias("patch"), redacted(F.col("patch")).alias("strict_patch"))


def q39_redactions(spark, folder):
    t = table(spark, folder, "conversation_turns").select("source", redactions(F.col("user_text")).alias("n"))
    return t.groupBy("source").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("redactions"), F.count(F.when(F.col("n") > 0, 1)).alias("texts"))


def q40_chunks(spark, folder):
    d = table(spark, folder, "documents")
    return d.select("doc_id", F.posexplode(chunks(F.col("text"), 600)).alias("chunk_no", "c")).select("doc_id", "chunk_no", "c.heading", F.length("c.text").alias("chars"))


def q41_files(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.explode(mentioned_files(F.col("text"))).alias("path"))


def q42_section_signal(spark, folder):
    """Paths and headings from the documents: every seventh number a readme, the heading the first line if it is one."""
    d = table(spark, folder, "documents").where("kind = 'doc_section' and text is not null")
    path = F.concat_ws("/", F.coalesce("source", F.lit("docs")), F.when(F.col("doc_id") % 7 == 0, "README.md").otherwise("guide.md"))
    heading = F.nullif(F.regexp_extract("text", r"^#{1,6} ([^\r\n]*)", 1), F.lit(""))
    return d.select("doc_id", signals.section_signal(path, heading, F.col("text")).alias("signal"))


def q43_turn_signal(spark, folder):
    t = table(spark, folder, "conversation_turns").where("user_text is not null and assistant_text is not null")
    return t.select("turn_id", signals.turn_signal(F.col("user_text"), F.col("assistant_text")).alias("signal"))


def q44_command_signal(spark, folder):
    h = table(spark, folder, "hook_log").where("command is not null")
    return h.select("entry_id", signals.command_signal(F.col("command"), F.col("exit_code")).alias("signal"))


def q45_patch_signal(spark, folder):
    """Each patch with the subject of a commit of its project, the first by title."""
    d = table(spark, folder, "file_diffs").where("not is_binary")
    n = table(spark, folder, "nodes").where("kind = 'git_commit' and title is not null").groupBy("project_id").agg(F.min("title").alias("title"))
    told = d.join(n, "project_id", "left").select("diff_id", F.coalesce("title", F.lit("")).alias("t"), "file_path", "change_status", "insertions", "deletions")
    return told.select("diff_id", signals.patch_signal(F.col("t"), F.col("file_path"), F.col("change_status"), F.col("insertions") + F.col("deletions")).alias("signal"))


def q45_commit_signal(spark, folder):
    """Commits by title, with as many files and as much churn as the patches of their project in all, a merge where the title says so."""
    n = live_nodes(spark, folder).where("kind = 'git_commit' and title is not null")
    sizes = table(spark, folder, "file_diffs").groupBy("project_id").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("insertions", F.lit(0)) + F.coalesce("deletions", F.lit(0))).alias("churn"))
    told = n.join(sizes, "project_id", "left").fillna(0, ["files", "churn"])
    return told.select("node_id", signals.commit_signal(F.col("title"), F.length(F.coalesce("body", F.lit(""))), F.lower("title").contains("merge"), F.col("files"), F.col("churn")).alias("signal"))


def q47_turns(spark, folder):
    """Of a line told several times, the smallest copy: the same whatever the order of the rows; lines without number stay apart."""
    t = table(spark, folder, "transcript_lines")
    rest = [c for c in t.columns if c not in ("session_id", "line_no")]
    one = t.where("line_no is not null").groupBy("session_id", "line_no").agg(F.min(F.struct(*rest)).alias("r")).select("session_id", "line_no", "r.*")
    return turns_of(one.unionByName(t.where("line_no is null")))


def q48_sessions(spark, folder):
    return session_groups(_turns(spark, folder))


def q49_settled(spark, folder):
    return settled(session_groups(_turns(spark, folder)), 1_521_500_000_000).select("session_key", "ended_at")


def q50_prompt_turns(spark, folder):
    t = _turns(spark, folder).where("user_text is not null").select("session_key", "ts", F.col("turn_id").alias("id"), truncated(F.col("user_text"), 400).alias("text"), signals.turn_signal(F.col("user_text"), F.coalesce("assistant_text", F.lit(""))).alias("signal"))
    return within_budget(t, "session_key", 900)


def q51_meta_json(spark, folder):
    code = F.get_json_object("meta", "$.exitCode").try_cast("int")
    return live_nodes(spark, folder).where(code.isNotNull() & (code != 0)).select("node_id", code.alias("exit_code"), (F.get_json_object("meta", "$.tsApprox") == "true").alias("ts_approx"))


def q52_tail(spark, folder):
    """The last five commands of each shell, with their distance from the end."""
    s = table(spark, folder, "shell_entries").where("command is not null")
    back = F.row_number().over(Window.partitionBy("shell").orderBy(F.desc("entry_id"))) - 1
    return s.withColumn("from_end", back).where("from_end < 5").select("shell", "entry_id", "from_end")


def q55_slugs(spark, folder):
    d = table(spark, folder, "documents").where("text is not null and kind = 'doc_section'")
    return sections(d.select(F.concat(F.coalesce("project_id", F.lit("")), F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content")), 600).select("path", "index", "natural_key", "title")


def q56_even_sample(spark, folder):
    return even_sample(table(spark, folder, "documents").select("doc_id"), "doc_id", 16)


def q64_saving(spark, folder):
    """Per source: what packing 320 characters of each document saves against reading them whole."""
    d = table(spark, folder, "documents").where("text is not null and source is not null")
    t = d.select("source", approx_tokens(F.col("text")).alias("whole"), (approx_tokens(truncated(F.col("text"), 320)) + 8).alias("used"))
    return t.groupBy("source").agg(F.round(F.median(1 - F.col("used") / F.greatest("whole", F.lit(1))), 6).alias("median_saving"), F.round(1 - F.sum("used") / F.sum("whole"), 6).alias("saving"))


def q65_hottest(spark, folder):
    return table(spark, folder, "file_diffs").groupBy("file_path").agg(F.countDistinct("sha").alias("commits")).orderBy(F.desc("commits"), "file_path").limit(5)


_RAW = [
    "VERDICT: YES\nREASON: the lock is gone", "reason: none\nverdict: no", "maybe", "VERDICT: YES or NO", "  VERDICT: NO\n",
    "TITLE: Session summary\n- a", "TITLE: **Raised the floor:**\n- why", "prose without a title", "TITLE: You are a reviewer\nx", "TITLE: Only a title",
]


def q71_verdicts(spark, folder):
    r = spark.createDataFrame([(i, t) for i, t in enumerate(_RAW)], "i int, raw string").withColumn("v", parsed_verdict(F.col("raw")))
    return r.where("v is not null").select("i", "v.contradicts", "v.reason")


def q72_summaries(spark, folder):
    r = spark.createDataFrame([(i, t) for i, t in enumerate(_RAW)], "i int, raw string").withColumn("s", parsed_summary(F.col("raw"), F.lit("the opening line")))
    return r.select("i", "s.title", "s.body")


def q73_headers(spark, folder):
    n = live_nodes(spark, folder).where("kind = 'git_commit' and title is not null").withColumn("h", signals.header(F.col("title")))
    return n.select("node_id", "h.type", "h.scope", "h.breaking", "h.description")


QUERIES = {k: f for k, f in list(globals().items()) if re.match(r"q\d+_", k)}

_ws = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_trim = lambda c: f"regexp_replace({c}, '^{_ws}+|{_ws}+$', '', 'g')"
_clamp = lambda c: f"round(least(1.0, greatest(0.05, {c})) + 1e-9, 3)"
_q = lambda s: s.replace("'", "''")
_red = "{}"
for _s in SHAPES:
    _red = f"regexp_replace({_red}, '{_q(_s)}', '[redacted]', 'g')"
_count = " + ".join([f"len(regexp_extract_all({{c{i}}}, '{_q(s)}'))" for i, s in enumerate((*SHAPES, KEY_VALUE))])
_steps, _c = {}, "user_text"
for _i, _s in enumerate(SHAPES):
    _steps[f"c{_i}"] = _c
    _c = f"regexp_replace({_c}, '{_q(_s)}', '[redacted]', 'g')"
_steps[f"c{len(SHAPES)}"] = _c
for _i, _s in enumerate((*SHAPES, KEY_VALUE)):
    _count = _count.replace(f"{{c{_i}}}", _steps[f"c{_i}"])
_weight = "case lower(regexp_extract({t}, '" + signals.HEADER + "', 1)) " + " ".join(f"when '{k}' then {v}" for k, v in signals.TYPE_WEIGHTS.items()) + " else 0.5 end"
_one = "with t as (select * from conversation_turns qualify row_number() over (partition by natural_key order by turn_id) = 1)"
_expl, _ack = signals.EXPLANATION, signals.ACKNOWLEDGEMENT
_turn = _clamp(f"0.3 + case when regexp_matches(user_text || chr(10) || reply, '{_expl}') then 0.25 else 0 end + case when length(reply) > 400 then 0.15 when length(reply) < 80 then -0.1 else 0 end - case when regexp_matches(trim(user_text), '{_ack}') then 0.2 else 0 end + case when ends_with(trim(user_text), '?') then 0.05 else 0 end")
SQL = {
    "q26_top_files": "select sha, diff_id, file_path, churn, place from (select sha, diff_id, file_path, cast(coalesce(insertions, 0) + coalesce(deletions, 0) as bigint) as churn, cast(row_number() over (partition by sha order by coalesce(insertions, 0) + coalesce(deletions, 0) desc, diff_id) as int) as place from file_diffs) where place <= 3",
    "q27_churn": "select sha, count(*) as files, cast(sum(coalesce(insertions, 0)) as bigint) as insertions, cast(sum(coalesce(deletions, 0)) as bigint) as deletions from file_diffs group by sha",
    "q39_redactions": f"select source, cast(coalesce(sum(n), 0) as bigint) as redactions, count(*) filter (n > 0) as texts from (select source, {_count} as n from conversation_turns) group by source",
    "q41_files": f"with m as (select doc_id, unnest(list_slice(list_distinct_in_order, 1, 20)) as path from (select doc_id, list_filter(r, lambda x, i: list_position(r, x) = i) as list_distinct_in_order from (select doc_id, regexp_extract_all(text, '\\b{_NAMES}\\b') as r from documents))) select * from m",
    "q42_section_signal": f"select doc_id, {_clamp(f'''0.45 + case when regexp_matches(text, '{_expl}') then 0.25 else 0 end + case when doc_id % 7 = 0 then 0.1 else 0 end - case when regexp_extract(text, '^#{{1,6}} ([^\\r\\n]*)', 1) = '' then 0.1 else 0 end - case when length(text) < 80 then 0.15 else 0 end''')} as signal from documents where kind = 'doc_section' and text is not null",
    "q43_turn_signal": f"select turn_id, {_turn} as signal from (select turn_id, user_text, assistant_text as reply from conversation_turns where user_text is not null and assistant_text is not null)",
    "q44_command_signal": "select entry_id, " + _clamp(f"case when regexp_matches(trim(command), '{signals.NOISE}') then 0.1 when regexp_matches(trim(command), '{signals.RISKY}') or regexp_matches(trim(command), '{signals.DESTRUCTIVE}') then 0.75 when regexp_matches(trim(command), '{signals.INSTALL}') then 0.6 when regexp_matches(trim(command), '{signals.BUILD_TEST}') then 0.55 when regexp_matches(trim(command), '{signals.GIT}') then 0.2 else 0.35 end + case when exit_code is null then 0 when exit_code <> 0 then 0.25 else 0.05 end + case when length(trim(command)) > 60 then 0.05 when length(trim(command)) <= 3 then -0.05 else 0 end") + " as signal from hook_log where command is not null",
    "q45_patch_signal": "with n as (select project_id, min(title) as title from nodes where kind = 'git_commit' and title is not null group by project_id), d as (select f.*, coalesce(title, '') as t from file_diffs f left join n using (project_id) where not is_binary) select diff_id, "
    + _clamp(f"({_weight.format(t='trim(t)')} + case when regexp_extract(trim(t), '{signals.HEADER}', 3) = '!' then 0.1 else 0 end - case when regexp_matches(file_path, '{signals.TEST_PATH}') then 0.1 else 0 end + case change_status when 'added' then 0.05 when 'deleted' then -0.1 else 0 end - case when insertions + deletions <= 2 then 0.05 else 0 end) * case when insertions + deletions > 400 then 0.75 else 1 end")
    + " as signal from d",
    "q45_commit_signal": f"with n as ({LIVE_SQL}), z as (select project_id, count(*) as files, sum(coalesce(insertions, 0) + coalesce(deletions, 0)) as churn from file_diffs group by project_id), c as (select n.*, coalesce(files, 0) as files, coalesce(churn, 0) as churn, {_weight.format(t='trim(title)')} + case when regexp_extract(trim(title), '{signals.HEADER}', 3) = '!' then 0.12 else 0 end + case when length(coalesce(body, '')) > 120 then 0.1 else 0 end as s from n left join z using (project_id) where kind = 'git_commit' and title is not null) select node_id, "
    + _clamp(f"(case when contains(lower(title), 'merge') then least(s, 0.3) else s end - case when regexp_matches(title, '{signals.AUTOMATED}') then 0.15 else 0 end) * case when files > 100 or churn > 5000 then 0.75 else 1 end - case when files <= 1 and churn <= 3 then 0.05 else 0 end")
    + " as signal from c",
    "q48_sessions": f"{_one} select session_key, count(*) as turns, min(ts) as started_at, max(ts) as ended_at, arg_min(cwd, (ts, turn_id)) filter (cwd is not null) as cwd, {_clamp('0.6 + least(0.25, count(*) / 100)')} as signal from t group by session_key",
    "q51_meta_json": f"with n as ({LIVE_SQL}) select node_id, cast(json_extract_string(meta, '$.exitCode') as int) as exit_code, json_extract_string(meta, '$.tsApprox') = 'true' as ts_approx from n where try_cast(json_extract_string(meta, '$.exitCode') as int) <> 0",
    "q52_tail": "select shell, entry_id, from_end from (select shell, entry_id, cast(row_number() over (partition by shell order by entry_id desc) - 1 as int) as from_end from shell_entries where command is not null) where from_end < 5",
    "q56_even_sample": "with n as (select doc_id, row_number() over (order by doc_id) - 1 as i, count(*) over () as n from documents) select distinct doc_id from n, range(16) r(k) where i = cast(floor(k * (n - 1) / 15.0 + 0.5) as bigint)",
    "q64_saving": f"with t as (select source, ceil(length(text) / 4) as whole, ceil(length(case when length(text) > 320 then regexp_replace(substr(text, 1, 319), '{_ws}+$', '') || '…' else text end) / 4) + 8 as used from documents where text is not null and source is not null) select source, round(median(1 - used / greatest(whole, 1)), 6) as median_saving, round(1 - sum(used) / sum(whole), 6) as saving from t group by source",
    "q65_hottest": "select file_path, count(distinct sha) as commits from file_diffs group by file_path order by commits desc, file_path limit 5",
    "q73_headers": f"with n as ({LIVE_SQL}), h as (select node_id, trim(title) as t from n where kind = 'git_commit' and title is not null) select node_id, nullif(lower(regexp_extract(t, '{signals.HEADER}', 1)), '') as type, nullif(regexp_extract(t, '{signals.HEADER}', 2), '') as scope, regexp_extract(t, '{signals.HEADER}', 3) = '!' as breaking, trim(coalesce(nullif(regexp_extract(t, '{signals.HEADER}', 4), ''), t)) as description from h",
}
SQL["q38_redacted"] = f"select diff_id, {_red.replace('{}', 'patch')} as patch, regexp_replace({_red.replace('{}', 'patch')}, '{_q(KEY_VALUE)}', '\\1: [redacted]', 'g') as strict_patch from file_diffs"
_given = [t.replace("'", "''") for t in _RAW]
_spare = "'the opening line'"
SQL["q71_verdicts"] = "select * from (values (0, true, 'the lock is gone'), (1, false, 'none'), (3, true, ''), (4, false, '')) v(i, contradicts, reason)"
SQL["q72_summaries"] = "select * from (values " + ", ".join(
    [f"({i}, {_spare}, '{t.strip()}')" for i, t in enumerate(_given) if not t.startswith("TITLE:")]
    + [f"(5, {_spare}, '- a')", "(6, 'Raised the floor', '- why')", f"(8, {_spare}, 'x')", "(9, 'Only a title', 'Only a title')"]
) + ") v(i, title, body)"
_end = r"""(epoch_ms(try_cast(replace(substr(ended_at, 1, 19), 'T', ' ') as timestamp)) + coalesce(try_cast(substr(rpad(regexp_extract(ended_at, '\.(\d+)', 1), 3, '0'), 1, 3) as bigint), 0)
 - case when ends_with(ended_at, 'Z') then 0 else (case when substr(ended_at, -6, 1) = '-' then -1 else 1 end) * (cast(substr(ended_at, -5, 2) as bigint) * 60 + cast(right(ended_at, 2) as bigint)) * 60000 end)"""
SQL["q49_settled"] = f"{_one}, s as (select session_key, max(ts) as ended_at from t group by session_key) select session_key, ended_at from s where case when regexp_matches(ended_at, '^\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?(Z|[+-]\\d\\d:\\d\\d)$') then {_end} <= 1521500000000 - 1800000 else true end"
SQL["q50_prompt_turns"] = f"""{_one.replace('with t as', 'with recursive t as')}, p as (select session_key, turn_id, ts, length(case when length(user_text) > 400 then regexp_replace(substr(user_text, 1, 399), '{_ws}+$', '') || '…' else user_text end) as n, {_turn} as signal
 from (select *, coalesce(assistant_text, '') as reply from t) where user_text is not null), o as (select session_key, turn_id, n, row_number() over (partition by session_key order by signal desc, ts nulls first, turn_id) as i from p),
f as (select session_key, 0::bigint as i, 0::bigint as used, null::bigint as id from (select distinct session_key from o)
 union all select f.session_key, o.i, case when used + n <= 900 then used + n else used end, case when used + n <= 900 then turn_id end from f join o on f.session_key is not distinct from o.session_key and o.i = f.i + 1)
select session_key, id from f where id is not null"""
