"""Failures and what resolved them, risks of files, stale and contradicted rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions.text import normalised_command
from lodeline.functions.times import with_instant
from lodeline.operators.lexical import _SYNTAX, B, FREQUENT, K1, LEAST_CORPUS, LIVE_SQL, TITLE_WEIGHT, live_nodes, words, words_sql
from lodeline.operators.sessions import directory_key
from lodeline.operators.vectors import nearest_of_queries
from lodeline.tables import cut, table

DAY_MS = 86_400_000
STALE_DAYS, RISK_DAYS, RISK_COMMITS = 45, 30, 4


def commands(hook_log: DataFrame) -> DataFrame:
    """(entry_id, at_ms, dir_key, command_key, failed) of the entries with an instant, a command and an exit code."""
    dated = with_instant(hook_log.where("command is not null and exit_code is not null"), F.col("ts"), "at_ms").where("at_ms is not null")
    return dated.select("entry_id", "at_ms", directory_key(F.col("cwd")).alias("dir_key"), normalised_command(F.col("command")).alias("command_key"), (F.col("exit_code") != 0).alias("failed"))


def retry_links(runs: DataFrame, window_ms: int = DAY_MS) -> DataFrame:
    """(failure_id, success_id): each failure with the first success of the same command and directory in (t, t + window].

    Directories are compared null-safely; of successes at one time the smaller id counts. Runs are
    spread by command, directory and stretch of time as long as the window; successes also go to the
    stretch before, so that each failure meets all candidates in its own. A command with a third of all
    runs is so cut by time, and nothing is joined.
    """
    stretch = F.floor(F.col("at_ms") / window_ms)
    spread = runs.withColumn("_b", F.when(F.col("failed"), F.array(stretch)).otherwise(F.array(stretch, stretch - 1))).withColumn("_b", F.explode("_b"))
    later = Window.partitionBy("command_key", "dir_key", "_b").orderBy("at_ms").rangeBetween(1, window_ms)
    success = F.when(~F.col("failed"), F.struct("at_ms", "entry_id"))
    found = spread.withColumn("_s", F.min(success).over(later)).where("failed and _s is not null")
    return found.select(F.col("entry_id").alias("failure_id"), F.col("_s.entry_id").alias("success_id"))


def command_phrases(command: Column) -> Column:
    """The distinct terms of a command as words with a blank before each: tokens without search syntax, ``id`` only where there is nothing else."""
    tokens = F.filter(F.split(F.regexp_replace(command, _SYNTAX.pattern, " "), r"\s+"), lambda t: t != "")
    kept = F.filter(tokens, lambda t: F.lower(t) != "id")
    tokens = F.when(F.size(kept) > 0, kept).otherwise(tokens)
    return F.array_distinct(F.filter(F.transform(tokens, lambda t: F.concat(F.lit(" "), F.array_join(words(t), " "))), lambda p: p != " "))


def discussion_links(failures: DataFrame, talk: DataFrame, window_ms: int = DAY_MS, frequent: float = FREQUENT) -> DataFrame:
    """(failure_id, node_id): each failure with the best text of its project in (t, t + window] that holds all terms of its command.

    ``failures`` (failure_id, project_id, at_ms, command), ``talk`` (node_id, project_id, at_ms, title, body); projects are
    compared null-safely. A term is the words of one token side by side, the last as a prefix; terms in more than a
    fifth of a project's texts, if it has ten, don't count, and a failure left without terms has no link. The
    best text is that of the highest BM25 over the project's texts, titles weighing ten times; ties go to the
    earlier, then the smaller id.

    Distinct terms meet distinct words once; a failure's candidates are the texts of its rarest term in its stretch
    of time, whose other terms are then looked up in the text's own: a term is in at most a fifth of all
    texts and spread by time, so no key is hot.
    """
    project = lambda: F.coalesce("project_id", F.lit("\0")).alias("project")
    asked = failures.select("failure_id", project(), F.col("at_ms").alias("f_ms"), "command")
    commands_ = asked.select("project", "command").distinct().withColumn("_p", command_phrases(F.col("command")))
    terms = commands_.select("project", F.explode("_p").alias("p")).distinct()
    told = talk.select("node_id", project(), F.col("at_ms").alias("t_ms"), words(F.col("title")).alias("_t"), words(F.col("body")).alias("_b"))
    # Words, postings and matches are read several times: each is made once.
    told = cut(told.withColumn("len", (F.size("_t") + F.size("_b")).cast("double")))
    sizes = told.groupBy("project").agg(F.count(F.lit(1)).cast("double").alias("total"), F.avg("len").alias("avg_len"))
    one = lambda field, t, b: F.transform(field, lambda w: F.struct(w.alias("word"), F.lit(t).alias("t"), F.lit(b).alias("b")))
    posts = cut(told.select("node_id", "project", F.inline(F.concat(one("_t", 1, 0), one("_b", 0, 1)))).groupBy("node_id", "project", "word").agg(F.sum("t").alias("t"), F.sum("b").alias("b")))
    # Single words are prefixes of words; of several, the first is found as it stands and the rest is looked for in the text.
    single = ~F.substring("p", 2, 1 << 30).contains(" ")
    vocabulary = posts.select("project", "word").distinct()
    prefixes = F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.concat(F.lit(" "), F.substring(F.col("word"), F.lit(1), n)))
    means = vocabulary.select("project", "word", F.explode(prefixes).alias("p")).join(terms.where(single), ["project", "p"])
    by_word = posts.join(means, ["project", "word"]).groupBy("project", "p", "node_id").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
    several = terms.where(~single).withColumn("word", F.substring_index(F.substring("p", 2, 1 << 30), " ", 1))
    text = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    times = lambda c: ((F.length(text(c)) - F.length(F.replace(text(c), F.col("p"), F.lit("")))) / F.length("p")).cast("bigint")
    near = posts.join(several, ["project", "word"]).select("project", "p", "node_id").join(told.select("node_id", "_t", "_b"), "node_id")
    by_text = near.select("project", "p", "node_id", times("_t").alias("t"), times("_b").alias("b")).where("t + b > 0")
    met = cut(by_word.unionByName(by_text), posts)
    df = met.groupBy("project", "p").agg(F.count(F.lit(1)).alias("df"))
    rated = terms.join(df, ["project", "p"], "left").fillna(0, ["df"]).join(sizes, "project").where((F.col("total") < LEAST_CORPUS) | (F.col("df") / F.col("total") <= frequent))
    rated = rated.withColumn("idf", F.greatest(F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6)))
    wanted = commands_.select("project", "command", F.explode("_p").alias("p")).join(rated.select("project", "p", "df"), ["project", "p"]).groupBy("project", "command").agg(
        F.min(F.struct("df", "p"))["p"].alias("rarest"), F.collect_set("p").alias("all")
    )
    weight = F.col("t") * TITLE_WEIGHT + F.col("b")
    texts = told.select("node_id", "t_ms", "len")
    scored = met.join(rated, ["project", "p"]).join(texts, "node_id").select(
        "project", "p", "node_id", "t_ms", (F.col("idf") * weight * (K1 + 1) / (weight + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))).alias("s")
    )
    holds = scored.groupBy("project", "node_id", "t_ms").agg(F.collect_list(F.struct("p", "s")).alias("has"))
    stretch = lambda c: F.floor(c / window_ms)
    open_ = asked.join(wanted, ["project", "command"]).withColumn("_b", F.explode(F.array(stretch(F.col("f_ms")), stretch(F.col("f_ms")) + 1)))
    offered = holds.withColumn("rarest", F.explode(F.transform("has", lambda h: h["p"]))).withColumn("_b", stretch(F.col("t_ms")))
    pairs = open_.join(offered, ["project", "rarest", "_b"]).where((F.col("t_ms") > F.col("f_ms")) & (F.col("t_ms") <= F.col("f_ms") + window_ms))
    full = pairs.where(F.size(F.array_except("all", F.transform("has", lambda h: h["p"]))) == 0)
    score = F.round(F.aggregate(F.array_sort(F.filter("has", lambda h: F.array_contains("all", h["p"]))), F.lit(0.0), lambda x, h: x + h["s"]), 6)
    best = F.min_by("node_id", F.struct((-score).alias("s"), "t_ms", "node_id"))
    return full.groupBy("failure_id").agg(best.alias("node_id"))


def chain_stats(failures: DataFrame, retry: DataFrame, discussion: DataFrame) -> DataFrame:
    """One row: failures, resolved by retry, by discussion, by either; each failure counts once."""
    r = retry.select("failure_id").distinct().withColumn("r", F.lit(True))
    d = discussion.select("failure_id").distinct().withColumn("d", F.lit(True))
    both = failures.select("failure_id").distinct().join(r, "failure_id", "left").join(d, "failure_id", "left")
    count = lambda c: F.count(F.when(c, 1))
    return both.agg(F.count(F.lit(1)).alias("failures"), count(F.col("r")).alias("by_retry"), count(F.col("d")).alias("by_discussion"), count(F.col("r") | F.col("d")).alias("by_either"))


def file_words(path: Column) -> Column:
    """The words of a file's name without its extension."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)\z", 1), r"\.[a-zA-Z0-9]+\z", "")
    found = F.filter(F.split(F.lower(stem), r"[^a-z0-9]+"), lambda w: w != "")
    kept = F.filter(found, lambda w: w != "id")
    return F.when(F.size(kept) > 0, kept).otherwise(found)


def file_risk(paths: DataFrame, failures: DataFrame, links: DataFrame, touches: DataFrame, now_ms: int, days: int = RISK_DAYS) -> DataFrame:
    """(path, failures, commits, flagged): failures without link whose command holds all words of the file's name, each as a prefix, and commits touching it, in the last days.

    Words in more than a fifth of all commands don't count. The distinct words of commands meet those of
    names once, on equal prefixes; names with the same words are matched once. A failure is a candidate of
    a name by the name's rarest word only, its other words are then looked up in the failure's own.
    """
    since = now_ms - days * DAY_MS
    said = failures.select("failure_id", "at_ms", F.explode(F.array_distinct(words(F.col("command")))).alias("word"))
    total = failures.agg(F.count(F.lit(1)).alias("total"))
    named = paths.select("path").distinct().withColumn("_k", F.array_sort(F.array_distinct(file_words(F.col("path")))))
    names = named.select("_k").where("size(_k) > 0").distinct()
    listed = names.select(F.explode("_k").alias("_w")).distinct()
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.substring(F.col("word"), 1, n))).alias("_w")
    means = said.select("word").distinct().select("word", prefix).join(listed, "_w")
    hits = said.join(means, "word").select("failure_id", "at_ms", "_w").distinct()
    df = hits.groupBy("_w").agg(F.count(F.lit(1)).alias("df"))
    kept = listed.join(df, "_w", "left").fillna(0, ["df"]).join(F.broadcast(total)).where("total < 10 or df / total <= 0.2").select("_w", "df")
    wanted = names.withColumn("_w", F.explode("_k")).join(kept, "_w").groupBy("_k").agg(F.min(F.struct("df", "_w"))["_w"].alias("_w"), F.collect_set("_w").alias("_all"))
    recent = hits.where(F.col("at_ms") >= since).join(links.select("failure_id"), "failure_id", "left_anti")
    held = recent.groupBy("failure_id").agg(F.collect_set("_w").alias("_has")).withColumn("_w", F.explode("_has"))
    met = wanted.join(held, "_w").where(F.size(F.array_except("_all", "_has")) == 0)
    failed = named.join(met.groupBy("_k").agg(F.count(F.lit(1)).alias("failures")), "_k").select("path", "failures")
    commits = touches.where(F.col("at_ms") >= since).groupBy(F.col("file_path").alias("path")).agg(F.countDistinct("sha").alias("commits"))
    out = paths.select("path").distinct().join(failed, "path", "left").join(commits, "path", "left").fillna(0, ["failures", "commits"])
    return out.withColumn("flagged", (F.col("failures") > 0) | (F.col("commits") >= RISK_COMMITS))


def stale(nodes: DataFrame, now_ms: int, days: int = STALE_DAYS) -> DataFrame:
    """Rows not observed directly, older than ``days``, that nothing of their project supersedes, with their age; unknown provenance counts as not observed."""
    old = nodes.where((F.coalesce("provenance", F.lit("inferred")) != "observed") & (F.col("ts_epoch") < now_ms - days * DAY_MS))
    replaced = nodes.where("supersedes is not null").select("project_id", F.col("supersedes").alias("node_id"))
    left = old.join(replaced, ["project_id", "node_id"], "left_anti")
    return left.withColumn("age_days", F.round((now_ms - F.col("ts_epoch")) / DAY_MS).cast("bigint"))


def to_judge(candidates: DataFrame, verdicts: DataFrame, cap: int) -> DataFrame:
    """Pairs without a verdict yet, at most ``cap``, oldest candidate first: a judged pair costs nothing."""
    return candidates.join(verdicts.select("candidate_id", "against_id"), ["candidate_id", "against_id"], "left_anti").orderBy("candidate_id").limit(cap)


def open_verdicts(verdicts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Contradictions whose candidate still stands, with both titles."""
    n = nodes.select("node_id", "title")
    replaced = nodes.where("supersedes is not null").select(F.col("supersedes").alias("candidate_id"))
    return (
        verdicts.where("contradicts").join(replaced, "candidate_id", "left_anti")
        .join(n.withColumnsRenamed({"node_id": "candidate_id", "title": "candidate_title"}), "candidate_id")
        .join(n.withColumnsRenamed({"node_id": "against_id", "title": "against_title"}), "against_id")
    )


# --- queries ---------------------------------------------------------------------------------------

NOW_MS = 1_767_225_600_000
PATCH_NOW_MS = 1_522_540_800_000


def _runs(spark, folder):
    return commands(table(spark, folder, "hook_log"))


def _failures(spark, folder):
    return _runs(spark, folder).where("failed").select(F.col("entry_id").alias("failure_id"), "at_ms", F.col("command_key").alias("command"), F.col("dir_key").alias("project_id"))


def _talk(spark, folder):
    t = with_instant(table(spark, folder, "conversation_turns"), F.col("ts"), "at_ms").where("at_ms is not null")
    return t.select(F.col("turn_id").alias("node_id"), "at_ms", F.col("user_text").alias("title"), F.col("assistant_text").alias("body"), directory_key(F.col("cwd")).alias("project_id"))


def q21_retry_links(spark, folder):
    return retry_links(_runs(spark, folder))


def q22_null_cwd_links(spark, folder):
    """Links of all runs where long directories are taken for unknown: an unknown one equals an unknown one."""
    return retry_links(_runs(spark, folder).withColumn("dir_key", F.when(F.length("dir_key") > 30, None).otherwise(F.col("dir_key"))))


def q23_discussion_links(spark, folder):
    """Failures with talk of any directory, as of one project."""
    return discussion_links(*_one_project(spark, folder))


def q23_project_links(spark, folder):
    """Failures with talk of the same directory."""
    return discussion_links(_failures(spark, folder), _talk(spark, folder))


def _one_project(spark, folder):
    one = lambda df: df.withColumn("project_id", F.lit("p"))
    return one(_failures(spark, folder)), one(_talk(spark, folder))


def q24_chain_stats(spark, folder):
    f = _failures(spark, folder)
    return chain_stats(f, q21_retry_links(spark, folder), q23_discussion_links(spark, folder))


def q25_resolutions(spark, folder):
    """The thirty latest failures (a report's list), newest first, each followed by the success that resolved it; links are as old as the success."""
    from lodeline.operators.retrieval import with_resolutions

    runs, links = _runs(spark, folder), q21_retry_links(spark, folder)
    name = lambda c: F.col(c).cast("string")
    top = runs.where("failed").orderBy(F.desc("at_ms"), "entry_id").limit(30)
    hits = top.select(name("entry_id").alias("node_id"), F.row_number().over(Window.orderBy(F.desc("at_ms"), "entry_id")).alias("position"))
    linked = links.select(name("failure_id").alias("from_id"), name("success_id").alias("to_id"), F.lit("resolved_by_retry").alias("relation"), F.col("success_id").alias("created_ms"))
    return with_resolutions(hits, linked, runs.select(name("entry_id").alias("node_id")))


def q28_file_risk(spark, folder):
    d = with_instant(table(spark, folder, "file_diffs"), F.col("authored_at"), "at_ms")
    paths = d.select(F.col("file_path").alias("path"))
    return file_risk(paths, _failures(spark, folder), q21_retry_links(spark, folder), d, PATCH_NOW_MS)


def q29_stale(spark, folder):
    return stale(live_nodes(spark, folder), NOW_MS).orderBy("ts_epoch", "node_id").limit(50).select("node_id", "kind", "age_days")


def q30_open_verdicts(spark, folder):
    """Every superseding row judged against the one it replaces and against itself; what is still open."""
    n = live_nodes(spark, folder)
    v = n.where("kind = 'doc_section' and signal_score > 0.6").select(F.col("node_id").alias("candidate_id"), F.col("node_id").alias("against_id"), F.lit(True).alias("contradicts"))
    w = n.where("supersedes is not null").select(F.col("supersedes").alias("candidate_id"), F.col("node_id").alias("against_id"), F.lit(True).alias("contradicts"))
    return open_verdicts(v.unionByName(w), n).select("candidate_id", "against_id", "candidate_title", "against_title")


def q30_to_judge(spark, folder):
    v = table(spark, folder, "embeddings")
    pairs = nearest_of_queries(v, v.where("vec_id % 20 = 0"), 1).select(F.col("query_id").alias("candidate_id"), F.col("id").alias("against_id"))
    return to_judge(pairs, pairs.where("candidate_id % 40 = 0"), 10)


QUERIES = {k: f for k, f in list(globals().items()) if re.match(r"q\d+_", k)}

_INSTANT = r"""(epoch_ms(try_cast(regexp_extract(trim({c}), p, 1) || ' ' || regexp_extract(trim({c}), p, 2) as timestamp)) + cast(substr(rpad(regexp_extract(trim({c}), p, 3), 3, '0'), 1, 3) as bigint)
 - case when lower(regexp_extract(trim({c}), p, 4)) = 'z' then 0 else (case when regexp_extract(trim({c}), p, 4)[1] = '-' then -1 else 1 end) * (cast(substr(regexp_extract(trim({c}), p, 4), 2, 2) as bigint) * 60 + cast(right(regexp_extract(trim({c}), p, 4), 2) as bigint)) * 60000 end)"""
_P = r"(select '^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(?:[.,](\d+))? ?(Z|z|[+-]\d{2}:?\d{2})$' as p)"
_RUNS = rf"""runs as (select entry_id, {_INSTANT.format(c='ts')} as at_ms, lower(regexp_replace(replace(cwd, '\', '/'), '/+$', '')) as dir_key, lower(regexp_replace(trim(command), '\s+', ' ', 'g')) as command_key, exit_code <> 0 as failed
 from hook_log, {_P} where command is not null and exit_code is not null and regexp_matches(trim(ts), p))"""
_RETRY = """links as (select f.entry_id as failure_id, arg_min(s.entry_id, (s.at_ms, s.entry_id)) as success_id from runs f join runs s on f.command_key = s.command_key and f.dir_key is not distinct from s.dir_key
 and s.at_ms > f.at_ms and s.at_ms <= f.at_ms + 86400000 where f.failed and not s.failed group by f.entry_id)"""
_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(command_key, '[\"''()*:^{}\[\]-]', ' ', 'g'), '\s+'), lambda x: x <> '')"


def _disc_sql(project: str) -> str:
    """Discussion links by comparing every term with every text."""
    phrase = f"' ' || array_to_string({words_sql('x')}, ' ')"
    times = lambda c: f"cast((length({c}) - length(replace({c}, p, ''))) / length(p) as bigint)"
    return rf"""talk as (select turn_id as node_id, {project.format(c='cwd')} as project, {_INSTANT.format(c='ts')} as t_ms, {words_sql('user_text')} as wt, {words_sql('assistant_text')} as wb from conversation_turns, {_P} where regexp_matches(trim(ts), p)),
spaced as (select *, ' ' || array_to_string(wt, ' ') || ' ' as st, ' ' || array_to_string(wb, ' ') || ' ' as sb, cast(len(wt) + len(wb) as double) as len_ from talk),
tot as (select project, count(*) as total, avg(len_) as avg_len from spaced group by project),
asked as (select entry_id as failure_id, at_ms as f_ms, {project.format(c='dir_key')} as project, command_key, {_TOKENS} as toks from runs where failed),
terms as (select distinct failure_id, f_ms, project, p from (select *, unnest(list_transform(case when len(list_filter(toks, lambda x: lower(x) <> 'id')) > 0 then list_filter(toks, lambda x: lower(x) <> 'id') else toks end, lambda x: {phrase})) as p from asked) where p <> ' '),
met as (select * from (select d.p, s.project, node_id, t_ms, len_, {times('st')} as t, {times('sb')} as b from (select distinct project, p from terms) d join spaced s on d.project is not distinct from s.project) where t + b > 0),
df as (select project, p, count(*) as df from met group by all),
rated as (select d.project, d.p, coalesce(df, 0) as df, total, avg_len from (select distinct project, p from terms) d join tot on d.project is not distinct from tot.project left join df on d.project is not distinct from df.project and d.p = df.p
  where total < {LEAST_CORPUS} or coalesce(df, 0) / total <= {FREQUENT}),
useful as (select t.*, df, total, avg_len from terms t join rated r on t.project is not distinct from r.project and t.p = r.p), wanted as (select failure_id, count(*) as wanted from useful group by failure_id),
pairs as (select u.failure_id, m.node_id, m.t_ms, count(*) as met, round(sum(greatest(ln((total - df + 0.5) / (df + 0.5)), 1e-6) * (t * {TITLE_WEIGHT} + b) * {K1 + 1} / ((t * {TITLE_WEIGHT} + b) + {K1} * (1 - {B} + {B} * len_ / avg_len))), 6) as score
  from useful u join met m on u.p = m.p and u.project is not distinct from m.project and m.t_ms > f_ms and m.t_ms <= f_ms + 86400000 group by all),
disc as (select failure_id, arg_min(node_id, (-score, t_ms, node_id)) as node_id from pairs join wanted using (failure_id) where met = wanted group by failure_id)"""


_DIRECTORY = r"lower(regexp_replace(replace({c}, '\', '/'), '/+$', ''))"
_DISC = _disc_sql("'p'")
SQL = {
    "q21_retry_links": f"with {_RUNS}, {_RETRY} select * from links",
    "q22_null_cwd_links": f"with {_RUNS.replace('runs as', 'runs0 as')}, runs as (select * replace (case when length(dir_key) > 30 then null else dir_key end as dir_key) from runs0), {_RETRY} select * from links",
    "q23_discussion_links": f"with {_RUNS}, {_DISC} select * from disc",
    "q23_project_links": f"with {_RUNS}, {_disc_sql(_DIRECTORY)} select * from disc",
    "q24_chain_stats": f"""with {_RUNS}, {_RETRY}, {_DISC} select count(*) as failures, count(*) filter (entry_id in (select failure_id from links)) as by_retry, count(*) filter (entry_id in (select failure_id from disc)) as by_discussion,
 count(*) filter (entry_id in (select failure_id from links) or entry_id in (select failure_id from disc)) as by_either from runs where failed""",
    "q29_stale": f"""with n as ({LIVE_SQL}) select node_id, kind, cast(round(({NOW_MS} - ts_epoch) / 86400000.0) as bigint) as age_days from n where coalesce(provenance, 'inferred') <> 'observed' and ts_epoch < {NOW_MS} - 45 * 86400000::bigint
 and (project_id, node_id) not in (select (project_id, supersedes) from n where supersedes is not null) order by ts_epoch, node_id limit 50""",
    "q30_open_verdicts": f"""with n as ({LIVE_SQL}), v as (select node_id as c, node_id as a from n where kind = 'doc_section' and signal_score > 0.6 union all select supersedes, node_id from n where supersedes is not null)
select c as candidate_id, a as against_id, x.title as candidate_title, y.title as against_title from v join n x on c = x.node_id join n y on a = y.node_id where c not in (select supersedes from n where supersedes is not null)""",
}
_near = "round(list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])), 6)"
SQL["q30_to_judge"] = f"""with p as (select a.vec_id as candidate_id, arg_min(b.vec_id, ({_near}, b.vec_id)) as against_id from embeddings a, embeddings b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id group by a.vec_id)
select * from p where candidate_id % 40 <> 0 order by candidate_id limit 10"""
SQL["q25_resolutions"] = f"""with {_RUNS}, {_RETRY}, top as (select entry_id, row_number() over (order by at_ms desc, entry_id) as position from (select * from runs where failed order by at_ms desc, entry_id limit 30)),
far as (select success_id, min((position, failure_id)) as first from links join top on failure_id = entry_id where success_id not in (select entry_id from top) group by success_id),
al as (select cast(entry_id as varchar) as node_id, position, 0 as sub, null as pulled_by, null as other from top union all select cast(success_id as varchar), first[1], 1, cast(first[2] as varchar), cast(success_id as varchar) from far)
select node_id, cast(row_number() over (order by position, sub, other) as int) as position, pulled_by from al"""
_SINCE = PATCH_NOW_MS - RISK_DAYS * DAY_MS
SQL["q28_file_risk"] = rf"""with {_RUNS}, {_RETRY}, f as (select entry_id, at_ms, {words_sql('command_key')} as said from runs where failed), tot as (select count(*) as total from f),
nm as (select path, list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[a-zA-Z0-9]+$', '')), '[^a-z0-9]+'), lambda x: x <> '')) as ws from (select distinct file_path as path from file_diffs)),
nk as (select path, case when len(list_filter(ws, lambda x: x <> 'id')) > 0 then list_filter(ws, lambda x: x <> 'id') else ws end as ws from nm), dw as (select distinct unnest(ws) as w from nk),
hits as (select w, entry_id, at_ms from dw join f on len(list_filter(said, lambda x: starts_with(x, w))) > 0), df as (select w, count(*) as df from hits group by w),
kept as (select dw.w from dw left join df on dw.w = df.w, tot where total < 10 or coalesce(df, 0) / total <= 0.2), want as (select n.path, n.w from (select path, unnest(ws) as w from nk) n join kept on n.w = kept.w),
wc as (select path, count(*) as n from want group by path), met as (select path, entry_id, count(*) as m from want join hits on want.w = hits.w where at_ms >= {_SINCE} and entry_id not in (select failure_id from links) group by all),
fl as (select met.path, count(*) as failures from met join wc on met.path = wc.path where m = n group by met.path),
cm as (select path, count(distinct sha) as commits from (select file_path as path, sha, {_INSTANT.format(c='authored_at')} as at_ms from file_diffs, {_P} where regexp_matches(trim(authored_at), p)) where at_ms >= {_SINCE} group by path)
select nm.path, coalesce(failures, 0) as failures, coalesce(commits, 0) as commits, coalesce(failures, 0) > 0 or coalesce(commits, 0) >= {RISK_COMMITS} as flagged from nm left join fl on nm.path = fl.path left join cm on nm.path = cm.path"""
