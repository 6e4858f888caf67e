"""Ordered conversations rebuilt from message rows by their reply links."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.times import with_instant
from lodeline.llm.components import components
from lodeline.tables import cut, discard, table

#: Sessions of more lines are ordered by pointer doubling instead of within one task.
MAX_LINES = 100_000
_BLOCKS = "array<struct<type:string,text:string>>"
_BLANK = r"^[\s  ᠎ -   　﻿]*\z"


def _text(content: Column, plain: bool) -> Column:
    """The text of a message: its text blocks, or, if ``plain``, content that isn't a list of blocks."""
    blocks = F.from_json(content, _BLOCKS)
    listed = F.exists(blocks, lambda b: b["type"].isNotNull()) | (F.size(blocks) == 0)
    texts = F.array_join(F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), lambda t: t.isNotNull()), "\n")
    return F.when(F.coalesce(listed, F.lit(False)), texts).otherwise(content if plain else F.lit(None))


def message_lines(lines: DataFrame) -> DataFrame:
    """(session_id, uuid, parent_uuid, line_no, at_ms, role, text): one row per line of a session that counts.

    Side work and lines without uuid are ignored, a null flag counts as false, lines of one uuid are
    one line (its first ``line_no``, latest time, a parent if any copy has one). ``role`` is 'user' or
    'assistant' for messages, null for all other lines, which still link messages.
    """
    used = lines.where("session_id is not null and uuid is not null and not coalesce(is_sidechain, false)")
    has_result = F.coalesce(F.exists(F.from_json("msg_content", _BLOCKS), lambda b: F.coalesce(b["type"] == "tool_result", F.lit(False))), F.lit(False))
    used = with_instant(used, F.col("line_ts"), "at_ms").select(
        "session_id", "uuid", "parent_uuid", "line_no", "at_ms", "line_type",
        F.when((F.col("line_type") == "user") & ~has_result, _text(F.col("msg_content"), True))
        .when(F.col("line_type") == "assistant", _text(F.col("msg_content"), False)).alias("text"),
    )
    one = used.groupBy("session_id", "uuid").agg(
        F.max("parent_uuid").alias("parent_uuid"), F.min("line_no").alias("line_no"), F.max("at_ms").alias("at_ms"),
        F.min_by(F.struct("line_type", "text"), F.struct(F.col("text").isNull(), F.coalesce("line_no", F.lit(2**62)), "text")).alias("_line"),
    )
    told = F.col("_line.text").isNotNull() & ~F.col("_line.text").rlike(_BLANK)
    return one.select(
        "session_id", "uuid", "parent_uuid", "line_no", "at_ms",
        F.when(told, F.col("_line.line_type")).alias("role"), F.when(told, F.col("_line.text")).alias("text"),
    )


def _node(session: str, uuid: str) -> Column:
    return F.unhex(F.md5(F.concat_ws("\0", F.col(session), F.col(uuid))))


def sound_sessions(lines: DataFrame) -> DataFrame:
    """``lines`` of the sessions in which every named parent exists and no parents run in a circle; adds ``component``.

    Conversations are the connected components of the reply links. A component of a forest has one
    link less than it has lines; one with as many links as lines holds a circle. Links are put next to
    each other by session and line before they are linked, a session of many lines over many tasks.
    """
    columns = [c for c in lines.columns if c not in ("_node", "_parent")]
    node = lines.select(*columns, _node("session_id", "uuid").alias("_node"), F.when(F.col("parent_uuid").isNotNull(), _node("session_id", "parent_uuid")).alias("_parent"))
    links = node.where("_parent is not null").repartitionByRange("session_id", "line_no").select(F.col("_node").alias("a"), F.col("_parent").alias("b"))
    lost = (
        node.where("_parent is not null").select("session_id", "_parent")
        .join(node.select(F.col("_node").alias("_parent")), "_parent", "left_anti").select("session_id")
    )
    found = components(node, links, "_node")
    with_component = cut(node.join(found, "_node").drop("_node", "_parent"), found)
    circles = with_component.groupBy("session_id", "component").agg(F.count(F.lit(1)).alias("n"), F.count("parent_uuid").alias("links")).where("links >= n").select("session_id")
    return with_component.join(lost.unionByName(circles).distinct(), "session_id", "left_anti")


def main_path(rows: list[tuple]) -> list[int]:
    """Indices of the rows (uuid, parent, at_ms, line_no) on the path kept of one session's forest, from its first line on."""
    children: dict[str | None, list[int]] = {}
    for i, r in enumerate(rows):
        children.setdefault(r[1], []).append(i)
    order, stack = [], list(children.get(None, []))
    while stack:
        i = stack.pop()
        order.append(i)
        stack += children.get(rows[i][0], [])
    rank = lambda r: (r[2] is not None, r[2] or 0, r[3] or 0, r[0])
    latest: dict[int, tuple] = {}
    for i in reversed(order):
        latest[i] = max([rank(rows[i]), *(latest[c] for c in children.get(rows[i][0], []))])
    path, at = [], None
    while options := children.get(at, []):
        i = max(options, key=lambda c: latest[c])
        path.append(i)
        at = rows[i][0]
    return path


def _ordered_small(lines: DataFrame) -> DataFrame:
    """Sessions one after the other within each task; none is larger than the caller's limit."""
    columns = ["session_id", "uuid", "parent_uuid", "at_ms", "line_no", "role"]
    sorted_lines = lines.select(*columns).repartition("session_id").sortWithinPartitions("session_id", "line_no", "uuid")
    clean = lambda v: None if v is None or v != v else int(v)

    def paths(session, rows):
        kept = [(r[1], r[2], clean(r[3]), clean(r[4])) for r in rows]
        return [(session, rows[i][1], no, rows[i][5]) for no, i in enumerate(main_path(kept))]

    def order(frames):
        session, rows, out = None, [], []
        for frame in frames:
            for row in zip(*(frame[c] for c in columns), strict=True):
                if row[0] != session:
                    out += paths(session, rows) if rows else []
                    session, rows = row[0], []
                rows.append(row)
            yield pd.DataFrame(out, columns=["session_id", "uuid", "step", "role"])
            out = []
        yield pd.DataFrame(paths(session, rows) if rows else [], columns=["session_id", "uuid", "step", "role"])

    return sorted_lines.mapInPandas(order, "session_id string, uuid string, step bigint, role string")


def _ordered_large(lines: DataFrame) -> DataFrame:
    """The same for sessions of any size, by pointer doubling: no session is ever gathered.

    The line with the latest time of a session lies on the kept path, and so do its ancestors; what
    follows it is found in the same way among its descendants, until there are none.
    """
    key = ["session_id", "uuid"]
    rank = F.struct(F.col("at_ms").isNotNull(), F.coalesce("at_ms", F.lit(0)), F.coalesce("line_no", F.lit(0)), "uuid")
    nodes = cut(lines.select(*key, "parent_uuid", "role", rank.alias("rank")))
    jumps = [cut(nodes.select(*key, F.col("parent_uuid").alias("up"), F.when(F.col("parent_uuid").isNull(), 0).otherwise(1).cast("bigint").alias("depth")))]
    while not jumps[-1].where("up is not null").isEmpty():
        above = jumps[-1].select("session_id", F.col("uuid").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        jumps.append(cut(jumps[-1].join(above, ["session_id", "up"], "left").select(*key, F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"))))
    on_path, scope = None, nodes
    while True:
        tops = cut(scope.groupBy("session_id").agg(F.max("rank").alias("rank")).select("session_id", F.col("rank.uuid").alias("uuid")))
        if tops.isEmpty():
            break
        marks = tops
        for jump in jumps:
            up = jump.join(marks, key).where("up is not null").select("session_id", F.col("up").alias("uuid"))
            marks = cut(marks.unionByName(up).distinct(), *([marks] if marks is not tops else []))
        on_path = marks if on_path is None else cut(on_path.unionByName(marks).distinct(), on_path, marks)
        below = cut(nodes.select(*key, "parent_uuid").join(tops.select("session_id", F.col("uuid").alias("parent_uuid"), F.lit(True).alias("under")), ["session_id", "parent_uuid"], "left").select(*key, F.coalesce("under", F.lit(False)).alias("under")))
        for jump in jumps[:-1]:
            higher = below.select("session_id", F.col("uuid").alias("up"), F.col("under").alias("_under"))
            below = cut(below.join(jump.select(*key, "up"), key).join(higher, ["session_id", "up"], "left").select(*key, (F.col("under") | F.coalesce("_under", F.lit(False))).alias("under")), below)
        scope = cut(nodes.join(below.where("under").select(*key), key), below, tops, *([scope] if scope is not nodes else []))
    if on_path is None:
        return nodes.select(*key, F.lit(0).cast("bigint").alias("step"), "role").limit(0)
    return on_path.join(jumps[-1].select(*key, F.col("depth").alias("step")), key).join(nodes.select(*key, "role"), key).select(*key, "step", "role")


def conversations(lines: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """(session_id, msg_no, uuid, role, text): the messages of each usable session, numbered from 1.

    Sessions that name a missing parent, hold a circle, have no user message, or one that isn't
    answered before the next or the end, give no rows. Where a line has several continuations, or a
    session several first lines, the one that leads to the latest time holds; of equal times, the one
    that leads to the later line. Lines without time lead nowhere later than any. Repeated rows count
    once, empty tables give no rows, other columns aren't read.
    """
    kept = cut(message_lines(lines))
    checked = sound_sessions(kept.drop("text"))
    sound = cut(checked.drop("component"))
    large = cut(sound.groupBy("session_id").count().where(F.col("count") > max_lines).select("session_id"))
    if large.isEmpty():
        ordered = _ordered_small(sound)
    else:
        ordered = _ordered_small(sound.join(large, "session_id", "left_anti")).unionByName(_ordered_large(sound.join(large, "session_id", "left_semi")))
    said = cut(ordered.where("role is not null"))
    # Counted per session without ordering it in one task: a user step is answered if the next message step after it is an assistant's.
    numbered = _numbered(said)
    asked = cut(said.where("role = 'user'").select("session_id").distinct(), sound, large)
    following = numbered.select("session_id", (F.col("msg_no") - 1).alias("msg_no"), F.col("role").alias("next_role"))
    judged = numbered.join(following, ["session_id", "msg_no"], "left")
    bad = judged.where("role = 'user' and coalesce(next_role, 'user') = 'user'").select("session_id").distinct()
    good = numbered.join(asked, "session_id", "left_semi").join(bad, "session_id", "left_anti")
    discard(said)
    return good.join(kept.select("session_id", "uuid", "text"), ["session_id", "uuid"]).select("session_id", "msg_no", "uuid", "role", "text")


def _numbered(said: DataFrame, width: int = 10_000) -> DataFrame:
    """Adds msg_no by ``step`` within a session: counts before each stretch of ``width`` steps, and ranks within it."""
    from pyspark.sql import Window

    at = said.withColumn("_stretch", F.floor(F.col("step") / width))
    counts = at.groupBy("session_id", "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("session_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("session_id", "_stretch").orderBy("step"))
    ranked = at.withColumn("_rank", within).join(counts.select("session_id", "_stretch", "_before"), ["session_id", "_stretch"])
    return cut(ranked.select("session_id", (F.col("_before") + F.col("_rank")).cast("bigint").alias("msg_no"), "uuid", "role"))


def p6_messages(spark, folder: str) -> DataFrame:
    return conversations(table(spark, folder, "transcript_lines"))


def p6_found(spark, folder: str) -> DataFrame:
    return p6_messages(spark, folder).select("session_id", "msg_no", "uuid")


QUERIES = {"p6_found": p6_found, "p6_messages": p6_messages}
SQL: dict[str, str] = {}
