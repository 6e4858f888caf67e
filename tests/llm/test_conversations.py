import random

from lodeline.llm.components import components
from lodeline.llm.conversations import conversations, main_path

LINE = "session_id string, line_no bigint, line_type string, uuid string, parent_uuid string, is_sidechain boolean, line_ts string, msg_content string, role string, text int"


def line(session, no, kind, uuid, parent, at=None, content="hi", side=False):
    if kind == "assistant" and content is not None:
        content = f'[{{"type": "text", "text": "{content}"}}]'
    return (session, no, kind, uuid, parent, side, None if at is None else f"2020-01-01T00:00:{at:02d}Z", content, "clash", 0)


def run(spark, rows, max_lines=1000):
    out = conversations(spark.createDataFrame(rows, LINE), max_lines).collect()
    return sorted((r.session_id, r.msg_no, r.uuid, r.role) for r in out)


def test_components_against_union_find(spark):
    rng = random.Random(1)
    nodes = [f"n{i:03d}" for i in range(120)]
    links = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(70)] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(80, 118)]
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    df = spark.createDataFrame([(n,) for n in [*nodes, nodes[0], None]], "node string")
    got = {r.node: r.component for r in components(df, spark.createDataFrame([*links, (None, "n001"), ("n002", "n002")], "a string, b string")).collect()}
    assert got == {n: root(n) for n in nodes}
    assert components(df.limit(0), spark.createDataFrame([], "a string, b string")).count() == 0


def test_sessions(spark):
    rows = [
        line("ok", 1, "user", "a", None, 1), line("ok", 2, "system", "b", "a", 2, None), line("ok", 3, "assistant", "c", "b", 3), line("ok", 3, "assistant", "c", "b", 3),
        line("ok", 4, "user", "r", "c", 4, '[{"type": "tool_result", "text": "x"}]'), line("ok", 5, "assistant", "d", "r", 5), line("ok", 6, "user", "side", "zzz", 6, side=True), line("ok", 7, "summary", None, None),
        line("lost", 1, "user", "a", "gone", 1), line("lost", 2, "assistant", "b", "a", 2),
        line("ring", 1, "user", "a", "b", 1), line("ring", 2, "assistant", "b", "a", 2), line("ring", 3, "user", "x", None, 3), line("ring", 4, "assistant", "y", "x", 4),
        line("self", 1, "user", "a", "a", 1), line("self", 2, "assistant", "b", "a", 1),
        line("open", 1, "user", "a", None, 1), line("open", 2, "assistant", "b", "a", 2), line("open", 3, "user", "c", "b", 3),
        line("mute", 1, "assistant", "a", None, 1), line("blank", 1, "user", "a", None, 1, " \n"), line("blank", 2, "assistant", "b", "a", 2),
        line("edit", 1, "user", "a", None, 1), line("edit", 2, "assistant", "b", "a", 2), line("edit", 3, "assistant", "b2", "a", 9), line("edit", 4, "user", "old", "b", 3), line("edit", 5, "assistant", "o2", "old", 4),
        line("roots", 1, "user", "a", None, 5), line("roots", 2, "assistant", "b", "a", 5), line("roots", 3, "user", "c", None, 5), line("roots", 4, "assistant", "d", "c", 5),
        line(None, 1, "user", "a", None, 1),
    ]
    want = [
        ("edit", 1, "a", "user"), ("edit", 2, "b2", "assistant"),
        ("ok", 1, "a", "user"), ("ok", 2, "c", "assistant"), ("ok", 3, "d", "assistant"), ("roots", 1, "c", "user"), ("roots", 2, "d", "assistant"),
    ]
    assert run(spark, rows) == want
    assert run(spark, rows, max_lines=0) == want
    assert run(spark, []) == []


def test_large_route_equals_small(spark):
    rng = random.Random(4)
    rows = []
    for s in range(6):
        for i in range(25):
            parent = None if i == 0 else f"u{rng.randrange(max(0, i - 3), i):02d}"
            rows.append(line(f"s{s}", i, "user" if i % 2 == 0 else "assistant", f"u{i:02d}", parent, rng.choice([None, rng.randrange(60)])))
    assert run(spark, rows) == run(spark, rows, max_lines=0)


def test_long_chain():
    rows = [(str(i), None if i == 0 else str(i - 1), i, i) for i in range(50_000)]
    assert main_path(rows) == list(range(50_000))
