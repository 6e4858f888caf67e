from lodeline.operators.collect import chunks, sections, turns_of, within_budget
from lodeline.operators.correlate import file_risk, q28_file_risk
from lodeline.operators.retrieval import best_hunk, packed, summary
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_chunks(spark):
    text = "intro\r\n\r\n# Head\nbody\n\nmore\n\n**Bold:** x\n\n" + "y" * 30
    assert [(c.heading, c.text) for c in one(spark, chunks(F.lit(text), 30))] == [(None, "intro"), ("Head", "# Head\nbody\n\nmore"), ("Bold:", "**Bold:** x"), (None, "y" * 30)]
    assert one(spark, chunks(F.lit("z" * 50), 10))[0].text == "z" * 9 + "…"
    assert one(spark, chunks(F.lit(" \n\n "), 10)) == []


def test_sections(spark):
    files = spark.createDataFrame([("a.md", "# Why\nx\n\n# Why\ny\n\n# 何\nz"), ("b.md", "")], "path string, content string")
    assert [r.natural_key for r in sections(files).orderBy("index").collect()] == ["a.md#why", "a.md#why:1", "a.md#_section-2"]


def test_turns(spark):
    block = lambda *t: "[" + ", ".join(f'{{"type": "text", "text": "{x}"}}' for x in t) + "]"
    rows = [
        ("s", 0, "assistant", False, block("early")), ("s", 1, "user", None, " q1 "), ("s", 2, "assistant", False, block("a", "b")), ("s", 3, "user", False, '[{"type": "tool_result"}]'),
        ("s", 4, "assistant", False, block("c")), ("s", 5, "user", True, "side"), ("s", 6, "user", False, block("q2")), ("s", 7, "assistant", False, "plain"), (None, 8, "user", False, "x"),
    ]
    df = spark.createDataFrame(rows, "session_id string, line_no bigint, line_type string, is_sidechain boolean, msg_content string")
    assert [(r.user_text, r.assistant_text) for r in turns_of(df).orderBy("turn_no").collect()] == [("q1", "a\nb\n\nc"), ("q2", "")]


def test_budget(spark):
    df = spark.createDataFrame([("k", "1", 1, "x" * 6, 0.5), ("k", "2", 2, "x" * 5, 0.9), ("k", "3", 3, "x" * 4, 0.4), ("e", "1", 4, "", 0.1)], "key string, ts string, id bigint, text string, signal double")
    assert sorted((r.key, r.id) for r in within_budget(df, "key", 10).collect()) == [("e", 4), ("k", 2), ("k", 3)]


def test_summary_and_hunks(spark):
    patch = "@@ -1 +1 @@\n a\n-b\n+openStore\n@@ -9,4 +9,4 @@\n c\n d\n e\n+rankDecay(x)\n f"
    assert one(spark, best_hunk(F.lit(patch), "why does the rank decay")) == "@@ -9,4 +9,4 @@\n e\n+rankDecay(x)\n f"
    assert one(spark, best_hunk(F.lit(patch), "the")).startswith("@@ -1 +1 @@")
    told = lambda kind, title, body: one(spark, summary(F.lit(kind), F.lit(title), F.lit(body), "store", 40))
    assert told("conversation_turn", "t", "Q: x\n\nA:  the answer ") == "the answer"
    assert told("note", "t", "t\n\nrest") == "rest" and told("note", "t", "t") == "t"
    assert told("code_diff", "t", "head\nfile\n\n" + patch).startswith("head\nfile\n@@ -1 +1 @@")


def test_packing_skips_and_goes_on(spark):
    rows = [(1, "a", "doc_section", "x", "tttt", "ssss"), (2, "b", "doc_section", "x", "tttt", "s" * 400), (3, "c", "doc_section", "x", "tttt", "ssss"), (4, "d", "doc_section", "x", "tttt", "ssss"), (5, "e", "note", "x", "tttt", "ssss")]
    df = spark.createDataFrame(rows, "position int, node_id string, kind string, ts string, title string, summary string")
    assert [(r.node_id, r.tokens) for r in packed(df, 40).orderBy("position").collect()] == [("a", 10), ("c", 10), ("e", 10)]
    assert packed(df.limit(0), 40).count() == 0


def test_file_risk(spark):
    failures = spark.createDataFrame([(i, 1000, "npm test queue batch" if i < 2 else f"run {i}") for i in range(20)], "failure_id bigint, at_ms bigint, command string")
    paths = spark.createDataFrame([("src/queue.batch.ts",), ("src/other.ts",), ("src/run.ts",)], "path string")
    links = spark.createDataFrame([(0, 5)], "failure_id bigint, success_id bigint")
    touches = spark.createDataFrame([("src/other.ts", f"c{i}", 900) for i in range(4)], "file_path string, sha string, at_ms bigint")
    out = {r.path: (r.failures, r.commits, r.flagged) for r in file_risk(paths, failures, links, touches, 2000).collect()}
    assert out == {"src/queue.batch.ts": (1, 0, True), "src/other.ts": (0, 4, True), "src/run.ts": (0, 0, False)}


def test_file_risk_examines_every_file(spark, tmp_path):
    """A file of one commit among a hundred busier ones is flagged by its unresolved failure; repeated words of a name count once."""
    diffs = [(f"src/busy{i}.ts", f"c{i}{j}", "2018-03-20T10:00:00Z") for i in range(100) for j in range(2)] + [("src/quiet-quiet.ts", "q", "2018-03-20T10:00:00Z")]
    spark.createDataFrame(diffs, "file_path string, sha string, authored_at string").write.parquet(str(tmp_path / "file_diffs.parquet"))
    log = [(i, "2018-03-21T10:00:00Z", "/a", "npm test quietly" if i == 0 else f"run {i}", 1) for i in range(20)]
    spark.createDataFrame(log, "entry_id bigint, ts string, cwd string, command string, exit_code int").write.parquet(str(tmp_path / "hook_log.parquet"))
    out = {r.path: (r.failures, r.commits, r.flagged) for r in q28_file_risk(spark, str(tmp_path)).collect()}
    assert len(out) == 101 and out["src/quiet-quiet.ts"] == (1, 1, True) and out["src/busy7.ts"] == (0, 2, False)
