import json

from lodeline.operators.nodes import commit_nodes, completed, contradiction_prompt, patch_nodes, refreshed, session_nodes, session_prompts, shell_nodes, turn_nodes
from pyspark.sql import functions as F

FILE = "struct<path:string,previous_path:string,insertions:int,deletions:int,is_binary:boolean>"
COMMIT = f"project_id string, sha string, short_sha string, authored_at string, subject string, message_body string, is_merge boolean, files array<{FILE}>"


def test_commit(spark):
    files = [("a.ts", None, 1, 1, False), ("img.png", None, None, None, True), ("new.md", "old.md", 9, 0, False)]
    rows = [("p", "f" * 40, "fffffff", "2020", "fix(core)!: keep it", "why " * 40, False, files), ("p", "e" * 40, "eeeeeee", "2020", "", None, None, None)]
    out = {r.node_id: r for r in commit_nodes(spark.createDataFrame(rows, COMMIT), most=2).collect()}
    full, bare = sorted(out.values(), key=lambda r: -len(r.body))
    assert full.body.endswith("Files changed:\n  new.md (+9/-0, renamed from old.md)\n  a.ts (+1/-1)\n  ...and 1 more file(s)") and full.files == ["new.md", "a.ts"]
    assert full.signal_score == 1.0 and json.loads(full.meta)["conventionalScope"] == "core"
    assert bare.title == "(no subject) eeeeeee" and bare.body == "" and bare.files == []


def test_patch_keeps_what_people_wrote(spark):
    kinds = "project_id string, sha string, short_sha string, subject string, authored_at string, path string, previous_path string, status string, insertions int, deletions int, hunk_count int, is_binary boolean, patch string"
    row = lambda path, ins, hunks=1, binary=False: ("p", "s", "s", "feat: x", "2020", path, None, "modified", ins, 0, hunks, binary, "@@ -1 +1 @@\n+k = ghp_" + "a" * 30)
    rows = [row("a.ts", 5), row("dist/b.js", 50), row("yarn.lock", 9), row("c.png", 7, binary=True), row("d.ts", 1, 0), row("e.ts", 9, None), row("f.min.js", 1), row("g.ts", 3)]
    out = patch_nodes(spark.createDataFrame(rows, kinds), most=1).collect()
    assert [r.title for r in out] == ["a.ts @ s — feat: x"] and "[redacted]" in out[0].body and out[0].body.startswith("feat: x (s)\nmodified a.ts (+5/-0, 1 hunk)\n")


def test_shell(spark):
    kinds = "project_id string, natural_key string, command string, ts string, ts_approx boolean, exit_code int, duration_ms bigint, cwd string, shell string"
    rows = [("p", "k1", "ls\nx", "t", True, None, None, None, "zsh"), ("p", "k2", "make", "t", False, 2, 5, "/a", "bash"), ("p", "k3", None, "t", None, None, None, None, "bash")]
    out = {r.title: r.body for r in shell_nodes(spark.createDataFrame(rows, kinds)).collect()}
    assert out == {"ls": "$ ls\nx", "make": "$ make\n\ncwd: /a  exit: 2  duration: 5ms"}


def test_turn(spark):
    kinds = "project_id string, natural_key string, user_text string, assistant_text string, ts string, cwd string, source string"
    rows = [("p", "k", "why " * 80, "# Head\nbody\n\n# Tail\nmore", "t", None, "s"), ("p", "e", "q", "", "t", None, "s"), ("p", "n", "q", None, "t", None, "s"), ("p", "b", None, "y " * 900, "t", None, "s")]
    out = sorted(turn_nodes(spark.createDataFrame(rows, kinds)).collect(), key=lambda r: (r.source, r.title))
    assert [r.title[-7:] for r in out] == ["", " — Head", " — Tail"] and all(len(r.title) <= 200 for r in out)


def test_sessions(spark):
    turns = spark.createDataFrame([("s", 1, "2020-01-02", "b", "x" * 90), ("s", 2, "2020-01-01", "why a", "because " + "y" * 500), ("s", 3, None, None, None), (None, 4, "t", "u", "v")], "session_key string, turn_id bigint, ts string, user_text string, assistant_text string")
    r = session_prompts(turns, "I", 700).first()
    assert (r.included, r.turns) == (2, 3) and "developer: why a" in r.prompt and len(r.hash) == 64
    told = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "session_key string, prompt string").coalesce(1)
    assert {x.session_key for x in completed(told, lambda p: None if p in "23" else "TITLE: x\ny").collect()} == {"a"}
    s = spark.createDataFrame([("p", "s", 2, "2020-01-01T1", "2020-01-02T1", None, "cli", "h", 2, "opening")], "project_id string, session_key string, turns int, started_at string, ended_at string, cwd string, source string, hash string, included int, fallback string")
    n = session_nodes(s, spark.createDataFrame([("s", "TITLE: Raised it\n- why")], "session_key string, raw string")).first()
    assert (n.title, n.body, n.ts) == ("Raised it", "Session of 2020-01-01 — 2 exchange(s)\n\n- why", "2020-01-02T1")
    assert spark.range(1).select(contradiction_prompt(F.lit("o"), F.lit("x" * 2000), F.lit(None), F.lit("n"), "?")).first()[0].count("x") == 1499


def test_refreshed_keeps_unreadable(spark):
    stored = spark.createDataFrame([("a", "docs"), ("b", "docs"), ("c", "docs"), ("d", "git")], "node_id string, source string")
    files = spark.createDataFrame([("b", "b.md"), ("c", "c.md")], "node_id string, path string")
    gone = refreshed(stored, stored.where("node_id = 'a'"), "docs", spark.createDataFrame([("b.md",)], "path string"), files)
    assert [r.node_id for r in gone.collect()] == ["c"]
