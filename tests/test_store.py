import pytest
from lodeline import schema
from lodeline.functions.text import approx_tokens, default_provenance, node_id, normalised_command, normalised_url, truncated
from lodeline.operators.correlate import retry_links
from lodeline.operators.store import DenyRule, denied_by, edge_snapshot, forgotten, inserted_or_ignored, labels, pruned, put, replaced_files, states, upsert
from pyspark.sql import functions as F

NODE = schema.TABLES["nodes"]


def node(i, body="b", title="t", signal=0.5, created=1, kind="note", source="s", project="p"):
    return (i, kind, project, "2020-01-01T00:00:00Z", 1, source, title, body, signal, "{}", created, "authored", None)


def test_upsert_states_and_columns(spark):
    stored = spark.createDataFrame([node("a"), node("b"), node("c")], NODE)
    incoming = spark.createDataFrame([node("a", created=9), node("b", body="new", created=9), node("d", created=5), node("d", body="later", created=6), node("e", body="secret words"), node(None)], NODE)
    out = upsert(stored, incoming, [DenyRule(1, "SECRET")])
    assert {(r.node_id, r.state) for r in out.collect()} == {("a", "unchanged"), ("b", "updated"), ("c", "kept"), ("d", "inserted"), ("e", "denied"), (None, "denied")}
    rows = {r.node_id: r for r in out.collect()}
    assert (rows["b"].body, rows["b"].created_at, rows["d"].body) == ("new", 1, "later")
    again = upsert(out.where("state <> 'denied'").drop("state"), incoming.where("node_id is not null"), [DenyRule(1, "SECRET")])
    assert {r.state: r.rows for r in states(again).collect()} == {"unchanged": 3, "kept": 1, "denied": 1}
    empty = schema.empty(spark, "nodes")
    assert upsert(empty, empty).count() == 0


def test_deny_rules(spark):
    df = spark.createDataFrame([("x", "Lock LOST", "{}"), (None, None, None), ("a.b", "axb", "{}")], "title string, body string, meta string")
    rules = [DenyRule(1, "a.b", ignore_case=False), DenyRule(2, r"lock\s+lost", regex=True)]
    assert [r[0] for r in df.select(denied_by(rules)).collect()] == [2, None, 1]
    for pattern in ("", "a*"):
        with pytest.raises(ValueError):
            DenyRule(1, pattern, regex=True)


def test_forget_and_prune(spark):
    nodes = spark.createDataFrame([node("a", body="bad"), node("b"), node("c", source="x")], NODE)
    stays, stones = forgotten(nodes, DenyRule(4, "bad"), 77)
    assert [r.node_id for r in stays.orderBy("node_id").collect()] == ["b", "c"]
    assert [(r.node_id, r.body_length, r.rule_id, r.removed_at) for r in stones.collect()] == [("a", 3, 4, 77)]
    files = spark.createDataFrame([("a", "kept.md")], "node_id string, path string")
    gone = pruned(nodes, "s", nodes.where("false"), files.select("path"), files)
    assert [r.node_id for r in gone.collect()] == ["b"]


def test_small_mutations(spark):
    links = spark.createDataFrame([("a", "b", "r", 1)], schema.TABLES["node_links"])
    more = spark.createDataFrame([("a", "b", "r", 9), ("a", "c", "r", 2), ("a", "c", "r", 2)], schema.TABLES["node_links"])
    assert sorted(tuple(r) for r in inserted_or_ignored(links, more, "from_id", "to_id", "relation").collect()) == [("a", "b", "r", 1), ("a", "c", "r", 2)]
    meta = spark.createDataFrame([("k", "1"), ("l", "2")], "key string, value string")
    assert sorted(tuple(r) for r in put(meta, spark.createDataFrame([("k", "3")], "key string, value string"), "key").collect()) == [("k", "3"), ("l", "2")]
    edges = spark.createDataFrame([("p", "a", "b", "i"), ("q", "a", "b", "i")], schema.TABLES["file_edges"])
    fresh = spark.createDataFrame([("p", "x", "y", "i"), ("p", "x", "y", "i")], schema.TABLES["file_edges"])
    assert sorted(tuple(r) for r in edge_snapshot(edges, fresh).collect()) == [("p", "x", "y", "i"), ("q", "a", "b", "i")]
    files = spark.createDataFrame([("a", "old"), ("b", "same")], "node_id string, path string")
    incoming = spark.createDataFrame([("a", "new", 0), ("a", "new", 1), ("b", "other", 0)], "node_id string, path string, position int")
    assert sorted(tuple(r) for r in replaced_files(files, incoming, spark.createDataFrame([("a",)], "node_id string")).collect()) == [("a", "new"), ("b", "same")]
    projects = spark.createDataFrame([("abcdef99", "C:\\W\\x"), ("123456aa", "/y/x/"), ("7", "/z")], "project_id string, root string")
    assert {r.project_id: r.label for r in labels(projects).collect()} == {"abcdef99": "x#abcdef", "123456aa": "x#123456", "7": "z"}


def test_migration_and_kinds(spark):
    old = spark.createDataFrame([("a", "git_commit"), ("b", "odd")], "node_id string, kind string")
    new = schema.migrated(old, 1)
    assert [(r.provenance, r.supersedes) for r in new.orderBy("node_id").collect()] == [("observed", None), (None, None)]
    assert [r.node_id for r in schema.checked_kinds(old).collect()] == ["b"]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(truncated(F.lit("abc d efg"), 5)) == "abc…" and one(truncated(F.lit("abc"), 3)) == "abc"
    assert one(approx_tokens(F.lit("12345"))) == 2
    assert one(normalised_command(F.lit("  Npm\t run  X "))) == "npm run x"
    for url in ("git@Host.test:Team/App.git", "https://host.test/team/app/", "ssh://git@host.test//team/app.git/"):
        assert one(normalised_url(F.lit(url))) == "host.test/team/app"
    assert one(default_provenance(F.lit("session_summary"))) == "derived"
    assert len(one(node_id(F.lit("p"), F.lit("k"), F.lit("n")))) == 24


def test_retry_links_window_ties_and_nulls(spark):
    day = 86_400_000
    runs = [
        (1, 0, "d", "c", True), (2, 0, "d", "c", False), (3, day, "d", "c", False), (4, day, "d", "c", False), (5, 10, None, "c", True), (6, 20, None, "c", False),
        (7, 5, "e", "c", True), (8, 5 + day + 1, "e", "c", False), (9, day - 1, "f", "x", True), (10, day + 1, "f", "x", False),
    ]
    df = spark.createDataFrame(runs, "entry_id bigint, at_ms bigint, dir_key string, command_key string, failed boolean")
    assert {tuple(r) for r in retry_links(df).collect()} == {(1, 3), (5, 6), (9, 10)}
    assert retry_links(df.limit(0)).count() == 0
