import json

import pytest
from lodeline import schema
from lodeline.config import Settings, read_settings
from lodeline.operators.store import DenyRule
from lodeline.operators.upkeep import (
    cleared, exported_rules, forget, import_preview, import_rules, initialised, judged_pairs, live_projects, mark_stale, read_registry, read_rules, recorded, unregistered, vectors_kept,
    with_supersedes, without_sources, without_vectors, write_registry,
)

NODE = schema.TABLES["nodes"]


def node(i, project="p", body="b", source="s", supersedes=None):
    return (i, "note", project, "2020-01-01T00:00:00Z", 1, source, "t", body, 0.5, "{}", 1, "authored", supersedes)


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([node("a", body="secret one"), node("b"), node("c", "old", "secret two"), node("d", "other", "secret three"), node("e", None)], NODE)


def ids(df):
    return sorted(r.node_id for r in df.collect())


def test_clear(spark, nodes):
    vectors = spark.createDataFrame([("a",), ("d",)], "node_id string")
    cursors = spark.createDataFrame([("p", "git"), ("old", "git")], "project_id string, source string")
    c = cleared(nodes, vectors, cursors, "p")
    assert ids(c.nodes) == ["c", "d", "e"] and ids(c.vectors) == ["d"] and c.cursors.count() == 1 and c.count.first().removed == 2
    assert without_vectors(vectors)[1].first().removed == 2 and without_vectors(vectors)[0].count() == 0
    assert ids(vectors_kept(vectors, spark.createDataFrame([("a", "updated"), ("d", "unchanged")], "node_id string, state string"))) == ["d"]


def test_supersede(spark, nodes):
    pairs = spark.createDataFrame([("a", "b"), ("a", "a"), ("a", "d"), ("a", "x"), ("x", "a")], "node_id string, supersedes string")
    told = {(r.node_id, r.supersedes): r.refused for r in judged_pairs(nodes, pairs).collect()}
    assert told == {("a", "b"): None, ("a", "a"): "itself", ("a", "d"): "other project", ("a", "x"): "no old row", ("x", "a"): "no new row"}
    assert {r.node_id: r.supersedes for r in with_supersedes(nodes, pairs).collect()}["a"] == "b"
    assert {r.node_id: r.supersedes for r in mark_stale(nodes, "b", "a", "p").collect()}["a"] == "b"
    for old, new, project in (("a", "a", "p"), ("d", "a", "p"), ("x", "a", "p"), ("b", "a", "old")):
        with pytest.raises(ValueError):
            mark_stale(nodes, old, new, project)


def test_forget_over_all_ids_of_a_project(nodes):
    done = forget(nodes, [DenyRule(1, "one"), DenyRule(2, "secret"), DenyRule(3, "absent")], ["p", "old"], 9)
    assert ids(done.nodes) == ["b", "d", "e"]
    assert {(r.node_id, r.rule_id, r.body_length) for r in done.tombstones.collect()} == {("a", 1, 10), ("c", 2, 10)}
    audit = {r.audit_id: r for r in done.audit.collect()}
    assert {k: r.affected_count for k, r in audit.items()} == {1: 1, 2: 1, 3: 0}
    assert json.loads(audit[3].detail) == {"pattern": "absent", "matchType": "literal", "ignoreCase": True, "scopeProjectIds": ["p", "old"]}
    assert forget(nodes.limit(0), [DenyRule(1, "x")], ["p"], 0).audit.first().affected_count == 0


def test_rules_out_and_in(nodes):
    stored = forget(nodes, [DenyRule(1, "one")], ["p"], 0).rules
    lines = [r.json for r in exported_rules(stored).collect()]
    assert [(r.pattern, r.regex, r.ignore_case) for r in read_rules([*lines, " "])] == [("one", False, True)]
    with pytest.raises(ValueError):
        read_rules(['{"pattern": "", "matchType": "literal"}'])
    rules = [DenyRule(5, "one"), DenyRule(6, "secret"), DenyRule(7, "secret")]
    done, counts = import_rules(nodes, stored, rules, ["p", "old"], 0)
    assert tuple(counts.first()) == (1, 2, 2) and ids(done.nodes) == ["b", "d", "e"]
    assert {r.rule_id: (r.already_present, r.would_remove) for r in import_preview(nodes, stored, rules, ["p", "old"]).collect()} == {5: (True, 0), 6: (False, 2), 7: (True, 0)}
    assert import_preview(nodes, stored, [], ["p"]).count() == 0


def test_sources(nodes):
    assert without_sources(nodes, ["s"], ["p"]).count() == 5
    assert ids(without_sources(nodes, ["s"], ["p", "old"], yes=True)) == ["d", "e"]


def test_registry(spark, tmp_path):
    path = str(tmp_path / "registry.json")
    assert read_registry(spark, path).count() == 0
    (tmp_path / "broken.json").write_text("{nope")
    assert read_registry(spark, str(tmp_path / "broken.json")).count() == 0
    kind = "project_id string, root string, db_path string, last_seen_at bigint"
    r = recorded(read_registry(spark, path), spark.createDataFrame([("p", "/p", "/p/db", 1), ("q", "/q", "/q/db", 5)], kind))
    write_registry(r, path)
    write_registry(recorded(read_registry(spark, path), spark.createDataFrame([("p", "/p2", "/p/db", 9)], kind)), path)
    back = read_registry(spark, path)
    assert [(x.project_id, x.root, x.last_seen_at) for x in back.collect()] == [("p", "/p2", 9), ("q", "/q", 5)]
    assert [f.name for f in tmp_path.iterdir() if f.name.endswith(".tmp")] == []
    assert {x.project_id: x.live for x in live_projects(back, spark.createDataFrame([("/q/db",)], "db_path string")).collect()} == {"p": False, "q": True}
    assert [x.project_id for x in unregistered(back, back.where("project_id = 'p'")).collect()] == ["q"]


def test_init(spark, tmp_path):
    assert initialised(spark, str(tmp_path / "store")) and not initialised(spark, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store" / "nodes")).columns == spark.createDataFrame([], NODE).columns


def test_settings():
    assert read_settings(None) == read_settings(" ") == Settings()
    assert read_settings('{"limits": {"budget": 50}, "shell": {"enabled": false}}').limits.budget == 50
    for bad in ("[", "[]", '{"x": 1}', '{"limits": {"budget": 0}}', '{"limits": {"budget": true}}', '{"shell": {"enabled": 1}}', '{"limits": 3}'):
        with pytest.raises(ValueError):
            read_settings(bad)


def test_rule_of_one_project(spark, nodes):
    from lodeline.operators.store import denied_by

    hit = nodes.where(denied_by([DenyRule(1, "secret", project="old")]).isNotNull())
    assert ids(hit) == ["c"]


def test_sources_chosen():
    from lodeline.sources.shell import chosen_sources

    assert chosen_sources({"pwsh", "pwsh-hook", "zsh"}) == ["pwsh-hook", "zsh"] and chosen_sources({"pwsh"}) == ["pwsh"] and chosen_sources(set()) == []


def test_json_keeps_nulls(spark):
    from lodeline.operators.upkeep import as_json

    assert as_json(spark.createDataFrame([(1, None)], "a int, b string")).first().json == '{"a":1,"b":null}'
