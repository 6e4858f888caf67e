from lodeline.operators.correlate import DAY_MS, discussion_links, stale, to_judge

FAILURE = "failure_id bigint, project_id string, at_ms bigint, command string"
TALK = "node_id bigint, project_id string, at_ms bigint, title string, body string"


def links(spark, failures, talk):
    return {tuple(r) for r in discussion_links(spark.createDataFrame(failures, FAILURE), spark.createDataFrame(talk, TALK)).collect()}


def filler(n, project="p"):
    return [(1000 + i, project, 5, "npm things", f"word{i} npm") for i in range(n)]


def test_all_terms_as_prefixes_side_by_side_within_the_window(spark):
    failures = [(1, "p", 10, "npm test src/pack.ts"), (2, "p", 10, "npm"), (3, None, 10, "lock"), (4, "p", 10, "id"), (5, "p", 10, None), (6, "p", 10, "zzz lock")]
    talk = [
        (1, "p", 20, "testing", "in src pack tsx"), (2, "p", 20, None, "test src x pack ts"), (3, "q", 20, "test", "src/pack.ts"), (4, "p", 10, "test src pack ts", None), (5, "p", 10 + DAY_MS + 1, "test src/pack.ts", ""),
        (6, None, 11, "", "locks"), (7, "p", 30, "", "ids"), *filler(20),
    ]
    assert links(spark, failures, talk) == {(1, 1), (3, 6), (4, 7)}


def test_title_first_then_earlier_then_smaller(spark):
    talk = [(1, "p", 30, "", "lock"), (2, "p", 20, "lock", ""), (3, "p", 15, "", "lock"), *filler(20)]
    assert links(spark, [(1, "p", 10, "lock")], talk) == {(1, 2)}
    same = [(4, "p", 20, "lock", ""), (2, "p", 20, "lock", ""), (3, "p", 30, "lock", ""), *filler(20)]
    assert links(spark, [(1, "p", 10, "lock")], same) == {(1, 2)}


def test_frequent_terms_only_in_corpora_of_ten(spark):
    talk = [(i, "p", 20, "", "lock") for i in range(5)]
    assert links(spark, [(1, "p", 10, "lock")], talk) == {(1, 0)}
    assert links(spark, [(1, "p", 10, "lock")], talk + filler(6)) == set()
    assert links(spark, [], talk) == set() and links(spark, [(1, "p", 10, "lock")], []) == set()


def test_stale_and_judged(spark):
    nodes = spark.createDataFrame([("a", "p", "authored", 0, None), ("b", "p", "observed", 0, None), ("c", "p", None, 0, None), ("d", "p", "authored", 99 * DAY_MS, "a"), ("e", "q", "authored", None, "c")], "node_id string, project_id string, provenance string, ts_epoch bigint, supersedes string")
    assert {(r.node_id, r.age_days) for r in stale(nodes, 100 * DAY_MS).collect()} == {("c", 100)}
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "candidate_id int, against_id int")
    assert [tuple(r) for r in to_judge(pairs, pairs.where("candidate_id = 2"), 1).collect()] == [(1, 2)]
