import subprocess

import pytest
from lodeline.sources import git
from lodeline.sources.files import read_files, read_imports, read_transcripts, transcript_folder
from lodeline.sources.shell import under_root
from lodeline.streaming.ingest import live_failures, worth_telling
from pyspark.sql import functions as F


def run(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=Ann", "-c", "user.email=a@x.test", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repository")
    run(root, "init", "-q", "-b", "main")
    (root / "a.md").write_text("# One\n")
    (root / "mod.py").write_text("import other\n")
    (root / "other.py").write_text("x = 1\n")
    run(root, "add", ".")
    run(root, "commit", "-qm", "feat: first\n\nwhy it was")
    run(root, "mv", "a.md", "b.md")
    (root / "other.py").write_text("x = 2\n")
    run(root, "add", ".")
    run(root, "commit", "-qm", "fix: second")
    return str(root)


def test_log_and_patches(spark, repository):
    c = git.commits(git.read_log(spark, repository)).orderBy("subject").collect()
    assert [(r.subject, r.message_body) for r in c] == [("feat: first", "why it was"), ("fix: second", "")]
    assert git.commits(git.read_log(spark, repository, most=1)).count() == 1
    blocks = git.patches(git.read_patches(spark, repository))
    assert {r.subject for r in blocks.collect()} == {"feat: first", "fix: second"}
    files = {(r.path, r.previous_path, r.status, r.insertions) for r in git.file_diffs(blocks.where("subject = 'fix: second'").select("sha", "block")).collect()}
    assert files == {("b.md", "a.md", "renamed", 0), ("other.py", None, "modified", 1)}


def test_cursor(spark, repository):
    first, head = (git.git(repository, "rev-parse", r).strip() for r in ("HEAD~1", "HEAD"))
    assert git.walk_from(repository, first) == first and git.walk_from(repository, "0" * 40) is None and git.walk_from(repository, None) is None
    assert git.commits(git.read_log(spark, repository, after=first)).count() == 1
    cursors = spark.createDataFrame([("p", "git", first, 1), ("p", "diff", first, 1)], "project_id string, source string, cursor string, last_run_at bigint")
    assert {(r.source, r.cursor) for r in git.moved(cursors, "p", "git", head, 2).collect()} == {("git", head), ("diff", first)}


def test_failing_and_empty_histories(spark, tmp_path):
    run(tmp_path, "init", "-q")
    assert git.read_log(spark, str(tmp_path)).count() == 0
    assert git.facts(str(tmp_path))["head"] is None
    with pytest.raises(Exception, match="not a git repository|cannot change"):
        git.read_log(spark, str(tmp_path / "none")).count()
    with pytest.raises(RuntimeError):
        git.facts(str(tmp_path / "none"))


def test_records_across_chunks():
    assert list(git.record_batches(["\x1ea", "b\x1ec", "\x1e", "d"])) == ["ab", "c", "d"]
    assert list(git.record_batches([])) == []


def test_tracked_and_changed(spark, repository):
    assert {r.path for r in git.tracked(spark, repository, "*.py").collect()} == {"mod.py", "other.py"}
    assert git.changed(spark, repository).count() == 0


def test_files_and_imports(spark, repository, tmp_path):
    listed = git.tracked(spark, repository, "*.md").unionByName(spark.createDataFrame([("gone.md",)], "path string"))
    files, missing = read_files(spark, repository, "*.md", listed)
    assert [(r.path, r.content) for r in files.collect()] == [("b.md", "# One\n")] and [r.path for r in missing.collect()] == ["gone.md"]
    edges, missing = read_imports(spark, repository, "p", git.tracked(spark, repository))
    assert [(r.from_path, r.to_path) for r in edges.collect()] == [("mod.py", "other.py")] and [r.path for r in missing.collect()] == ["b.md"]


def test_transcripts(spark, tmp_path):
    (tmp_path / "s1.jsonl").write_text('{"type": "user", "uuid": "u", "timestamp": "t", "isSidechain": false, "message": {"role": "user", "content": [{"type": "text", "text": "hi"}]}}\n{"type": "us\n{"sessionId": "other", "type": "x"}\n')
    rows = read_transcripts(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.session_id, r.line_no, r.line_type, r.uuid) for r in rows] == [("s1", 0, "user", "u"), ("s1", 1, None, None), ("other", 2, "x", None)]
    assert rows[0].msg_role == "user" and rows[0].msg_content == '[{"type":"text","text":"hi"}]'
    assert transcript_folder("C:\\work\\app_1") == "C--work-app-1"


def test_predicates(spark):
    df = spark.createDataFrame([(1, "x", 0.9), (0, "x", 0.9), (None, "x", 0.9), (2, " ", 0.9), (2, "y", 0.0)], "exitCode int, command string, confidence double")
    assert [r.command for r in live_failures(df).collect()] == ["x"] and live_failures(df.drop("confidence")).count() == 2
    told = spark.createDataFrame([(1, "x"), (1, " "), (0, "x"), (1, None)], "n int, t string")
    assert told.where(worth_telling(F.col("n"), F.col("t"))).count() == 1
    roots = spark.createDataFrame([("C:\\Work\\App\\x", "c:/work/app/"), ("/a/bc", "/a/b"), ("/a/b", "/A/B/"), (None, "/a")], "cwd string, root string")
    assert [r[0] for r in roots.select(under_root(F.col("cwd"), F.col("root"))).collect()] == [True, False, True, None]
