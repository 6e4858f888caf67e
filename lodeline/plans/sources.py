"""Queries over the parsers of sources, with inline inputs and what they must give."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lodeline.sources import git, shell

_U = git.UNIT
_RECORDS = [
    _U.join(["a" * 40, "aaaaaaa", "", "Ann", "a@x.test", "2024-01-01T00:00:00Z", "2024-01-01T00:00:01Z", "fix: one", "fix: one\n\nwhy it was", "\n3\t1\tsrc/a.ts\n-\t-\timg.png\n2\t0\tsrc/{old => new}/b.ts\n"]),
    "\x1e" + _U.join(["b" * 40, "bbbbbbb", "p1 p2", "Bo", "b@x.test", "t", "t", "merge", "merge", "with a unit", "\n1\t1\t\"d\\303\\251.md\"\n"]),
    "torn", _U.join(["xyz"] * 10),
]
_BLOCK = (
    "diff --git a/src/a.ts b/src/a.ts\nindex 1..2 100644\n--- a/src/a.ts\n+++ b/src/a.ts\n@@ -1,2 +1,2 @@ f()\n-one\n+two\n three\n@@ -9 +9,2 @@\n+four\n"
    "diff --git a/old.md b/new.md\nsimilarity index 90%\nrename from old.md\nrename to new.md\n"
    "diff --git a/gone.py b/gone.py\ndeleted file mode 100644\n--- a/gone.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n"
    "diff --git a/i.png b/i.png\nnew file mode 100644\nBinary files /dev/null and b/i.png differ\n"
)
_BASH = "ls\n#1700000000\nnpm test\n\n#1700000005\n#1700000009\ngit push\nmake"
_ZSH = ": 1700000000:4;npm test\nplain\n: 1700000100:0;for x in a\\\n b\\\n c\n\n"


def _text(spark, content):
    return spark.createDataFrame([("h", 1_700_001_000_000, content)], "path string, mtime_ms bigint, content string")


def q53_bash_history(spark, folder):
    return shell.bash_history(_text(spark, _BASH)).select("command", "at_ms", "ts_approx")


def q53_pwsh_tail(spark, folder):
    return shell.pwsh_history(_text(spark, "a\r\n\r\nb\r\nc"), 2).select(F.split("natural_key", ":")[1].alias("place"), "command", "at_ms")


def q54_zsh_history(spark, folder):
    return shell.zsh_history(_text(spark, _ZSH)).select("command", "at_ms", "duration_ms")


def q51_hook_lines(spark, folder):
    lines = ['{"ts": "t1", "cwd": "/a", "exitCode": 1, "durationMs": 5, "command": "x"}', '{"ts": "t2", "cwd"', '{"ts": "t3", "cwd": "/a", "command": "y"}', '{"cwd": "/a", "command": "z"}', ""]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")
    return shell.hook_lines(df, 1).unionByName(shell.hook_lines(df, 99)).select("line_no", "ts", "exitCode", "command")


def q75_commits(spark, folder):
    c = git.commits(spark.createDataFrame([(r,) for r in _RECORDS], "record string"))
    return c.select("short_sha", "subject", "message_body", "is_merge", F.size("parents").alias("parents"))


def q75_touches(spark, folder):
    c = git.commits(spark.createDataFrame([(r,) for r in _RECORDS], "record string"))
    return git.touches(c).select(F.substring("sha", 1, 1).alias("sha"), "position", "path", "previous_path", "insertions", "is_binary")


def q76_patches(spark, folder):
    return git.file_diffs(spark.createDataFrame([("s", _BLOCK)], "sha string, block string")).select("position", "path", "previous_path", "status", "is_binary", "insertions", "deletions", "hunk_count")


QUERIES = {k: f for k, f in list(globals().items()) if re.match(r"q\d+_", k)}
_values = lambda rows, names: f"select * from (values {', '.join(rows)}) v({names})"
SQL = {
    "q53_bash_history": _values(["('ls', 1700000997000::bigint, true)", "('npm test', 1700000000000, false)", "('git push', 1700000009000, false)", "('make', 1700001000000, true)"], "command, at_ms, ts_approx"),
    "q53_pwsh_tail": _values(["('1', 'b', 1700000999000::bigint)", "('2', 'c', 1700001000000)"], "place, command, at_ms"),
    "q54_zsh_history": _values(["('npm test', 1700000000000::bigint, 4::bigint)", "('plain', 1700000999000, null)", "('for x in a' || chr(10) || ' b' || chr(10) || ' c', 1700000100000, 0)"], "command, at_ms, duration_ms"),
    "q51_hook_lines": _values(["(0, 't1', 1, 'x')", "(2, 't3', null, 'y')", "(2, 't3', null, 'y')"], 'line_no, ts, "exitCode", command'),
    "q75_commits": _values(["('aaaaaaa', 'fix: one', 'why it was', false, 0)", "('bbbbbbb', 'merge', chr(31) || 'with a unit', true, 2)"], "short_sha, subject, message_body, is_merge, parents"),
    "q75_touches": _values(["('a', 0, 'src/a.ts', null, 3, false)", "('a', 1, 'img.png', null, null, true)", "('a', 2, 'src/new/b.ts', 'src/old/b.ts', 2, false)", "('b', 0, 'dé.md', null, 1, false)"], "sha, position, path, previous_path, insertions, is_binary"),
    "q76_patches": _values(["(0, 'src/a.ts', null, 'modified', false, 2, 1, 2)", "(1, 'new.md', 'old.md', 'renamed', false, 0, 0, 0)", "(2, 'gone.py', null, 'deleted', false, 0, 1, 1)", "(3, 'i.png', null, 'added', true, 0, 0, 0)"], "position, path, previous_path, status, is_binary, insertions, deletions, hunk_count"),
}
