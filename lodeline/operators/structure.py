"""Import edges between source files: specifiers read from texts, resolved against the tracked paths."""

from __future__ import annotations

import re
import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How imports are written, and what a specifier may stand for, in order.
SCRIPT = (
    r"\b(?:import|export)\b[^'\"\n]*?\bfrom\s*['\"]([^'\"]+)['\"]",
    r"\bimport\s*['\"]([^'\"]+)['\"]",
    r"\brequire\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"\bimport\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
)
REWRITES = {".js": (".ts", ".tsx", ".js"), ".jsx": (".tsx", ".jsx"), ".mjs": (".mts", ".mjs"), ".cjs": (".cts", ".cjs")}
APPENDED = (".ts", ".tsx", ".js", ".jsx", ".d.ts", ".json", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
KINDS = {"script": r"\.[cm]?[jt]sx?\z", "python": r"\.py\z", "go": r"\.go\z", "rust": r"\.rs\z", "java": r"\.java\z", "php": r"\.php\z"}


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def specifiers(text: Column, language: str) -> Column:
    """Distinct import specifiers of a source text, in first-seen order of each pattern."""
    if language == "script":
        found = F.concat(*[_all(text, p) for p in SCRIPT])
        return F.array_distinct(F.filter(found, lambda s: s.startswith("./") | s.startswith("../")))
    if language == "python":
        names = lambda raw: F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace(raw, "#.*", ""), "[()]", ""), ","), lambda t: F.regexp_replace(F.trim(t), r"\s+as\s+.*", "")), lambda n: n.rlike(r"^[A-Za-z_]\w*\z"))
        relative = r"\bfrom\s+(\.+)([\w.]*)\s+import\s+([^\n]+)"
        lines = F.split(text, "\n")
        rel = F.flatten(F.transform(F.filter(lines, lambda x: x.rlike(relative)), lambda x: F.when(F.regexp_extract(x, relative, 2) != "", F.array(F.concat(F.regexp_extract(x, relative, 1), F.regexp_extract(x, relative, 2)))).otherwise(F.transform(names(F.regexp_extract(x, relative, 3)), lambda n: F.concat(F.regexp_extract(x, relative, 1), n)))))
        bare = _all(text, r"(?m)^[ \t]*from\s+([A-Za-z_]\w*)\s+import\b")
        plain = F.flatten(F.transform(_all(text, r"(?m)^[ \t]*import\s+([^\n]+)"), names))
        return F.array_distinct(F.concat(rel, bare, plain))
    if language == "go":
        blocks = F.flatten(F.transform(_all(text, r"\bimport\s*\(([\s\S]*?)\)"), lambda b: _all(b, r"(?:^|\n)\s*(?:[\w.]+\s+)?\"([^\"]+)\"")))
        return F.array_distinct(F.concat(blocks, _all(text, r"\bimport\s+(?:[\w.]+\s+)?\"([^\"]+)\"")))
    if language == "rust":
        return F.array_distinct(_all(text, r"\b(?:pub(?:\([^)]*\))?\s+)?mod\s+([A-Za-z_]\w*)\s*;"))
    if language == "java":
        return F.array_distinct(_all(text, r"\bimport\s+(?!static\b)([\w.]+(?:\.\*)?)\s*;"))
    if language == "php":
        return F.array_distinct(_all(text, r"\b(?:require|include)(?:_once)?\b\s*\(?\s*(?:__DIR__|dirname\s*\(\s*__FILE__\s*\))\s*\.\s*['\"]([^'\"]+)['\"]"))
    raise ValueError(language)


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(".")


def joined(folder: Column, rest: Column) -> Column:
    """A path put together and tidied of ``.`` and ``..``; one that leaves the root keeps its dots and matches nothing."""
    parts = F.filter(F.split(F.concat_ws("/", folder, rest), "/"), lambda p: (p != "") & (p != "."))
    up = lambda s, p: F.when((p == "..") & (F.size(s) > 0) & (F.element_at(F.concat(F.array(F.lit("")), s), -1) != ".."), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")


def _candidates(path: Column, spec: Column, language: str) -> Column:
    """What a specifier may stand for, best first."""
    if language == "script":
        full = joined(directory(path), spec)
        options = F.concat(F.array(full), F.transform(F.array(*map(F.lit, APPENDED)), lambda s: F.concat(full, s)))
        ext = F.regexp_extract(full, r"(\.[^./]+)\z", 1)
        out = F.when(ext == "", options).otherwise(F.array(full))
        for old, new in REWRITES.items():
            base = F.regexp_replace(full, rf"\{old}\z", "")
            out = F.when(ext == old, F.array(full, *[F.concat(base, F.lit(s)) for s in new])).otherwise(out)
        return F.array_distinct(out)
    if language == "python":
        level = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
        rest = F.regexp_replace(F.regexp_replace(spec, r"^\.+", ""), r"\.", "/")
        ups = F.concat_ws("/", F.array_repeat(F.lit(".."), F.greatest(level - 1, F.lit(0))))
        base = joined(directory(path), F.concat_ws("/", ups, rest))
        std = spec.isin(*sorted(sys.stdlib_module_names))
        return F.when(std | (rest == ""), F.array().cast("array<string>")).otherwise(F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py"))))
    if language == "rust":
        own = F.regexp_extract(path, r"([^/]*)\.rs\z", 1)
        folder = F.when(own.isin("mod", "lib", "main"), directory(path)).otherwise(F.concat_ws("/", directory(path), own))
        return F.array(joined(folder, F.concat(spec, F.lit(".rs"))), joined(folder, F.concat(spec, F.lit("/mod.rs"))))
    if language == "php":
        return F.array(joined(directory(path), spec))
    raise ValueError(language)


def import_edges(files: DataFrame, go_module: str | None = None) -> DataFrame:
    """(project_id, from_path, to_path, kind): edges between tracked files (project_id, path, text).

    A specifier becomes an edge to the best candidate that is tracked; Go packages to every file of their
    directory but tests; a Java name only if exactly one path ends in it. Self edges are left out,
    every edge stands once. Candidates are joined by path, never compared with all paths.
    """
    tracked = files.select("project_id", F.col("path").alias("to_path"))
    parts = []
    for language, pattern in KINDS.items():
        found = files.where(F.col("path").rlike(pattern)).select("project_id", F.col("path").alias("from_path"), F.explode(specifiers(F.col("text"), language)).alias("spec"))
        if language == "go":
            rel = F.when(F.col("spec") == go_module, ".").when(F.col("spec").startswith(f"{go_module}/"), F.substring("spec", F.lit(len(go_module or "") + 2), F.length("spec")))
            homes = tracked.where(F.col("to_path").endswith(".go") & ~F.col("to_path").endswith("_test.go")).withColumn("_d", directory(F.col("to_path")))
            edges = found.withColumn("_d", rel).join(homes, ["project_id", "_d"])
        elif language == "java":
            tail = F.regexp_replace(F.regexp_replace("spec", r"\.\*\z", ""), r"\.", "/")
            wild = F.col("spec").endswith(".*")
            suffixes = lambda p: F.transform(F.sequence(F.lit(0), F.size(F.split(p, "/")) - 1), lambda i: F.array_join(F.slice(F.split(p, "/"), i + 1, F.size(F.split(p, "/"))), "/"))
            homes = tracked.where(F.col("to_path").endswith(".java"))
            by_file = homes.select("project_id", "to_path", F.explode(suffixes(F.col("to_path"))).alias("_k"))
            by_dir = homes.select("project_id", "to_path", directory(F.col("to_path")).alias("_home"), F.explode(suffixes(directory(F.col("to_path")))).alias("_k"))
            named = found.where(~wild).withColumn("_k", F.concat(tail, F.lit(".java"))).join(by_file, ["project_id", "_k"])
            one = F.count(F.lit(1)).over(Window.partitionBy("project_id", "from_path", "spec")) == 1
            wide = found.where(wild).withColumn("_k", tail).join(by_dir, ["project_id", "_k"])
            homes_met = F.size(F.collect_set("_home").over(Window.partitionBy("project_id", "from_path", "spec"))) == 1
            edges = named.withColumn("_1", one).where("_1").select("project_id", "from_path", "to_path").unionByName(wide.withColumn("_1", homes_met).where("_1").select("project_id", "from_path", "to_path"))
        else:
            options = found.select("project_id", "from_path", "spec", F.posexplode(_candidates(F.col("from_path"), F.col("spec"), language)).alias("_rank", "to_path"))
            met = options.join(tracked, ["project_id", "to_path"])
            edges = met.groupBy("project_id", "from_path", "spec").agg(F.min_by("to_path", "_rank").alias("to_path"))
        parts.append(edges.select("project_id", "from_path", "to_path").withColumn("kind", F.lit("import")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("from_path <> to_path").distinct()


# --- queries ---------------------------------------------------------------------------------------

_FILES = [
    ("p", "src/a.ts", "import { b } from './b.js';\nimport './lib';\nconst c = require('../tools/c');\nexport * from './gone';\nimport('./a');"),
    ("p", "src/b.ts", "export const b = 1;"), ("p", "src/lib/index.ts", ""), ("p", "tools/c.js", "require('fs')"),
    ("p", "py/m.py", "import os, helper as h\nfrom . import sub\nfrom .pkg import x\nfrom ..top import y\n"), ("p", "py/helper.py", ""), ("p", "py/sub.py", ""), ("p", "py/pkg/__init__.py", ""), ("p", "top.py", ""),
    ("p", "cmd/main.go", 'import (\n\t"fmt"\n\tw "example.test/app/walk"\n)\n'), ("p", "walk/w.go", ""), ("p", "walk/w_test.go", ""),
    ("p", "rs/lib.rs", "pub mod store;\nmod inline { }\nmod deep;"), ("p", "rs/store.rs", ""), ("p", "rs/deep/mod.rs", ""),
    ("p", "j/src/org/x/A.java", "import org.x.B;\nimport static org.x.C.d;\nimport org.y.*;\nimport org.x.Dup;"), ("p", "j/src/org/x/B.java", ""), ("p", "j/src/org/y/E.java", ""), ("p", "j/src/org/x/Dup.java", ""), ("p", "k/org/x/Dup.java", ""),
    ("p", "web/i.php", "<?php require_once __DIR__ . '/inc/f.php';"), ("p", "web/inc/f.php", ""),
]


def q59_import_edges(spark, folder):
    return import_edges(spark.createDataFrame(_FILES, "project_id string, path string, text string"), "example.test/app")


def q61_edge_counts(spark, folder):
    return q59_import_edges(spark, folder).groupBy("project_id").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("from_path").alias("files"))


QUERIES = {k: f for k, f in list(globals().items()) if re.match(r"q\d+_", k)}
_edges = [
    ("src/a.ts", "src/b.ts"), ("src/a.ts", "src/lib/index.ts"), ("src/a.ts", "tools/c.js"), ("py/m.py", "py/helper.py"), ("py/m.py", "py/sub.py"), ("py/m.py", "py/pkg/__init__.py"), ("py/m.py", "top.py"),
    ("cmd/main.go", "walk/w.go"), ("rs/lib.rs", "rs/store.rs"), ("rs/lib.rs", "rs/deep/mod.rs"), ("j/src/org/x/A.java", "j/src/org/x/B.java"), ("j/src/org/x/A.java", "j/src/org/y/E.java"), ("web/i.php", "web/inc/f.php"),
]
_values = "(values " + ", ".join(f"('p', '{a}', '{b}', 'import')" for a, b in _edges) + ") v(project_id, from_path, to_path, kind)"
SQL = {
    "q59_import_edges": f"select * from {_values}",
    "q61_edge_counts": f"select project_id, count(*) as edges, count(distinct from_path) as files from {_values} group by project_id",
}
