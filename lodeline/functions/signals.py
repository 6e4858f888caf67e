"""Prior importance of rows, 0.05 to 1, by the shape of what they record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights by type of commit, patterns by kind of command and text, bands by source.
TYPE_WEIGHTS = {
    "fix": 0.8,
    "feat": 0.8,
    "revert": 0.78,
    "perf": 0.7,
    "refactor": 0.68,
    "security": 0.85,
    "test": 0.45,
    "docs": 0.35,
    "build": 0.32,
    "ci": 0.28,
    "chore": 0.25,
    "style": 0.2,
}
AUTOMATED = r"(?i)^(merge (branch|pull request|remote)|bump |update dependenc|\[bot\]|revert \"merge)"
HEADER = r"^([A-Za-z]+)(?:\(([^)]*)\))?(!)?:\s*(.+)$"
NOISE = r"(?i)^(cd|ls|dir|pwd|clear|cls|exit|history|whoami|date|type|cat|more|less|ll|la)\b"
BUILD_TEST = r"(?i)^(npm|pnpm|yarn)\s+(run\s+)?(test|build|lint|typecheck|tsc)\b|(?i)^(pytest|go\s+test|cargo\s+(test|build)|mvn\s+test|gradle\s+test|dotnet\s+(test|build))\b"
INSTALL = r"(?i)^(npm|pnpm|yarn)\s+(install|add|remove|uninstall|ci)\b|^pip\s+install\b|^(cargo\s+add|go\s+get|composer\s+require)\b"
GIT = r"(?i)^git\s+"
DESTRUCTIVE = r"(?i)^git\s+(push\s+.*--force|reset\s+--hard|clean\s+-[a-z]*f|branch\s+-d)\b"
RISKY = r"(?i)(rm\s+-rf|remove-item\s+.*-recurse|del\s+\/s|drop\s+(table|database)|--force\b|truncate\s+table)"
EXPLANATION = r"(?i)\b(because|why|reason|root cause|instead of|trade-?off|decided|so that)\b"
ACKNOWLEDGEMENT = r"(?i)^(ok|okay|thanks|thank you|yes|no|sure|go ahead|continue|done)[.!]?$"
GENERATED = (
    r"(^|/)(node_modules|dist|build|out|coverage|vendor|third_party)/"
    r"|(^|/)(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|composer\.lock|Cargo\.lock|poetry\.lock|Gemfile\.lock|go\.sum)$"
    r"|\.(min\.js|min\.css|map|snap)$"
)
TEST_PATH = r"(^|/)(tests?|__tests__|spec|e2e)/|\.(test|spec)\.[cm]?[jt]sx?$"
BANDS = {"git": (0.7, 0.45), "shell": (0.6, 0.4), "conversation": (0.55, 0.35), "docs": (0.55, 0.35), "diff": (0.7, 0.45)}


def clamped(score: Column) -> Column:
    """Between 0.05 and 1, to three places; a hair is added so that both engines round halves alike."""
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.05), score)) + 1e-9, 3)


def header(subject: Column) -> Column:
    """type, scope, breaking and description of a conventional subject; the subject alone if it is none."""
    s = F.trim(subject)
    part = lambda i: F.when(s.rlike(HEADER) & (F.regexp_extract(s, HEADER, i) != ""), F.regexp_extract(s, HEADER, i))
    return F.struct(F.lower(part(1)).alias("type"), part(2).alias("scope"), part(3).isNotNull().alias("breaking"), F.trim(F.coalesce(part(4), s)).alias("description"))


def type_weight(kind: Column) -> Column:
    out = F.lit(0.5)
    for name, weight in TYPE_WEIGHTS.items():
        out = F.when(kind == name, weight).otherwise(out)
    return out


def commit_signal(subject: Column, body_length: Column, is_merge: Column, files: Column, churn: Column) -> Column:
    h = header(subject)
    score = type_weight(h["type"]) + F.when(h["breaking"], 0.12).otherwise(0.0) + F.when(body_length > 120, 0.1).otherwise(0.0)
    score = F.when(is_merge, F.least(score, F.lit(0.3))).otherwise(score) - F.when(subject.rlike(AUTOMATED), 0.15).otherwise(0.0)
    score = score * F.when((files > 100) | (churn > 5000), 0.75).otherwise(1.0)
    return clamped(score - F.when((files <= 1) & (churn <= 3), 0.05).otherwise(0.0))


def patch_signal(subject: Column, path: Column, status: Column, churn: Column) -> Column:
    h = header(subject)
    score = type_weight(h["type"]) + F.when(h["breaking"], 0.1).otherwise(0.0) - F.when(path.rlike(TEST_PATH), 0.1).otherwise(0.0)
    score = score + F.when(status == "added", 0.05).when(status == "deleted", -0.1).otherwise(0.0) - F.when(churn <= 2, 0.05).otherwise(0.0)
    return clamped(score * F.when(churn > 400, 0.75).otherwise(1.0))


def command_signal(command: Column, exit_code: Column) -> Column:
    c = F.trim(command)
    base = F.when(c.rlike(NOISE), 0.1).when(c.rlike(RISKY) | c.rlike(DESTRUCTIVE), 0.75).when(c.rlike(INSTALL), 0.6).when(c.rlike(BUILD_TEST), 0.55).when(c.rlike(GIT), 0.2).otherwise(0.35)
    score = base + F.when(exit_code.isNull(), 0.0).when(exit_code != 0, 0.25).otherwise(0.05)
    return clamped(score + F.when(F.length(c) > 60, 0.05).when(F.length(c) <= 3, -0.05).otherwise(0.0))


def section_signal(path: Column, heading: Column, text: Column) -> Column:
    score = 0.45 + F.when(text.rlike(EXPLANATION), 0.25).otherwise(0.0) + F.when(path.rlike(r"(?i)(^|/)readme\.md$"), 0.1).otherwise(0.0)
    return clamped(score - F.when(heading.isNull(), 0.1).otherwise(0.0) - F.when(F.length(text) < 80, 0.15).otherwise(0.0))


def turn_signal(user: Column, reply: Column) -> Column:
    u = F.trim(user)
    score = 0.3 + F.when(F.concat_ws("\n", user, reply).rlike(EXPLANATION), 0.25).otherwise(0.0)
    score = score + F.when(F.length(reply) > 400, 0.15).when(F.length(reply) < 80, -0.1).otherwise(0.0)
    return clamped(score - F.when(u.rlike(ACKNOWLEDGEMENT), 0.2).otherwise(0.0) + F.when(u.endswith("?"), 0.05).otherwise(0.0))


def session_signal(turns: Column) -> Column:
    return clamped(0.6 + F.least(F.lit(0.25), turns / 100))


def source_band(signal: Column, source: Column) -> Column:
    """The band of a signal by the bounds of its row's source; sources without bounds of their own have those of documents."""
    of = (
        F.when(source.startswith("git-diff"), "diff").when(source.startswith("git"), "git").when(source.startswith("shell"), "shell")
        .when(source.startswith("conversation") | source.startswith("session"), "conversation").otherwise("docs")
    )
    out = band(signal, "docs")
    for name in BANDS:
        out = F.when(of == name, band(signal, name)).otherwise(out)
    return out


def band(signal: Column, source: str) -> Column:
    high, medium = BANDS[source]
    return F.when(signal >= high, "high").when(signal >= medium, "medium").otherwise("low")
