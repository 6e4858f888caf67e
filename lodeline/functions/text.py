"""Column expressions on text, ids and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and the letters they count as in lexical search.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
WORD_BREAK = r"[^\p{L}\p{N}]+"
#: Provenance by kind of node.
PROVENANCE = {
    "git_commit": "observed",
    "code_diff": "observed",
    "shell_command": "observed",
    "doc_section": "authored",
    "note": "authored",
    "conversation_turn": "recorded",
    "session_summary": "derived",
}


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def truncated(text: Column, n: int) -> Column:
    """At most ``n`` characters; what is longer ends in an ellipsis, without blanks before it."""
    cut = F.regexp_replace(F.substring(text, 1, n - 1), r"(?U)\s+\z", "")
    return F.when(F.length(text) > n, F.concat(cut, F.lit("…"))).otherwise(text)


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4)


def words(text: Column) -> Column:
    """Lower-case words of letters and digits, Latin marks taken off; none for null."""
    spaced = F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN)
    return F.filter(F.split(spaced, WORD_BREAK), lambda w: w != "")


def node_id(project: Column, kind: Column, natural_key: Column) -> Column:
    """First 24 hex digits of the digest of project, kind and key, joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", project, kind, natural_key), 256), 1, 24)


def normalised_url(url: Column) -> Column:
    """Host and path of a repository address, lower case, whatever its scheme, user, form or ending."""
    s = trimmed(url)
    scp = r"^(?:[^@/]+@)?([^/:]+):(.+)$"
    plain = F.regexp_replace(F.regexp_replace(s, r"(?i)^[a-z+]+://", ""), r"^[^@/]+@", "")
    s = F.when(s.rlike(scp) & ~s.contains("://"), F.regexp_replace(s, scp, "$1/$2")).otherwise(plain)
    s = F.regexp_replace(F.regexp_replace(s, r"/+\z", ""), r"(?i)\.git\z", "")
    return F.lower(F.regexp_replace(F.regexp_replace(s, r"/+\z", ""), r"/{2,}", "/"))


def project_id(root: Column, origin_url: Column) -> Column:
    """First 16 hex digits of the digest of the normalised origin, or of the root where there is none."""
    by_url = F.concat(F.lit("remote:"), normalised_url(origin_url))
    by_path = F.concat(F.lit("path:"), F.lower(F.regexp_replace(root, r"\\", "/")))
    return F.substring(F.sha2(F.when(F.coalesce(origin_url, F.lit("")) != "", by_url).otherwise(by_path), 256), 1, 16)


def default_provenance(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, value in PROVENANCE.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def normalised_command(command: Column) -> Column:
    """Trimmed, inner white space as single blanks, lower case."""
    return F.lower(F.regexp_replace(trimmed(command), r"(?U)\s+", " "))
