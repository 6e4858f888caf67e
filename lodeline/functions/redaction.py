"""The store's own redaction of texts before they are kept: a short chain of shapes, in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes in their order; the last keeps the name of the key and is left out for code.
SHAPES = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
)
KEY_VALUE = r"(?i)\b((?:api[_-]?key|secret|password|passwd|token|access[_-]?key)s?)\s*[:=]\s*['\"]?[A-Za-z0-9_\-./+=]{8,}['\"]?"


def redacted(text: Column, code: bool = False) -> Column:
    """The text after every rule in turn; for ``code`` without the key and value rule."""
    for shape in SHAPES:
        text = F.regexp_replace(text, shape, "[redacted]")
    return text if code else F.regexp_replace(text, KEY_VALUE, "$1: [redacted]")


def redactions(text: Column, code: bool = False) -> Column:
    """How many pieces the rules replace, each counted in the text the rules before it left."""
    total = F.lit(0)
    for shape in SHAPES:
        total = total + F.regexp_count(text, F.lit(shape))
        text = F.regexp_replace(text, shape, "[redacted]")
    return total if code else total + F.regexp_count(text, F.lit(KEY_VALUE))
