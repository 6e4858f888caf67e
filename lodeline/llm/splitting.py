"""Oversized items cut into overlapping pieces at the strongest natural boundaries."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.tables import table

#: Strength of a cut by what stands before or after it. The text is cut behind the match's group ``cut``.
BOUNDARIES = (
    (9, re.compile(r"\n(?P<cut>)(?=#{1,6} )")),  # before a heading
    (9, re.compile(r"\n(?P<cut>)(?=@@ -)")),  # before a hunk
    (8, re.compile(r"\r?\n[ \t]*(?:\r?\n[ \t]*)*\r?\n(?P<cut>)")),  # after blank lines
    (7, re.compile(r"\n[+ -]?(?:\}|end|\);?)[ \t;,]*\r?\n(?P<cut>)")),  # after a closed block of code
    (6, re.compile(r"\n(?P<cut>)")),  # after a line
    (5, re.compile(r"[.!?…]+[\"'”’»)\]]*[ \t ]+(?P<cut>)")),  # after a sentence
    (5, re.compile(r"[。！？｡।؟]+[」』”’）]*[ 　]*(?P<cut>)")),
    (4, re.compile(r"[;:；：،,，、][ \t　]*(?P<cut>)")),  # after a clause
    (2, re.compile(r"[ \t　]+(?P<cut>)")),  # after a word
)
#: A cut never falls before one of these, nor between the two halves of a line mark.
_CLINGS = re.compile(r"(?<=\r)(?=\n)|(?=[̀-ͯ‍️︎⃣\U0001f3fb-\U0001f3ff็-๎ัิ-़ฺ-ाि-्ً-ٟ])|(?<=‍)")


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before each position 0..len(text): 1 anywhere, more at natural boundaries, 0 where text clings together."""
    out = np.ones(len(text) + 1, dtype=np.int8)
    for strength, pattern in BOUNDARIES:
        at = np.fromiter((m.start("cut") for m in pattern.finditer(text)), dtype=np.int64)
        if len(at):
            out[at] = np.maximum(out[at], strength)
    clings = np.fromiter((m.start() for m in _CLINGS.finditer(text)), dtype=np.int64)
    if len(clings):
        out[clings] = 0
    return out


class RangeMax:
    """Sparse table: index of the greatest of a range of at most ``widest`` values (of any, if None) in constant time, ties to the right.

    Levels stop at the widest range asked for, so their number doesn't grow with the values.
    """

    def __init__(self, values: np.ndarray, widest: int | None = None):
        self.values = values
        level = np.arange(len(values), dtype=np.int32)
        self.levels = [level]
        width = 1
        while 2 * width <= min(len(values), widest or len(values)):
            a, b = level[:-width], level[width:]
            level = np.where(values[a] > values[b], a, b)
            self.levels.append(level)
            width *= 2

    def query(self, low: int, high: int) -> int:
        """Of low..high, both included."""
        k = (high - low + 1).bit_length() - 1
        a, b = self.levels[k][low], self.levels[k][high - (1 << k) + 1]
        return int(a if self.values[a] > self.values[b] else b)


def pieces(text: str, max_size: int, overlap: int, unit: str) -> list[tuple[int, int]]:
    """Positions (start, end) of the pieces of ``text``, each within ``max_size`` of ``unit`` ('chars' or 'bytes').

    Each cut is the strongest one, the rightmost of equals, in the whole permissible window; the next
    piece starts ``overlap`` earlier (in bytes, at the first whole character within ``overlap``). A
    single character larger than ``max_size`` is a piece of its own.
    """
    n = len(text)
    size = np.arange(n + 1, dtype=np.int64)
    if unit == "bytes" and not text.isascii():
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for beyond in (0x7F, 0x7FF, 0xFFFF):
            size[1:] += np.cumsum(points > beyond)
    if size[-1] <= max_size:
        return [(0, n)]
    # A window holds at most as many cuts as a piece has room for characters.
    best = RangeMax(strengths(text), max_size + 1)
    out, start, reached = [], 0, 0
    while True:
        last = int(np.searchsorted(size, size[start] + max_size, side="right")) - 1
        if last >= n:
            out.append((start, n))
            return out
        # The cut lies behind the last one, and so far on that the next piece starts later than this one.
        least = max(int(np.searchsorted(size, size[start] + overlap, side="right")), start + 1, reached + 1)
        last = max(last, reached + 1, start + 1)
        least = min(least, last)
        end = best.query(least, last)
        out.append((start, end))
        if end == n:
            return out
        room = min(int(np.searchsorted(size, size[end + 1] - max_size)), end)  # so that the next piece holds one more character
        start, reached = max(int(np.searchsorted(size, size[end] - overlap)), start + 1, room), end


def split_items(items: DataFrame, limits: DataFrame) -> DataFrame:
    """(item_set, item_key, piece_no, start_pos, end_pos, piece_text, heading) of every oversized item.

    ``items`` has (item_set, item_key, heading, text); ``limits`` (item_set, size_unit, max_size,
    overlap_size), one row per set, is the broadcast side: as many rows as there are sets. Only
    oversized items reach Python; each is cut by itself, so nothing is gathered. Items that are null,
    empty, within the limit, or of a set without limit give no rows; a limit under 1 counts as 1;
    repeated rows give their pieces once each; a null heading stays null.
    """
    one = limits.groupBy("item_set").agg(F.min_by(F.struct("size_unit", "max_size", "overlap_size"), "max_size").alias("l")).select("item_set", "l.*")
    sized = items.select("item_set", F.col("item_key").cast("string").alias("item_key"), "heading", "text").join(F.broadcast(one), "item_set")
    over = sized.where(F.when(F.col("size_unit") == "bytes", F.octet_length("text")).otherwise(F.length("text")) > F.greatest("max_size", F.lit(1)))

    def cut_up(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                limit = max(int(r.max_size), 1)
                overlap = min(max(int(r.overlap_size or 0), 0), limit - 1)
                for no, (a, b) in enumerate(pieces(r.text, limit, overlap, r.size_unit)):
                    rows.append((r.item_set, r.item_key, no, a, b, r.text[a:b], r.heading))
            yield pd.DataFrame(rows, columns=["item_set", "item_key", "piece_no", "start_pos", "end_pos", "piece_text", "heading"])

    return over.mapInPandas(
        cut_up, "item_set string, item_key string, piece_no int, start_pos int, end_pos int, piece_text string, heading string"
    ).dropDuplicates(["item_set", "item_key", "piece_no", "start_pos", "end_pos", "piece_text"])


def _items(spark, folder: str) -> DataFrame:
    chunks = table(spark, folder, "assistant_chunks").select(F.lit("assistant_chunks.text").alias("item_set"), F.col("chunk_id").alias("item_key"), "heading", "text")
    patches = table(spark, folder, "file_diffs").select(F.lit("file_diffs.patch").alias("item_set"), F.col("diff_id").alias("item_key"), F.lit(None).cast("string").alias("heading"), F.col("patch").alias("text"))
    return chunks.unionByName(patches)


def p5_pieces(spark, folder: str) -> DataFrame:
    return split_items(_items(spark, folder), table(spark, folder, "size_limits"))


def p5_found(spark, folder: str) -> DataFrame:
    return p5_pieces(spark, folder).where("piece_no = 0").select("item_set", "item_key").distinct()


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces}
SQL = {
    "p5_found": """
with items as (
    select 'assistant_chunks.text' as item_set, cast(chunk_id as varchar) as item_key, text from assistant_chunks
    union all select 'file_diffs.patch', cast(diff_id as varchar), patch from file_diffs)
select distinct i.item_set, i.item_key from items i join size_limits l using (item_set)
where case when size_unit = 'bytes' then strlen(text) else length(text) end > max_size
"""
}
