"""Sentences of texts in any language: a hidden-event n-gram model puts boundaries between words."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.tables import cut, table

ROUNDS = 3

# Marks that end, close and open, and the layout of lines.
_WIDE_ENDS = "。！？｡．។៕။"
_ENDS = ".!?…‥؟۔।॥։" + _WIDE_ENDS
_CLOSERS = "\"'”’“‘»›」』）)]】》〉*_`"
_OPENERS = "\"'“„‚‘«‹「『（([【《〈¿¡*_`"
_PAIRS = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "《": "》", "‘": "’"}
_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿｡-ﾟ、。「」『』！？（），：；～…“”"
_THAI = "ก-๏"
_BLANKS = " \t\r\n\v\f\x85\xa0  -     　﻿"
_STRIP = "".join(chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))

TITLES = frozenset("mr mrs ms mx dr prof st hr fr herr frau sr sra srta dra mme mlle mm dott sig ing rev gen col capt lt sgt hon pres gov nr no fig vol chap sec art pp г-н г-жа им ул".split())

#: Words a sentence doesn't end behind, so that a number with a point after them is an ordinal.
BEFORE_ORDINALS = frozenset("am im vom zum zur der die das dem den des ab bis seit beim ins ans ein eine einem einen jeder jede jedem seinem ihrem dieser diesem".split())
#: Weight of what the marks around a gap say, beside the model.
PRIOR_WEIGHT = 0.5
#: Belief in a boundary at a gap without a mark, in blocks whose marks end no sentence, before anything is learnt.
PLAIN_PRIOR = 0.05
#: Words of one shape that a word never seen is thought to be one of.
UNSEEN = 1000

_LINE = re.compile(r"[^\n\r]*(?:\r\n|\n|\r|$)")
_INDENT = rf"[{_BLANKS.replace(chr(10), '').replace(chr(13), '')}]*"
_FENCE = re.compile(_INDENT + r"(`{3,}|~{3,})")
_HEADING = re.compile(_INDENT + r"#{1,6}[ \t]+\S")
_COMMAND = re.compile(_INDENT + r"\$ \S?")
_BULLET = re.compile(_INDENT + r"[-*+•‣–][ \t]+(?=\S)")
_NUMBER = re.compile(_INDENT + r"(\d{1,4})[.)][ \t]+(?=\S)")
_TURN = re.compile(_INDENT + r"[QA]:(?=\s)")

#: A place where a sentence may end: ending marks with the closing ones after them.
_CANDIDATE = re.compile(rf"[{re.escape(_ENDS)}]+(?:[{_BLANKS}]?[»›]|[{re.escape(_CLOSERS)}])*")
_THAI_SPACE = re.compile(rf"(?<=[{_THAI}])[{_BLANKS}]+(?=[{_THAI}])")
_TOKEN = re.compile(rf"[^{_BLANKS}]+")
_NO_CASE = re.compile(rf"[{_CJK.replace('…“”', '')}\u0590-\u109f\u1100-\u1cff\uac00-\ud7af]")
_IS_CJK = re.compile(rf"[{_CJK}]")
_PATH = re.compile(r"^[\"'“„«(\[]*(?:https?://|[\w.-]+/[\w./-]+|\.[a-z]\w+|[\w-]+\.(?:ts|js|py|go|rs|md|sql|yaml|yml|json|java|html|sh|txt|toml|log)\b)")
_CORE = re.compile(rf"^[{re.escape(_OPENERS)}]*(.*?)[{re.escape(_ENDS + _CLOSERS)},;:，、；：]*$", re.S)

#: Words of spaced scripts; of scripts without spaces a letter with all that is written around it (Han and kana, Lao, Khmer, Burmese).
_LETTERS = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\u0e81-\u0edf\u1000-\u103f\u1050-\u109f\u1780-\u17d3"
_UNIT = re.compile(
    "[\u1780-\u17b3](?:\u17d2[\u1780-\u17b3]|[\u17b4-\u17d1\u17d3])*"
    "|[\u1000-\u102a\u103f\u1050-\u1055](?:\u1039[\u1000-\u102a]|[\u102b-\u1038\u103a-\u103e\u1056-\u1059]|[\u1000-\u1021]\u103a)*"
    "|[\u0ec0-\u0ec4]?[\u0e81-\u0eae\u0edc-\u0edf][\u0eaf-\u0ebd\u0ec6-\u0ecf]*"
    "|[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f][ぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮー々ﾞﾟ]*"
    rf"|[^{_BLANKS}{_LETTERS}]+|[^{_BLANKS}]"
)
_IS_LETTER = re.compile(f"[{_LETTERS}]")
_HAS_THAI = re.compile(f"[{_THAI}]")
_ENDED = re.compile(rf"[{re.escape(_ENDS)}](?:[{_BLANKS}]|[{re.escape(_CLOSERS)}])*\Z")
_BLANK_RUN = re.compile(f"[{re.escape(_STRIP)}]+")
_MARKER = re.compile(r"\s*(?:[-*+•]|\d+[.)]|[QA]:)")
_DAY = re.compile(r"\d{1,2}\.")
_JOINS = ",;:，、；：—–-(（[【"
_JOINED = ",;:，、；：—–-(（[【”’»›」』）)]】》〉"


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of the parts of a text that sentences never cross; ``whole`` ones are one sentence."""
    out: list[tuple[int, int, bool]] = []
    at, n, kind = 0, len(text), ""
    start = 0
    fence = None

    def close(end: int, whole: bool = False) -> None:
        if text[start:end].strip(_STRIP):
            out.append((start, end, whole))

    while at < n:
        m = _LINE.match(text, at)
        line, end = m[0], m.end()
        if end == at:
            break
        if fence is not None:
            stripped = line.strip(_STRIP)
            if stripped.startswith(fence) and not stripped.strip(fence[0]):
                close(end, True)
                start, fence, kind = end, None, ""
            at = end
            continue
        blank = not line.strip(_STRIP)
        f = _FENCE.match(line)
        number = _NUMBER.match(line)
        item = _BULLET.match(line) or (number if number and (kind != "text" or number[1] == "1") else None)
        if blank:
            close(at)
            start, kind = end, ""
        elif f:
            close(at)
            start, fence = at, f[1]
        elif _HEADING.match(line) or _COMMAND.match(line):
            close(at)
            start = at
            close(end, True)
            start, kind = end, ""
        elif item or _TURN.match(line):
            close(at)
            start, kind = at, "item" if item else "text"
        elif not kind:
            close(at)
            start, kind = at, "text"
        at = end
    close(n, fence is not None)
    return out


def _quote_spans(text: str) -> list[tuple[int, int]]:
    """(opening, closing) positions of quotations and brackets, outermost first by opening."""
    spans, stack, plain = [], [], None
    for i, c in enumerate(text):
        if c == '"':
            if plain is None:
                plain = i
            else:
                spans.append((plain, i))
                plain = None
        elif stack and c == stack[-1][1]:
            spans.append((stack.pop()[0], i))
        elif c in _PAIRS and not (c == "‘" and i and text[i - 1].isalpha()):
            stack.append((i, _PAIRS[c]))
    return sorted(spans)


@functools.lru_cache(200_000)
def _norm(token: str) -> str:
    if _PATH.match(token):
        return "PATH" + token[-1:] if token[-1:] in _ENDS else "PATH"
    return re.sub(r"\d+(?:[.,:]\d+)*", "0", token)


@functools.lru_cache(200_000)
def _shape(token: str) -> str:
    """The class of a token: its opening marks, the kind of its letters, its last marks."""
    core = _CORE.match(token)[1]
    tail = token[token.rindex(core) + len(core) :] if core else token
    if not core:
        kind = "-"
    elif core.startswith("PATH"):
        kind = "P"
    elif core[0].isdigit():
        kind = "0"
    elif _IS_CJK.match(core[0]):
        kind = "c"
    elif core[0].isupper():
        kind = "X" if len(core) == 1 else "A"
    elif core[0].islower():
        kind = "x" if len(core) == 1 else "m" if any(c.isupper() or c == "_" for c in core) or "." in core else "a"
    else:
        kind = "u"
    return ("q" if token[0] in _OPENERS else "") + kind + tail


#: A word of more characters is one unknown word of its own, whatever it is.
LONG = 40
_MARKS_ONLY = frozenset(_ENDS + _CLOSERS)


def _left(text: str, low: int, end: int) -> str:
    """The word that ends at ``end``: of spaced scripts the whole, of others the last letter and the marks."""
    start = end
    while start > low and text[start - 1] not in _STRIP and end - start <= LONG:
        start -= 1
    return _left_word(text[start:end])


@functools.lru_cache(200_000)
def _left_word(token: str) -> str:
    tail = len(token)
    while tail and token[tail - 1] in _MARKS_ONLY:
        tail -= 1
    m = _CANDIDATE.search(token)
    first = m.start() if m else len(token)
    if tail and _IS_CJK.match(token[tail - 1]) or first and _IS_CJK.match(token[first - 1]) and not token.isascii():
        return token[max(0, tail - 1) :]
    if len(token) > LONG:
        return "LONG" + token[tail:]
    token = _norm(token)
    return token if token[:1].isupper() and len(token) <= 2 else token.lower() if not token.startswith("PATH") else token


def _right(text: str, start: int, high: int) -> str:
    m = _TOKEN.match(text, start, min(high, start + LONG + 1))
    return _right_word(m[0]) if m else "</b>"


@functools.lru_cache(200_000)
def _right_word(token: str) -> str:
    core = _CORE.match(token)[1]
    if core and _IS_CJK.match(core[0]):
        return token[: token.index(core) + 2]
    if len(token) > LONG:
        return "LONG"
    token = _norm(token)
    return token if token.startswith("PATH") else token.rstrip(_ENDS + ",;:)»”\"'") or token


class Gap:
    """One place where a sentence may end: where, the words around, and what is believed beforehand."""

    __slots__ = ("end", "plain", "prior", "start", "u1", "u2", "v1")

    def __init__(self, end, start, u2, u1, v1, prior, plain=None):
        self.end, self.start, self.u2, self.u1, self.v1, self.prior = end, start, u2, u1, v1, prior
        #: Of gaps without a mark (where u1 starts, script): their words are units, read by the part of the model that knows no marks.
        self.plain = plain


@functools.lru_cache(200_000)
def _bare(token: str) -> str:
    """A word without the marks around it, '' if it is none but marks."""
    return _norm(_CORE.match(token)[1])


def _context(word: str) -> str:
    return word if word == "PATH" else word.lower()


def units(text: str, low: int, high: int) -> list[tuple[int, int, str, str]]:
    """(start, end, word, word as the next one) of the units of text[low:high]; the latter of scripts without spaces is two of them."""
    found = [(m.start(), m.end(), _bare(m[0])) for m in _UNIT.finditer(text, low, high)]
    out = []
    for i, (a, b, word) in enumerate(found):
        following = word
        if i + 1 < len(found) and _IS_LETTER.match(word) and found[i + 1][0] == b:
            following += found[i + 1][2]
        out.append((a, b, word, following))
    return out


def _joined(text: str, left: tuple, right: tuple) -> bool:
    """Whether no sentence can end between two units: a mark or bracket joins them, one is a mark, or nothing parts the words."""
    if not left[2] or not right[2] or text[left[1] - 1] in _JOINS or text[right[0]] in _JOINED:
        return True
    return left[1] == right[0] and not (_IS_LETTER.match(text[left[1] - 1]) and _IS_LETTER.match(text[right[0]]))


def _plain_script(text: str, low: int, high: int) -> str:
    """The script of a block, 'f' where letters have cases and no capital is among them, or nothing else."""
    script = _script(text, low, high)
    if script == "l" and (text[low:high].islower() or text[low:high].isupper()):
        return "f"
    return script


def _plain_gaps(text: str, low: int, high: int, taken: set[int]) -> list[Gap]:
    """Every gap between words (letters, in scripts without spaces) but those ``taken``; the model decides."""
    found, script, body = units(text, low, high), _plain_script(text, low, high), text[low:high]
    closed = []
    for a, b in _quote_spans(body):
        at = low + a - 1
        while at >= low and text[at] in _STRIP:
            at -= 1
        if text[low + a] in "(（" or at >= low and text[at] not in _ENDS + _CLOSERS + _OPENERS or _goes_on(body, b + 1):
            closed.append((low + a, low + b))
    out, i, until = [], 0, low
    u2 = "<s>"
    for left, right in zip(found, found[1:], strict=False):
        while i < len(closed) and closed[i][0] < left[1]:
            until = max(until, closed[i][1])
            i += 1
        if left[1] not in taken and left[1] > until and not _joined(text, left, right):
            v1 = right[3].lower() if script == "f" and right[3] != "PATH" else right[3]
            out.append(Gap(left[1], right[0], u2, _context(left[2]), v1, PLAIN_PRIOR, (left[0], script)))
        u2 = _context(left[2]) if left[2] else u2
    return out


def gaps(text: str, low: int, high: int) -> list[Gap]:
    """The gaps of text[low:high] in order, but for its end.

    Where marks end sentences, gaps are behind marks; where no mark may, between any two words. In Thai, blanks between letters end sentences
    by rule and nothing else but marks does.
    """
    out = _mark_gaps(text, low, high)
    body = text[low:high]
    if any(g.prior > 0.1 for g in out) or _ENDED.search(body) or _HAS_THAI.search(body):
        return out
    plain = _plain_gaps(text, low, high, {g.end for g in out})
    return sorted(out + plain, key=lambda g: g.end) if out else plain


def _mark_gaps(text: str, low: int, high: int) -> list[Gap]:
    """The gaps behind marks, and the blanks of Thai."""
    body = text[low:high]
    spans = None
    found: dict[int, tuple[int, int, float | None]] = {}
    for m in _THAI_SPACE.finditer(body):
        found[m.start()] = (m.start(), m.end(), 1.0)
    for m in _CANDIDATE.finditer(body):
        end = m.end()
        if end >= len(body):
            continue
        mark, before = m[0], body[max(0, m.start() - 1) : m.start()]
        spaced = body[end] in _STRIP
        # Between scripts without spaces these marks always open what follows.
        while not spaced and end > m.start() + 1 and body[end - 1] in "“‘" and _IS_CJK.match(body[end]):
            end -= 1
        if not spaced:
            wide = mark[0] in _WIDE_ENDS or mark[0] in "…‥" and bool(_IS_CJK.match(body[end])) or mark[0] in "?!" and bool(_IS_CJK.match(before or " ")) and bool(_IS_CJK.match(body[end]))
            if not wide:
                continue
        start = end
        while start < len(body) and body[start] in _STRIP:
            start += 1
        if start < len(body):
            # an opening quotation mark after blanks isn't a closing one before them
            found.setdefault(end, (end, start, None))
    if not found:
        return []
    out, quotes = [], None
    blanks = [m.span() for m in _BLANK_RUN.finditer(body)]
    i = -1
    for end in sorted(found):
        _, start, fixed = found[end]
        here, after = low + end, low + start
        u1 = _left(text, low, here)
        while i + 1 < len(blanks) and blanks[i + 1][1] <= end - len(u1):
            i += 1
        at = low + blanks[i][0] if i >= 0 else low
        u2 = _left(text, low, at) if at > low else "<b>"
        v1 = _right(text, after, high)
        prior = fixed
        if prior is None:
            quotes = quotes or _Quotes(body)
            prior = _prior(body, end, start, quotes)
        out.append(Gap(here, after, u2, u1, v1, prior))
    return out


class _Quotes:
    """The quotations and brackets of a block: which ones nothing is split in, and where each begins by where it ends."""

    def __init__(self, body: str):
        spans = _quote_spans(body)
        self.first = len(body) - len(body.lstrip(_STRIP))
        self.opened = {b: a for a, b in spans}
        self.whole = []
        for a, b in spans:
            before = self.before(body, a, _STRIP + _OPENERS)
            fresh = not before or before[-1] in _ENDS + _CLOSERS or bool(_MARKER.fullmatch(before))
            if not fresh or body[a] in "(（" or _goes_on(body, b + 1):
                self.whole.append((a, b))
        self.at, self.until = 0, -1

    def before(self, body: str, at: int, skipped: str) -> str:
        """What stands before ``at`` without the ``skipped`` characters at its end, as far back as a marker may be long."""
        while at > 0 and body[at - 1] in skipped:
            at -= 1
        return body[self.first : at] if at - self.first < 16 else body[at - 16 : at]

    def within(self, end: int) -> bool:
        """Whether ``end`` lies in a quotation that is never split; asked in rising order."""
        while self.at < len(self.whole) and self.whole[self.at][0] < end:
            self.until = max(self.until, self.whole[self.at][1])
            self.at += 1
        return end <= self.until

    def closed_before(self, end: int) -> int | None:
        """Where the quotation began that closed within the last three characters."""
        found = [self.opened[p] for p in range(max(0, end - 3), end) if p in self.opened]
        return max(found) if found else None


def _goes_on(body: str, at: int) -> bool:
    """Whether what stands at ``at``, behind a closed quotation, continues its sentence for certain."""
    while at < len(body) and body[at] in _STRIP:
        at += 1
    c = body[at : at + 1]
    return bool(c) and (c in ",;:，、；：)）—–" or c.islower())


def _ordinal(body: str, end: int) -> bool:
    """Whether a number with a point ends at ``end`` behind a word that no sentence ends with."""
    at = end - 1
    while at > 0 and body[at - 1].isdecimal():
        at -= 1
    word = at
    while word > 0 and body[word - 1] in _STRIP:
        word -= 1
    low = word
    while low > 0 and word - low < 8 and body[low - 1].isalpha():
        low -= 1
    return low < word < at and body[low:word].lower() in BEFORE_ORDINALS


def _prior(body: str, end: int, start: int, quotes: _Quotes) -> float:
    """Belief in a boundary before anything is learnt; 0 where a quotation is open in a sentence that goes on."""
    if quotes.within(end):
        return 0.0
    if start < len(body) and body[start] in ",;，、；)）」』”»" or _goes_on(body, start) and body[start] in ",;:":
        return 0.0
    # quotations that end here, behind the mark they hold
    opened = quotes.closed_before(end) if body[end - 1] not in _ENDS else None
    low = end
    while low > 0 and end - low <= LONG and body[low - 1] not in _STRIP:
        low -= 1
    last = body[low:end].strip(_OPENERS + _CLOSERS)
    at = start
    while at < len(body) and body[at] in _OPENERS:
        at += 1
    first = body[at : at + 1]
    mark = body[end - 1] if body[end - 1] in _ENDS else next((c for c in reversed(body[max(0, end - 4) : end]) if c in _ENDS), ".")
    word = _TOKEN.match(body, start, start + LONG)
    told = word[0].lstrip(_OPENERS) if word else ""
    if last.lower().rstrip(".") in TITLES:
        prior = 0.01
    elif len(last) == 2 and last[0].isalpha() and last[1] == "." and (len(told) == 2 and told[1] == "." or not first.isupper()):
        prior = 0.03
    elif _DAY.fullmatch(last) and _ordinal(body, end):
        prior = 0.02
    elif mark in _WIDE_ENDS:
        prior = 0.93
    elif first.islower():
        prior = 0.3 if told and _shape(_norm(told))[0] in "mP" else 0.03
    elif first.isdigit():
        prior = 0.5 if mark in "!?" else 0.15
    elif first.isupper() and not _IS_CJK.match(first):
        prior = 0.95 if mark != "." else 0.7
    else:
        prior = 0.93
    if opened is not None:
        before = quotes.before(body, opened, _STRIP)
        if before and before[-1] not in _ENDS + _CLOSERS and not _MARKER.fullmatch(before) and not (first.isupper() and not _IS_CJK.match(first)):
            prior = min(prior, 0.04)
    return prior


# --- the model -------------------------------------------------------------------------------------


def _script(text: str, low: int, high: int) -> str:
    """What a block is written in: 'c' without spaces, 'l' with letter cases, 'o' other."""
    m = _NO_CASE.search(text, low, high)
    return "l" if not m else "c" if _IS_CJK.match(m[0]) else "o"


def events(u2: str, u1: str, v1: str, script: str, p: float, n: float) -> list[tuple[str, float]]:
    """Expected counts of the n-grams of a gap that was seen ``n`` times, with boundary probability ``p``."""
    q = 1 - p
    out = [(("E0", _shape(u1), "1"), p), (("E0", _shape(u1), "0"), q), (("E1", u1, "1"), p), (("E1", u1, "0"), q), (("E2", u2, u1, "1"), p), (("E2", u2, u1, "0"), q)]
    out += [(("S1", script, v1), p), (("S0", script, _shape(v1)), p), (("S", script), p)]
    if q > 0.9:
        out += [(("M1", script, v1), q), (("M0", script, _shape(v1)), q), (("M", script), q)]
    return [("\t".join(k), c * n) for k, c in out if c > 1e-6]


def _cased(script: str, word: str) -> list[tuple[str, str]]:
    """A word as counted: in scripts with letter cases also without them, for texts that use none."""
    return [(script, word), ("f", word if word == "PATH" else word.lower())] if script == "l" else [(script, word)]


def plain_events(kind: str, u2: str, u1: str, v1: str, script: str, n: float) -> list[tuple[str, float]]:
    """Counts of the n-grams without marks: 'b' of sentence ends, 'n' of words that end none, 'a' of first words, 'w' of later ones."""
    if kind in "bn":
        yes = "1" if kind == "b" else "0"
        keys = [("n0", _shape(u1), yes), ("n1", u1, yes), ("n2", u2, u1, yes)]
    else:
        keys = [k for sc, v in _cased(script, v1) for k in ((kind + "1", sc, v), (kind + "0", sc, _shape(v)), (kind, sc))]
        keys += [("w2", sc, u1, v) for sc, v in _cased(script, v1) if kind == "w"]
    return [("\t".join(k), n) for k in keys if n > 1e-6]


class Model:
    """Interpolated n-gram probabilities: of the boundary event after words, and of words after it and within sentences."""

    def __init__(self, counts: dict[str, float]):
        self.c = counts
        self.memo: dict[tuple, float] = {}

    def _get(self, *parts: str) -> float:
        return self.c.get("\t".join(parts), 0.0)

    def log_odds(self, u2: str, u1: str, v1: str, script: str) -> float:
        """Of a boundary between u1 and v1 against none. ``u2`` is '<s>' where a sentence begins at u1."""
        if (known := self.memo.get((u2, u1, v1, script))) is not None:
            return known
        p = 0.5
        for weight, key in ((1, ("E0", _shape(u1))), (2, ("E1", u1)), (6, ("E2", u2, u1))):
            yes, no = self._get(*key, "1"), self._get(*key, "0")
            p = (yes + weight * p) / (yes + no + weight)
        p = min(max(p, 1e-6), 1 - 1e-6)
        shape, starts = _shape(v1), self._get("S", script) + 1
        if shape.lstrip("q")[:1] == "c":
            within = 1 / 300  # of scripts without spaces words aren't told apart
            begin = (self._get("S1", script, v1) + 0.05) / (self._get("S0", script, shape) + 1)
        else:
            begin = (self._get("S0", script, shape) + 0.1) / starts
            begin = (self._get("S1", script, v1) + begin * 0.05) / starts
            words = self._get("M", script) + 1
            within = (self._get("M0", script, shape) + 0.1) / words
            within = (self._get("M1", script, v1) + within * 0.05) / words
        told = math.log(p / (1 - p)) + min(7.0, max(-7.0, math.log(begin / within)))
        if len(self.memo) < 400_000:
            self.memo[u2, u1, v1, script] = told
        return told

    def plain_odds(self, u2: str, u1: str, v1: str, script: str) -> float:
        """Log odds of a boundary between words u1 and v1 with no mark between them."""
        key = ("plain", u2, u1, v1, script)
        if (known := self.memo.get(key)) is not None:
            return known
        p, stays = 0.1, 0.0
        for weight, n in ((1, ("n0", _shape(u1))), (2, ("n1", u1)), (6, ("n2", u2, u1))):
            yes, no = self._get(*n, "1"), self._get(*n, "0")
            p = (yes + weight * p) / (yes + no + weight)
            stays = no if n[0] == "n1" else stays
        p = min(max(p, 1e-6), 1 - 1e-6)
        shape = _shape(v1)
        begin, within = (
            (0.9 * self._get(k + "1", script, v1) + 0.1 * (self._get(k + "0", script, shape) + 0.1) / UNSEEN) / (self._get(k, script) + 1) for k in "aw"
        )
        within = (self._get("w2", script, u1, v1) + 5 * within) / (stays + 5)
        told = math.log(p / (1 - p)) + min(7.0, max(-7.0, math.log(begin / within)))
        if len(self.memo) < 400_000:
            self.memo[key] = told
        return told

    def plain_with_prior(self, u2: str, u1: str, v1: str, script: str, prior: float) -> float:
        return self.plain_odds(u2, u1, v1, script) + PRIOR_WEIGHT * math.log(prior / (1 - prior))

    def with_prior(self, u2: str, u1: str, v1: str, script: str, prior: float) -> float:
        prior = min(max(prior, 0.01), 0.99)
        return self.log_odds(u2, u1, v1, script) + PRIOR_WEIGHT * math.log(prior / (1 - prior))

    def posteriors(self, chain: list[Gap], script: str) -> list[float]:
        """Of a block's gaps in order, by forward-backward: where one gap's next word is the next gap's last, they depend on each other."""
        n = len(chain)
        weights = []
        for i, g in enumerate(chain):
            if g.plain:
                at, own = g.plain
                free = self.plain_with_prior(g.u2, g.u1, g.v1, own, g.prior)
                weights.append((free, self.plain_with_prior("<s>", g.u1, g.v1, own, g.prior) if i and chain[i - 1].start == at else free))
                continue
            free = self.with_prior(g.u2, g.u1, g.v1, script, g.prior)
            tied = self.with_prior("<s>", g.u1, g.v1, script, g.prior) if i and chain[i - 1].start >= g.end - len(g.u1) - 2 else free
            weights.append((free, tied))
        # Two states, boundary or none, at each gap; ``steps`` holds the probability of a boundary from either.
        steps, forward, stays, ends = [], [], 1.0, 0.0
        for (free, tied), g in zip(weights, chain, strict=True):
            p = (g.prior, g.prior) if g.prior in (0.0, 1.0) else (_logistic(free), _logistic(tied))
            steps.append(p)
            stays, ends = stays * (1 - p[0]) + ends * (1 - p[1]), stays * p[0] + ends * p[1]
            forward.append((stays, ends))
        out, after0, after1 = [0.0] * n, 1.0, 1.0
        for i in range(n - 1, -1, -1):
            none, some = forward[i][0] * after0, forward[i][1] * after1
            out[i] = some / (none + some)
            p = steps[i]
            after0, after1 = (1 - p[0]) * after0 + p[0] * after1, (1 - p[1]) * after0 + p[1] * after1
        return out


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-min(40.0, max(-40.0, x))))


def sentences_of(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text in order, blanks and byte-order marks stripped off."""
    out = []

    def add(a: int, b: int) -> None:
        piece = text[a:b]
        a += len(piece) - len(piece.lstrip(_STRIP))
        b -= len(piece) - len(piece.rstrip(_STRIP))
        if b > a:
            out.append((a, b))

    for low, high, whole in blocks(text):
        if whole:
            add(low, high)
            continue
        body_low = _body(text, low, high)
        chain = gaps(text, body_low, high)
        at = low
        for g, p in zip(chain, model.posteriors(chain, _script(text, low, high)) if chain else [], strict=True):
            if p > 0.5:
                add(at, g.end)
                at = g.end
        add(at, high)
    return out


def _windows(texts) -> Counter:
    """Counted windows (kind, u2, u1, v1, script, prior): 'g' gaps, 's' starts and 'e' ends of blocks, which are certain, 'm' words within sentences.

    Without marks: 'p' gaps, 'b' and 'a' words around certain boundaries, 'n' and 'w' those where there is none.
    """
    seen: Counter = Counter()
    for text in texts:
        for low, high, whole in blocks(text):
            if whole:
                continue
            body = _body(text, low, high)
            while body < high and text[body] in _STRIP:
                body += 1
            end = high
            while end > body and text[end - 1] in _STRIP:
                end -= 1
            if end <= body:
                continue
            script = _script(text, body, end)
            seen["s", "", "", _right(text, body, high), script, 1.0] += 1
            u1 = _left(text, body, end)
            if u1 and u1[-1] in _ENDS + _CLOSERS:
                seen["e", "", u1, "", script, 1.0] += 1
            starts = {body}
            believed: dict[int, float | None] = {}
            for g in gaps(text, body, high):
                if g.plain:
                    believed[g.start] = None
                    seen["p", g.u2, g.u1, g.v1, g.plain[1], g.prior] += 1
                    continue
                starts.add(g.start)
                believed[g.start] = g.prior
                if g.prior != 0.0:
                    seen["g", g.u2, g.u1, g.v1, script, round(g.prior, 2)] += 1
            for m in _TOKEN.finditer(text, body, end):
                if m.start() not in starts:
                    seen["m", "", "", _right(text, m.start(), high), script, 1.0] += 1
            if not _HAS_THAI.search(text, body, end):
                _plain_windows(seen, text, body, end, believed)
    return seen


def _plain_windows(seen: Counter, text: str, low: int, high: int, believed: dict[int, float | None]) -> None:
    """Counts what a block tells of words at and away from boundaries, where marks are sure enough; None in ``believed`` stands for hidden."""
    found, script = units(text, low, high), _plain_script(text, low, high)
    u2, u1, fresh = "", "<s>", True
    for i, right in enumerate(found):
        left = found[i - 1] if i else right
        prior = believed.get(right[0], 0.0)
        if i and prior is not None and prior >= 0.5 and u1 != "<s>":
            seen["b", u2, u1, "", script, 1.0] += 1
            u2, u1, fresh = "", "<s>", True
        elif i and prior is not None and prior <= 0.1 and not fresh and not _joined(text, left, right):
            seen["n", u2, u1, "", script, 1.0] += 1
            seen["w", "", u1, right[3], script, 1.0] += 1
        if right[2]:
            if fresh:
                seen["a", "", "", right[3], script, 1.0] += 1
            u2, u1, fresh = u1, _context(right[2]), False
    if u1 != "<s>":
        seen["b", u2, u1, "", script, 1.0] += 1


def _body(text: str, low: int, high: int) -> int:
    """Where the text of a block begins, behind its marker."""
    marker = _BULLET.match(text, low, high) or _NUMBER.match(text, low, high) or _TURN.match(text, low, high)
    return marker.end() if marker else low


_WINDOW = ["kind", "u2", "u1", "v1", "script", "prior"]


def window_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """Every distinct window of all texts with its number; counted within each batch before the shuffle."""

    def count(frames):
        for frame in frames:
            seen = _windows(t for t in frame["t"] if t)
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=[*_WINDOW, "n"])

    schema = "kind string, u2 string, u1 string, v1 string, script string, prior double, n bigint"
    return documents.select(F.col(text).alias("t")).mapInPandas(count, schema).groupBy(*_WINDOW).agg(F.sum("n").alias("n"))


def train(documents: DataFrame, text: str = "text", rounds: int = ROUNDS) -> dict[str, float]:
    """Counts of the hidden-event model, by expectation maximisation over the windows of all documents.

    The first round believes the marks and letter cases around a gap, later ones the model so far.
    All n-grams come to the driver and are broadcast: as many as the documents' distinct windows tell, however rare.
    """
    windows = cut(window_counts(documents, text))
    counts: dict[str, float] | None = None
    for _ in range(rounds):
        told = documents.sparkSession.sparkContext.broadcast(counts)

        def expect(frames, told=told):
            model = Model(told.value) if told.value is not None else None
            for frame in frames:
                sums: Counter = Counter()
                for r in frame.itertuples(index=False):
                    if r.kind in "sm":
                        c = r.kind.upper()
                        for k in ((c + "1", r.script, r.v1), (c + "0", r.script, _shape(r.v1)), (c, r.script)):
                            sums["\t".join(k)] += r.n
                    elif r.kind in "abnw":
                        for k, c in plain_events(r.kind, r.u2, r.u1, r.v1, r.script, r.n):
                            sums[k] += c
                    elif r.kind == "p":
                        p = r.prior
                        if model is not None:
                            p = 1 / (1 + math.exp(-min(40.0, max(-40.0, model.plain_with_prior(r.u2, r.u1, r.v1, r.script, r.prior)))))
                        for kind, share in (("b", p), ("a", p), ("n", 1 - p), ("w", 1 - p)):
                            for k, c in plain_events(kind, r.u2, r.u1, r.v1, r.script, share * r.n):
                                sums[k] += c
                    elif r.kind == "e":
                        sums["\t".join(("E1", r.u1, "1"))] += r.n
                        sums["\t".join(("E0", _shape(r.u1), "1"))] += r.n
                    else:
                        p = r.prior
                        if model is not None and p != 1.0:
                            p = 1 / (1 + math.exp(-min(40.0, max(-40.0, model.with_prior(r.u2, r.u1, r.v1, r.script, r.prior)))))
                        for k, c in events(r.u2, r.u1, r.v1, r.script, p, r.n):
                            sums[k] += c
                yield pd.DataFrame(list(sums.items()), columns=["k", "c"])

        grams = windows.mapInPandas(expect, "k string, c double").groupBy("k").agg(F.sum("c").alias("c"))
        # Sums of doubles differ in their last digits with the order; rounding makes the model repeatable.
        kept = grams.select("k", F.round("c", 4).alias("c")).where("c > 0").toArrow()
        counts = dict(zip(kept["k"].to_pylist(), kept["c"].to_pylist(), strict=True))
    return counts or {}


def sentences(documents: DataFrame, id_column: str = "doc_id", text: str = "text", counts: dict[str, float] | None = None) -> DataFrame:
    """(id_column, sentence_no, start_pos, end_pos, sentence): the sentences of every document in order, numbered from 0.

    Layout ends sentences for certain: headings, command lines, fenced code, list items, blank lines; in
    between, a hidden-event model trained on all documents decides by forward-backward. Null, empty and
    blank texts have no sentences; repeated rows are split each by themselves; an id may repeat. Other
    columns aren't read.
    """
    counts = train(documents, text) if counts is None else counts
    told = documents.sparkSession.sparkContext.broadcast(counts)
    kind = documents.schema[id_column].dataType.simpleString()

    def split(frames):
        model = Model(told.value)
        for frame in frames:
            ids, rows = [], []
            for i, t in zip(frame["i"], frame["t"], strict=True):
                for no, (a, b) in enumerate(sentences_of(t, model)):
                    ids.append(i)
                    rows.append((no, a, b, t[a:b]))
            out = pd.DataFrame(rows, columns=["sentence_no", "start_pos", "end_pos", "sentence"])
            out.insert(0, id_column, pd.Series(ids, dtype=frame["i"].dtype))
            yield out

    return documents.select(F.col(id_column).alias("i"), F.col(text).alias("t")).where("t <> ''").mapInPandas(split, f"`{id_column}` {kind}, sentence_no int, start_pos bigint, end_pos bigint, sentence string")


def p9_sentences(spark, folder: str) -> DataFrame:
    return sentences(table(spark, folder, "documents"))


def p9_found(spark, folder: str) -> DataFrame:
    return p9_sentences(spark, folder).select("doc_id", "start_pos", "end_pos")


QUERIES = {"p9_found": p9_found, "p9_sentences": p9_sentences}
SQL: dict[str, str] = {}
