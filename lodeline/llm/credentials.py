"""Credentials embedded in source code, commands and messages: found by one automaton, replaced in place."""

from __future__ import annotations

import base64
import binascii
import bisect
import functools
import itertools
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.automaton import Automaton
from lodeline.tables import table

#: Characters that are scanned together.
BATCH_CHARS = 4_000_000

# Key names, words of several languages, and public token formats.
_KEYS = (
    "password|passwd|passphrase|passcode|passwort|kennwort|pwd|pass|secret|token|jeton|credentials?|"
    "api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|signing[_-]?key|auth[_-]?key|encryption[_-]?key|"
    "account[_-]?key|master[_-]?key|shared[_-]?key|mot de passe|contraseña|clave|пароль"
)
_WORDS = "密码|密碼|口令|パスワード|トークン|비밀번호|토큰|كلمة المرور|รหัสผ่าน|पासवर्ड"
FORMATS = {
    "aws": r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}",
    "git host": r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}",
    "chat": r"xox[abeoprs]-[A-Za-z0-9-]{10,}",
    "payment": r"[sr]k_live_[A-Za-z0-9]{16,}",
    "mail": r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    "maps": r"AIza[0-9A-Za-z_-]{35}",
    "registry": r"npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{40,}",
    "model": r"hf_[A-Za-z0-9]{30,}|sk-(?:ant-|proj-)?[A-Za-z0-9_-]{20,}",
    "web token": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}

#: What the automaton recognises, and the contexts that are then read exactly around it.
HEADS = (
    ("format", r"akia[0-9a-z]{4}|asia[0-9a-z]{4}|gh[pousr]_[a-z0-9]{4}|github_pat_|glpat-|xox[abeoprs]-|[sr]k_live_|sg\.[a-z0-9_-]{4}|aiza[0-9a-z_-]{4}|npm_[a-z0-9]{4}|pypi-|hf_[a-z0-9]{4}|sk-[a-z0-9]{4}|eyj[a-z0-9_-]{4}"),
    ("armor", r"-----begin [a-z0-9 ]*private key"),
    ("connection", r"://[^\s/:@'\"<>]*:[^\s/@]"),
    ("header", r"(bearer|basic)[ \t]"),
    ("option", r"\s-[pkuaw]|sshpass"),
    ("login", r"auth[ \t]*=|identified by"),
    ("key", f"({_KEYS.replace('_-]?', '_-]{0,1}').replace('s?', 's{0,1}')}|pw|{_WORDS})"),
)

_QUOTE = r"(?P<q>\\?[\"'`]?)"
#: What may follow each head, read from where the head ends, as far as it goes, and how its value is judged.
_ASSIGNED = re.compile(r"(?:\\?[\"'`\])])*[ \t]*(?:(?::=|=>|==?|[:：>])[ \t]*(?:[Ss]tring|str)?(?:[ \t]*=[ \t]*)?|,[ \t]*(?=\\?[\"'`]))[ \t]*" + _QUOTE)
_OPTION_VALUE = re.compile(r"[ =][ \t]*" + _QUOTE)
_SAID = re.compile(r"[ \t]+(?:(?:is|was|ist|est|es|lautet|to|of)[ \t]+)?" + _QUOTE)
_SAID_WORD = re.compile(r"[ \t]*(?:是|は|为|為|은|는|이|คือ|है|هي|[:：—-])?[ \t]*(?P<q>[「『“\"'`]?)")
_PLAIN_VALUE = re.compile(r"[ \t]*(?P<q>)")
_USER = re.compile(r"[ =]*[\"']?[^\s:\"'=]+:(?P<q>)")
_PASS_OPTION = re.compile(r"[ \t]+-p[ \t]*" + _QUOTE)
_AT_ONCE, _NEAR, _APART = re.compile(_QUOTE), re.compile(r"[ \t]*" + _QUOTE), re.compile(r"[ \t]+" + _QUOTE)
_LOGIN = re.compile(r"[ \t]*\([ \t]*([\"'])[^\"'\n]*\1[ \t]*,[ \t]*(?P<q>[\"'])")
#: Programs whose options hold passwords: the letters of the option, and what stands between it and its value.
_PROGRAMS = (
    (("mysql", "mysqldump", "mysqladmin", "mariadb"), "p", _AT_ONCE),
    (("zip", "unzip", "7z", "rar"), "pP", _NEAR),
    (("openssl",), "k", _APART),
    (("redis-cli", "sqlcmd", "ldapsearch"), "aPw", _APART),
)
_PROGRAM = re.compile(r"\b(?:" + "|".join(name for names, _, _ in _PROGRAMS for name in sorted(names, key=len, reverse=True)) + r")\b")
_WORD_ENDS = tuple(_WORDS.split("|"))
_KEY_LONGEST = 16
_NAME = re.compile(rf"(?i:pw|{_KEYS})\Z")
_FORMAT = re.compile("(?<![A-Za-z0-9])(?:" + "|".join(FORMATS.values()) + ")(?![A-Za-z0-9])")
_ADDRESS = re.compile(r"[^\s/@'\"<>]+(?=@)")
_ARMOR = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----")
_BARE = re.compile(r"[^\s\"'`<>;,)}\]\\「」『』“”]+")
_QUOTED = {q: re.compile(rf"[^{re.escape(q)}\s]*") for q in "\"'`"} | {"「": re.compile(r"[^」\s]*"), "『": re.compile(r"[^』\s]*"), "“": re.compile(r"[^”\s]*")}
_CLOSING = {"「": "」", "『": "』", "“": "”"}
#: What is left of a private key whose last line is lost: lines of its letters.
_KEY_LINES = re.compile(r"(?:(?:\\r|\\n|[\r\n \t+-])*[A-Za-z0-9+/=]{16,}(?![A-Za-z0-9+/=]))+")
_CALL = re.compile(r"[A-Za-z_$][\w.$]*\([^()]*\)?")
_COMMON_WORD = re.compile(r"pass|pwd|secret|token|key|name|prod|dev|test|user|admin|data|value|field|config|service|default|required|invalid|missing|error|hash|file|path|auth|login|string|input|sample|mask|null|none|true|false")
_NO = re.compile(
    r"(?i)^[$<{%&(\[@*]|^\.{2,}|\*{3}|x{5}|\.{3}|\byour|your[_-]|example|changeme|placeholder|redacted|dummy|_here\b|process\.env|environ|getenv|getpass|vault|secrets\.|^sha\d+[-:]|^data:|^https?:"
    r"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^(?-i:(?:0x)?[0-9A-F]{8,40})$|^(?:string|str|none|null|true|false)\b"
)
_PATH = re.compile(r"^[\w.-]*(?:/[\w.-]+)+\.\w{1,5}$|^(?:\.{0,2}/)[\w./-]+$|^v?\d+(?:\.\d+)+$")


def _phrase(value: str) -> bool:
    """A pass phrase: three words and more, none of them one that names of fields and settings are made of."""
    parts = re.split(r"[-_.]", value.lower())
    return len(parts) >= 3 and all(len(p) >= 3 and p.isalpha() for p in parts) and not any(_COMMON_WORD.search(p) for p in parts)


def live(value: str, how: str, quoted: bool = False, password: bool = False) -> bool:
    """Whether a value in a context looks like a credential rather than a reference, placeholder, mask or id.

    ``quoted`` ones may hold brackets if they are no call, and of a ``password`` a quoted phrase needs no digit.
    """
    if _FORMAT.fullmatch(value):
        return not re.search(r"EXAMPLE|(.)\1{7}", value)
    if len(value) < (8 if how == "prose" else 6) or _NO.search(value) or "(" in value and (not quoted or _CALL.fullmatch(value)):
        return False
    if password and quoted and how == "strict" and _phrase(value):
        return True
    if not re.search(r"[A-Za-z]", value) or not re.search(r"\d", value) or (_PATH.match(value) and not re.fullmatch(r"[A-Za-z0-9+/]{20,}={0,2}", value)):
        return False
    return how != "prose" or len(value) >= 16 or bool(re.search(r"[^A-Za-z0-9]", value))


def _value(text: str, m: re.Match) -> tuple[int, int] | None:
    start, quote = m.end(), m["q"]
    close = quote.lstrip("\\")
    if close:
        end = _QUOTED[close].match(text, start).end()
        # an open one may end with its line, unless its mark also is an apostrophe
        if end >= len(text) or text[end] != _CLOSING.get(close, close) and (text[end] != "\n" or close in "'`"):
            return None
        if quote.startswith("\\") and text[end - 1 : end] == "\\":
            end -= 1
        return start, end
    v = _BARE.match(text, start)
    if not v:
        return None
    end = v.end()
    while end > start and text[end - 1] in ".:?":
        end -= 1
    return start, end


def _base64(value: str) -> bool:
    try:
        return b":" in base64.b64decode(value + "=" * (-len(value) % 4), validate=True)
    except (binascii.Error, ValueError):
        return False


@functools.cache
def _automaton() -> Automaton:
    return Automaton([pattern for _, pattern in HEADS])


def _back(text: str, at: int, chars: str, most: int | None = None) -> int:
    """The first position of the run of ``chars`` that ends at ``at``, of at most ``most``."""
    low = 0 if most is None else max(0, at - most)
    while at > low and text[at - 1] in chars:
        at -= 1
    return at


def _authorized(text: str, at: int) -> bool:
    """Whether the name of the header stands before its scheme, which begins at ``at``."""
    at = _back(text, _back(text, _back(text, at, " \t"), "\"'`", 1), " \t")
    at, colon = _back(text, at, ":=,", 1), at
    at = _back(text, _back(text, at, " \t"), "\"'`", 1) if at < colon else 0
    return text[max(0, at - 13) : at].lower() == "authorization"


class _Commands:
    """Which programs stand before a position in its command; the text is read once, when first asked."""

    def __init__(self, text: str):
        self.text, self.breaks = text, None

    def before(self, at: int, names: tuple[str, ...]) -> bool:
        if self.breaks is None:
            self.breaks = [m.start() for m in re.finditer(r"[\n|;&]", self.text)]
            self.found: dict[str, list[int]] = {}
            for m in _PROGRAM.finditer(self.text):
                self.found.setdefault(m[0], []).append(m.start())
        i = bisect.bisect_left(self.breaks, at)
        low = self.breaks[i - 1] if i else -1
        for name in names:
            places = self.found.get(name, [])
            j = bisect.bisect_left(places, at)
            if j and places[j - 1] > low:
                return True
        return False


def _key_values(text: str, end: int):
    """(match up to the value, how to judge it, whether a password is named) of what follows a key name that ends at ``end``."""
    name = text[max(0, end - _KEY_LONGEST) : end]
    if name.endswith(_WORD_ENDS):
        yield _SAID_WORD.match(text, end), "prose", False
        return
    if re.match(r"[A-Za-z0-9_]", text[end : end + 1]) or name[-2:].lower() == "pw" and name[-3:-2].isalpha():
        return
    password = bool(re.search(r"(?i)(?:pass(?:word|wd|phrase|code)?|pwd|pw|passwort|kennwort|contraseña|clave|mot de passe|пароль)\Z", name))
    yield _ASSIGNED.match(text, end), "strict", password
    whole = _NAME.search(name)
    at = end - len(name) + whole.start() if whole else 0
    while at > 0 and text[at - 1].isascii() and text[at - 1].isalpha():
        at -= 1
    if text[max(0, at - 1) : at] == "-":
        yield _OPTION_VALUE.match(text, end), "strict", password
    yield _SAID.match(text, end), "prose", False


def _contexts(text: str, head: str, end: int, commands: _Commands):
    """(match up to the value, how to judge it, whether a password is named) of what the head that ends at ``end`` stands in."""
    if head == "key":
        yield from _key_values(text, end)
    elif head == "header":
        word = "bearer" if text[end - 7 : end - 1].lower() == "bearer" else "basic"
        at = end - 1 - len(word)
        told = _authorized(text, at)
        if word == "basic":
            yield told and _PLAIN_VALUE.match(text, end), "basic", False
        elif told or not re.match(r"\w", text[at - 1 : at]):
            yield _PLAIN_VALUE.match(text, end), "strict" if told else "prose", False
    elif head == "option":
        if text[end - 7 : end] == "sshpass":
            yield not re.match(r"\w", text[max(0, end - 8) : max(0, end - 7)]) and _PASS_OPTION.match(text, end), "strict", True
            return
        if text[end - 1] == "u":
            yield _USER.match(text, end), "strict", False
        for names, letters, value in _PROGRAMS:
            if text[end - 1] in letters and text[max(0, end - 3) : end - 2] in (" ", "\t") and commands.before(end - 2, names):
                yield value.match(text, end), "strict", True
    elif head == "login":
        if text[end - 1] == "=":
            at = _back(text, end - 1, " \t") - 4
            yield not re.match(r"\w", text[max(0, at - 1) : max(0, at)]) and _LOGIN.match(text, end), "strict", False
        else:
            yield _APART.match(text, end), "strict", True


def spans(texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Of each text, the disjoint (start, end, kind) of its credentials in order."""
    found: list[dict[tuple[int, int], str]] = [{} for _ in texts]
    done: dict[int, int] = {}
    commands: dict[int, _Commands] = {}
    never: set[tuple[int, str]] = set()  # keys of this kind end nowhere in the rest of the text
    # an option has a blank before it, but for one that begins the text
    option = 1 << [head for head, _ in HEADS].index("option")
    first = ((no, 2, option) for no, text in enumerate(texts) if text.startswith("-u"))
    for no, end, bits in itertools.chain(first, _automaton().run(texts)):
        text = texts[no]
        for k, (head, _) in enumerate(HEADS):
            if not bits >> k & 1:
                continue
            if head == "format":
                for at in range(max(0, end - 12), end):
                    if m := _FORMAT.match(text, at):
                        if live(m[0], "strict"):
                            found[no][m.span()] = "token"
                        break
            elif head == "armor":
                m = end > done.get(no, -1) and _ARMOR.match(text, max(0, text.rfind("-----BEGIN ", 0, end)))
                if m and (no, m[1]) not in never and (stop := text.find(f"-----END {m[1]}-----", m.end())) > 0:
                    done[no] = stop
                    found[no][m.start(), stop + len(m[1]) + 14] = "private key"
                elif m and not never.add((no, m[1])) and (rest := _KEY_LINES.match(text, m.end())):
                    found[no][m.start(), rest.end()] = "cut private key"
            elif head == "connection":
                m = _ADDRESS.match(text, end - 1)
                scheme = text.rfind("://", 0, end - 2)
                if m and re.match(r"[A-Za-z0-9+.-]", text[scheme - 1 : scheme]) and live(m[0], "strict"):
                    found[no].setdefault(m.span(), "password")
            else:
                here = commands.setdefault(no, _Commands(text))
                for m, how, password in _contexts(text, head, end, here):
                    if not m or not (v := _value(text, m)):
                        continue
                    value = text[v[0] : v[1]]
                    if _base64(value) if how == "basic" else live(value, "strict" if m["q"] else how, bool(m["q"]), password):
                        found[no].setdefault(v, "login" if how == "basic" else "secret")
    out = []
    for each in found:
        kept: list[tuple[int, int, str]] = []
        for (a, b), kind in sorted(each.items(), key=lambda x: (x[0][0], -x[0][1])):
            if not kept or a >= kept[-1][1]:
                kept.append((a, b, kind))
        out.append(kept)
    return out


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced by a placeholder of its kind, and all else as it was."""
    parts, at = [], 0
    for a, b, kind in found:
        parts += [text[at:a], f"[{kind.upper().replace(' ', '_')}]"]
        at = b
    return "".join([*parts, text[at:]])


def _batches(frames):
    for frame in frames:
        texts, low, chars = frame["text"].fillna("").tolist(), 0, 0
        for i, t in enumerate(texts):
            chars += len(t)
            if chars > BATCH_CHARS or i == len(texts) - 1:
                yield frame.iloc[low : i + 1], texts[low : i + 1]
                low, chars = i + 1, 0


def credentials(fields: DataFrame) -> DataFrame:
    """(field_ref, row_key, secret_text, start_pos, end_pos, kind) of every credential in ``fields`` (field_ref, row_key, text).

    All token formats, key armors, connection strings and key names are one deterministic automaton that
    runs over overlapping chunks of the whole texts in lock step; where it ends in a match the context
    is read exactly from there, as far as it goes, and spans are deduplicated by absolute position. A private
    key without its last line has the kind 'cut private key'. Each text is taken by itself, so
    nothing is shuffled but the few rows found. Null and empty texts hold nothing; repeated rows give
    their spans once; other columns aren't read.
    """

    def scan(frames):
        for frame, texts in _batches(frames):
            rows = [
                (ref, key, t[a:b], a, b, kind)
                for ref, key, t, found in zip(frame["field_ref"], frame["row_key"], texts, spans(texts), strict=True)
                for a, b, kind in found
            ]
            yield pd.DataFrame(rows, columns=["field_ref", "row_key", "secret_text", "start_pos", "end_pos", "kind"])

    kinds = "field_ref string, row_key string, secret_text string, start_pos bigint, end_pos bigint, kind string"
    return fields.select("field_ref", F.col("row_key").cast("string").alias("row_key"), "text").where("text <> ''").mapInPandas(scan, kinds).distinct()


def redact_credentials(fields: DataFrame) -> DataFrame:
    """(field_ref, row_key, n_found, text): every row of ``fields`` with its credentials replaced; null texts stay null."""

    def scan(frames):
        for frame, texts in _batches(frames):
            found = spans(texts)
            out = frame.assign(n_found=[len(f) for f in found])
            out["text"] = [redacted(t, f) if had is not None else None for t, f, had in zip(texts, found, frame["text"], strict=True)]
            yield out[["field_ref", "row_key", "n_found", "text"]]

    return fields.select("field_ref", F.col("row_key").cast("string").alias("row_key"), "text").mapInPandas(scan, "field_ref string, row_key string, n_found int, text string")


def _fields(spark, folder: str) -> DataFrame:
    pick = lambda name, key, text: table(spark, folder, name).select(F.lit(f"{name}.{text}").alias("field_ref"), F.col(key).cast("string").alias("row_key"), F.col(text).alias("text"))
    return pick("hook_log", "entry_id", "command").unionByName(pick("conversation_turns", "turn_id", "user_text")).unionByName(pick("file_diffs", "diff_id", "patch"))


def p2_found(spark, folder: str) -> DataFrame:
    whole = credentials(_fields(spark, folder)).where("kind <> 'cut private key'")
    return whole.select("field_ref", "row_key", "secret_text").distinct()


def p2_redacted(spark, folder: str) -> DataFrame:
    return redact_credentials(_fields(spark, folder))


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted}
SQL: dict[str, str] = {}
