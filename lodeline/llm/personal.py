"""Personal data in free text: proposed by patterns, confirmed by checksums, weighed by the words around."""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.tables import table

#: A span whose score reaches this counts.
THRESHOLD = 0.6

# The words and shapes of each kind.
_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪİĶŁĻŃŇŅŌŐŒŘŚŞŠŤŪŮŰŹŻŽ"
_CAPITAL = rf"[{_UP}][^\W\d_]*(?:[’'-][^\W\d_]+)*"
_PARTICLE = r"(?:von|van|der|den|de|del|della|di|da|dos|la|le|ter|ten|bin|ibn|zu|zum)"
_LAST = rf"(?:(?:{_PARTICLE} )*(?:(?:al|el)-)?{_CAPITAL})"
_FULL = rf"(?:{_CAPITAL}(?: [{_UP}]\.)*(?: {_LAST}){{1,2}}|{_LAST}, {_CAPITAL}(?: [{_UP}]\.)*)"
_CJK_FULL = r"(?:[一-鿿]{2,6}·[一-鿿]{2,6}|[ァ-ヴー]{2,}[・＝ ][ァ-ヴー]{2,})"
_ANY = rf"(?:(?<![A-Za-z0-9À-ž])(?:{_FULL}|{_CJK_FULL}))"

_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+/:-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])")
_DOT = r"(?:\.| ?\[dot\] ?| ?\(dot\) ?| ?\{dot\} ?| dot )"
_AROUND = re.compile(
    rf"(?<![A-Za-z0-9._%+/:-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?: ?(?:\(at\)|\[at\]|\{{at\}}|\(a\)|＠) ?[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}| at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)* dot [A-Za-z]{{2,}})(?![A-Za-z0-9])",
    re.I,
)
_PHONES = (
    (0.7, re.compile(r"(?<![A-Za-z0-9_.+/-])(?:\+|00)[1-9]\d{0,2}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,9}){1,6}(?![A-Za-z0-9_])")),
    (0.65, re.compile(r"(?<![A-Za-z0-9_.+/-])\(\d{2,4}\) ?\d{3,4}[ -]\d{4}(?![A-Za-z0-9_-])")),
    (0.6, re.compile(r"(?<![A-Za-z0-9_.+/-])0\d{1,4}(?:[ /-]\d{2,6}){1,5}(?![A-Za-z0-9_-])")),
    (0.35, re.compile(r"(?<![A-Za-z0-9_.+/-])\d{3}[-. ]\d{3}[-. ]\d{4}(?![A-Za-z0-9_-])")),
)
_PHONE_NEAR = re.compile(r"(?i)(?:\bphone|call|tel\.?|tél|telefon|teléfono|mobile|appelez|rückruf|ruf|llama|fax|whatsapp|电话|電話|전화|телефон|हाल|फ़ोन|هاتف|โทร)\W{0,3}(?:\w+\W+){0,3}$")
_NUMBER_NEAR = re.compile(r"(?i)\b(?:build|ticket|invoice|order|version|took|id|no|sec|ref|issue|pr|column|inc|release|code)\b\W{0,3}(?:\w+\W+)?$")
_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

_STREET_EN = r"(?:Street|St\.|St(?![A-Za-z0-9_])|Avenue|Ave\.|Ave(?![A-Za-z0-9_])|Road|Rd\.|Rd(?![A-Za-z0-9_])|Lane|Ln\.|Drive|Dr\.|Boulevard|Blvd\.?|Court|Ct\.|Close|Way|Place|Square|Terrace|Crescent|Parkway|Row|Hill|Mews)"
_CITY = rf"{_CAPITAL}(?: {_CAPITAL})*"
_UNIT = r"(?:(?:Apt|Apartment|Unit|Suite|Ste|Flat|Room|Rm)\.? ?#?\d+\w?, )"
_AFTER = rf"(?:, (?:\d{{4,5}} {_CITY}|{_CITY} \d{{4,5}}(?![A-Za-z0-9_])))?"
_NO = r"\d{1,4}(?: ?[a-z](?![A-Za-z0-9_]))?"
_ADDRESSES = (
    (0.7, re.compile(rf"(?<![A-Za-z0-9_.]){_UNIT}?\d{{1,5}}[A-Za-z]? (?:[{_UP}][^\W\d_’'-]+[’'-]?\w* ){{1,3}}{_STREET_EN}(?![A-Za-z0-9_])(?:, (?:Apt|Unit|Suite|Flat)\.? ?#?\d+\w?)?{_AFTER}")),
    (0.65, re.compile(rf"(?<![A-Za-z0-9_.]){_UNIT}?(?:[{_UP}]\w+(?:str\.|straße|strasse|gasse|weg|allee|platz|ring|damm|ufer|steig)|[{_UP}]\w+er (?:Straße|Str\.|Allee|Weg|Platz|Gasse|Ring|Damm|Ufer)) {_NO}(?![A-Za-z0-9_]){_AFTER}")),
    (0.3, re.compile(rf"(?<![A-Za-z0-9_.])(?:Am|Im|An der|An den|Auf dem|Auf der|Zum|Zur|In der|In den|Unter den|Hinter dem) {_CAPITAL}(?: {_CAPITAL})? {_NO}(?![A-Za-z0-9_]){_AFTER}")),
    (0.7, re.compile(rf"(?<![A-Za-z0-9_.])(?:Calle|C/|Avenida|Avda?\.|Plaza|Pza\.|Paseo|Pº|Camino|Carrera|Ronda|Travesía|Rua|Via)(?: (?:de|del|la|las|los|el|da|do))* {_CAPITAL}(?: (?:(?:de|del|la|las|los) )*{_CAPITAL})*,? (?:n\.?º ?)?{_NO}(?![A-Za-z0-9_])(?:, \d{{1,2}}\.?º ?\w?)?{_AFTER}")),
    (0.7, re.compile(rf"(?<![A-Za-z0-9_.])\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.|bd|boulevard|impasse|place|quai|chemin|allée|cours|route|passage|square)(?: (?:de|du|des|la|le|les))* (?:de l’|l’|d’|de l'|l'|d')?{_CAPITAL}(?: {_CAPITAL})*{_AFTER}")),
)
_ADDRESS_NEAR = re.compile(r"(?i)(?:live at|address|addr|invoice says|ship|deliver|lieferung|anschrift|adresse|livrez|dirección|domicilio|enviar|地址|送付先|住所|주소|адрес)\W{0,6}(?:\w+\W+){0,4}$")

_TITLE = r"(?:Mr|Mrs|Ms|Mx|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Sra|Sr|Srta|Señora?|Don|Doña|Signora?)"
_NAMES = (
    re.compile(rf"\b(?:reviewer|author|owner|maintainer|contact|colleague|customer|user|tester) (?:was|is) (?P<n>{_ANY})"),
    re.compile(rf"(?P<n>{_ANY})(?= (?:wrote|reported|saw|found|fixed|tested|confirmed|reviewed|asked|approved|hat (?:den|es|das)|l’a |a validé|a signalé|lo (?:probó|pidió|vio)|已经确认|确认|看到)|が(?:確認|見)|さん|様|氏)"),
    re.compile(rf"\b(?:I am|I’m|I'm|[Mm]y name is|[Ii]ch bin|[Ii]ch heiße|[Jj]e suis|[Jj]e m’appelle|[Ss]oy|[Mm]e llamo|[Tt]hanks to|[Tt]hank you,|[Cc]’est|[Rr]eviewed by|[Ff]ound by|[Ww]ritten by|[Aa]pproved by|[Rr]eported by|[Ff]ixed by|kam von|pidió|ask|asked|from|by) (?P<n>{_ANY})"),
    re.compile(rf"\b(?:Signed-off-by|Co-authored-by|Reported-by|Reviewed-by|Acked-by|Tested-by|Suggested-by|Author|Committer|From|To|Cc|Name|Reviewer): (?P<n>{_ANY})(?= ?<|\s*$)", re.M),
    re.compile(rf"\"(?:full_?name|fullName|name|author|owner|contact_name)\" ?: ?\"(?P<n>{_ANY})\""),
    re.compile(rf"\| ?(?P<n>{_ANY}) ?(?=\| ?[(+\d])"),
    re.compile(rf"(?P<n>{_ANY})(?= \([+\d(][\d ()./+-]{{6,}}\))"),
    re.compile(rf"(?P<n>{_ANY})(?= ?<[^<>\s]{{1,64}} ?(?:@|\(at\)|\[at\]))"),
    re.compile(rf"\b{_TITLE}\.? (?P<n>{_FULL}|{_LAST})"),
    re.compile(rf"(?<![^\W\d_] )\bM\. (?P<n>{_FULL}|{_LAST})(?= (?:l’a|a |qui|est))"),
    re.compile(rf"(?P<n>{_LAST}|[ァ-ヴー]{{2,}}|[一-鿿]{{2,4}})(?=(?: ?(?:さん|様)|氏(?:が|は)))"),
    re.compile(rf"(?P<n>{_LAST})(?= ?(?:先生|女士|小姐|님|씨))"),
)
_TITLED = re.compile(rf"{_TITLE}\.? ")
#: Capitalised words of prose that begin no name.
_NO_NAME = re.compile(r"(?:The|A|An|This|That|These|It|If|When|On|In|At|After|Before|Once|During|Under|Our|My|Please|Der|Die|Das|Ein|Eine|La|Le|Les|El|Los|Las|Un|Une|Q|I|Signed|Reported|Hook|Cursor|Index|Lock|Budget|Log|Error|Timeout|Overflow)\b")
#: Those of them that are no name behind a title either.
_NO_NAME_TITLED = re.compile(_NO_NAME.pattern.replace("|Hook|Cursor|Index|Lock|Budget|Log|Error|Timeout|Overflow", ""))
_BEHIND_TITLE = re.compile(rf"(?<![^\W\d_]){_TITLE}\.? \Z")


#: Given names of many places that are no other words.
GIVEN = frozenset(
    """Adam Ahmed Aisha Alejandro Alice Amina Ana Andrea Andrew Anna Anne Antonio Arjun Barbara Beatriz Benjamin Carlos Carmen Catherine Charlotte Chiara Chloe
    Christine Christopher Claire Claudia Cristina Daniel David Deborah Diego Dmitri Edward Elena Elizabeth Emily Emma Enrique Eric Fatima Felix Fernando Fiona
    Francesca Francisco Franz Friedrich Gabriel Giovanni Giulia Gonzalo Guillaume Hannah Hans Hassan Heinrich Helen Henry Hiroshi Ibrahim Ines Ingrid Isabel
    Ivan Jacob James Jan Jane Javier Jean Jennifer Jessica Joanna Johann Johanna John Jonas Jonathan Jorge Joseph Juan Julia Jürgen Karen Katarzyna Katharina
    Kenji Khalid Klaus Laura Lars Layla Leila Leonardo Linda Lucas Lucia Luis Lukas Magdalena Manuel Marco Margaret Maria María Marie Mariana Mario Marta Martin
    Mary Matthew Mehmet Michael Miguel Mohammed Monika Mustafa Nadia Natalia Nicholas Nicolas Nikolai Nina Olga Olivia Omar Pablo Patricia Paul Pedro Peter
    Philippe Pierre Priya Rachel Rafael Raj Rebecca Renate Ricardo Richard Robert Roberto Rosa Sabine Samuel Sandra Sanjay Sara Sarah Sergei Simon Sofia Sophie
    Stefan Stephanie Steven Susan Svetlana Takashi Tatiana Teresa Thomas Timothy Ursula Valentina Victoria Vladimir Wei William Yuki Yusuf Zeynep""".split()
)
_TWO_CAPITALS = re.compile(rf"(?<![^\W_])(?=[{_UP}])([^\W\d_]+)(?= [{_UP}])")
_FULL_NAME = re.compile(_FULL)
_PERSON_BEFORE = re.compile(r"(?:^|\s)(?:to|with|from|by|and|for|tell|told|ask|asked|met|meet|call|called|email|emailed|invite|mit|von|an|und|für|avec|de|par|à|et|con|por|y|para) $")
_PERSON_AFTER = re.compile(r",? (?:who|joined|said|says|spoke|agreed|left|called|emailed|lives|works|worked|suggested|noted|thinks|wants|sagte|meinte|arbeitet|a dit|travaille|dijo|trabaja)\b")


def _people(text: str):
    """(score, start, end) of two and three capitalised words by what speaks for a person: a given name, words before and after."""
    until = 0
    for t in _TWO_CAPITALS.finditer(text):
        if t.start() < until or _NO_NAME.match(t[0]) or not (m := _FULL_NAME.match(text, t.start())):
            continue
        score = 0.3 + 0.4 * (t[1] in GIVEN)
        score += 0.2 * bool(_PERSON_BEFORE.search(text, max(0, t.start() - 10), t.start())) + 0.25 * bool(_PERSON_AFTER.match(text, m.end()))
        if score >= THRESHOLD:
            until = m.end()
            yield score, m.start(), m.end()


_LONE = re.compile(rf"[{_UP}] ")


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


def mod97(text: str) -> bool:
    """International bank account numbers: letters count as 10 to 35, the first four characters stand last."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _cpf(digits: str) -> bool:
    check = lambda n: (sum(int(c) * (n + 1 - i) for i, c in enumerate(digits[:n])) * 10) % 11 % 10 == int(digits[n])
    return len(set(digits)) > 1 and check(9) and check(10)


def _nir(digits: str) -> bool:
    return 97 - int(digits[:13]) % 97 == int(digits[13:])


def _chinese(text: str) -> bool:
    weights = [2 ** (17 - i) % 11 for i in range(17)]
    return "10X98765432"[sum(int(c) * w for c, w in zip(text, weights, strict=False)) % 11] == text[17]


_digits = lambda t: re.sub(r"\D", "", t)
#: pattern, score without a valid checksum, check, words that raise the score
_IDS = (
    (re.compile(r"(?<![A-Za-z0-9_.-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9_-])"), 0.2, None, r"SSN|social security"),
    (re.compile(r"(?<![A-Za-z0-9_.-])\d{3}\.\d{3}\.\d{3}-\d{2}(?![A-Za-z0-9_-])"), 0.3, lambda t: _cpf(_digits(t)), r"CPF"),
    (re.compile(r"(?<![A-Za-z0-9_.-])(?:\d{8}|[XYZ]-?\d{7})-?[A-Z](?![A-Za-z0-9_-])"), 0.1, lambda t: _LETTERS[int(_digits(t.translate(str.maketrans("XYZ", "012"), ) if t[0] in "XYZ" else t)) % 23] == t[-1], r"DNI|NIE|NIF"),
    (re.compile(r"(?<![A-Za-z0-9_.-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![A-Za-z0-9_-])"), 0.5, None, r"National Insurance|NINO|NI no"),
    (re.compile(r"(?<![A-Za-z0-9_.-])[12] ?\d{2} ?(?:0[1-9]|1[0-2]|[2-9]\d) ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3} ?\d{2}(?![A-Za-z0-9_-])"), 0.2, lambda t: _digits(t).isdigit() and len(_digits(t)) == 15 and _nir(_digits(t)), r"sécurité sociale|NIR|INSEE"),
    (re.compile(r"(?<![A-Za-z0-9_.-])(?=[A-Z0-9]*\d)[A-Z0-9]{8,9}(?![A-Za-z0-9_-])"), 0.1, None, r"passport|Reisepass|Pass-?Nr|passeport|pasaporte|护照|パスポート"),
    (re.compile(r"(?<![A-Za-z0-9_.-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9_-])"), 0.1, lambda t: 15 <= len(t.replace(" ", "")) <= 34 and mod97(t.replace(" ", "")), r"IBAN"),
    (re.compile(r"(?<![A-Za-z0-9_.-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![A-Za-z0-9_-])"), -0.4, lambda t: luhn(_digits(t)), r"card|Karte|carte|tarjeta|visa|mastercard|卡"),
    (re.compile(r"(?<![A-Za-z0-9_.-])[1-9]\d{5}(?:19|20)\d{9}[\dX](?![A-Za-z0-9_-])"), 0.0, lambda t: _chinese(t), r"身份证"),
)
_IDS = tuple((pattern, score, check, re.compile(words, re.I)) for pattern, score, check, words in _IDS)


def _in_address_of_program(text: str, start: int) -> bool:
    """Within a URL, or a user at a machine named for a program."""
    word = text.rfind(" ", 0, start) + 1
    word = max(word, text.rfind("\n", 0, start) + 1)
    return "://" in text[word:start] or bool(re.search(r"(?:ssh|scp|sftp|rsync|clone)(?: -\S+)* $", text[max(0, start - 30) : start]))


def spans(text: str) -> list[tuple[int, int, str]]:
    """The disjoint (start, end, kind) of the personal data of a text, in order."""
    found: list[tuple[float, int, int, str]] = []
    if "@" in text or "at" in text.lower() or "＠" in text or "(a)" in text:
        for pattern in (_EMAIL, _AROUND):
            for m in pattern.finditer(text):
                after = text[m.end() : m.end() + 2]
                repository = re.match(r"[:/]\S", after) is not None or m[0].lower().startswith("git@")
                if not repository and not _in_address_of_program(text, m.start()):
                    found.append((1.0, *m.span(), "email"))
    if re.search(r"\d", text):
        for score, pattern in _PHONES:
            for m in pattern.finditer(text):
                digits, before = len(_digits(m[0])), text[max(0, m.start() - 40) : m.start()]
                if not 9 <= digits <= 15:
                    continue
                total = score + 0.3 * bool(_PHONE_NEAR.search(before)) - 0.5 * bool(_NUMBER_NEAR.search(before) and not _PHONE_NEAR.search(before))
                if total >= THRESHOLD:
                    found.append((total, *m.span(), "phone"))
        for pattern, score, check, words in _IDS:
            for m in pattern.finditer(text):
                near = text[max(0, m.start() - 35) : m.start()] + " " + text[m.end() : m.end() + 35]
                valid = check is not None and check(m[0])
                total = score + 0.6 * valid + 0.6 * bool(words.search(near)) - 0.5 * bool(_NUMBER_NEAR.search(text[max(0, m.start() - 16) : m.start()]) and not words.search(near))
                if total >= THRESHOLD or (total >= 0.5 and score == 0.5):
                    found.append((1 + total, *m.span(), "id_number"))
        for score, pattern in _ADDRESSES:
            for m in pattern.finditer(text):
                if score + 0.4 * bool(_ADDRESS_NEAR.search(text[max(0, m.start() - 40) : m.start()])) >= THRESHOLD:
                    found.append((0.9, *m.span(), "address"))
    for pattern in _NAMES:
        for m in pattern.finditer(text):
            start, end = m.span("n")
            if title := _TITLED.match(text, start, end):
                start = title.end()
            no_name = _NO_NAME_TITLED if title or _BEHIND_TITLE.search(text, max(0, start - 12), start) else _NO_NAME
            # words of prose, and a lone letter, that happen to stand before a name
            while (skipped := no_name.match(text, start, end) or _LONE.match(text, start, end)) and (after := text.find(" ", skipped.start(), end)) > 0 and " " in text[after + 1 : end]:
                start = after + 1
            if not no_name.match(text, start, end):
                found.append((0.8, start, end, "name"))
    found += [(0.5, a, b, "name") for _, a, b in _people(text)]
    found.sort(key=lambda f: (-f[0], f[1] - f[2], f[1]))
    # Kept spans are disjoint, so a span can only meet the one before it and the one after it.
    kept: list[tuple[int, int, str]] = []
    for _, a, b, kind in found:
        i = bisect.bisect_left(kept, (a,))
        if (i == 0 or kept[i - 1][1] <= a) and (i == len(kept) or kept[i][0] >= b):
            kept.insert(i, (a, b, kind))
    return kept


def replaced(text: str, found: list[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced by the placeholder of its kind."""
    parts, at = [], 0
    for a, b, kind in found:
        parts += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*parts, text[at:]])


def personal_data(fields: DataFrame) -> DataFrame:
    """(field_ref, row_key, pii_kind, pii_text, start_pos, end_pos) of all personal data in ``fields`` (field_ref, row_key, text).

    Whole texts, each by itself; nothing is shuffled but the few rows found. Null and empty texts hold
    nothing; repeated rows give their spans once; other columns aren't read.
    """

    def scan(frames):
        for frame in frames:
            rows = [
                (ref, key, kind, t[a:b], a, b)
                for ref, key, t in zip(frame["field_ref"], frame["row_key"], frame["text"], strict=True)
                for a, b, kind in spans(t)
            ]
            yield pd.DataFrame(rows, columns=["field_ref", "row_key", "pii_kind", "pii_text", "start_pos", "end_pos"])

    kinds = "field_ref string, row_key string, pii_kind string, pii_text string, start_pos bigint, end_pos bigint"
    return fields.select("field_ref", F.col("row_key").cast("string").alias("row_key"), "text").where("text <> ''").mapInPandas(scan, kinds).distinct()


def mask_personal_data(fields: DataFrame) -> DataFrame:
    """(field_ref, row_key, n_found, text): every row of ``fields`` with its personal data replaced; null texts stay null."""

    def scan(frames):
        for frame in frames:
            found = [spans(t) if t else [] for t in frame["text"]]
            out = frame.assign(n_found=[len(f) for f in found])
            out["text"] = [replaced(t, f) if t else t for t, f in zip(frame["text"], found, strict=True)]
            yield out[["field_ref", "row_key", "n_found", "text"]]

    return fields.select("field_ref", F.col("row_key").cast("string").alias("row_key"), "text").mapInPandas(scan, "field_ref string, row_key string, n_found int, text string")


def _fields(spark, folder: str) -> DataFrame:
    pick = lambda name, key, text: table(spark, folder, name).select(F.lit(f"{name}.{text}").alias("field_ref"), F.col(key).cast("string").alias("row_key"), F.col(text).alias("text"))
    turns = pick("conversation_turns", "turn_id", "user_text").unionByName(pick("conversation_turns", "turn_id", "assistant_text"))
    return turns.unionByName(pick("nodes", "node_id", "body"))


def p4_found(spark, folder: str) -> DataFrame:
    return personal_data(_fields(spark, folder)).select("field_ref", "row_key", "pii_kind", "pii_text").distinct()


def p4_masked(spark, folder: str) -> DataFrame:
    return mask_personal_data(_fields(spark, folder))


QUERIES = {"p4_found": p4_found, "p4_masked": p4_masked}
SQL: dict[str, str] = {}
