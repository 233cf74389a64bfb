"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, URL schemes,
digits, and cue words of identifiers, secrets, streets and phones.  At each
anchor a small deterministic parser reads the characters around it, decides
where the item begins and ends and validates it:

    EMAIL    local part to the left, host labels to the right of an at-sign, letters of any script
    URL      after a scheme: host and path; taken only with user info, an IP host or an e-mail in it
    IP       four numbers up to 255; eight groups of hexadecimal digits, or fewer around '::'
    PHONE    '+' or parentheses, or a cue word, also with "number", "no", "is" and the like after it; 7 to 15 digits
             in groups; without these ddd-ddd-dddd, with blanks only where both codes begin with 2 to 9
    ACCOUNT  13 to 19 digits with a right check digit or after "card", or 16 without a gap (the tables' card numbers
             have no check digit); an IBAN with a right remainder; or letters and digits after a cue such as
             "account", "iban", "ssn", as far as words with a digit go; up to three words without one may stand between
    SSN      ddd-dd-dddd outside the ranges never given out
    SECRET   the value after a cue such as "token", "password", "api_key" and '=' or ':', or after "bearer"
    ADDRESS  house number, capitalised words and a street word; number, "rue" or the like and a name; a name in
             -straße, -weg and the like and a number; "Calle" or the like, a name and a number

Cues and the words that join them to a value are read in any case.

Overlaps: the earliest start stays, of equal starts the longest.  An item is
replaced by its kind in angle brackets; a secret's cue and quotes stay.  The
scan is one pass without a shuffle.

Defined cases: a null text stays null and an empty one empty, both with no
item; very long texts are read whole, and so is an item, however long; a null id
passes through and ids keep their type; repeated rows are treated alike, each
for itself; a text column that isn't there is an error, one in another case is
found as Spark finds it; other columns of a stage's input pass through,
``n_chars`` is counted anew where there is one; an empty table gives an empty
result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillmill.llm.shared import read_table, resolved, type_of

SECRET_CUES = ("token", "secret", "password", "passwd", "pwd", "api_key", "api-key", "apikey", "access_key", "private_key", "secret_key", "api key", "access key", "private key", "secret key", "client_secret")
ACCOUNT_CUES = ("account", "acct", "acct.", "iban", "ssn", "passport", "konto", "cuenta", "compte", "licence no", "licence no.", "license no", "license no.", "customer no", "customer no.", "member id", "national id", "tax id", "bsb")
PHONE_CUES = ("phone", "tel", "mobile", "fax", "call", "telephone", "telefax", "telefon", "téléphone", "teléfono", "cell", "cellphone", "cellular", "mob", "hotline", "whatsapp")
STREETS = ("Street", "Avenue", "Road", "Lane", "Boulevard", "Drive", "Court", "Square", "Terrace", "Highway", "Parade", "Crescent", "Place", "Way", "St", "Ave", "Rd", "Ln", "Blvd", "Dr", "Ct")

#: Endings of German street names and first words of Spanish ones, as anchors.
ROADS = ("straße", "strasse", "str.", "weg", "platz", "allee", "gasse")
CALLES = ("calle", "c/", "avenida", "avda", "paseo", "plaza de")

_LOCAL = set(".!#$%&'*+/=?^_`{|}~-")
_HOST = re.compile(r"(?:[^\W_](?:[^\W_]|-)*\.)+(?:xn--[A-Za-z0-9-]+|[^\W\d_]{2,})(?![^\W_])")
_IPV4 = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?![\d.]*\d)")
_IPV6 = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?")
_PLAIN = re.compile(r"\d{13,19}(?![\d\w])")
_GROUPED = re.compile(r"\d{4}(?:([ -])\d{4}\1\d{4}\1\d{1,7}|([ -])\d{6}\2\d{4,5})(?![\d\w])")
_SSN = re.compile(r"(\d{3})-(\d{2})-(\d{4})(?![\d-])")
#: Blanks may come before other signs between the groups, but not after them unless the number is short.
_PHONE = re.compile(r"(?:\+\d{1,3}[ ./-]?)?(?:\(\d{1,5}\)[ ./-]?)?\d+(?: \d{2,})*(?:[./-]\d{2,})*")
_PHONE_MORE = re.compile(r"(?:[ ./-]\d{2,5})+(?!\d)")
_PHONE_GAP = re.compile(r"[\s.:#]*(?:(?:number|num|no|nr|id|is)\b[\s.:#]*){0,3}", re.I)
_URL_END = re.compile(r"[^\s<>\"'|]+")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{2,4}){3,8}(?![A-Za-z0-9])")
#: Between an account cue and its value: connecting words, and up to three other words without a digit on the same line.
_CUE_GAP = re.compile(r"[\s:=#]*(?:(?:number|num|no|nr|id)\b\.?[\s:=#]*|[^\W\d_]+(?:[^\S\n]*[:=#][^\S\n]*|[^\S\n]+)){0,3}", re.I)
_CUE_VALUE = re.compile(r"[A-Za-z0-9-]*\d[A-Za-z0-9-]*(?: [A-Za-z0-9-]*\d[A-Za-z0-9-]*)*")
_SECRET_VALUE = re.compile(r"[\"']?\s*[:=]\s*(?:Bearer\s+)?([\"']?)([^\s\"'<>]{6,})\1")
_BEARER_VALUE = re.compile(r"[\"']?\s*[:=]?\s*[\"']?((?=[^\s\"'<>]*\d)[\w.~+/=-]{16,})")
_STREET = re.compile(r"\d{1,5}[A-Za-z]?(?:[-/]\d{1,5})?(?:[^\n\S]+[A-Z][\w'’.-]*)+?[^\n\S]+(?:" + "|".join(STREETS) + r")\b\.?")
_SMALL = r"(?:(?:de|du|des|del|la|le|les|las|los|el|et|y|aux?)[^\n\S]+|[ld]['’])"
_RUE = re.compile(r"\d{1,4}(?:[^\n\S]?(?:bis|ter))?,?[^\n\S]+(?i:rue|avenue|boulevard|place|allée|chemin|impasse|quai|cours|route)[^\n\S]+" + _SMALL + r"*[^\W\d_a-zß-öø-ÿ][\w'’-]*(?:[^\n\S]+" + _SMALL + r"*[^\W\d_a-zß-öø-ÿ][\w'’-]*)*")
_CALLE = re.compile(r"\.?(?:[^\n\S]+" + _SMALL + r"*[^\W\d_a-zß-öø-ÿ][\w'’-]*)+")
_NUMBER_AFTER = re.compile(r",?[^\n\S]+(?:n[.º°]{0,2}[^\n\S]*)?\d{1,3}(?:[^\n\S]?[A-Za-z])?(?![\w])(?![.,]?\d)")
_NATIONAL = re.compile(r"(\d{3})([ .-])(\d{3})\2\d{4}(?![\d-])")
_CARD = re.compile(r"card(?:\s+(?:number|num|no|nr|is)\b)*[\s.:#]*$", re.I)

_automaton = None


def automaton():
    """One a worker, for lower-case text; the value is the parser's name and the anchor's length."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for kind, words in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES), ("phone", PHONE_CUES), ("bearer", ("bearer",)), ("road", ROADS), ("calle", CALLES)):
            for w in words:
                a.add_word(w, (kind, len(w)))
        for d in "0123456789":
            a.add_word(d, ("digit", 1))
        a.add_word("@", ("at", 1))
        a.add_word("://", ("scheme", 3))
        a.add_word("::", ("colons", 2))
        a.make_automaton()
        _automaton = a
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def parse_email(t: str, at: int):
    a = at
    while a > 0 and (t[a - 1].isalnum() or t[a - 1] in _LOCAL):
        a -= 1
    while a < at and t[a] in _LOCAL and t[a] != "_":
        a += 1
    if a == at or t[at - 1] == "." or ".." in t[a:at]:
        return None
    m = _HOST.match(t, at + 1)
    return (a, m.end(), "EMAIL") if m else None


def parse_url(t: str, at: int):
    a = at
    while a > 0 and (t[a - 1].isascii() and (t[a - 1].isalnum() or t[a - 1] in "+.-")):
        a -= 1
    if a == at or not t[a].isalpha():
        return None
    m = _URL_END.match(t, at + 3)
    if not m:
        return None
    end = m.end()
    while end > at + 3 and t[end - 1] in ".,;:!?)]}":
        end -= 1
    body = t[at + 3 : end]
    host = re.split(r"[/?#]", body, maxsplit=1)[0]
    private = "@" in body or _ipv4(host, 0) is not None or "%40" in body
    return (a, end, "URL") if private and host else None


def _ipv4(t: str, at: int):
    m = _IPV4.match(t, at)
    return m if m and all(int(g) <= 255 for g in m.groups()) else None


def _phone(t: str, at: int) -> int:
    """Where a telephone number of 7 to 15 digits that begins at ``at`` ends, at the end of a group, or 0."""
    m = _PHONE.match(t, at)
    if not m:
        return 0
    end, digits = m.end(), sum(c.isdigit() for c in m[0])
    if digits < 10 and (more := _PHONE_MORE.match(t, end)) and digits + sum(c.isdigit() for c in more[0]) <= 15:
        end, digits = more.end(), digits + sum(c.isdigit() for c in more[0])
    while digits > 15:
        last = max(t.rfind(c, at, end) for c in " ./-)")
        if last < at:
            return 0
        digits -= sum(c.isdigit() for c in t[last:end])
        end = last
    return end if digits >= 7 else 0


def parse_digits(t: str, at: int):
    """The item that a number at ``at`` begins (``at`` is the first digit of its run)."""
    before = t[at - 1] if at else ""
    glued = before.isalnum() or before == "_"
    if not glued and before != ".":
        m = _ipv4(t, at)
        if m:
            return at, m.end(), "IP"
        m = _SSN.match(t, at)
        if m and before != "-" and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            return at, m.end(), "SSN"
    if not glued:
        m = _PLAIN.match(t, at) or _GROUPED.match(t, at)
        if m:
            d = re.sub(r"[ -]", "", m[0])
            if 13 <= len(d) <= 19 and (luhn(d) or len(d) == 16 and d == m[0] or _CARD.search(t[max(0, at - 32) : at])):
                return at, m.end(), "ACCOUNT"
    # telephone: a plus or an opening parenthesis before the digits
    a = at
    if before == "(":
        a = at - 1
        if a and t[a - 1] in " .-" and a > 1 and t[a - 2].isdigit():
            a = at  # the country code's own anchor sees to it
    if before == "+":
        a = at - 1
    if a < at:
        if end := _phone(t, a):
            return a, end, "PHONE"
    if not glued and before not in ("-", "."):
        m = _NATIONAL.match(t, at)
        if m and (m[2] != " " or m[1] > "2" and m[3] > "2"):
            return at, m.end(), "PHONE"
        m = _STREET.match(t, at) or _RUE.match(t, at)
        if m:
            return at, m.end(), "ADDRESS"
        m = _IPV6.match(t, at)
        if m and m[0].count(":") >= 2 and not t[m.end() : m.end() + 1].isalnum():
            return at, m.end(), "IP"
    return None


def parse_colons(t: str, at: int):
    a = at
    while a > 0 and at - a < 30 and (t[a - 1] in "0123456789abcdefABCDEF:"):
        a -= 1
    if a and t[a - 1].isalnum():
        return None
    m = _IPV6.match(t, a)
    return (a, m.end(), "IP") if m and m.end() > at + 2 and m[0] != "::" and any(c.isdigit() for c in m[0]) and not t[m.end() : m.end() + 1].isalnum() else None


def parse_secret(t: str, end: int, start: int):
    if start and (t[start - 1].isalnum()):
        return None
    m = _SECRET_VALUE.match(t, end)
    if not m:
        return None
    value = m[2]
    stop = m.end(2)
    if not m[1]:
        while stop > m.start(2) and t[stop - 1] in ".,;:!?)":
            stop -= 1
        value = t[m.start(2) : stop]
    if len(value) < 6 or not any(c.isdigit() or not c.isalnum() for c in value) and not m[1]:
        return None
    return m.start(2), stop, "SECRET"


def parse_account(t: str, end: int, start: int):
    if start and t[start - 1].isalnum() or t[end : end + 1].isalpha():
        return None
    m = _CUE_VALUE.match(t, _CUE_GAP.match(t, end).end())
    if not m:
        return None
    value = m[0].strip("-")
    if sum(c.isdigit() for c in value) < 4 or len(value) < 6:
        return None
    begin = m.start() + len(m[0]) - len(m[0].lstrip("-"))
    return begin, begin + len(value), "ACCOUNT"


def parse_bearer(t: str, end: int, start: int):
    m = None if start and t[start - 1].isalnum() else _BEARER_VALUE.match(t, end)
    return (m.start(1), m.end(1), "SECRET") if m and m.start(1) > end else None


def parse_road(t: str, end: int, start: int):
    """A German street: the word that ends here, or it and the one before, begins with a capital; a house number follows."""
    m = _NUMBER_AFTER.match(t, end)
    if not m:
        return None
    a = start
    while a and (t[a - 1].isalnum() or t[a - 1] in "-'’."):
        a -= 1
    if a == start:
        b = a
        while b and t[b - 1] in " \t":
            b -= 1
        c = b
        while c and (t[c - 1].isalnum() or t[c - 1] in "-'’."):
            c -= 1
        if b == a or c == b or not t[a].isupper():
            return None
        a = c
    return (a, m.end(), "ADDRESS") if t[a].isupper() else None


def parse_calle(t: str, end: int, start: int):
    """A Spanish street; where none is found, how far was read."""
    if start and t[start - 1].isalnum() or not t[start].isupper():
        return None
    m = _CALLE.match(t, end)
    if not m:
        return None
    n = _NUMBER_AFTER.match(t, m.end())
    return (start, n.end(), "ADDRESS") if n else m.end()


def parse_phone(t: str, end: int, start: int):
    if start and t[start - 1].isalnum() or t[end : end + 1].isalpha():
        return None
    m = _PHONE_GAP.match(t, end)
    stop = _phone(t, m.end())
    return (m.end(), stop, "PHONE") if stop else None


def iban_at(t: str, at: int):
    """Two capitals before the digit at ``at``."""
    a = at - 2
    if a < 0 or not (t[a].isascii() and t[at - 1].isascii() and t[a].isupper() and t[at - 1].isupper()) or (a and t[a - 1].isalnum()):
        return None
    m = _IBAN.match(t, a)
    if not m:
        return None
    body = m[0]
    while len(body) >= 15:
        if iban_ok(body):
            return a, a + len(body), "ACCOUNT"
        cut = body.rstrip()
        body = cut[: cut.rfind(" ")] if " " in cut else ""
    return None


def lower(t: str) -> str:
    """Lower case, each character at its own place."""
    low = t.lower()
    return low if len(low) == len(t) else "".join(x if len(x := c.lower()) == 1 else c for c in t)


def find_items(t: str) -> list[tuple[int, int, str]]:
    """Items as (start, end, kind), ordered and without overlaps."""
    if not t:
        return []
    found = []
    digits_to = read_to = secret_to = -1
    for last, (kind, size) in automaton().iter(lower(t)):
        start = last - size + 1
        if kind == "digit":
            if start <= digits_to:
                digits_to = start + 1 if start == digits_to else digits_to
                continue
            digits_to = start + 1
            item = iban_at(t, start) or parse_digits(t, start)
        elif kind == "at":
            item = parse_email(t, start)
        elif kind == "scheme":
            item = parse_url(t, start)
        elif kind == "colons":
            item = parse_colons(t, start)
        elif kind == "secret":
            item = parse_secret(t, last + 1, start) if start >= secret_to else None
            secret_to = item[1] if item else secret_to
        elif kind == "account":
            item = parse_account(t, last + 1, start)
        elif kind == "bearer":
            item = parse_bearer(t, last + 1, start)
        elif kind == "road":
            item = parse_road(t, last + 1, start)
        elif kind == "calle":
            # names that an earlier anchor read in vain have no number for this one either
            item = parse_calle(t, last + 1, start) if start >= read_to else None
            if isinstance(item, int):
                item, read_to = None, item
        else:
            item = parse_phone(t, last + 1, start)
        if item:
            found.append(item)
    if len(found) > 1:
        found.sort(key=lambda x: (x[0], -x[1]))
        out, end = [], -1
        for x in found:
            if x[0] >= end:
                out.append(x)
                end = x[1]
        found = out
    return found


def redact(t: str, items) -> str:
    out, at = [], 0
    for a, b, kind in items:
        out += [t[at:a], f"<{kind}>"]
        at = b
    return "".join([*out, t[at:]])


_ITEMS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_items, items, text): the redacted text of every row and where its items stood in the original."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            items = [find_items(t) for t in texts]
            clean = [redact(t, x) if x else t for t, x in zip(texts, items)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in items], pa.int32()), pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in x] for x in items], _ITEMS), pa.array(clean, pa.string())],
                names=["doc_id", "n_items", "items", "text"],
            )

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {type_of(src, 'doc_id')}, n_items int, items array<struct<start:int,end:int,kind:string>>, text string")


def redact_private(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """The same rows with redacted texts and, where there is such a column, new character counts."""

    k = docs.columns.index(resolved(docs, text_col))
    counts = [i for i, c in enumerate(docs.columns) if c.lower() == count_col.lower()]

    def run(batches):
        for batch in batches:
            texts = batch.column(k).to_pylist()
            clean = [redact(t, x) if t and (x := find_items(t)) else t for t in texts]
            cols = [*batch.columns]
            cols[k] = pa.array(clean, batch.schema.field(k).type)
            for c in counts[:1]:
                old = batch.column(c).to_pylist()
                cols[c] = pa.array([o if a is b else len(b) for o, a, b in zip(old, texts, clean)], batch.schema.field(c).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


QUERIES = {"op9_pii_anchors": lambda spark, sf_dir: find_private(read_table(spark, sf_dir, "documents"))}
ORACLE: dict[str, str] = {}
