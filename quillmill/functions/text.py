"""Text expressions: normalisation, coverage, weak signals, edit distance, markdown.

All of them are Column expressions that stay inside Catalyst but the two at
the end, which need Unicode normal forms or a word-level distance.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, StringType

#: What Python's strip() removes; Spark's trim() knows blanks only.
SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
MARKS = "*x_#=-"
_RUN = r"([-=#_x*])\1\1+"
_SEGMENT = r"[-=#_x*]{2,}"
_PLAIN = r"[^\p{L}\p{N} \n\t.,:;?!'\"/()-]"

# a page footer "12 | P a g e" as scanners garble it: each letter with its look-alikes
_P, _A, _G, _E = "[FP]'?", "[20&a]", "[<328&g]", r"[\dF?P€&e]"
FOOTER = rf"(?md)^\s*\d+\s*[&|]\s*{_P}\s*{_A}\s*{_G}\s*{_E}\s*$"
FOOTER_TWO_LINES = rf"(?md)^\s*\d{{1,2}}\s*[&|]?\s*$\n\s*{_P}\s+{_A}\s+{_G}\s*{_E}?\s*$"
SCHEME = r"(?U)http(?!://)[_IlL/.:\s]+(?=[Ww])"
_QUOTED = [(q + gap + sign, q + "s") for q, gap, sign in (("’", " ", "$"), ("’", "", "$"), ("'", " ", "$"), ("'", "", "$"), ("’", "", "€"), ("'", "", "€"))]


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, "")


def normalise_text(c: Column) -> Column:
    """Repair apostrophe-s, URL schemes and page footers, in this order."""
    for bad, good in _QUOTED:
        c = F.replace(c, F.lit(bad), F.lit(good))
    c = F.regexp_replace(c, SCHEME, "http://")
    return F.regexp_replace(F.regexp_replace(c, FOOTER, ""), FOOTER_TWO_LINES, "")


def full_text(pages: Column) -> Column:
    """Page texts that aren't empty, a blank line between them. ``pages``: array of structs with ``text``."""
    return F.array_join(F.transform(F.filter(pages, lambda p: p["text"] != ""), lambda p: p["text"]), "\n\n")


def text_coverage(pages: Column, least: int = 50) -> Column:
    """Share of pages whose stripped text is longer than ``least``; 0 without pages."""
    n = F.size(pages)
    return F.when(n > 0, F.size(F.filter(pages, lambda p: F.length(strip(p["text"])) > least)) / n).otherwise(F.lit(0.0))


def normalise_pages(pages: Column) -> Column:
    """Each page with its text repaired; blank pages stay as they are."""
    return F.transform(pages, lambda p: p.withField("text", F.when(strip(p["text"]) == "", p["text"]).otherwise(normalise_text(p["text"]))))


def blank_page_warnings(pages: Column, method: Column) -> Column:
    blank = F.filter(pages, lambda p: strip(p["text"]) == "")
    return F.transform(blank, lambda p: F.concat(F.lit("blank page "), p["page_number"].cast("string"), F.lit(" (method="), method, F.lit(")")))


def garbled_ratio(c: Column) -> Column:
    """Share of odd characters once runs of a redaction mark are taken out."""
    clean = F.regexp_replace(c, _RUN, "")
    n = F.length(clean)
    return F.when(n > 0, (n - F.length(F.regexp_replace(clean, _PLAIN, ""))) / n).otherwise(F.lit(0.0))


def is_valid_redaction(c: Column) -> Column:
    return c.rlike("^" + _RUN + "$")


def garbled_redaction_ratio(c: Column) -> Column:
    """Share of mark segments that aren't one mark three times or more."""
    found = F.regexp_extract_all(c, F.lit(_SEGMENT), F.lit(0))
    n = F.size(found)
    return F.when(n > 0, F.size(F.filter(found, lambda s: ~is_valid_redaction(s))) / n).otherwise(F.lit(0.0))


def weak_signals(text: Column, confidence: Column | None = None, page_count: Column | None = None, least_confidence: float = 0.7, most_garbled: float = 0.3, most_redaction: float = 0.05, most_pages: int = 200) -> Column:
    """Names of the signals that a row shows, in a fixed order."""
    tests = []
    if confidence is not None:
        tests.append(F.when(confidence < least_confidence, F.lit("low_confidence")))
    if page_count is not None:
        tests.append(F.when((page_count == 0) | (page_count > most_pages), F.lit("page_count_anomaly")))
    some = F.coalesce(text, F.lit("")) != ""
    tests.append(F.when(some & (garbled_ratio(text) > most_garbled), F.lit("garbled_text")))
    tests.append(F.when(some & (garbled_redaction_ratio(text) > most_redaction), F.lit("redaction_garbled")))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def table_to_markdown(headers: Column, rows: Column) -> Column:
    """A pipe table; rows are cut or filled to the headers' width; '' without rows and headers."""
    width = F.when(F.size(headers) > 0, F.size(headers)).otherwise(F.coalesce(F.size(F.try_element_at(rows, F.lit(1))), F.lit(0)))
    heads = F.when(F.size(headers) > 0, headers).otherwise(F.array_repeat(F.lit(""), width))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda x: F.coalesce(x, F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.transform(rows, lambda r: line(F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width)))
    empty = (F.size(headers) <= 0) & (F.size(rows) <= 0)
    return F.when(empty, F.lit("")).otherwise(F.array_join(F.concat(F.array(line(heads), rule), body), "\n"))


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over the reference's length; an empty reference gives 0 or 1."""
    n = F.length(reference)
    return F.when(n > 0, F.levenshtein(reference, hypothesis) / n).otherwise(F.when(F.length(hypothesis) > 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def decode_span(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def spans_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def span_contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_start) & (b_end <= a_end)


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def variation_score(c: Column, low: float = 0.1, span: float = 0.4) -> Column:
    """1 for an even quantity, 0 for a scattered one, by its coefficient of variation."""
    return clamp01(1 - (c - low) / span)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes with x0, y0, x1, y1."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    both = w * h
    union = area(a) + area(b) - both
    return F.when((both > 0) & (union > 0), both / union).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


@F.pandas_udf(StringType())
def metric_form(s: pd.Series) -> pd.Series:
    """NFC, lower case, white space collapsed: the form in which texts are compared."""
    return s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).lower().split()))


def word_distance(a: list[str], b: list[str]) -> int:
    """Edits of whole words, a row of the table at a time."""
    import numpy as np

    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in (a, b))
    at = np.arange(len(y) + 1)
    row = at.copy()
    for i, word in enumerate(x.tolist(), 1):
        # the best without a word of b put in, then the running best of putting in words
        best = np.minimum(row[1:] + 1, row[:-1] + (y != word))
        row = np.minimum.accumulate(np.concatenate([[i], best]) - at) + at
    return int(row[-1])


@F.pandas_udf(DoubleType())
def word_error_rate(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Word-level edit distance over the reference's words."""

    def one(r, h):
        if r is None or h is None:
            return None
        a, b = r.split(), h.split()
        return word_distance(a, b) / len(a) if a else float(bool(b))

    return pd.Series([one(r, h) for r, h in zip(reference, hypothesis)], dtype="float64")
