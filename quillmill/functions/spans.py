"""Spans: finding them, resolving overlaps, splicing replacements."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

SPAN = "struct<start:int,end:int,entity_type:string,score:double,ord:int>"
SPANS = f"array<{SPAN}>"

GAP = r"[^\S\n]+"
NAME = r"[A-Z][-'A-Za-z]+"
NAMES = rf"{NAME}(?:{GAP}{NAME})"
HONORIFIC = re.compile(rf"\b(?:(?:Dr|Prof|Mrs?|Ms)\.?|Miss|Sir){GAP}{NAMES}*\b")
TITLE_CASE = re.compile(rf"\b{NAMES}+\b")
_STREETS = sorted("Avenue Ave Boulevard Blvd Circuit Cct Close Cl Court Ct Crescent Cres Drive Dr Highway Hwy Lane Ln Parade Pde Place Pl Road Rd Street St Terrace Tce Way".split(), key=lambda w: (-len(w), w))
_STATE = rf"(?:{'|'.join(sorted('ACT NSW NT QLD SA TAS VIC WA'.split()))}){GAP}\d{{4}}"
ADDRESS = re.compile(
    rf"(?:(?:Lot|Suite|Unit|Level){GAP}\d+[;,]?{GAP})?\d+(?:\s*[–-]\s*\d+)?{GAP}{NAMES}*{GAP}(?:{'|'.join(_STREETS)})\b"
    rf"(?:,[^\S\n]*{NAME}(?:{GAP}(?!{_STATE}\b){NAME})*)?(?:,?{GAP}{_STATE})?"
)
#: Words of titles, offices, places and the calendar that make no name; the list decides what is cleaned, so it is the known one, sorted.
COMMON = frozenset(
    """Act Acting Action Administrative Agency Annexure Annual Appendix Application April Assessment Assistant Association
    Assurance Attachment August Australia Australian Authorised Authority Bill Board Capital Care Central Centre Clause
    Commissioner Committee Commonwealth Community Compliance Corporate Council December Decision Department Deputy Direction
    Director Division East Education February Federal Framework Friday General Government Guidelines Hours House Incorporated
    Inquiry Issue Its January July June Law Laws Legal Local Manager March May Minister Ministry Monday National New North
    Northern Notice November October Office Officer Officers Ombudsman Parliament Part Plan Plans Policy Principal Procedure
    Program Programs Queensland Refer Regional Regulation Regulations Regulatory Report Review Saturday Schedule School
    Secretary Section Senate Senior September Service Services South State Strategy Sunday Territory That The Their These This
    Those Thursday Tribunal Tuesday Unit Victoria Wales Wednesday West Western""".split()
)
CONTEXTS = (
    "a person came to the meeting and gave a statement about what happened",
    "she spoke with the client, took notes and wrote down what was said",
    "he was present at the hearing and answered the questions put to him",
    "the carer referred the child to the service",
    "the worker visited the family, assessed it and recommended support",
    "the victim told the police about what was done to them",
    "the witness described what they had seen to the officer",
    "the applicant lodged a claim through the portal",
    "yours sincerely signed by the officer for the department",
    "the director approved the decision and signed the letter",
    "the officer in charge was named at the foot of the notice",
    "the assistant director gave a direction under the act",
)


def is_all_common(c: Column) -> Column:
    """Every word of the text is a known word that makes no name."""
    known = F.array(*[F.lit(w) for w in sorted(COMMON)])
    return F.forall(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""), lambda w: F.array_contains(known, w))


_SIZE = 256
_refs: list = []


def trigram_vectors(texts: list[str]):
    """Unit vectors of hashed letter trigrams, all texts at once."""
    import numpy as np

    flat = [" " + " ".join(t.lower().split()) + " " for t in texts]
    size = np.array([len(t) for t in flat])
    code = np.frombuffer("".join(flat).encode("utf-32-le"), np.uint32).astype(np.uint64)
    out = np.zeros((len(flat), _SIZE))
    if len(code) > 2:
        gram = code[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ code[2:] * np.uint64(0x165667B19E3779F9)
        gram = (gram ^ gram >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(56)
        row = np.repeat(np.arange(len(flat)), size)
        inside = row[:-2] == row[2:]
        np.add.at(out, (row[:-2][inside], gram[inside].astype(np.int64)), 1)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def hashed_context_scores(contexts: list[str]) -> list[float]:
    """Greatest cosine of each context's hashed letter trigrams with the reference contexts.

    It stands in for a sentence model, which can be passed in its place; scores
    near a threshold differ from that model's.
    """
    if not _refs:
        _refs.append(trigram_vectors(list(CONTEXTS)))
    return (trigram_vectors(contexts) @ _refs[0].T).max(axis=1).tolist() if contexts else []


Scorer = Callable[[list[str]], list[float]]


def candidates_in(texts: list[str | None], entities=("PERSON",), threshold: float = 0.35, scorer: Scorer = hashed_context_scores, window: int = 100) -> list[list[tuple[int, int, str, float, int]]]:
    """Candidates of each text in their order of insertion: addresses, honorifics, scored title-case pairs; the scorer sees all contexts at once."""
    out: list[list] = []
    asked: list[tuple[int, int, int]] = []
    contexts: list[str] = []
    for k, text in enumerate(texts):
        found: list = []
        out.append(found)
        if not text:
            continue
        if "ADDRESS" in entities:
            found += [(*m.span(), "ADDRESS", 0.9) for m in ADDRESS.finditer(text)]
        if "PERSON" in entities:
            found += [(*m.span(), "PERSON", 0.9) for m in HONORIFIC.finditer(text)]
            sure = [(a, b) for a, b, *_ in found]
            for m in TITLE_CASE.finditer(text):
                if any(a <= m.start() and m.end() <= b for a, b in sure) or all(w in COMMON for w in m.group().split()):
                    continue
                asked.append((k, *m.span()))
                contexts.append(text[max(0, m.start() - window) : m.end() + window])
    for (k, a, b), score in zip(asked, scorer(contexts)):
        if score >= threshold:
            out[k].append((a, b, "PERSON", score))
    return [[(*x, i) for i, x in enumerate(found)] for found in out]


def find_candidates(text: Column, entities=("PERSON",), threshold: float = 0.35, scorer: Scorer = hashed_context_scores) -> Column:
    """Array of candidate spans of a text."""

    @F.pandas_udf(SPANS)
    def run(s: pd.Series) -> pd.Series:
        names = ("start", "end", "entity_type", "score", "ord")
        return pd.Series([[dict(zip(names, c)) for c in found] for found in candidates_in(s.tolist(), entities, threshold, scorer)])

    return run(F.coalesce(text, F.lit("")))


def title_case_candidates(text: Column) -> Column:
    """All title-case word groups, as text, without scoring. Stays in the JVM."""
    return F.regexp_extract_all(text, F.lit(rf"(?U)\b{NAMES}+\b"), F.lit(0))


def keep_first(spans: Column, by_score: bool = False) -> Column:
    """Overlap resolution: by start (and score, the higher first), ties by order of insertion; a span stays if it starts at or after the last one's end."""

    def compare(a: Column, b: Column) -> Column:
        out = F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
        if by_score:
            out = out.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
        return out.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)

    empty = F.struct(F.array().cast(SPANS).alias("kept"), F.lit(-1).alias("last"))
    step = lambda acc, x: F.when(x["start"] >= acc["last"], F.struct(F.concat(acc["kept"], F.array(x)).alias("kept"), x["end"].alias("last"))).otherwise(acc)
    return F.aggregate(F.array_sort(spans.cast(SPANS), compare), empty, step, lambda acc: acc["kept"])


def splice(text: Column, spans: Column) -> Column:
    """Replace resolved spans by their type in angle brackets."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, x: F.struct(
        F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("<"), x["entity_type"], F.lit(">")).alias("out"), x["end"].alias("at")
    )
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2147483647))))


def rebase_known(known: Column, offset: Column, length: Column) -> Column:
    """Known spans of a whole document clipped to a block at ``offset``; score 0.95."""
    moved = F.transform(known, lambda k, i: F.struct(F.greatest(F.lit(0), k["start"] - offset).cast("int").alias("start"), F.least(length, k["end"] - offset).cast("int").alias("end"), k["entity_type"].alias("entity_type"), F.lit(0.95).alias("score"), (i + 1_000_000).cast("int").alias("ord")))
    return F.filter(moved, lambda s: s["end"] > s["start"])
