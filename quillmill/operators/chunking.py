"""Token-bounded chunks with exact character offsets.

A text is cut at the strongest separator that makes pieces small enough
(blank lines, lines, sentence ends, clause ends, blanks, characters), and
neighbouring pieces are merged again as long as they fit.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from quillmill.functions.text import table_to_markdown
from quillmill.operators.graph import span_chunks

CHUNK = "struct<chunk_index:int,start_char:int,end_char:int,text:string>"
_LEVELS = [re.compile(p) for p in (r"\n\s*\n+", r"\n", r"(?<=[.!?])\s+", r"(?<=[,;:])\s+", r"\s+")]
MARK = "[REDACTED]"


def word_count(text: str) -> int:
    return len(text.split())


def remembered(count: Callable[[str], int], most: int | None = 65536) -> Callable[[str], int]:
    """A counter that keeps the counts of recent texts; ``most``: how many, None for all."""
    return lru_cache(maxsize=most)(count)


def token_count_of(path: str) -> Callable[[str], int]:
    """Counter by a tokenizer file of the public library, which is read once in each worker; the path has to be readable there."""
    made: list = []

    def count(text: str) -> int:
        if not made:
            from tokenizers import Tokenizer

            made.append(Tokenizer.from_file(path))
            made[0].encode_special_tokens = True
        return len(made[0].encode(text, add_special_tokens=False).ids)

    return count


def _measure(text: str, count: Callable[[str], int], size: int, longest: int | None) -> Callable[[int, int], int]:
    """Tokens of text[a:b]; words are counted from their places, without slicing."""
    if count is not word_count:
        # a text longer than ``size`` of the longest tokens needs no counting
        return lambda a, b: size + 1 if longest and b - a > size * longest else count(text[a:b])
    starts = [m.start() for m in re.finditer(r"\S+", text)]
    inside = lambda a: 0 < a < len(text) and not text[a].isspace() and not text[a - 1].isspace()
    return lambda a, b: bisect_left(starts, b) - bisect_left(starts, a) + (a < b and inside(a))


def split_text(text: str, size: int, count: Callable[[str], int] = word_count, overlap: float = 0, longest: int | None = None) -> list[tuple[int, int]]:
    """Ranges [start, end) of at most ``size`` tokens; ``overlap`` under 1 is a share of the size, from 1 on a number of tokens.

    ``longest``: characters of the longest token, where known.
    """
    if size < 1:
        raise ValueError("chunk_size has to be 1 at least")
    extra = int(overlap * size) if overlap < 1 else int(overlap)
    if extra >= size:
        raise ValueError("the overlap has to be less than the chunk size")
    if not text or not text.strip():
        return []
    tokens = _measure(text, count, size, longest)
    out: list[tuple[int, int]] = []
    for a, b in _merge(_cut(text, 0, len(text), size - extra, tokens, 0), size - extra, tokens):
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b))
    if extra and out:
        wide = [out[0]]
        for (p, _), (a, b) in zip(out, out[1:]):
            # reach back over whole words while the chunk still fits
            first = a
            for m in reversed(list(re.finditer(r"\S+", text[p:a]))):
                if tokens(p + m.start(), a) > extra or tokens(p + m.start(), b) > size:
                    break
                first = p + m.start()
            wide.append((first, b))
        out = wide
    return out


def _cut(text, a, b, size, tokens, level) -> list[tuple[int, int]]:
    if b <= a or tokens(a, b) <= size:
        return [(a, b)]
    while level < len(_LEVELS):
        at = [a + m.end() for m in _LEVELS[level].finditer(text[a:b]) if a + m.end() < b]
        level += 1
        if at:
            edges = [a, *at, b]
            return [r for x, y in zip(edges, edges[1:]) for r in _cut(text, x, y, size, tokens, level)]
    if b - a == 1:
        return [(a, b)]
    mid = (a + b) // 2
    return _cut(text, a, mid, size, tokens, level) + _cut(text, mid, b, size, tokens, level)


def _merge(ranges, size, tokens) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    i = 0
    while i < len(ranges):
        # the furthest piece that still fits, by doubling and halving
        lo, hi, step = i, len(ranges) - 1, 1
        fits = lambda k: tokens(ranges[i][0], ranges[k][1]) <= size  # noqa: B023, E731
        while lo + step <= hi and fits(lo + step):
            lo, step = lo + step, step * 2
        while step:
            if lo + step <= hi and fits(lo + step):
                lo += step
            step //= 2
        out.append((ranges[i][0], ranges[lo][1]))
        i = lo + 1
    return out


def split_texts(df: DataFrame, size: int, count: Callable[[str], int] = word_count, overlap: float = 0) -> DataFrame:
    """``all``: for each of a row's ``texts`` an array of chunks. Blank texts have none, and only the first text's chunks overlap. Other columns stay."""

    def one(t, extra):
        return [{"chunk_index": i, "start_char": a, "end_char": b, "text": t[a:b]} for i, (a, b) in enumerate(split_text(t, size, count, extra))]

    def run(batches):
        for pdf in batches:
            pdf["all"] = [[one(t, 0 if k else overlap) for k, t in enumerate(ts)] for ts in pdf["texts"]]
            yield pdf.drop(columns="texts")

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "texts"]
    return df.mapInPandas(run, ", ".join([*kept, f"all array<array<{CHUNK}>>"]))


def chunk_documents(docs: DataFrame, size: int, count: Callable[[str], int] = word_count, overlap: float = 0, tables_col: str | None = None) -> DataFrame:
    """(document_id, chunk_index, start_char, end_char, text, content_type, has_redaction): narrative chunks, then those of the tables' markdown, numbered through per document."""
    kept = lambda chunks, kind: F.transform(chunks, lambda c: F.struct(c["start_char"].alias("start_char"), c["end_char"].alias("end_char"), c["text"].alias("text"), F.lit(kind).alias("content_type"), F.lit(False).alias("has_redaction")))
    # the splitter sees a document's text and the markdown of all its tables as one array, so nothing is shuffled
    texts = F.array(F.coalesce("text", F.lit("")))
    if tables_col:
        markdown = F.transform(F.coalesce(tables_col, F.array()), lambda t: table_to_markdown(t["headers"], t["rows"]))
        texts = F.concat(texts, markdown)
    split = split_texts(docs.select("document_id", texts.alias("texts")), size, count, overlap)
    own = F.concat(kept(F.col("all")[0], "narrative"), F.flatten(F.transform(F.slice("all", F.lit(2), F.size("all")), lambda cs: kept(cs, "table"))))
    # marks are mended before rows become chunks
    return split.select("document_id", F.posexplode(repair_splits(own)).alias("chunk_index", "c")).select("document_id", "chunk_index", "c.*")


def _torn(a: Column, b: Column) -> Column:
    """A marker begins at the end of one text and ends at the start of the next."""
    out = F.lit(False)
    for k in range(1, len(MARK)):
        out = out | (a.endswith(MARK[:k]) & b.startswith(MARK[k:]))
    return out


def repair_splits(chunks: Column) -> Column:
    """Merge neighbours between which a redaction marker is torn; a merged pair isn't merged again."""
    kind = "array<struct<start_char:int,end_char:int,text:string,content_type:string,has_redaction:boolean>>"
    start = F.struct(F.array().cast(kind).alias("done"), F.lit(False).alias("merged"))

    def step(acc, c):
        last = F.try_element_at(acc["done"], F.lit(-1))
        torn = (F.size(acc["done"]) > 0) & ~acc["merged"] & _torn(last["text"], c["text"])
        one = F.struct(last["start_char"].alias("start_char"), c["end_char"].alias("end_char"), F.concat(last["text"], c["text"]).alias("text"), last["content_type"].alias("content_type"), (last["has_redaction"] | c["has_redaction"]).alias("has_redaction"))
        head = F.slice(acc["done"], F.lit(1), F.greatest(F.size(acc["done"]) - 1, F.lit(0)))
        return F.when(torn, F.struct(F.concat(head, F.array(one)).cast(kind).alias("done"), F.lit(True).alias("merged"))).otherwise(F.struct(F.concat(acc["done"], F.array(c)).cast(kind).alias("done"), F.lit(False).alias("merged")))

    return F.aggregate(chunks.cast(kind), start, step, lambda acc: acc["done"])


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("content_type") == "narrative").alias("n_narrative"), F.count_if(F.col("content_type") == "table").alias("n_table"))


def flag_redacted(chunks: DataFrame, affected: DataFrame) -> DataFrame:
    """``has_redaction`` where one of a chunk's source pages was redacted. ``affected``: document_id, pages."""
    pages = F.when(F.size(F.coalesce("source_pages", F.array().cast("array<int>"))) > 0, F.col("source_pages")).otherwise(F.array("page_number")) if "source_pages" in chunks.columns else F.array("page_number")
    return chunks.join(affected, "document_id", "left").withColumn("has_redaction", F.coalesce(F.arrays_overlap(pages, F.col("pages")), F.lit(False))).drop("pages")


def source_pages(chunks: DataFrame, page_offsets: DataFrame) -> DataFrame:
    """Adds the numbers of the pages that a narrative chunk covers. ``page_offsets``: document_id, page_number, page_start, page_end."""
    pages = page_offsets.select("document_id", "page_number", F.col("page_start").alias("start"), F.col("page_end").alias("end"))
    hit = span_chunks(pages, chunks).groupBy("document_id", "chunk_index").agg(F.array_sort(F.collect_set("page_number")).alias("source_pages"))
    return chunks.join(hit, ["document_id", "chunk_index"], "left")
