"""Contracts of decoders and models that aren't part of the engine, and what stands in for them.

A page decoder opens a document and gives its pages; an OCR reader and a layout
analyser look at rasters.  Without a backend every file becomes a row with an
error, of the same shape as a file that can't be read.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from quillmill.functions import text as X
from quillmill.operators import classify
from quillmill.operators.images import blur_score, contour_regularity, glyph_regularity, gray_of, has_ruled_lines, prepare_for_ocr, stroke_consistency, stroke_widths
from quillmill.sources.office import each_file, stem_of_path

Box = tuple[float, float, float, float]


@dataclass
class Region:
    """Something seen in a raster: a text line with its words, or a part of the layout with its label."""

    box: Box
    text: str = ""
    label: str = "figure"
    confidence: float = 0.0


@dataclass
class DecodedPage:
    """What a decoder says of a page, boxes in its own units."""

    number: int
    text: str = ""
    image: np.ndarray | None = None
    width: float = 0.0
    height: float = 0.0
    tables: list[tuple[Box, list[list]]] = field(default_factory=list)
    images: list[Box] = field(default_factory=list)
    widgets: list[tuple[str, str, Box]] = field(default_factory=list)
    blocks: list[tuple[str, float, Box]] = field(default_factory=list)  # text, greatest font size, box
    n_drawings: int = 0


class PageDecoder(Protocol):
    def pages(self, content: bytes) -> Iterator[DecodedPage]: ...


class OcrReader(Protocol):
    def read(self, image: np.ndarray) -> list[Region]: ...


class LayoutAnalyser(Protocol):
    def analyse(self, image: np.ndarray, confidence: float) -> list[Region]: ...


#: Classes of a general object detector as block types; others are figures.
BLOCK_TYPES = {"person": "paragraph", "book": "paragraph", "dining table": "table"} | dict.fromkeys(("tv", "laptop", "cell phone", "monitor", "keyboard", "mouse", "scissors", "clock"), "figure")
_POS = "position:struct<x:double,y:double,width:double,height:double>"
TABLES = f"array<struct<headers:array<string>,rows:array<array<string>>,{_POS},confidence:double>>"
FORMS = f"array<struct<field_name:string,value:string,{_POS},confidence:double>>"
IMAGES = f"array<struct<alt_text:string,{_POS},confidence:double>>"
BLOCKS = f"array<struct<text:string,{_POS},block_type:string,confidence:double>>"
PAGES = f"path string, document_id string, strategy string, page_number int, text string, method string, confidence double, steps array<string>, kind string, tables {TABLES}, forms {FORMS}, images {IMAGES}, text_blocks {BLOCKS}, warnings array<string>, seconds double, error string"
SIGNALS = "path string, page_number int, total_pages int, text string, n_images int, n_drawings int, table_shapes array<struct<rows:int,cols:int>>, ruled boolean, glyph double, stroke double, ocr_confidence double, error string"
BLANK = 100
LOW_BLUR, LOW_CONFIDENCE, LAYOUT_CONFIDENCE = 50.0, 40.0, 0.3
_PARTS = ("tables", "forms", "images", "text_blocks")


def block_type(label: str) -> str:
    return BLOCK_TYPES.get(label, "figure")


def _area(r: Region) -> float:
    return (r.box[2] - r.box[0]) * (r.box[3] - r.box[1])


def layout_regions(analyser: LayoutAnalyser, image: np.ndarray, confidence: float = LAYOUT_CONFIDENCE) -> list[Region]:
    """The regions that are sure enough, from top to bottom."""
    return sorted((r for r in analyser.analyse(image, confidence) if r.confidence >= confidence), key=lambda r: r.box[1])


def place(box: Box, width: float, height: float) -> dict:
    """A box as shares of the page; 0 where the page has no extent."""
    x0, y0, x1, y1 = box
    share = lambda v, whole: v / whole if whole else 0.0
    return {"x": share(x0, width), "y": share(y0, height), "width": share(x1 - x0, width), "height": share(y1 - y0, height)}


def page_tables(page: DecodedPage) -> list[dict]:
    """Found tables, the first row as headers; empty cells become ''."""
    text = lambda row: ["" if c is None or c == "" else str(c) for c in row]
    return [{"headers": text(rows[0]), "rows": [text(r) for r in rows[1:]], "position": place(box, page.width, page.height), "confidence": 0.8} for box, rows in page.tables if rows and rows[0]]


def page_forms(page: DecodedPage) -> list[dict]:
    return [{"field_name": name or "", "value": value or "", "position": place(box, page.width, page.height), "confidence": 0.9} for name, value, box in page.widgets]


def page_images(page: DecodedPage) -> list[dict]:
    return [{"alt_text": "", "position": place(box, page.width, page.height), "confidence": 0.7} for box in page.images]


def text_block_type(font: float, text: str) -> str:
    return "heading" if font >= 16 else "caption" if len(text) < 40 else "paragraph"


def native_blocks(page: DecodedPage) -> list[dict]:
    return [{"text": t, "position": place(box, page.width, page.height), "block_type": text_block_type(font, t), "confidence": 0.9} for t, font, box in ((t.strip(), f, b) for t, f, b in page.blocks) if t]


def ocr_block(text: str, confidence: float, kind: str = "paragraph") -> list[dict]:
    """One block for a whole page; none for a blank text. ``confidence``: 0 to 100."""
    text = text.strip()
    return [{"text": text, "position": dict(x=0.0, y=0.0, width=1.0, height=1.0), "block_type": kind, "confidence": confidence / 100}] if text else []


def layout_blocks(page: DecodedPage, analyser: LayoutAnalyser | None, text: str, confidence: float) -> list[dict]:
    """Blocks of the page's layout.  A region's own text isn't known, so unless it is all tables the page's
    text becomes one block of the largest region's type; without regions it is a paragraph."""
    try:
        regions = layout_regions(analyser, page.image) if analyser is not None and page.image is not None else []
    except Exception:  # an analyser has its own error types; the text is kept all the same
        regions = []
    if not regions:
        return ocr_block(text, confidence)
    whole = ocr_block(text, confidence, block_type(max(regions, key=_area).label))
    if whole:
        return whole
    height, width = page.image.shape[:2]
    return [{"text": "[TABLE]" if block_type(r.label) == "table" else "", "position": place(r.box, width, height), "block_type": block_type(r.label), "confidence": r.confidence} for r in regions]


def ocr_page(page: DecodedPage, reader: OcrReader) -> tuple[str, float, list[str], list[str]]:
    """(text, confidence 0 to 100, steps, warnings) of a raster that is prepared and read."""
    gray, warnings = gray_of(page.image), []
    blur = blur_score(gray)
    image, steps = prepare_for_ocr(page.image)
    if blur is not None and blur < LOW_BLUR:
        steps.append("low_blur_warning")
        warnings.append(f"page {page.number}: blurred ({blur:.1f})")
    said = [r for r in reader.read(image) if r.text.strip()] if image.size else []
    confidence = float(np.mean([r.confidence for r in said]) * 100) if said else 0.0
    if confidence < LOW_CONFIDENCE:
        warnings.append(f"page {page.number}: low confidence ({confidence:.1f})")
    return "\n".join(r.text for r in said), confidence, steps, warnings


def sample_confidence(image: np.ndarray | None, reader: OcrReader | None) -> float | None:
    """Mean confidence, 0 to 100, of the lines read; None where nothing can be read."""
    try:
        seen = [r.confidence for r in reader.read(image) if r.text.strip()] if reader is not None and image is not None else []
    except Exception:  # a reader has its own error types
        return None
    return float(np.mean(seen) * 100) if seen else None


def once(make: Callable | None) -> Callable:
    """A function that gives what the factory makes, made at its first call in a task; None without a factory."""
    made: list = []

    def get():
        if make is not None and not made:
            made.append(make())
        return made[0] if made else None

    return get


def page_signals(files: DataFrame, make_decoder: Callable[[], PageDecoder] | None, make_ocr: Callable[[], OcrReader] | None = None, most: int = 5) -> DataFrame:
    """What the decision tree wants to know of each sampled page. ``files``: path, content."""
    decoder, reader = once(make_decoder), once(make_ocr)

    def parse(path, content):
        if make_decoder is None:
            raise ValueError("backend unavailable: page decoder")
        pages = list(_decoded(decoder(), content))
        n = len(pages)
        for k in range(n) if n <= most else [i * n // most for i in range(most)]:
            page = pages[k]
            gray = gray_of(page.image) if page.image is not None else None
            textual = len(page.text.strip()) > BLANK
            seen = gray is not None and not textual
            yield (
                path, page.number, n, page.text, len(page.images), page.n_drawings, [{"rows": len(rows), "cols": max(map(len, rows), default=0)} for _, rows in page.tables],
                has_ruled_lines(gray) if seen else False, glyph_regularity(gray) if seen else None, stroke_consistency(stroke_widths(gray)) if seen else None,
                sample_confidence(page.image, reader()) if seen else None, None,
            )

    return each_file(files.select("path", "content"), parse, lambda path, error: (path, *[None] * 10, error), SIGNALS)


def _decoded(decoder: PageDecoder, content: bytes) -> Iterator[DecodedPage]:
    try:
        yield from decoder.pages(bytes(content))
    except (ValueError, OSError):
        raise
    except Exception as error:  # decoders have their own error types
        raise ValueError(f"{type(error).__name__}: {error}") from error


def profile_files(files: DataFrame, make_decoder: Callable[[], PageDecoder] | None, make_ocr: Callable[[], OcrReader] | None = None, least_coverage: float = 0.3, table_threshold: float = 0.4, most: int = 5) -> DataFrame:
    """(path, doc_type, strategy, profile_error): each file's type by its sampled pages; one that can't be opened has the error."""
    signals = page_signals(files, make_decoder, make_ocr, most)
    table = classify.has_table_structure(F.coalesce("text", F.lit(""))) | classify.has_structural_tables(F.coalesce("table_shapes", F.array()))
    hand = classify.handwriting_signals(F.col("ruled"), F.col("glyph"), F.col("stroke"))
    pages = signals.filter("error IS NULL").select(F.col("path").alias("document_id"), "page_number", "total_pages", "text", "n_images", "n_drawings", table.alias("has_table"), hand.alias("handwriting"), "ocr_confidence", "glyph", "stroke")
    types = classify.profile_pages(pages, most=most, least_coverage=least_coverage, table_threshold=table_threshold).select(F.col("document_id").alias("path"), "doc_type")
    failed = signals.groupBy("path").agg(F.first("error", ignorenulls=True).alias("profile_error"))
    return failed.join(types, "path", "left").select("path", F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"), classify.strategy(F.coalesce("doc_type", F.lit("unknown"))).alias("strategy"), "profile_error")


def decode_pages(files: DataFrame, strategy: str | Column, make_decoder: Callable[[], PageDecoder] | None = None, make_ocr: Callable[[], OcrReader] | None = None, make_layout: Callable[[], LayoutAnalyser] | None = None, max_pages: int | None = None) -> DataFrame:
    """One row a page. ``files``: path, content; ``strategy``: one for all, or a column with each file's own.

    Native strategies take the page's own text; ocr ones read its raster; hybrid
    ones take the own text where it is longer than 100 characters.
    """
    which = F.lit(strategy) if isinstance(strategy, str) else strategy
    decoder, reader, analyser = once(make_decoder), once(make_ocr), once(make_layout)

    def parse(path, content, plan):
        if plan == "non_textual":
            raise ValueError("no text to extract: manual review")
        if make_decoder is None:
            raise ValueError("backend unavailable: page decoder")
        for page in _decoded(decoder(), content):
            if max_pages is not None and page.number >= max_pages:
                break
            began = time.perf_counter()
            row = _page(page, plan, reader(), analyser())
            yield path, stem_of_path(path), plan, page.number, *row[:-1], time.perf_counter() - began, row[-1]

    return each_file(files.select("path", "content", which.alias("plan")), parse, lambda path, error: (path, stem_of_path(path), None, None, None, None, None, [], None, [], [], [], [], [], None, error), PAGES)


def _page(page: DecodedPage, plan: str, ocr: OcrReader | None, layout: LayoutAnalyser | None) -> tuple:
    """(text, method, confidence, steps, kind, tables, forms, images, text_blocks, warnings, error)."""
    if plan.startswith("native") or plan == "structured" or plan == "hybrid" and len(page.text.strip()) > BLANK:
        rich = plan in ("native_with_structured", "hybrid")
        return page.text, "native", 95.0 if plan == "hybrid" else None, [], None, page_tables(page) if rich or plan == "structured" else [], page_forms(page) if rich else [], page_images(page) if rich else [], native_blocks(page), [], None
    if ocr is None or page.image is None:
        return None, "ocr", None, [], None, [], [], [], [], [], "backend unavailable: ocr"
    text, confidence, steps, warnings = ocr_page(page, ocr)
    blocks = ocr_block(text, confidence) if plan == "ocr_handwritten" else layout_blocks(page, layout, text, confidence)
    kind = None
    if plan == "ocr_mixed":
        kind = "typed" if contour_regularity(gray_of(page.image)) > 0.5 else "handwritten"
        blocks = [b | {"block_type": kind} for b in blocks]
    images = [{"alt_text": "", "position": dict(x=0.0, y=0.0, width=1.0, height=1.0), "confidence": 0.9}] if plan == "image" else []
    return text, "ocr", confidence, steps, kind, [], [], images, blocks, warnings, None


def document_confidence(plan: Column, coverage: Column, tables: Column, pages: Column) -> Column:
    """0 to 1 by strategy; ``pages``: the mean of the pages' own, 0 to 100."""
    return (
        F.when(plan == "native_narrative", F.least(F.lit(0.95), 0.8 + 0.15 * coverage))
        .when(plan == "native_with_structured", 0.85)
        .when(plan == "structured", F.when(F.size(tables) > 0, 0.8).otherwise(0.6))
        .otherwise(F.coalesce(pages / 100, F.lit(0.0)))
    )


def collect_documents(pages: DataFrame) -> DataFrame:
    """Pages to documents: document_id, source_path, text, metadata, warnings, tables, forms, images, text_blocks, method, status, error."""
    n = F.count("page_number")
    share = lambda c, v: F.try_divide(F.count_if(F.col(c) == v), n)
    mix = F.when(F.first("strategy", True) == "hybrid", F.create_map(F.lit("native"), share("method", "native"), F.lit("scanned"), share("method", "ocr")))
    mix = mix.when(F.first("strategy", True) == "ocr_mixed", F.create_map(F.lit("typed"), share("kind", "typed"), F.lit("handwritten"), share("kind", "handwritten")))
    each = pages.groupBy("path", "document_id").agg(
        F.sort_array(F.collect_list(F.struct("page_number", F.struct("text", "method", "steps", "warnings", *_PARTS).alias("p")))).alias("all"), F.first("strategy", True).alias("method"), n.cast("int").alias("page_count"),
        F.avg("confidence").alias("c"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), mix.alias("content_mix"), F.first("error", True).alias("error"),
    )
    flat = lambda name: F.flatten(F.transform("all", lambda x: F.coalesce(x["p"][name], F.array())))
    text_pages = F.transform(F.filter("all", lambda x: x["page_number"].isNotNull()), lambda x: F.struct(x["page_number"].alias("page_number"), F.coalesce(x["p"]["text"], F.lit("")).alias("text")))
    d = each.select("*", text_pages.alias("raw"), *[flat(x).alias(x) for x in ("steps", "warnings", *_PARTS)])
    d = d.withColumns({"pages": X.normalise_pages(F.col("raw")), "coverage": X.text_coverage(F.col("raw"))})
    meta = F.struct(
        F.col("method").alias("extraction_strategy"), document_confidence(F.col("method"), F.col("coverage"), F.col("tables"), F.col("c")).alias("confidence"), F.col("seconds").alias("processing_time"),
        "page_count", F.col("coverage").alias("text_coverage"), F.array_sort(F.array_distinct("steps")).alias("preprocessing_steps"), "content_mix",
    )
    blank = X.blank_page_warnings(F.col("raw"), F.coalesce("method", F.lit("unknown")))
    return d.select(
        "document_id", F.col("path").alias("source_path"), X.full_text(F.col("pages")).alias("text"), meta.alias("metadata"), F.concat("warnings", blank).alias("warnings"), *_PARTS,
        "method", F.when(F.col("error").isNull(), "completed").otherwise("error").alias("status"), "error",
    )


def find_models_dir(start: str, env: str | None = None) -> str | None:
    """A ``models`` folder: from the environment, else next to ``start`` or up to eight folders above."""
    if env and os.environ.get(env):
        return os.environ[env] if os.path.isdir(os.environ[env]) else None
    here = os.path.abspath(start)
    for _ in range(9):
        if os.path.isdir(os.path.join(here, "models")):
            return os.path.join(here, "models")
        here = os.path.dirname(here)
    return None


def model_path(name: str, start: str, env: str | None = None) -> str:
    """Where a model lies: a file, the snapshot that its ``refs/main`` names, or its folder; its name itself where there is none."""
    root = find_models_dir(start, env)
    local = os.path.join(root, name) if root else ""
    ref = os.path.join(local, "refs", "main")
    if local and os.path.isfile(ref):
        with open(ref) as f:
            snapshot = os.path.join(local, "snapshots", f.read().strip())
        if os.path.isdir(snapshot):
            return snapshot
    return local if local and os.path.exists(local) else name
