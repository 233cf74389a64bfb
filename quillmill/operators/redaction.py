"""Redacted regions of page rasters, and what follows for texts and chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

REGION = "struct<page:int,x:int,y:int,width:int,height:int,area_ratio:double>"


def components(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Bounding boxes (x, y, w, h) of the 8-connected parts of a mask."""
    return [box for box, _ in parts(mask)]


def parts(mask: np.ndarray) -> list[tuple[tuple[int, int, int, int], int]]:
    """(bounding box, x of the leftmost cell in its first line) of each part: runs of each line, joined from line to line."""
    parent: list[int] = []

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    boxes: list[list[int]] = []
    last: list[tuple[int, int, int]] = []
    for y in range(mask.shape[0]):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
        now = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            label = len(parent)
            parent.append(label)
            boxes.append([a, y, b, y + 1])
            for p, q, other in last:
                if p <= b and a <= q:  # they touch, corners too
                    parent[find(other)] = find(label)
            now.append((a, b, label))
        last = now
    out: dict[int, list[int]] = {}
    for k, (a, y0, b, y1) in enumerate(boxes):
        r = out.setdefault(find(k), [a, y0, b, y1, a])
        r[0], r[1], r[2], r[3] = min(r[0], a), min(r[1], y0), max(r[2], b), max(r[3], y1)
    return [((a, y0, b - a, y1 - y0), first) for a, y0, b, y1, first in out.values()]


def detect_regions(image: np.ndarray, page: int = 0, threshold: int = 50, least: float = 0.001, most: float = 0.9, aspect: tuple[float, float] = (0.1, 10.0)) -> list[dict]:
    """Dark boxes of a plausible size and shape on one page."""
    if image is None or image.size == 0:
        return []
    gray = image if image.ndim == 2 else image[..., :3].mean(axis=2)
    total = gray.shape[0] * gray.shape[1]
    out = []
    for x, y, w, h in sorted(components(gray < threshold), key=lambda b: (b[1], b[0])):
        ratio = w * h / total
        if least <= ratio <= most and aspect[0] <= w / h <= aspect[1]:
            out.append({"page": page, "x": x, "y": y, "width": w, "height": h, "area_ratio": ratio})
    return out


def mask_regions(image: np.ndarray, regions: list[dict]) -> np.ndarray:
    """The page with its regions painted white."""
    out = image.copy()
    for r in regions:
        out[r["y"] : r["y"] + r["height"], r["x"] : r["x"] + r["width"]] = 255
    return out


def redaction_reports(rasters: DataFrame, **options) -> DataFrame:
    """(document_id, report, total, affected_pages). ``rasters``: document_id, page_number, width, height, pixels (bytes, row by row); a page that can't be read has no regions."""

    @F.pandas_udf(f"array<{REGION}>")
    def regions(page: pd.Series, width: pd.Series, height: pd.Series, pixels: pd.Series) -> pd.Series:
        def one(p, w, h, raw):
            try:
                return detect_regions(np.frombuffer(raw, np.uint8).reshape(int(h), int(w)), int(p), **options)
            except (ValueError, TypeError):
                return []

        return pd.Series([one(*x) for x in zip(page, width, height, pixels)])

    pages = rasters.select("document_id", "page_number", regions("page_number", "width", "height", "pixels").alias("regions"))
    per = pages.groupBy("document_id").agg(F.sort_array(F.collect_list(F.when(F.size("regions") > 0, F.struct("page_number", "regions")))).alias("hit"))
    return per.select("document_id", F.map_from_entries("hit").alias("report"), report_total(F.map_from_entries("hit")).alias("total"), affected_pages(F.map_from_entries("hit")).alias("affected_pages"))


def report_total(report: Column) -> Column:
    return F.aggregate(F.map_values(report), F.lit(0), lambda s, r: s + F.size(r))


def affected_pages(report: Column) -> Column:
    return F.array_sort(F.map_keys(report))


def apply_text_redaction(pages: Column, affected: Column, mode: str = "flag") -> Column:
    """flag: nothing; blackout: a marker line before the page's text, which stays; delete: the text goes."""
    if mode == "flag":
        return pages
    if mode not in ("blackout", "delete"):
        raise ValueError(f"unknown redaction mode: {mode}")
    new = (lambda t: F.concat(F.lit("[REDACTED]\n"), t)) if mode == "blackout" else (lambda t: F.lit(""))
    return F.transform(pages, lambda p: F.when(F.array_contains(F.coalesce(affected, F.array().cast("array<int>")), p["page_number"].cast("int")), p.withField("text", new(p["text"]))).otherwise(p))


def redaction_warnings(report: Column) -> Column:
    return F.transform(F.array_sort(F.map_keys(report)), lambda k: F.concat(F.lit("page "), k.cast("string"), F.lit(": "), F.size(F.element_at(report, k)).cast("string"), F.lit(" redacted region(s) detected")))


def redacted_documents(reports: DataFrame) -> DataFrame:
    """One row: how many documents have a redacted region."""
    return reports.agg(F.coalesce(F.count_if(F.col("total") > 0), F.lit(0)).alias("redacted_documents"))
