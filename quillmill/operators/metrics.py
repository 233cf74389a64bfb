"""Accuracy of recognised text and layout against a ground truth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quillmill.functions.text import character_error_rate, metric_form


Box = tuple[float, float, float, float]


def spatial_text(words: list[tuple[str, Box]], tolerance: float = 0.5) -> str:
    """Words in reading order: by centre, a new line where one is too far below the line's first word."""
    if not words:
        return ""
    height = sum(b[3] - b[1] for _, b in words) / len(words)
    items = sorted(((b[1] + b[3]) / 2, (b[0] + b[2]) / 2, t) for t, b in words)
    lines: list[list[tuple[float, str]]] = []
    anchor = None
    for cy, cx, t in items:
        if anchor is None or cy - anchor > tolerance * height:
            lines.append([])
            anchor = cy
        lines[-1].append((cx, t))
    return "\n".join(" ".join(t for _, t in sorted(line, key=lambda w: w[0])) for line in lines)


def box_ious(one: Box, boxes: np.ndarray) -> np.ndarray:
    """Overlap of a box with each of many, as a share of what they cover together."""
    left, top, right, bottom = one
    w = np.maximum(0, np.minimum(right, boxes[:, 2]) - np.maximum(left, boxes[:, 0]))
    h = np.maximum(0, np.minimum(bottom, boxes[:, 3]) - np.maximum(top, boxes[:, 1]))
    both = w * h
    union = (right - left) * (bottom - top) + (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1]) - both
    return np.where(both > 0, both / np.where(union > 0, union, 1), 0.0)


def concordance(order: list[int]) -> float:
    """Share of pairs that stand in their right order; 1 for fewer than two."""
    n = len(order)
    if n < 2:
        return 1.0
    x = np.array(order)
    good = sum(int((x[i] < x[i + 1 :]).sum()) for i in range(n - 1))
    return good / (n * (n - 1) / 2)


def match_words(reference, hypothesis, least: float = 0.3) -> list[int]:
    """Greedily, each reference word's best free partner by overlap, the first of equal ones; the partners' places in the hypothesis."""
    boxes = np.array([b for _, b in hypothesis], float).reshape(-1, 4)
    free, out = np.ones(len(boxes), bool), []
    for _, box in reference:
        if not free.any():
            break
        score = np.where(free, box_ious(box, boxes), -1.0)
        best = int(score.argmax())
        if score[best] >= least:
            free[best] = False
            out.append(best)
    return out


def _pairs(pdf: pd.DataFrame):
    return [(r.text, (r.x0, r.y0, r.x1, r.y1)) for r in pdf.sort_values(["ord", "y0", "x0", "text"]).itertuples()]


def spatial_sort(words: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(document_id, text). ``words``: document_id, ord, text, x0, y0, x1, y1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"document_id": [pdf["document_id"].iloc[0]], "text": [spatial_text(_pairs(pdf), tolerance)]})

    return words.select("document_id", "ord", "text", "x0", "y0", "x1", "y1").groupBy("document_id").applyInPandas(run, "document_id string, text string")


def cer_spatial(reference: DataFrame, hypothesis: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(document_id, cer) after both sides are put in reading order."""
    r = spatial_sort(reference, tolerance).select("document_id", metric_form("text").alias("r"))
    h = spatial_sort(hypothesis, tolerance).select("document_id", metric_form("text").alias("h"))
    return r.join(h, "document_id", "left").select("document_id", character_error_rate(F.col("r"), F.coalesce("h", F.lit(""))).alias("cer"))


def reading_order(reference: DataFrame, hypothesis: DataFrame, least: float = 0.3) -> DataFrame:
    """(document_id, accuracy): concordant pairs among the matched words."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"document_id": [key[0]], "accuracy": [concordance(match_words(_pairs(left), _pairs(right), least))]})

    return reference.groupBy("document_id").cogroup(hypothesis.groupBy("document_id")).applyInPandas(run, "document_id string, accuracy double")


def near_boxes(docs: np.ndarray, boxes: np.ndarray, other_docs: np.ndarray, others: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Along one axis: an order of the others, and for each box the range in it outside of which nothing of its document overlaps it. Documents ascend."""
    n, m = len(boxes), len(others)
    start, end = others[:, axis], others[:, axis + 2]
    order = np.lexsort((start, other_docs))
    # the furthest end so far within the document, by ranks, so that one running maximum does for all documents
    rank = np.empty(m, np.int64)
    rank[np.argsort(end, kind="stable")] = np.arange(m)
    furthest = np.sort(end)[np.maximum.accumulate(rank[order] + other_docs[order] * m) % m] if m else end

    def before(values: np.ndarray, limits: np.ndarray, equal: bool) -> np.ndarray:
        """How many of the others, in their order, come before each limit of its document."""
        theirs = np.repeat([not equal, equal], [n, m])
        both = np.lexsort((~theirs, np.concatenate([limits, values]), np.concatenate([docs, other_docs[order]])))
        out = np.empty(n + m, np.int64)
        out[both] = np.cumsum(both >= n)
        return out[:n]

    return order, before(furthest, boxes[:, axis], True), before(start[order], boxes[:, axis + 2], False)


def match_boxes(docs: np.ndarray, boxes: np.ndarray, other_docs: np.ndarray, others: np.ndarray, least: float = 0.3, at_once: int = 1 << 20) -> np.ndarray:
    """Greedily, in their order, each box's best free partner in its document by overlap, the first of equal ones: its place in the others, or -1.

    Documents ascend in both. Only boxes that meet along one axis are compared, the axis with fewer of them, and about ``at_once`` pairs at a time.
    """
    m, out, free = len(others), np.full(len(boxes), -1), np.ones(len(others), bool)
    order, low, high = near_boxes(docs, boxes, other_docs, others, 0)
    if np.maximum(high - low, 0).sum() > 8 * len(boxes):
        order_y, low_y, high_y = near_boxes(docs, boxes, other_docs, others, 1)
        fewer = high_y - low_y < high - low
        order, low, high = np.concatenate([order, order_y]), np.where(fewer, low_y + m, low), np.where(fewer, high_y + m, high)
    # where numbers don't compare, or no overlap is enough, a box is compared with its whole document
    odd = np.isin(docs, np.concatenate([docs[~np.isfinite(boxes).all(axis=1)], other_docs[~np.isfinite(others).all(axis=1)]])) | (least <= 0)
    low, high = np.where(odd, np.searchsorted(other_docs, docs), low), np.where(odd, np.searchsorted(other_docs, docs, "right"), high)
    counts = np.maximum(high - low, 0)
    upto, a = np.cumsum(counts), 0
    while a < len(boxes):
        done = upto[a] - counts[a]
        b = max(a + 1, int(np.searchsorted(upto, done + at_once, "right")))
        c = counts[a:b]
        i = np.repeat(np.arange(a, b), c)
        j = order[np.arange(len(i)) + np.repeat(low[a:b] - (upto[a:b] - c - done), c)]
        i, j = i[free[j]], j[free[j]]
        with np.errstate(all="ignore"):
            score = box_ious(boxes[i].T, others[j])
        good = score >= least
        i, j, score = i[good], j[good], score[good]
        sure = (np.bincount(i - a, minlength=b - a)[i - a] == 1) & (np.bincount(j, minlength=m)[j] == 1 if len(j) else True)
        out[i[sure]] = j[sure]
        free[j[sure]] = False
        i, j, score = i[~sure], j[~sure], score[~sure]
        by = np.lexsort((j, i))
        i, j, score = i[by], j[by], score[by]
        edges = np.flatnonzero(np.diff(i, prepend=-1, append=-1)) if len(i) else i
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
            left = free[j[x:y]]
            if left.any():
                k = x + int(np.where(left, score[x:y], -1.0).argmax())
                out[i[k]] = j[k]
                free[j[k]] = False
        a = b
    return out


def match_layout(predicted: DataFrame, truth: DataFrame, least: float = 0.3) -> DataFrame:
    """(label, tp, fp, fn): greedy matching in the predictions' order; a wrong label counts against both.

    Many documents are matched at once, as work in Python for each of them would cost more than their boxes.
    """
    box = ("x0", "y0", "x1", "y1")

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            docs = batch.column(0)
            r = docs.flatten()
            rows = pa.table({"doc": np.repeat(np.arange(len(docs)), docs.value_lengths().to_numpy()), **{f.name: r.field(k) for k, f in enumerate(r.type)}})
            rows = rows.sort_by([(c, "ascending") for c in ("side", "doc", "ord", "y0", "x0", "y1", "x1", "label")])
            labels = rows["label"].combine_chunks().dictionary_encode()
            names = [*labels.dictionary.to_pylist(), None]
            code = pc.fill_null(labels.indices, len(names) - 1).to_numpy()
            doc, boxes = rows["doc"].to_numpy(), np.column_stack([pc.fill_null(rows[c], float("nan")).to_numpy() for c in box])
            n = pc.sum(pc.equal(rows["side"], 0)).as_py() or 0
            partner = match_boxes(doc[:n], boxes[:n], doc[n:], boxes[n:], least)
            right = (partner >= 0) & (code[:n] == np.append(code[n:], -1)[partner])
            tp = np.bincount(code[:n][right], minlength=len(names))
            fp, fn = np.bincount(code[:n], minlength=len(names)) - tp, np.bincount(code[n:], minlength=len(names)) - tp
            some = np.flatnonzero(tp + fp + fn)
            yield pa.record_batch({"label": pa.array([names[k] for k in some], pa.string()), "tp": tp[some], "fp": fp[some], "fn": fn[some]})

    side = lambda df, k: df.select("document_id", F.lit(k).alias("side"), "ord", F.col("label").cast("string").alias("label"), *[F.col(c).cast("double").alias(c) for c in box])
    regions = side(predicted, 0).unionByName(side(truth, 1))
    each = regions.groupBy("document_id").agg(F.collect_list(F.struct("side", "ord", "label", *box)).alias("regions")).select("regions")
    matched = each.mapInArrow(run, "label string, tp bigint, fp bigint, fn bigint")
    return matched.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def precision_recall(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1; 0 where a denominator is 0."""
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = rate(F.col("tp"), F.col("tp") + F.col("fp")), rate(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def merge_runs(spans: DataFrame) -> DataFrame:
    """Neighbours with one label become one box. ``spans``: document_id, ord, label, x0, y0, x1, y1."""
    w = Window.partitionBy("document_id").orderBy("ord")
    change = F.when(F.lag("label").over(w).eqNullSafe(F.col("label")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    island = spans.withColumn("__c", change).withColumn("island", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("document_id", "island").agg(F.min("label").alias("label"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n"))


def words_with_boxes(regions: DataFrame) -> DataFrame:
    """A region's words, its width dealt out by their lengths. ``regions``: document_id, ord, text, x0, y0, x1, y1."""
    words = regions.select("*", F.posexplode(F.filter(F.split("text", r"(?U)\s+"), lambda t: t != "")).alias("word_no", "word"))
    w = Window.partitionBy("document_id", "ord").orderBy("word_no")
    total = F.sum(F.length("word")).over(Window.partitionBy("document_id", "ord"))
    upto = F.sum(F.length("word")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    width = F.col("x1") - F.col("x0")
    return words.select("document_id", "ord", "word_no", "word", (F.col("x0") + width * (upto - F.length("word")) / total).alias("x0"), "y0", (F.col("x0") + width * upto / total).alias("x1"), "y1")


def page_confidence(regions: DataFrame) -> DataFrame:
    """Mean of page means, not weighted by regions. ``regions``: document_id, page_number, confidence, steps."""
    page = regions.groupBy("document_id", "page_number").agg(F.avg("confidence").alias("c"), F.flatten(F.collect_list("steps")).alias("s"))
    return page.groupBy("document_id").agg(F.avg("c").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("steps"))
