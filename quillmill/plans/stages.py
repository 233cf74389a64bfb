"""Stages over a wide documents table, composed by DataFrame.transform.

A table has document_id, status and what earlier stages added; rows that failed
keep their error and pass through every stage untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from quillmill import config as C
from quillmill.functions import text as X
from quillmill.functions.enrichment import parse
from quillmill.operators import chunking, classify, enrich, graph, pii, redaction

COMPLETED = "status = 'completed'"
POINTS = ("post_extraction", "post_chunk", "post_enrichment")


def normalise(docs: DataFrame, method: str = "native") -> DataFrame:
    """Repair page texts, note blank pages, put the full text and its coverage beside them."""
    pages = X.normalise_pages(F.col("pages"))
    return docs.withColumns({"warnings": F.concat(F.coalesce("warnings", F.array().cast("array<string>")), X.blank_page_warnings(F.col("pages"), F.lit(method))), "pages": pages}).withColumns(
        {"text": X.full_text(F.col("pages")), "text_coverage": X.text_coverage(F.col("pages"))}
    )


def redact(docs: DataFrame, rasters: DataFrame, cfg: C.Redaction) -> DataFrame:
    """Reports of the pages' rasters applied to the texts by the configured mode; documents without rasters stay as they are."""
    if not cfg.enabled:
        return docs
    reports = redaction.redaction_reports(rasters, threshold=cfg.threshold, least=cfg.min_area_ratio, most=cfg.max_area_ratio)
    j = docs.join(reports, "document_id", "left")
    pages = redaction.apply_text_redaction(F.col("pages"), F.col("affected_pages"), cfg.mode)
    said = F.when(F.col("report").isNotNull(), redaction.redaction_warnings(F.col("report"))).otherwise(F.array().cast("array<string>"))
    return j.withColumns({"pages": pages, "warnings": F.concat(F.coalesce("warnings", F.array().cast("array<string>")), said)}).withColumn("text", X.full_text(F.col("pages"))).drop("report", "total")


def chunk(docs: DataFrame, cfg: C.Chunking, count: Callable[[str], int] = chunking.word_count) -> DataFrame:
    done = docs.filter(COMPLETED) if "status" in docs.columns else docs
    tables = "tables" if cfg.chunk_tables and "tables" in docs.columns else None
    chunks = chunking.chunk_documents(done, cfg.chunk_size, count, cfg.overlap, tables)
    if "affected_pages" not in docs.columns or "pages" not in docs.columns:
        return chunks
    size = F.when(F.col("p.text") == "", 0).otherwise(F.length("p.text") + 2)
    before = F.coalesce(F.sum(size).over(Window.partitionBy("document_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = done.select("document_id", F.posexplode("pages").alias("at", "p")).withColumn("page_start", before)
    offsets = each.select("document_id", F.col("p.page_number").alias("page_number"), "page_start", (F.col("page_start") + F.length("p.text")).alias("page_end"))
    affected = done.select("document_id", F.col("affected_pages").alias("pages"))
    return chunking.flag_redacted(chunking.source_pages(chunks, offsets).withColumn("page_number", F.lit(None).cast("int")), affected).drop("page_number")


def clean_chunks(chunks: DataFrame, cfg: C.Pii, enriched: DataFrame | None = None) -> DataFrame:
    """Clean chunks; after enrichment its spans count too, and without one only the patterns do."""
    if not cfg.enabled:
        return chunks
    if cfg.pipeline_point not in POINTS:
        raise ValueError(f"unknown pipeline point: {cfg.pipeline_point}")
    options = {"entities": tuple(cfg.entities), "threshold": cfg.context_similarity_threshold}
    if cfg.pipeline_point == "post_enrichment" and enriched is not None:
        known = graph.known_spans(enriched, tuple(cfg.entities), tuple(cfg.person_types))
        return pii.clean_with_known(chunks.join(known, "document_id", "left"), "known", "start_char", **options).drop("known")
    return pii.clean(chunks, **options)


def enrich_documents(docs: DataFrame, make_client, cfg: C.Enrichment, concurrency: int = 8) -> DataFrame:
    """(document_id, e, error) of the documents long enough; a failed call gives a null result and its error."""
    done = docs.filter(COMPLETED) if "status" in docs.columns else docs
    out = enrich.enrich(done, make_client, cfg.skip_short_documents, concurrency, cfg.batch_size, cfg.max_retries, cfg.retry_base_delay)
    return out.select("document_id", parse(F.col("json")).alias("e"), "error")


def summary(docs: DataFrame) -> DataFrame:
    """One row: how many documents were completed and how many failed."""
    return docs.agg(F.count_if(F.expr(COMPLETED)).alias("succeeded"), F.count_if(F.col("status") == "error").alias("failed"))


def routed(files: DataFrame) -> DataFrame:
    """Files with their kind and the strategy that reads them."""
    kind = classify.file_type(F.col("path"))
    return files.withColumns({"file_type": kind, "strategy": classify.strategy(kind)})


def format_eta(seconds: float) -> str:
    s = int(seconds)
    return f"{s}s" if s < 60 else f"{s // 60}m {s % 60}s" if s < 3600 else f"{s // 3600}h {s % 3600 // 60}m"
