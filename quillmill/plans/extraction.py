"""From files to documents: profile, route, extract.  One plan a kind of file, however many files there are."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillmill import config as C
from quillmill.functions import text as X
from quillmill.operators import classify
from quillmill.sources import backends, files, office, sinks, tabular

#: Bytes beyond which a CSV file is split among tasks by Spark's own reader, a plan of its own.
LARGE_CSV = 64 << 20


def _facts(method: str, confidence: float, coverage: Column) -> Column:
    return F.struct(
        F.lit(method).alias("extraction_strategy"), F.lit(confidence).alias("confidence"), F.lit(0.0).alias("processing_time"), F.lit(1).alias("page_count"), coverage.cast("double").alias("text_coverage"),
        F.array().cast("array<string>").alias("preprocessing_steps"), F.lit(None).cast("map<string,double>").alias("content_mix"),
    )


def word_documents(found: DataFrame) -> DataFrame:
    """Word files as documents. ``found``: path, content."""
    d = office.docx_rows(found)
    text = X.normalise_text(F.col("text"))
    return d.select(
        "document_id", F.col("path").alias("source_path"), text.alias("text"), F.when(F.col("error").isNull(), _facts("docx", 0.9, F.col("text") != "")).alias("metadata"),
        "tables", "text_blocks", F.lit("docx").alias("method"), "error",
    )


def sheet_documents(rows: DataFrame) -> DataFrame:
    """Sheets as documents: tables and glossaries a document a row, forms and prose one for the sheet. ``rows``: of ``office.sheet_rows``."""
    kinds = classify.sheet_profiles(rows)
    j = rows.filter("sheet IS NOT NULL").join(kinds, ["path", "stem", "sheet"])
    whole = F.col("sheet_type").isin("narrative", "key_value")
    named = F.when(F.col("sheet") == "default", F.col("stem")).otherwise(F.concat_ws(":", "stem", "sheet"))
    place = F.struct(*[F.lit(v).alias(k) for k, v in (("x", 0.0), ("y", 0.0), ("width", 1.0), ("height", 1.0))])
    table = lambda cells: F.array(F.struct(F.col("headers"), cells.alias("rows"), place.alias("position"), F.lit(0.95).alias("confidence")))

    single = j.filter(~whole & ~(F.col("has_sub_headers") & classify.is_sub_header(F.col("cells"))))
    pairs = F.filter(F.zip_with("headers", "cells", lambda h, v: F.when(X.strip(v) != "", F.concat(h, F.lit(": "), X.strip(v)))), lambda t: t.isNotNull())
    key = F.element_at("cells", F.array_position("headers", F.col("key_column")).cast("int"))
    key = F.left(F.translate(X.strip(F.coalesce(key, F.lit(""))), "/", "-"), F.lit(60))
    row_id = F.concat_ws(":", named, F.when(key != "", key).otherwise(F.concat(F.lit("row:"), F.col("row_index").cast("string"))))
    by_row = single.select(row_id.alias("document_id"), F.col("path").alias("source_path"), F.array_join(pairs, "\n").alias("text"), table(F.array("cells")).alias("tables")).filter("text <> ''")

    def layout(pdf: pd.DataFrame) -> pd.DataFrame:
        body = pdf.sort_values("row_index")
        heads = list(body["headers"].iloc[0])
        cells = [[*c][: len(heads)] for c in body["cells"]]
        return pd.DataFrame({"document_id": [body["name"].iloc[0]], "source_path": [body["path"].iloc[0]], "text": [pd.DataFrame(cells, columns=heads).to_string(index=False)], "headers": [heads], "cells": [cells]})

    sheets = j.filter(whole).select("path", "sheet", named.alias("name"), "row_index", "headers", "cells").groupBy("path", "sheet").applyInPandas(layout, "document_id string, source_path string, text string, headers array<string>, cells array<array<string>>")
    by_sheet = sheets.select("document_id", "source_path", "text", table(F.col("cells")).alias("tables"))
    good = by_row.unionByName(by_sheet).select("*", _facts("spreadsheet", 0.95, F.col("text") != "").alias("metadata"), F.lit(None).cast("string").alias("error"))
    bad = rows.filter("sheet IS NULL").select(F.col("stem").alias("document_id"), F.col("path").alias("source_path"), F.lit("").alias("text"), "error")
    return good.unionByName(bad, allowMissingColumns=True).withColumn("method", F.lit("spreadsheet"))


def large_csv(spark: SparkSession, path: str) -> DataFrame:
    """One CSV file's rows in the shape of ``office.sheet_rows``, read by many tasks; a row has a number of its own, without gaps only within a part of the file."""
    df = tabular.read_csv(spark, path)
    heads = F.array(*[F.lit(c) for c in df.columns])
    cells = F.array(*[X.quoted(c) for c in df.columns])
    return df.select(F.lit(path).alias("path"), F.lit(office.stem_of_path(path)).alias("stem"), F.lit("default").alias("sheet"), F.monotonically_increasing_id().alias("row_index"), heads.alias("headers"), cells.alias("cells"), F.lit(None).cast("string").alias("error"))


def page_documents(found: DataFrame, make_decoder=None, make_ocr=None, make_layout=None, cfg: C.Detection = C.Detection(), max_pages: int | None = None) -> DataFrame:
    """Paged files as documents, each by the strategy of its own type. ``found``: path, content."""
    if make_decoder is None:
        pages = backends.decode_pages(found, "native_narrative", None)
    else:
        kinds = backends.profile_files(found, make_decoder, make_ocr, cfg.min_text_coverage, cfg.table_signal_threshold, cfg.max_sample_pages)
        routed = found.join(kinds.filter("profile_error IS NULL").select("path", "strategy"), "path", "left")
        pages = backends.decode_pages(routed, F.coalesce("strategy", F.lit("native_narrative")), make_decoder, make_ocr, make_layout, max_pages)
    return backends.collect_documents(pages)


def extract(spark: SparkSession, root: str, limit: int | None = None, skip: int = 0, done: sinks.Progress | None = None, make_decoder: Callable | None = None, make_ocr: Callable | None = None, make_layout: Callable | None = None, cfg: C.Detection = C.Detection(), max_pages: int | None = None, large: int = LARGE_CSV) -> DataFrame:
    """Documents of all supported files, with method, status and error; a file that fails gives an error row.

    Names alone are collected: a reader wants a list of paths.  Files of no bytes aren't listed by Spark's reader.
    """
    found = files.discover(spark, root, skip, limit).select(F.col("path").alias("source_path"), classify.file_type(F.col("path")).alias("kind"), "length")
    left = done.remaining(found) if done else found
    paths: dict[str, list[str]] = {}
    for r in left.collect():
        kind = "large" if r["source_path"].lower().endswith(".csv") and r["length"] > large else r["kind"]
        paths.setdefault(kind, []).append(r["source_path"])
    parts = []
    if "docx" in paths:
        parts.append(word_documents(office.contents(spark, paths["docx"])))
    if "spreadsheet" in paths:
        parts.append(sheet_documents(office.sheet_rows(office.contents(spark, paths["spreadsheet"]))))
    for path in paths.get("large", []):
        parts.append(sheet_documents(large_csv(spark, path)))
    if "pdf" in paths:
        parts.append(page_documents(office.contents(spark, paths["pdf"]), make_decoder, make_ocr, make_layout, cfg, max_pages))
    state = "method string, status string, error string"
    if not parts:
        return spark.createDataFrame([], f"{sinks.DOCUMENTS}, {state}")
    return sinks.union([sinks.extraction_rows(p, keep=("method", "error")) for p in parts]).withColumn("status", F.when(F.col("error").isNull(), "completed").otherwise("error")).select(*[c.name for c in sinks.schema_of(spark, f"{sinks.DOCUMENTS}, {state}")])
