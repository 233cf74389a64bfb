"""Document and sheet classification, routing, rows to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillmill.functions.text import strip

TABLE_EXTENSIONS = ("csv", "xls", "xlsx")
DISCOVERED = ("csv", "docx", "pdf", "xls", "xlsx")
STRATEGIES = {
    "scanned_handwritten": "ocr_handwritten",
    "scanned_machinewritten": "ocr_machinewritten",
    "scanned_mixed": "ocr_mixed",
    "hybrid": "hybrid",
    "native_with_structured": "native_with_structured",
    "structured": "structured",
    "image": "image",
    "docx": "docx",
    "spreadsheet": "spreadsheet",
    "text": "text",
}


def file_type(path: Column) -> Column:
    """Kind of a file by its extension; pdf files are looked into before they get a type."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(ext == "pdf", "pdf").when(ext == "docx", "docx").when(ext.isin(*TABLE_EXTENSIONS), "spreadsheet").when(ext == "txt", "text").otherwise("unknown")


def strategy(doc_type: Column) -> Column:
    """Extraction strategy of a document type; unknown ones are read as native text."""
    out = F.when(F.lit(False), "")
    for kind, name in STRATEGIES.items():
        out = out.when(doc_type == kind, name)
    return out.otherwise("native_narrative")


def has_table_structure(text: Column) -> Column:
    """Two rows in a row with two pipes or two tabs each, or three set apart by wide gaps."""
    two = "|".join(rf"(?<![^\n])(?:[^\n{sep}]*+[{sep}][^\n{sep}]*+[{sep}][^\n]*+\n){{2}}" for sep in ("|", r"\t"))
    return text.rlike(rf"(?U){two}|(?<!\s)(?:\s{{2,}}\S++\s{{2,}}\S[^\n]*+\n){{3}}")


def has_structural_tables(tables: Column, least_cells: int = 4) -> Column:
    """A detected table of at least so many cells. ``tables``: array of structs with rows and cols."""
    return F.exists(tables, lambda t: t["rows"] * t["cols"] >= least_cells)


def has_form_structure(n_widgets: Column, spans: Column) -> Column:
    """Two form fields, or ten short pieces of text."""
    return (n_widgets >= 2) | (F.size(F.filter(spans, lambda s: F.length(strip(s)).between(1, 30))) >= 10)


def sampled_pages(total: Column, most: int = 5) -> Column:
    """Page numbers that are looked at: all up to ``most``, else evenly spread ones."""
    return F.when(total <= 0, F.array().cast("array<int>")).when(total <= most, F.sequence(F.lit(0), total - 1)).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * total / most).cast("int"))
    )


def handwriting_signals(ruled: Column, glyph: Column, stroke: Column) -> Column:
    both = glyph.isNotNull() & stroke.isNotNull()
    return (
        F.coalesce(ruled, F.lit(False))
        | F.coalesce(both & (((glyph < 0.4) & (stroke < 0.4)) | (glyph < 0.25) | (stroke < 0.25)), F.lit(False))
        | F.coalesce(~both & (F.coalesce(glyph, stroke) < 0.3), F.lit(False))
    )


def classify_document(text_pages: Column, image_pages: Column, table_signals: Column, handwriting: Column, ocr: Column, glyph: Column, stroke: Column, total: Column, least_coverage: float = 0.3, table_threshold: float = 0.4) -> Column:
    """struct<doc_type, confidence> by the decision tree over a document's page signals."""
    cover, tables, hand = text_pages / total, table_signals / total, handwriting / total
    some_images, some_text = image_pages > 0, text_pages > 0
    shape = F.when(glyph.isNotNull() & stroke.isNotNull(), (glyph + stroke) / 2).otherwise(F.coalesce(glyph, stroke))
    out = lambda kind, c: F.struct(F.lit(kind).alias("doc_type"), (c if isinstance(c, Column) else F.lit(c)).cast("double").alias("confidence"))
    native = (
        F.when(tables >= 0.8, out("structured", 0.85))
        .when((tables >= table_threshold) | some_images, out("native_with_structured", 0.85))
        .otherwise(out("native_narrative", F.least(0.7 + 0.3 * cover, F.lit(0.95))))
    )
    scanned = (
        F.when(hand >= 0.8, out("scanned_handwritten", 0.75))
        .when(handwriting > 0, out("scanned_mixed", 0.70))
        .when(shape >= 0.6, out("scanned_machinewritten", F.least(0.5 + 0.4 * shape, F.lit(0.85))))
        .when(shape < 0.35, out("scanned_handwritten", 0.6))
        .when(ocr >= 70, out("scanned_machinewritten", F.least(0.5 + ocr / 200, F.lit(0.85))))
        .when(ocr < 70, out("unknown", 0.4))
        .otherwise(out("scanned_machinewritten", 0.5))
    )
    return (
        F.when(total == 0, out("unknown", 0.0))
        .when(cover >= least_coverage, native)
        .when(some_text & some_images & (cover > 0.1), out("hybrid", 0.65))
        .when(some_images, scanned)
        .otherwise(out("unknown", 0.3))
    )


def profile_pages(pages: DataFrame, least_text: int = 100, least_drawings: int = 30, most: int = 5, least_coverage: float = 0.3, table_threshold: float = 0.4) -> DataFrame:
    """One profile a document from its sampled pages.

    ``pages``: document_id, page_number, text, n_images, n_drawings, has_table, handwriting, ocr_confidence, glyph, stroke;
    total_pages where not all pages are there.
    """
    if "total_pages" in pages.columns:
        known = pages
    else:
        known = pages.join(pages.groupBy("document_id").agg((F.max("page_number") + 1).cast("int").alias("total_pages")), "document_id")
    looked = known.filter(F.array_contains(sampled_pages(F.col("total_pages"), most), F.col("page_number").cast("int")))
    is_text = F.length(strip(F.coalesce("text", F.lit("")))) > least_text
    is_image = ((F.col("n_images") > 0) | (F.col("n_drawings") >= least_drawings)) & ~is_text
    per = looked.groupBy("document_id", "total_pages").agg(
        F.count_if(is_text).alias("t"), F.count_if(is_image).alias("i"), F.count_if("has_table").alias("tab"), F.count_if("handwriting").alias("handwriting_pages"),
        F.count(F.lit(1)).alias("n"), F.avg("ocr_confidence").alias("ocr"), F.avg("glyph").alias("glyph"), F.avg("stroke").alias("stroke"),
    )
    scaled = lambda c: F.floor(F.col(c) * F.col("total_pages") / F.col("n"))
    counted = per.select("document_id", "total_pages", scaled("t").alias("text_pages"), scaled("i").alias("image_pages"), scaled("tab").alias("table_pages"), "handwriting_pages", "ocr", "glyph", "stroke")
    c = [F.col(x) for x in ("text_pages", "image_pages", "table_pages", "handwriting_pages", "ocr", "glyph", "stroke", "total_pages")]
    return counted.withColumn("profile", classify_document(*c, least_coverage, table_threshold)).select("*", "profile.doc_type", "profile.confidence").drop("profile")


def sheet_type(cols: Column, rows: Column, avg_len: Column) -> Column:
    """narrative, glossary, key_value or data, by a sheet's shape and the mean length of its cells."""
    return (
        F.when((cols == 1) | ((cols > 0) & (cols <= 3) & (avg_len > 150)), "narrative")
        .when((cols == 2) & rows.between(50, 500), "glossary")
        .when((cols == 2) & (rows < 50), "key_value")
        .otherwise("data")
    )


def sheet_profiles(rows: DataFrame, sample: int = 500) -> DataFrame:
    """(path, stem, sheet, sheet_type, key_column, has_sub_headers) of every sheet by its first ``sample`` rows.

    ``rows``: path, stem, sheet, row_index, headers, cells.
    """
    chars = F.aggregate("cells", F.lit(0), lambda s, c: s + F.length(c))
    one = rows.filter(F.col("sheet").isNotNull() & (F.col("row_index") < sample)).groupBy("path", "stem", "sheet").agg(
        F.count(F.lit(1)).alias("n"), F.first("headers").alias("headers"), F.try_divide(F.sum(chars), F.sum(F.size("cells"))).alias("avg_len"), F.count_if(is_sub_header(F.col("cells"))).alias("subs")
    )
    named = lambda word: F.element_at(F.filter("headers", lambda h: F.lower(h).contains(word)), 1)
    first = lambda word: F.when(F.exists("headers", lambda h: F.lower(h).contains(word)), named(word))
    key = F.coalesce(*[first(w) for w in ("id", "name", "code", "key")], F.try_element_at("headers", F.lit(1)))
    return one.select("path", "stem", "sheet", sheet_type(F.size("headers"), F.col("n"), F.coalesce("avg_len", F.lit(0.0))).alias("sheet_type"), key.alias("key_column"), (F.col("subs") > 2).alias("has_sub_headers"))


def is_sub_header(cells: Column) -> Column:
    """Of several cells only the first isn't blank."""
    return (F.size(cells) > 1) & (strip(cells[0]) != "") & F.forall(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda c: strip(c) == "")


def key_column(headers: list[str]) -> str | None:
    """The first header that contains id, else name, code, key; else the first one."""
    for word in "id name code key".split():
        for h in headers:
            if word in h.lower():
                return h
    return headers[0] if headers else None


def _cell(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _sub_header(df: DataFrame) -> Column:
    first, *rest = df.columns
    blank = lambda c: strip(_cell(c)) == ""
    out = ~blank(first)
    for c in rest:
        out = out & blank(c)
    return out if rest else F.lit(False)


def classify_sheet(df: DataFrame, name: str) -> DataFrame:
    """One row: sheet_type, counts, key column, whether it has sub-headers."""
    cols = len(df.columns)
    if cols == 0:
        return df.sparkSession.createDataFrame([(name, "data", df.count(), 0, None, False)], "name string, sheet_type string, row_count bigint, col_count bigint, key_column string, has_sub_headers boolean")
    total = sum((F.length(_cell(c)) for c in df.columns), F.lit(0))
    one = df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(total) / (F.count(F.lit(1)) * cols), F.lit(0.0)).alias("avg_len"), F.coalesce(F.count_if(_sub_header(df)), F.lit(0)).alias("subs"))
    kind = sheet_type(F.lit(cols), F.col("row_count"), F.col("avg_len"))
    return one.select(F.lit(name).alias("name"), kind.alias("sheet_type"), "row_count", F.lit(cols).cast("bigint").alias("col_count"), F.lit(key_column(df.columns)).alias("key_column"), (F.col("subs") > 2).alias("has_sub_headers"))


def rows_to_documents(df: DataFrame, stem: str, sheet: str | None = None, key: str | None = None, index: str | None = None, skip_sub_headers: bool = True) -> DataFrame:
    """(document_id, text): one document a row, 'header: value' lines of its cells that aren't blank.

    ``index``: a column with the row's number for rows without a key; it is no cell.
    """
    cells = [c for c in df.columns if c != index]
    body = df.select(*cells, *([index] if index else []))
    if skip_sub_headers:
        body = body.filter(~_sub_header(df.select(*cells)))
    key = key or key_column(cells)
    lines = F.filter(F.array(*[F.when(strip(_cell(c)) != "", F.concat(F.lit(f"{c}: "), strip(_cell(c)))) for c in cells]), lambda x: x.isNotNull())
    k = strip(F.left(F.translate(strip(_cell(key)), "/", "-"), F.lit(60)))
    row = F.concat(F.lit("row:"), F.col(index).cast("string")) if index else F.lit("row")
    doc_id = F.concat_ws(":", F.lit(stem), *([F.lit(sheet)] if sheet else []), F.when(k != "", k).otherwise(row))
    return body.select(doc_id.alias("document_id"), F.array_join(lines, "\n").alias("text")).filter("text <> ''")


def sheet_to_document(df: DataFrame, stem: str, sheet: str | None = None, order: str = "row_index") -> DataFrame:
    """One document for a whole sheet, laid out as a right-aligned table. A sheet is one document, so it is put together in one task."""
    cells = [c for c in df.columns if c != order]
    doc_id = f"{stem}:{sheet}" if sheet else stem

    def layout(pdf):
        import pandas as pd

        body = pdf.sort_values(order)[cells].fillna("")
        return pd.DataFrame({"document_id": [doc_id], "text": [body.to_string(index=False)]})

    return df.groupBy(F.lit(1).alias("__one")).applyInPandas(lambda pdf: layout(pdf), "document_id string, text string")
