"""All registered queries of the engine and their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmill.functions import spans as S, text as X
from quillmill.operators import chunking, classify, fidelity, graph, metrics, pii, redaction, verify
from quillmill.plans import tables as T
from quillmill.plans.sql import ORACLE

_QUERIES: dict = {}


def _query(f):
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLE.items() if k in _QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_weak_signals(spark, sf_dir)


def _text(c):
    return F.array_join(c, ",")


@_query
def verify_weak_signals(spark, d):
    return verify.weak_signal_scan(T.documents(spark, d)).select("document_id", _text("signals").alias("signals"), "snippet")


@_query
def verify_structural(spark, d):
    return verify.structural(T.documents(spark, d))


@_query
def verify_status(spark, d):
    return verify.status(T.documents(spark, d))


@_query
def normalise_text(spark, d):
    raw = F.concat(F.lit("the author’ $ and clerk'$ note\n 12 | P a g e\n"), "text", F.lit("\nhttp:llwww.example.org"))
    return T.documents(spark, d).select("document_id", X.normalise_text(raw).alias("text"))


@_query
def text_coverage(spark, d):
    p = T.paged(spark, d)
    return p.select("document_id", F.round(X.text_coverage(F.col("pages")), 6).alias("coverage"), F.size("pages").cast("bigint").alias("n_pages"))


@_query
def full_text_pages(spark, d):
    p = T.paged(spark, d)
    return p.select("document_id", X.full_text(F.col("pages")).alias("full_text"), _text(X.blank_page_warnings(F.col("pages"), F.lit("native"))).alias("warnings"))


@_query
def doc_profile(spark, d):
    lines = F.split("text", "\n")
    n = lambda f: F.size(F.filter(lines, f)).cast("int")
    docs = T.documents(spark, d).select(
        "document_id", "doc_id", F.size(lines).alias("total"), n(lambda t: F.length(t) > 100).alias("text_pages"), n(lambda t: F.length(t) < 30).alias("image_pages"), n(lambda t: t.contains(" | ")).alias("tables"), n(lambda t: t.contains("%")).alias("hand")
    )
    m = F.pmod("doc_id", F.lit(7))
    glyph, ocr = F.when(m < 4, m / 5), F.when(m == 4, F.lit(80.0)).when(m == 5, F.lit(40.0))
    c = classify.classify_document(F.col("text_pages"), F.col("image_pages"), F.col("tables"), F.col("hand"), ocr, glyph, F.lit(None).cast("double"), F.col("total"))
    return docs.select("document_id", c.alias("c")).select("document_id", "c.doc_type", F.round("c.confidence", 6).alias("confidence"), classify.strategy(F.col("c.doc_type")).alias("strategy"))


@_query
def file_routing(spark, d):
    ext = F.element_at(F.array(*[F.lit(x) for x in ("PDF", "csv", "xlsx", "docx", "txt", "png")]), (F.pmod("doc_id", F.lit(6)) + 1).cast("int"))
    path = F.concat("source", F.lit("/"), "document_id", F.lit("."), ext)
    return T.documents(spark, d).select(path.alias("path"), classify.file_type(path).alias("file_type"), classify.strategy(classify.file_type(path)).alias("strategy"))


@_query
def sheet_classify(spark, d):
    out = None
    for name in ("nation", "region", "customer", "supplier"):
        df = T.table(spark, d, name)
        df = df.select(*[F.col(c).cast("decimal(12,2)").cast("string").alias(c) if t == "double" else F.col(c).cast("string").alias(c) for c, t in df.dtypes])
        one = classify.classify_sheet(df, name)
        out = one if out is None else out.unionByName(one)
    return out


@_query
def row_documents(spark, d):
    return classify.rows_to_documents(T.customer_sheet(spark, d), "customer", index="row_index")


@_query
def markdown_table(spark, d):
    n = T.table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    rows = F.transform("r", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    return n.select("n_regionkey", X.table_to_markdown(F.array(F.lit("key"), F.lit("name"), F.lit("note")), rows).alias("markdown"))


@_query
def structural_fidelity(spark, d):
    return fidelity.structural_fidelity(T.customer_sheet(spark, d).drop("row_index"), T.customer_copy(spark, d).drop("row_index"))


@_query
def cell_integrity(spark, d):
    return fidelity.data_integrity(T.customer_sheet(spark, d), T.customer_copy(spark, d)).withColumn("score", F.round("score", 9))


@_query
def first_mismatches(spark, d):
    return fidelity.first_mismatches(T.customer_sheet(spark, d), T.customer_copy(spark, d))


@_query
def key_preservation(spark, d):
    return fidelity.key_preservation(T.customer_sheet(spark, d), T.customer_copy(spark, d), "c_custkey")


@_query
def duplicate_keys(spark, d):
    return fidelity.duplicate_keys(T.customer_copy(spark, d), "c_custkey")


@_query
def lineitem_integrity(spark, d):
    """Cells of two large tables aligned by position: rows are numbered without a single-partition window."""
    df = T.table(spark, d, "lineitem")
    li = fidelity.with_row_index(df, "l_orderkey", "l_linenumber", *[c for c in df.columns if c not in ("l_orderkey", "l_linenumber")])
    copy = li.withColumns({"l_returnflag": F.when(F.col("row_index") % 1000 == 7, "?").otherwise(F.col("l_returnflag")), "l_quantity": F.when(F.col("row_index") % 500 == 3, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))})
    return fidelity.data_integrity(li, copy).withColumn("score", F.round("score", 9))


@_query
def resume_anti_join(spark, d):
    docs = T.documents(spark, d)
    done = T.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("document_id"))
    return docs.join(done, "document_id", "left_anti").select("document_id", "source_path")


@_query
def batch_summary(spark, d):
    labels = T.table(spark, d, "labels").select(F.col("doc_id").alias("l_id"), "quality")
    j = T.documents(spark, d).join(labels, F.col("doc_id") == F.col("l_id"), "left")
    s = F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 1, "completed").otherwise("error")
    return j.withColumn("status", s).groupBy("source").agg(F.count_if(F.col("status") == "completed").alias("succeeded"), F.count_if(F.col("status") == "error").alias("failed"), F.count_if(F.col("status") == "pending").alias("pending"))


@_query
def span_chunk_overlap(spark, d):
    spans = T.line_spans(spark, d)
    return graph.span_chunks(spans, T.windows(spark, d)).select("document_id", "start", "end", "chunk_index")


@_query
def span_containment(spark, d):
    """Whether a window that a line overlaps holds all of it."""
    w = T.windows(spark, d).select("document_id", "chunk_index", "start_char", "end_char")
    pairs = graph.span_chunks(T.line_spans(spark, d), T.windows(spark, d)).join(w, ["document_id", "chunk_index"])
    return pairs.select("document_id", "ord", "chunk_index", X.span_contains(F.col("start_char"), F.col("end_char"), F.col("start"), F.col("end")).alias("whole"))


@_query
def mention_first_chunk(spark, d):
    spans = T.line_spans(spark, d).select("document_id", "start", "end")
    return graph.first_chunk(spans, T.windows(spark, d), ["document_id", "start", "end"])


@_query
def entity_mentions(spark, d):
    return graph.entity_mentions(T.enriched(spark, d), T.windows(spark, d))


@_query
def graph_edges_flat(spark, d):
    return graph.edges_to_rows(graph.edges(T.enriched(spark, d), T.windows(spark, d)))


@_query
def graph_nodes(spark, d):
    n = graph.nodes(T.enriched(spark, d), T.windows(spark, d))
    return n.select("document_id", "node_id", "label", F.size("props").cast("bigint").alias("n_props"))


@_query
def graph_edge_counts(spark, d):
    return graph.edges(T.enriched(spark, d), T.windows(spark, d)).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document_id").alias("n_docs"))


@_query
def graph_dangling_ends(spark, d):
    e, c = T.enriched(spark, d), T.windows(spark, d)
    return graph.dangling(graph.edges(e, c), graph.nodes(e, c).filter("label <> 'location'"))


@_query
def edges_for_document(spark, d):
    e = graph.edges_to_rows(graph.edges(T.enriched(spark, d), T.windows(spark, d)))
    return graph.edges_for_document(e, "7", "mentioned_in")


@_query
def mentions_for_document(spark, d):
    return graph.mentions_for_document(graph.entity_mentions(T.enriched(spark, d), T.windows(spark, d)), "7", "person")


@_query
def pii_spans(spark, d):
    return pii.spans_from_mentions(graph.entity_mentions(T.enriched(spark, d), T.windows(spark, d)))


@_query
def enrichment_meta(spark, d):
    return graph.enrichment_meta(T.enriched(spark, d))


@_query
def known_pii_spans(spark, d):
    k = graph.known_spans(T.enriched(spark, d), ("PERSON", "ADDRESS", "EMAIL"))
    return k.select("document_id", F.explode("known").alias("k")).select("document_id", "k.*")


@_query
def clean_known_spans(spark, d):
    """Known spans clipped to chunks, overlaps resolved, replaced by tags; no other detection."""
    k = graph.known_spans(T.enriched(spark, d), ("PERSON", "ADDRESS", "EMAIL"))
    c = T.windows(spark, d).join(k, "document_id", "left")
    found = S.keep_first(S.rebase_known(F.coalesce("known", F.array()), F.col("start_char"), F.length("text")), by_score=True)
    return c.withColumn("f", found).select("document_id", "chunk_index", F.size("f").cast("bigint").alias("n"), S.splice(F.col("text"), F.col("f")).alias("text_clean"))


@_query
def cer_pairs(spark, d):
    """Every benchmark text against its neighbour's; accented letters get capitals as names, since the other engine counts bytes."""
    b = T.table(spark, d, "benchmark").select("item_id", F.translate(F.lower("text"), *T.ACCENTS).alias("reference"))
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("reference").alias("hypothesis"))
    return b.join(other, "item_id").select("item_id", F.round(X.character_error_rate(F.col("reference"), F.col("hypothesis")), 6).alias("cer"))


@_query
def bbox_iou(spark, d):
    li = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_discount") * 100).alias("k"))
    box = lambda x, y, w, h: F.struct(x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))
    a = box(F.col("k"), F.col("k"), F.col("l_quantity"), F.lit(10.0))
    b = box(F.lit(5.0), F.lit(3.0), F.lit(20.0), F.col("l_quantity"))
    return li.select("l_orderkey", "l_linenumber", F.round(X.iou(a, b), 6).alias("iou"))


@_query
def cosine_reference(spark, d):
    e = T.table(spark, d, "embeddings")
    refs = e.filter("vec_id < 12").select(F.col("embedding").alias("ref"))
    # twelve reference vectors, as many as the method has
    return e.crossJoin(F.broadcast(refs)).groupBy("vec_id").agg(F.round(F.max(X.cosine(F.col("embedding"), F.col("ref"))), 5).alias("best"))


@_query
def title_case_groups(spark, d):
    docs = T.documents(spark, d)
    found = docs.select("document_id", F.explode(S.title_case_candidates(F.col("text"))).alias("name"))
    return found.groupBy("document_id", "name").agg(F.count(F.lit(1)).alias("n"))


@_query
def common_word_filter(spark, d):
    docs = T.documents(spark, d).select("document_id", F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    tagged = docs.withColumn("head", F.substring_index("line", " ", 2)).unionByName(docs.select("document_id", "line", F.lit("New South").alias("head")))
    return tagged.groupBy("document_id").agg(F.count_if(S.is_all_common(F.col("head"))).alias("n_common"), F.count(F.lit(1)).alias("n"))


@_query
def table_structure(spark, d):
    return T.documents(spark, d).select("document_id", classify.has_table_structure(F.regexp_replace("text", " \\| ", "|x\n")).alias("has_table"))


@_query
def page_sampling(spark, d):
    docs = T.documents(spark, d).select("document_id", classify.sampled_pages(F.col("page_count")).alias("p"))
    return docs.select("document_id", _text(F.col("p").cast("array<string>")).alias("pages"))


@_query
def redaction_modes(spark, d):
    p = T.paged(spark, d)
    affected = F.array(F.lit(0), F.lit(2))
    full = lambda mode: X.full_text(redaction.apply_text_redaction(F.col("pages"), affected, mode))
    return p.select("document_id", full("blackout").alias("blackout"), full("delete").alias("deleted"))


@_query
def layout_runs(spark, d):
    """Neighbouring lines with the same first letter merged to one box: gaps and islands."""
    s = T.line_spans(spark, d).select("document_id", F.col("ord"), F.lower(F.left("line", F.lit(1))).alias("label"), F.col("start").cast("double").alias("x0"), F.col("ord").cast("double").alias("y0"), F.col("end").cast("double").alias("x1"), (F.col("ord") + 1).cast("double").alias("y1"))
    return metrics.merge_runs(s)


@_query
def region_words(spark, d):
    n = T.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("document_id"), F.lit(0).alias("ord"), "text", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(100.0).alias("x1"), F.lit(10.0).alias("y1"))
    w = metrics.words_with_boxes(n)
    return w.select("document_id", F.col("word_no").cast("bigint").alias("word_no"), "word", F.round("x0", 5).alias("x0"), F.round("x1", 5).alias("x1"))


@_query
def layout_scores(spark, d):
    """Lines as regions labelled by their first letter, against the same with every fifth label changed and every seventh moved away."""
    s = T.line_spans(spark, d)
    letter = F.lower(F.left("line", F.lit(1)))
    box = lambda label, shift: s.select("document_id", "ord", label.alias("label"), (F.col("start") + shift).cast("double").alias("x0"), F.lit(0.0).alias("y0"), (F.col("end") + shift).cast("double").alias("x1"), F.lit(1.0).alias("y1"))
    counts = metrics.match_layout(box(letter, F.lit(0)), box(F.when(F.col("ord") % 5 == 0, "?").otherwise(letter), F.when(F.col("ord") % 7 == 0, 10_000_000).otherwise(0)))
    return metrics.precision_recall(counts).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@_query
def ocr_confidence(spark, d):
    r = T.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("document_id"), F.col("l_linenumber").alias("page_number"), F.col("l_discount").alias("confidence"), F.array(F.col("l_returnflag"), F.col("l_linestatus")).alias("steps"))
    return metrics.page_confidence(r).select("document_id", F.round("confidence", 6).alias("confidence"), _text("steps").alias("steps"))


@_query
def tag_counts(spark, d):
    k = graph.known_spans(T.enriched(spark, d), ("PERSON", "ADDRESS", "EMAIL"))
    c = T.documents(spark, d).join(k, "document_id", "left")
    found = S.keep_first(S.rebase_known(F.coalesce("known", F.array()), F.lit(0), F.length("text")), by_score=True)
    return pii.tag_counts(c.select(S.splice(F.col("text"), found).alias("text_clean")))


@_query
def events_by_window(spark, d):
    """The batch form of the streaming aggregation over event time."""
    from quillmill.streaming.events import windowed_counts

    w = windowed_counts(T.table(spark, d, "events"), "1 day", watermark=None)
    return w.select(F.col("window_start").cast("string").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@_query
def metric_forms(spark, d):
    return T.documents(spark, d).select("document_id", X.metric_form("text").alias("form"))


@_query
def chunk_source_pages(spark, d):
    """The lines that every window covers, as pages."""
    pages = T.line_spans(spark, d).select("document_id", F.col("ord").alias("page_number"), F.col("start").alias("page_start"), F.col("end").alias("page_end"))
    got = chunking.source_pages(T.windows(spark, d), pages)
    return got.select("document_id", "chunk_index", _text(F.col("source_pages").cast("array<string>")).alias("pages"))


@_query
def redacted_chunks(spark, d):
    """Windows on redacted pages: every line that begins with a vowel is one."""
    lines = T.line_spans(spark, d)
    pages = lines.select("document_id", F.col("ord").alias("page_number"), F.col("start").alias("page_start"), F.col("end").alias("page_end"))
    affected = lines.filter(F.lower(F.left("line", F.lit(1))).isin(*"aeiou")).groupBy("document_id").agg(F.collect_set("ord").alias("pages"))
    chunks = chunking.source_pages(T.windows(spark, d), pages).withColumn("page_number", F.lit(None).cast("int"))
    return chunking.flag_redacted(chunks, affected).select("document_id", "chunk_index", "has_redaction")


@_query
def page_structure(spark, d):
    """Detected tables and form fields, from the tables' own counts: lines by bars, short lines as labels."""
    lines = F.split("text", "\n")
    shape = F.array(F.struct(F.size(F.filter(lines, lambda t: t.contains(" | "))).alias("rows"), F.lit(2).alias("cols")))
    docs = T.documents(spark, d)
    return docs.select("document_id", classify.has_structural_tables(shape).alias("has_table"), classify.has_form_structure((F.col("doc_id") % 3).cast("int"), lines).alias("has_form"))


@_query
def graph_edges_from(spark, d):
    e = graph.edges(T.enriched(spark, d), T.windows(spark, d))
    out = graph.edges_from(e, "7:p1").withColumn("way", F.lit("from")).unionByName(graph.edges_to(e, "7:p1").withColumn("way", F.lit("to"))).unionByName(graph.edges_by_relation(e, "cites").withColumn("way", F.lit("cites")))
    return out.select("way", "source_id", "target_id", "relation")


@_query
def first_bad_keys(spark, d):
    """The report's first missing and repeated keys."""
    a, b = T.customer_sheet(spark, d), T.customer_copy(spark, d)
    kinds = (("missing", fidelity.missing_keys(a, b, "c_custkey")), ("repeated", fidelity.duplicate_keys(b, "c_custkey")))
    one, two = (fidelity.first_keys(df).withColumn("kind", F.lit(kind)) for kind, df in kinds)
    return one.unionByName(two)


@_query
def spatial_sort(spark, d):
    return metrics.spatial_sort(_word_boxes(spark, d, 0.0))


@_query
def spatial_errors(spark, d):
    named = lambda df: df.withColumn("text", F.translate(F.lower("text"), *T.ACCENTS))
    got = metrics.cer_spatial(named(_word_boxes(spark, d, 0.0)), named(_word_boxes(spark, d, 2.0)).filter("ord % 17 <> 3"))
    return got.select("document_id", F.round("cer", 6).alias("cer"))


@_query
def reading_order(spark, d):
    got = metrics.reading_order(_word_boxes(spark, d, 0.0), _word_boxes(spark, d, 2.0).withColumn("ord", F.when(F.col("ord") % 5 == 0, F.col("ord") + 2).otherwise(F.col("ord"))))
    return got.select("document_id", F.round("accuracy", 6).alias("accuracy"))


@_query
def redaction_detect(spark, d):
    """A page a document, with as many dark boxes as its id says, found again in the raster."""
    from quillmill.plans.rasters import pages_with_boxes

    reports = redaction.redaction_reports(pages_with_boxes(T.documents(spark, d)))
    return reports.select("document_id", "total", _text(F.col("affected_pages").cast("array<string>")).alias("pages"), _text(redaction.redaction_warnings(F.col("report"))).alias("warnings"))


@_query
def redacted_count(spark, d):
    from quillmill.plans.rasters import pages_with_boxes

    return redaction.redacted_documents(redaction.redaction_reports(pages_with_boxes(T.documents(spark, d))))


# == not expressible in SQL: tests hold these against brute force over the whole tables


@_query
def chunk_documents(spark, d):
    return chunking.chunk_documents(T.documents(spark, d), 200, overlap=0.1)


@_query
def chunk_summary(spark, d):
    return chunking.chunk_counts(chunking.chunk_documents(T.documents(spark, d), 200))


@_query
def pii_clean(spark, d):
    return pii.clean(T.documents(spark, d), entities=("PERSON", "ADDRESS")).select("document_id", "text_clean", "pii_count")


@_query
def word_errors(spark, d):
    b = T.table(spark, d, "benchmark").select("item_id", "text")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("hypothesis"))
    return b.join(other, "item_id").select("item_id", X.word_error_rate(X.metric_form("text"), X.metric_form("hypothesis")).alias("wer"))


def _word_boxes(spark, d, shift: float):
    w = F.posexplode(F.filter(F.split("text", r"(?U)\s+"), lambda t: t != "")).alias("ord", "text")
    b = T.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("document_id"), w)
    x, y = F.col("ord") % 10 * 12.0 + shift, F.floor(F.col("ord") / 10) * 15.0
    return b.select("document_id", "ord", "text", x.alias("x0"), y.alias("y0"), (x + 10).alias("x1"), (y + 10).alias("y1"))
