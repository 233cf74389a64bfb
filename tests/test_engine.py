import json
import os
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill import cli, config
from quillmill.functions.enrichment import parse
from quillmill.operators import classify, enrich, fidelity, graph, images, metrics, redaction, verify
from quillmill.sources import backends, files, office, sinks, tabular
from quillmill.streaming import events, ingest

# == verification and fidelity


def frame(spark, rows, schema="document_id string, source_path string, text string"):
    return spark.createDataFrame(rows, schema)


def test_structure_and_status(spark):
    good = frame(spark, [(str(i), "p", "fine text") for i in range(20)])
    assert verify.status(good).first()["overall_status"] == "passed"
    dup = frame(spark, [("1", "p", "t"), ("1", "p", "t"), (None, "p", "t"), (None, "p", "t")])
    assert verify.structural(dup).first()["duplicate_ids"] == 2 and verify.status(dup).first()["overall_status"] == "failed"
    some = frame(spark, [(str(i), "p", "%%&&" if i < 2 else "fine") for i in range(20)])
    assert verify.status(some).first().asDict() == {"overall_status": "warning", "structural_passed": True, "flagged_count": 2, "total_docs": 20}
    assert verify.status(frame(spark, [(str(i), "p", "%%&&" if i < 4 else "fine") for i in range(20)])).first()["overall_status"] == "failed"
    assert verify.structural(good.drop("text")).first()["missing_columns"] == "text"
    assert verify.status(frame(spark, [])).first()["overall_status"] == "passed"
    nested = frame(spark, [("1", "p", "t", (0.2, 3))], "document_id string, source_path string, text string, metadata struct<confidence:double,page_count:int>")
    assert verify.weak_signal_scan(verify.flatten_metadata(nested)).first()["signals"] == ["low_confidence"]


def test_cells_and_keys(spark):
    s = frame(spark, [(0, "1", "a"), (1, "2", None)], "row_index bigint, id string, v string")
    e = frame(spark, [(0, "1", "x"), (1, "2", "")], "row_index bigint, id string, v string")
    r = fidelity.data_integrity(s, e).first()
    assert (r["passed"], r["total_cells"], r["mismatched_cells"], r["score"]) == (False, 4, 1, 0.75)
    assert fidelity.data_integrity(s, e.select("row_index", F.col("v").alias("other"))).first()["score"] in (0.0, 1.0)
    assert fidelity.data_integrity(s.select("row_index", "id"), e.select("row_index", F.col("v").alias("o"))).first()["score"] == 0.0
    assert fidelity.data_integrity(s.limit(0), e).first().asDict() == {"passed": True, "total_cells": 0, "mismatched_cells": 0, "score": 1.0}
    assert fidelity.first_mismatches(s, e).collect()[0].asDict() == {"row_index": 0, "column": "v", "source_value": "a", "extracted_value": "x"}
    k = fidelity.key_preservation(s, frame(spark, [("1",), ("1",), ("3",)], "id string"), "id").first()
    assert (k["missing_keys"], k["duplicate_keys"], k["passed"]) == (1, 1, False)
    f = fidelity.structural_fidelity(s, e.drop("v")).first()
    assert f["missing_columns"] == "v" and not f["passed"]
    assert fidelity.schema_conforms(s, e.schema) and not fidelity.schema_conforms(s, e.drop("v").schema)


def test_row_index_follows_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(6)
    got = fidelity.with_row_index(df, "v").collect()
    assert sorted((r["v"], r["row_index"]) for r in got) == [(i, i) for i in range(1000)]


# == classification


@pytest.mark.parametrize(
    "signals, want",
    [
        ((5, 0, 0, 0, None, None, None, 5), ("native_narrative", 0.95)), ((5, 0, 5, 0, None, None, None, 5), ("structured", 0.85)), ((5, 0, 2, 0, None, None, None, 5), ("native_with_structured", 0.85)),
        ((4, 1, 0, 0, None, None, None, 5), ("native_with_structured", 0.85)), ((1, 4, 0, 0, None, None, None, 5), ("hybrid", 0.65)), ((0, 5, 0, 5, None, None, None, 5), ("scanned_handwritten", 0.75)),
        ((0, 5, 0, 2, None, None, None, 5), ("scanned_mixed", 0.70)), ((0, 5, 0, 0, None, 0.8, 0.8, 5), ("scanned_machinewritten", 0.82)), ((0, 5, 0, 0, None, 0.2, 0.3, 5), ("scanned_handwritten", 0.6)),
        ((0, 5, 0, 0, 90.0, None, None, 5), ("scanned_machinewritten", 0.85)), ((0, 5, 0, 0, 30.0, None, None, 5), ("unknown", 0.4)), ((0, 5, 0, 0, None, None, None, 5), ("scanned_machinewritten", 0.5)),
        ((0, 0, 0, 0, None, None, None, 5), ("unknown", 0.3)), ((0, 0, 0, 0, None, None, None, 0), ("unknown", 0.0)),
    ],
)
def test_decision_tree(spark, signals, want):
    schema = "a int, b int, c int, d int, o double, g double, s double, n int"
    r = spark.createDataFrame([signals], schema).select(classify.classify_document(*[F.col(x) for x in "abcdogsn"]).alias("r")).first()["r"]
    assert r["doc_type"] == want[0] and abs(r["confidence"] - want[1]) < 1e-9


def test_tables_in_text(spark):
    t = lambda s: spark.createDataFrame([(s,)], "t string").select(classify.has_table_structure(F.col("t"))).first()[0]
    assert t("a | b | c\nd | e | f\ng | h | i\n") and t("a\tb\tc\nd\te\tf\n") and not t("plain prose here.\nmore of it.\n") and not t("") and t("  aa  bb cc\n  dd  ee\n  ff  gg\n")


def test_profiles_of_sampled_pages(spark):
    rows = [("d", i, "t" * 200 if i % 2 == 0 else "", 0 if i % 2 == 0 else 1, 0, False, False, None, None, None) for i in range(20)]
    df = spark.createDataFrame(rows, "document_id string, page_number int, text string, n_images int, n_drawings int, has_table boolean, handwriting boolean, ocr_confidence double, glyph double, stroke double")
    r = classify.profile_pages(df).first()
    assert r["total_pages"] == 20 and r["text_pages"] == 20 and r["doc_type"] == "native_narrative"  # pages 0, 4, 8, 12, 16


def test_sheets_and_rows(spark):
    df = spark.createDataFrame([("A/1", "x", ""), ("", "y", ""), ("only", "", ""), ("B", None, "z ")], "Provider string, Name string, Note string")
    assert classify.key_column(["Provider", "Name"]) == "Provider" and classify.key_column(["x", "code"]) == "code" and classify.key_column(["x", "y"]) == "x"
    got = {r["document_id"]: r["text"] for r in classify.rows_to_documents(df.withColumn("i", F.monotonically_increasing_id()), "s", "sh", index="i").collect()}
    assert got["s:sh:A-1"] == "Provider: A/1\nName: x" and got["s:sh:B"] == "Provider: B\nNote: z" and not any("only" in k for k in got) and len(got) == 3
    kind = lambda rows, cols: classify.classify_sheet(spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(cols))), "s").first()
    assert kind([("a",)], 1)["sheet_type"] == "narrative" and kind([("a", "b")] * 60, 2)["sheet_type"] == "glossary" and kind([("a", "b")], 2)["sheet_type"] == "key_value" and kind([("a", "b", "c")], 3)["sheet_type"] == "data"
    assert kind([("long" * 200, "", "")], 3)["sheet_type"] == "narrative" and kind([("h", "", "")] * 3 + [("a", "b", "c")], 3)["has_sub_headers"]
    whole = classify.sheet_to_document(spark.createDataFrame([(0, "a", "1"), (1, "bb", "22")], "row_index int, x string, y string"), "stem", "sh").first()
    assert whole["document_id"] == "stem:sh" and [line.split() for line in whole["text"].split("\n")] == [["x", "y"], ["a", "1"], ["bb", "22"]]


# == graph


@pytest.fixture(scope="module")
def enriched(spark):
    text = "Alice Smith lives in Perth. See Section 2 of the Act for the Term used by her."
    sp = lambda s: {"start": text.index(s), "end": text.index(s) + len(s)}
    e = {
        "text": text, "type": "decision", "jurisdiction": None, "title": sp("Alice Smith"),
        "segments": [{"id": "s1", "kind": "container", "category": "main", "span": {"start": 0, "end": len(text)}, "level": 0}, {"id": "s2", "kind": "unit", "category": "main", "span": sp("See Section 2"), "parent": "s1", "level": 1}],
        "crossreferences": [{"start": "s1", "end": "s2", "span": sp("Section 2")}],
        "persons": [{"id": "p1", "name": sp("Alice Smith"), "type": "natural", "role": "other", "mentions": [sp("Alice Smith")], "residence": "l1"}],
        "locations": [{"id": "l1", "name": sp("Perth"), "type": "city", "mentions": [sp("Perth")]}],
        "terms": [{"id": "t1", "name": sp("Term"), "meaning": sp("used"), "mentions": [sp("Term")]}],
        "external_documents": [{"id": "x1", "name": sp("Act"), "type": "statute", "reception": "neutral", "mentions": [sp("Act")]}],
        "emails": [{"address": "a@b.org", "person": "p1", "mentions": []}], "dates": [{"value": "2024-01-01", "type": "effective", "mentions": []}, {"value": "2000-01-01", "type": "birth", "person": "p1"}],
    }
    df = spark.createDataFrame([("doc1", json.dumps(e))], "document_id string, json string").select("document_id", parse(F.col("json")).alias("e"))
    cut = text.index("See")
    chunks = spark.createDataFrame([("doc1", 0, 0, cut, "narrative", text[:cut]), ("doc1", 1, cut, len(text), "narrative", text[cut:]), ("doc1", 2, 0, 99, "table", "| t |")], "document_id string, chunk_index int, start_char int, end_char int, content_type string, text string")
    return df, chunks, text


def test_graph_nodes_and_edges(enriched):
    e, c, text = enriched
    c = c.filter("content_type = 'narrative'")
    n = graph.nodes(e, c).collect()
    assert len(n) == 9 and {r["label"] for r in n} == {"document", "chunk", "segment", "person", "location", "term", "external_document"}
    edges = graph.edges(e, c).collect()
    has = lambda a, b, rel: any((r["source_id"], r["target_id"], r["relation"]) == (a, b, rel) for r in edges)
    for a, b, rel in (("doc1", "doc1:s1", "contains"), ("doc1:s1", "doc1:s2", "parent_of"), ("doc1", "doc1:chunk:0", "contains"), ("doc1:s2", "doc1:chunk:1", "spans_chunk"), ("doc1:p1", "doc1:l1", "resides_at"), ("doc1:p1", "doc1:chunk:0", "mentioned_in"), ("doc1", "doc1:x1", "cites"), ("doc1:s1", "doc1:s2", "crossreferences"), ("doc1:s1", "doc1:chunk:1", "crossref_in"), ("doc1:p1", "doc1:p1", "has_email"), ("doc1", "doc1", "date_effective"), ("doc1", "doc1:p1", "date_birth")):
        assert has(a, b, rel)
    assert graph.dangling(graph.edges(e, c), graph.nodes(e, c)).count() == 0
    rows = graph.edges_to_rows(graph.edges(e, c))
    again = graph.rows_to_edges(rows, regroup=True)
    pair = again.filter("relation = 'mentioned_in' AND source_id = 'doc1:p1'").first()["props"]
    assert pair == {"start": "0", "end": "11"} and graph.rows_to_edges(rows).count() == rows.count()
    assert graph.edges_for_document(rows, "doc1", "cites").count() == 1 and graph.edges_for_document(rows, "none").count() == 0


def test_mentions_meta_and_spans(enriched):
    from quillmill.operators import pii

    e, c, text = enriched
    m = graph.entity_mentions(e, c).collect()
    assert {(r["entity_label"], r["name"], r["chunk_index"]) for r in m} == {("person", "Alice Smith", 0), ("location", "Perth", 0), ("term", "Term", 1), ("external_document", "Act", 1)}
    assert [r["entity_label"] for r in pii.spans_from_mentions(graph.entity_mentions(e, c)).collect()] == ["person", "location"]
    meta = graph.enrichment_meta(e).first()
    assert (meta["title"], meta["jurisdiction"], meta["segment_count"], meta["person_count"], meta["date_count"], meta["junk_span_count"]) == ("Alice Smith", "", 2, 1, 2, 0)
    assert [tuple(k) for k in graph.known_spans(e, ("PERSON", "ADDRESS")).first()["known"]] == [(0, 11, "PERSON")]
    none = graph.entity_mentions(e, c.filter("false"))
    assert {r["chunk_index"] for r in none.collect()} == {-1}


def test_bins_of_offsets_change_nothing(spark):
    rng = np.random.default_rng(7)
    a = [(f"d{rng.integers(2)}", int(x), int(x + rng.integers(0, 300))) for x in rng.integers(0, 1000, 120)]
    b = [(f"d{rng.integers(2)}", i, int(x), int(x + rng.integers(1, 400)), "narrative") for i, x in enumerate(rng.integers(0, 1000, 60))]
    spans = spark.createDataFrame(a, "document_id string, start int, end int")
    chunks = spark.createDataFrame(b, "document_id string, chunk_index int, start_char int, end_char int, content_type string")
    want = sorted((d, s, e, i) for d, s, e in a for dd, i, cs, ce, _ in b if d == dd and cs < e and s < ce)
    for size in (10, 97, 10**6):
        assert sorted(tuple(r) for r in graph.span_chunks(spans, chunks, bin_chars=size).collect()) == want


def test_retries():
    seen, slept = [], []

    def call(texts):
        seen.append(1)
        if len(seen) == 1:
            raise ValueError("HTTP 429")
        return texts

    assert enrich.with_retries(call, ["a"], 3, 1.0, slept.append) == ["a"] and len(seen) == 2 and slept == [1.0]
    for message in ("failed to generate", "HTTP 500"):
        seen.clear()

        def bad(texts):
            seen.append(1)
            raise ValueError(message)  # noqa: B023

        with pytest.raises(RuntimeError):
            enrich.with_retries(bad, ["a"], 3, 1.0, slept.append)
        assert len(seen) == 1


def test_enrich_stage(spark):
    docs = spark.createDataFrame([("1", "long enough text"), ("2", "x")], "document_id string, text string")
    got = enrich.enrich(docs, lambda: lambda ts: [json.dumps({"text": t}) for t in ts], least_chars=5, concurrency=2).collect()
    assert [(r["document_id"], json.loads(r["json"])["text"], r["error"]) for r in got] == [("1", "long enough text", None)]


# == rasters, redaction, metrics


def test_redacted_regions():
    page = np.full((200, 300), 255, np.uint8)
    page[20:50, 30:120] = 0
    page[100:130, 40:200] = 0
    page[5, 5] = 0
    got = redaction.detect_regions(page)
    assert [(r["x"], r["y"], r["width"], r["height"]) for r in got] == [(30, 20, 90, 30), (40, 100, 160, 30)]
    assert redaction.detect_regions(np.zeros((50, 50), np.uint8)) == [] and redaction.detect_regions(np.full((50, 50), 255, np.uint8)) == []
    assert (redaction.mask_regions(page, got)[20:50, 30:120] == 255).all()


def test_redaction_of_texts(spark):
    df = spark.createDataFrame([([(0, "a"), (1, "b")],)], "pages array<struct<page_number:int,text:string>>")
    texts = lambda mode: [p["text"] for p in df.select(redaction.apply_text_redaction(F.col("pages"), F.array(F.lit(1)), mode).alias("p")).first()["p"]]
    assert texts("flag") == ["a", "b"] and texts("blackout") == ["a", "[REDACTED]\nb"] and texts("delete") == ["a", ""]
    with pytest.raises(ValueError):
        texts("other")
    rep = spark.createDataFrame([("d", 2, 20, 10, bytes(range(200)))], "document_id string, page_number int, width int, height int, pixels binary")
    assert redaction.redaction_reports(rep).first()["total"] >= 0


def test_image_heuristics():
    rng = np.random.default_rng(0)
    grid = np.full((200, 200), 255, np.uint8)
    grid[[20, 100, 180], 10:190] = 0
    grid[10:190, [20, 100, 180]] = 0
    assert images.table_grid(grid) == {"has_grid": True, "horizontal_lines": 3, "vertical_lines": 3, "cell_count": 9}
    assert not images.table_grid(np.full((50, 50), 255, np.uint8))["has_grid"]
    noise = rng.integers(0, 256, (60, 60)).astype(np.uint8)
    assert images.blur_score(noise) > images.blur_score(np.full((60, 60), 9, np.uint8)) == 0 and images.blur_score(None) is None
    two = np.where(rng.random((40, 40)) < 0.5, 10, 240).astype(np.uint8)
    assert images.otsu(two)["is_bimodal"] is False and images.otsu(noise)["is_bimodal"] and 10 <= images.otsu(two)["threshold"] < 240
    assert images.histogram_facts(noise)["is_scanned"]
    ruled = np.full((600, 200), 255, np.uint8)
    ruled[20::30, 5:195] = 0
    assert images.has_ruled_lines(ruled) and not images.has_ruled_lines(grid)
    typed = np.full((300, 300), 255, np.uint8)
    for y in range(10, 290, 20):
        for x in range(10, 290, 20):
            typed[y : y + 10, x : x + 7] = 0
    assert images.glyph_regularity(typed) == 1.0 and images.glyph_regularity(grid) is None
    assert images.skew_angle([(0, 0, 10, 1)] * 6)[0] > 5 and images.skew_angle([]) == (0.0, 0.0) and images.needs_deskew(1.0, 0.5)
    assert images.stroke_consistency(np.full(200, 3.0)) == 1.0 and images.stroke_consistency(np.ones(5)) is None


def test_reading_order_and_layout(spark):
    w = lambda *ts: [(t, (x, y, x + 8, y + 10)) for t, x, y in ts]
    assert metrics.spatial_text(w(("b", 20, 1), ("a", 0, 0), ("c", 0, 30))) == "a b\nc" and metrics.spatial_text([]) == ""
    assert metrics.concordance([0, 1, 2]) == 1.0 and abs(metrics.concordance([0, 2, 1]) - 2 / 3) < 1e-9 and metrics.concordance([3]) == 1.0
    s = "document_id string, ord int, label string, x0 double, y0 double, x1 double, y1 double"
    p = spark.createDataFrame([("d", 0, "text", 0.0, 0.0, 10.0, 10.0), ("d", 1, "table", 20.0, 0.0, 30.0, 10.0), ("d", 2, "figure", 90.0, 90.0, 99.0, 99.0)], s)
    t = spark.createDataFrame([("d", 0, "text", 0.0, 0.0, 10.0, 9.0), ("d", 1, "title", 20.0, 0.0, 30.0, 10.0), ("d", 2, "list", 50.0, 50.0, 60.0, 60.0)], s)
    got = {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in metrics.match_layout(p, t).collect()}
    assert got == {"text": (1, 0, 0), "table": (0, 1, 0), "title": (0, 0, 1), "figure": (0, 1, 0), "list": (0, 0, 1)}
    f = {r["label"]: r["f1"] for r in metrics.precision_recall(metrics.match_layout(p, t)).collect()}
    assert f["text"] == 1.0 and f["table"] == 0.0


# == files


def make_docx(path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{para(t)}</w:tc>"
    body = para("Title", "Heading1") + para("") + para("Body text") + f"<w:tbl><w:tr>{cell('h1')}{cell('h2')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")


def make_xlsx(path):
    m, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>note</t></is></c></row><row><c r="A2"><v>7</v></c><c r="C2" t="b"><v>1</v></c></row></sheetData></worksheet>')


def make_shape(base, rings):
    recs = b""
    for i, ring in enumerate(rings):
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        c = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), 1, len(ring)) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
        recs += struct.pack(">2i", i + 1, len(c) // 2) + c
    open(f"{base}.shp", "wb").write(struct.pack(">i5i", 9994, 0, 0, 0, 0, 0) + struct.pack(">i", (100 + len(recs)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + recs)
    head = struct.pack("<B3BIHH20x", 3, 24, 1, 1, len(rings), 32 + 32 + 1, 11) + struct.pack("<11sc4xBB14x", b"NAME", b"C", 10, 0) + b"\r"
    open(f"{base}.dbf", "wb").write(head + b"".join(b" " + f"f{i}".ljust(10).encode() for i in range(len(rings))))
    open(f"{base}.prj", "w").write("GEOGCS[]")


def test_office_and_shapes(spark, tmp_path):
    make_docx(tmp_path / "a.docx")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    words = office.docx_rows(office.contents(spark, str(tmp_path), "*.docx"))
    got = {r["document_id"]: r for r in words.collect()}
    assert got["a"]["text"] == "Title\n\nBody text" and [b["block_type"] for b in got["a"]["text_blocks"]] == ["heading", "paragraph"] and got["a"]["tables"][0]["rows"] == [["1", "2"]] and "BadZipFile" in got["bad"]["error"]
    kinds = {r["path"].rsplit("/", 1)[-1]: tuple(r)[1:] for r in office.docx_profiles(words).collect()}
    assert kinds["a.docx"] == ("docx", 1, 1.0, False, True, 0.85) and kinds["bad.docx"][0] == "unknown" and kinds["bad.docx"][1] == 0 and kinds["bad.docx"][-1] == 0.3
    make_xlsx(tmp_path / "b.xlsx")
    r = office.sheet_rows(office.contents(spark, str(tmp_path / "b.xlsx"))).collect()
    assert len(r) == 1 and r[0]["headers"] == ["id", "name", "note"] and r[0]["cells"] == ["7", "", "True"] and r[0]["sheet"] == "S1"
    square = [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)]
    bow = [(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]
    make_shape(str(tmp_path / "s"), [square, bow])
    s = office.shape_rows(office.contents(spark, str(tmp_path), "s.*")).orderBy("feature").collect()
    assert [x["valid"] for x in s] == [True, False] and s[0]["attributes"] == {"NAME": "f0"} and s[0]["geometry_type"] == "Polygon" and s[0]["crs"] == "GEOGCS[]"
    assert struct.unpack_from("<BIII", s[0]["geometry"]) == (1, 3, 1, 5)


def test_shape_ingest(spark, tmp_path):
    from quillmill.sources import geo

    make_shape(str(tmp_path / "s"), [[(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)]])
    (tmp_path / "bad.shp").write_bytes(b"\0" * 130)
    got = {r["source"].rsplit("/", 1)[-1]: r for r in geo.ingest_shape_directory(spark, str(tmp_path), str(tmp_path / "out"))}
    assert got["s.shp"]["features"] == 1 and got["s.shp"]["geometry_type"] == "Polygon" and "bad.shp" in got
    back = spark.read.parquet(got["s.shp"]["output"])
    assert back.columns == ["NAME", "geometry"] and back.schema["geometry"].metadata["feature_count"] == "1" and "WKB" in back.schema["geometry"].metadata["geo"]


def test_psv_and_csv(spark, tmp_path):
    f = tmp_path / "NSW_STATE_psv.psv"
    f.write_text("1|2020-01-01||NEW SOUTH WALES|NSW\n2||||\n")
    df = tabular.read_psv(spark, str(f))
    assert df.columns == tabular.ADDRESS_TABLES["STATE"] and [tuple(r) for r in df.collect()] == [("1", "2020-01-01", "", "NEW SOUTH WALES", "NSW"), ("2", "", "", "", "")]
    done = tabular.ingest_psv(spark, str(f), str(tmp_path / "o" / "x.parquet"), md5=True)
    assert done["state"] == "NSW" and done["rows"] == 2 and len(done["md5"]) == 32
    assert spark.read.parquet(done["path"]).schema["state_pid"].metadata["table_name"] == "STATE"
    assert tabular.psv_name("Authority_Code_FLAT_TYPE_AUT_psv") == (None, "FLAT_TYPE_AUT") and tabular.psv_name("notes") == (None, None)
    assert tabular.read_psv(spark, str(tmp_path / "NSW_NOTHING_psv.psv")) is None
    names = spark.createDataFrame([("qld_locality_psv",), ("Authority_Code_STREET_TYPE_AUT_psv",), ("x",)], "s string").select(tabular.parse_psv_name(F.col("s")).alias("r")).collect()
    assert [tuple(r["r"]) for r in names] == [("QLD", "LOCALITY"), (None, "STREET_TYPE_AUT"), (None, None)]
    (tmp_path / "VIC_STATE_psv.psv").write_text("1|2\n")
    assert tabular.ingest_psv(spark, str(tmp_path / "VIC_STATE_psv.psv"), str(tmp_path / "o" / "y.parquet")) is None
    c = tmp_path / "t.csv"
    c.write_text('id,v\n1,"a ""q"" b"\n2,\n3,"x\ny"\n')
    assert [tuple(r) for r in tabular.read_csv(spark, str(c)).collect()] == [("1", 'a "q" b'), ("2", ""), ("3", "x\ny")]


def test_text_files_and_discovery(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("é".encode())
    (tmp_path / "l.txt").write_bytes("é".encode("latin-1"))
    assert {r["document_id"]: r["text"] for r in files.read_text_files(spark, str(tmp_path / "*.txt")).collect()} == {"u": "é", "l": "é"}
    for n in ("b.PDF", "a.csv", "c.docx", "d.png"):
        (tmp_path / n).write_text("x")
    assert [r["name"] for r in files.discover(spark, str(tmp_path)).collect()] == ["a.csv", "b.PDF", "c.docx"]
    assert [r["name"] for r in files.discover(spark, str(tmp_path), skip=1, limit=1).collect()] == ["b.PDF"]


def test_decoders(spark):
    files_ = spark.createDataFrame([("/x/a.pdf", b"12"), ("/x/bad.pdf", b"")], "path string, content binary")

    class Decoder:
        def pages(self, content):
            if not content:
                raise RuntimeError("empty file")
            yield backends.DecodedPage(0, "own text " * 20)
            yield backends.DecodedPage(1, "", np.full((30, 30), 255, np.uint8))

    class Ocr:
        def read(self, image):
            return [backends.Region((0, 0, 1, 1), "seen", confidence=0.9)]

    pages = backends.decode_pages(files_, "hybrid", Decoder, Ocr)
    docs = {r["document_id"]: r for r in backends.collect_documents(pages).collect()}
    assert docs["a"]["status"] == "completed" and docs["a"]["text"].endswith("seen") and docs["a"]["metadata"]["content_mix"] == {"native": 0.5, "scanned": 0.5} and docs["bad"]["status"] == "error" and "empty file" in docs["bad"]["error"]
    assert {r["error"] for r in backends.decode_pages(files_, "hybrid").collect()} == {"ValueError: backend unavailable: page decoder"}
    assert "manual review" in backends.decode_pages(files_, "non_textual").first()["error"]


# == sinks, configuration, runs


def test_tables_keep_their_schema(spark, tmp_path):
    p = sinks.write_table(spark.createDataFrame([], "document_id string"), str(tmp_path / "e.parquet"), sinks.CHUNKS)
    assert spark.read.parquet(p).columns[:2] == ["document_id", "chunk_index"]
    docs = spark.createDataFrame([("1", "p1", "t", "completed"), ("2", "p2", "t", "error")], "document_id string, source_path string, text string, status string")
    for batch in ("a", "b", "b"):
        sinks.write_documents(docs, str(tmp_path / "d.parquet"), batch)
    assert spark.read.parquet(str(tmp_path / "d.parquet")).groupBy("batch_id").count().count() == 2
    assert sinks.read_documents(spark, str(tmp_path / "d.parquet")).count() == 2
    prog = sinks.Progress(spark, str(tmp_path / "progress"))
    assert prog.remaining(docs).count() == 2
    prog.update(docs, "a")
    assert [r["source_path"] for r in prog.remaining(docs).collect()] == ["p2"] and prog.counts().first().asDict() == {"succeeded": 1, "failed": 1}


def test_stages_compose(spark):
    from quillmill.plans import stages

    page = "array<struct<page_number:int,text:string>>"
    docs = spark.createDataFrame([("a", "completed", [(0, "Dr Jane Doe wrote it' $ all down here"), (1, " "), (2, "last page of the file")], []), ("b", "error", [], [])], f"document_id string, status string, pages {page}, warnings array<string>")
    done = stages.normalise(docs)
    a = done.filter("document_id = 'a'").first()
    assert a["warnings"] == ["blank page 1 (method=native)"] and a["text"].startswith("Dr Jane Doe wrote it's all")
    raster = np.full((100, 100), 255, np.uint8)
    raster[10:40, 10:60] = 0
    pages = spark.createDataFrame([("a", 2, 100, 100, raster.tobytes())], "document_id string, page_number int, width int, height int, pixels binary")
    red = stages.redact(done, pages, config.Redaction(mode="blackout"))
    assert "[REDACTED]\nlast page" in red.filter("document_id = 'a'").first()["text"] and "page 2: 1 redacted region(s) detected" in red.filter("document_id = 'a'").first()["warnings"]
    chunks = stages.chunk(red, config.Chunking(chunk_size=6))
    got = chunks.orderBy("chunk_index").collect()
    assert [r["has_redaction"] for r in got] == ["REDACTED" in r["text"] or "last" in r["text"] or "file" in r["text"] for r in got] and any(r["has_redaction"] for r in got)
    clean = stages.clean_chunks(chunks, config.Pii(enabled=True, context_similarity_threshold=1.0))
    assert any(r["text_clean"].startswith("<PERSON> wrote") for r in clean.collect())
    with pytest.raises(ValueError):
        stages.clean_chunks(chunks, config.Pii(enabled=True, pipeline_point="nowhere"))
    e = stages.enrich_documents(red, lambda: lambda ts: [json.dumps({"text": t, "type": "other", "persons": [{"id": "p", "type": "natural", "name": {"start": 0, "end": 2}, "mentions": [{"start": 12, "end": 17}]}]}) for t in ts], config.Enrichment(enabled=True), concurrency=1)
    known = stages.clean_chunks(chunks, config.Pii(enabled=True, pipeline_point="post_enrichment", context_similarity_threshold=1.0), e)
    assert any("<PERSON> <PERSON> it" in r["text_clean"] for r in known.collect())
    assert stages.summary(red).first().asDict() == {"succeeded": 1, "failed": 1}
    assert stages.format_eta(59) == "59s" and stages.format_eta(61) == "1m 1s" and stages.format_eta(7300) == "2h 1m"


def test_configuration_bounds():
    base = {"paths": {"input_root": "i", "output_root": "o"}}
    assert config.Config.model_validate(base).chunking.chunk_size == 480
    for bad in ({"detection": {"min_text_coverage": 1.5}}, {"detection": {"min_text_coverage": -0.1}}, {"chunking": {"chunk_size": 0}}, {"extraction": {"ocr": {"dpi": 10}}}):
        with pytest.raises(ValueError):
            config.Config.model_validate(base | bad)


def test_run_and_resume(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "t.csv").write_text("id,name\n1,Alpha\n2,Beta\n")
    make_docx(src / "a.docx")
    (src / "p.pdf").write_bytes(b"%PDF")
    cfg = tmp_path / "c.yaml"
    cfg.write_text(f"paths:\n  input_root: {src}\n  output_root: {tmp_path}/out\n  checkpoint_dir: {tmp_path}/cp\n")
    out = cli.run(spark, config.load(str(cfg)))
    docs = spark.read.parquet(out["documents"])
    # two columns and few rows make a form, which is one document
    assert {r["document_id"] for r in docs.collect()} == {"t", "a"}
    assert spark.read.parquet(out["chunks"]).count() >= 3
    (src / "u.csv").write_text("id,name,note\n9,Gamma,x\n")
    cli.run(spark, config.load(str(cfg)))
    assert sorted(r["document_id"] for r in spark.read.parquet(out["documents"]).collect()) == ["a", "t", "u:9"]


def test_streaming_ingest_and_windows(spark, tmp_path, small):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("one")
    go = lambda: ingest.ingest_text(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    go()
    (src / "b.txt").write_text("two")
    go()
    assert {r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"one", "two"}
    os.makedirs(tmp_path / "ev")
    batch = spark.read.parquet(f"{small}/events.parquet")
    batch.write.mode("overwrite").parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "ev"))
    q = events.windowed_counts(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r["window_start"], r["event_type"], r["n"]) for r in events.windowed_counts(batch, "1 day", watermark=None).collect()}
    assert {(r["window_start"], r["event_type"], r["n"]) for r in spark.table("w").collect()} == want
    assert events.sessions(batch, watermark=None).agg(F.sum("n")).first()[0] == batch.count()


# == session


def test_batches_are_bounded_where_the_session_does_not_say_otherwise(spark):
    from quillmill import session

    before = spark.conf.get(session.BATCH_BYTES)
    try:
        spark.conf.set(session.BATCH_BYTES, session.USUAL_BATCH)
        session.ship(spark)
        assert spark.conf.get(session.BATCH_BYTES) == session.BATCH
        spark.conf.set(session.BATCH_BYTES, "3m")
        session.ship(spark)
        assert spark.conf.get(session.BATCH_BYTES) == "3m"
    finally:
        spark.conf.set(session.BATCH_BYTES, before)


def test_a_submitted_master_is_kept(spark, monkeypatch):
    from quillmill import session

    asked = []

    class Builder:
        def appName(self, name):  # noqa: N802
            return self

        def config(self, map):
            return self

        def master(self, name):
            asked.append(name)
            return self

        def getOrCreate(self):  # noqa: N802
            return "session"

    monkeypatch.setattr(session.SparkSession, "builder", Builder())
    monkeypatch.setattr(session, "SparkConf", lambda: type("Conf", (), {"contains": lambda self, key: False})())
    for name in ("MASTER", "SPARK_REMOTE", "PYSPARK_SUBMIT_ARGS"):
        monkeypatch.delenv(name, raising=False)
    assert session.get_session(3) == "session" and asked == ["local[3]"]
    monkeypatch.setenv("PYSPARK_SUBMIT_ARGS", "--master yarn pyspark-shell")
    session.get_session(3)
    assert asked == ["local[3]"]


def test_numbers_of_rows_do_not_need_an_order(spark):
    df = spark.range(0, 100, numPartitions=7).withColumn("v", F.lit(1))
    got = fidelity.with_row_index(df).collect()
    assert sorted(r["row_index"] for r in got) == list(range(100))
