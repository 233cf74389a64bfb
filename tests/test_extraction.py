"""From files to typed documents, with stand-ins for decoder, reader and layout; raster heuristics by shape."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from quillmill import config
from quillmill.operators import classify, images
from quillmill.plans import extraction
from quillmill.sources import backends, office, sinks

from test_engine import make_docx, make_xlsx

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the stand-ins go to the workers as they are


def squares(rows=10, cols=14, size=12):
    page = np.full((36 * rows + 40, 40 * cols + 40), 255, np.uint8)
    for r in range(rows):
        for c in range(cols):
            page[20 + 36 * r : 20 + 36 * r + size, 10 + 40 * c : 10 + 40 * c + size] = 0
    return page


def scribbles():
    page, rng = np.full((400, 600), 255, np.uint8), np.random.default_rng(3)
    for r in range(6):
        for c in range(8):
            x, y = 10 + 70 * c, 10 + 62 * r
            for _ in range(int(rng.integers(1, 9))):
                w, h, dx, dy = rng.integers(3, 26, 4)
                page[y + dy : y + dy + h, x + dx : x + dx + w] = 0
    return page


# == rasters


def test_labels_of_the_layout():
    want = {"person": "paragraph", "book": "paragraph", "dining table": "table", "tv": "figure", "laptop": "figure", "cell phone": "figure", "monitor": "figure", "keyboard": "figure", "mouse": "figure", "scissors": "figure", "clock": "figure", "zebra": "figure", "": "figure"}
    assert {k: backends.block_type(k) for k in want} == want


def test_outlines_and_corners():
    mask = np.zeros((40, 60), bool)
    mask[10:21, 5:50] = True
    ring = images.outline(mask, 5, 10)
    assert len(ring) == 2 * (45 + 11) - 4 and {tuple(p) for p in ring} == {(x, y) for y in range(10, 21) for x in range(5, 50) if y in (10, 20) or x in (5, 49)}
    assert images.polygon_corners(ring, 2.0) == 4
    one = np.zeros((3, 3), bool)
    one[1, 1] = True
    assert images.outline(one, 1, 1).tolist() == [[1, 1]] and images.polygon_corners(images.outline(one, 1, 1), 1.0) == 1


def test_contours_of_type_and_hand():
    assert images.contour_regularity(squares()) > 0.95
    assert images.contour_regularity(scribbles()) < 0.75 * images.contour_regularity(squares())
    assert images.contour_regularity(squares(1, 5)) == 0.5 and images.contour_regularity(np.full((50, 50), 255, np.uint8)) == 0.5


def lines_at(degrees):
    page = np.full((400, 600), 255, np.uint8)
    for k in range(8):
        for x in range(50, 550):
            y = int(40 + 40 * k + np.tan(np.radians(degrees)) * (x - 300))
            page[y : y + 2, x] = 0
    return page


@pytest.mark.parametrize("degrees", [0, 3, -5])
def test_skew_is_found_and_mended(degrees):
    angle, sure = images.skew_angle(images.find_lines(lines_at(degrees)))
    assert abs(angle - degrees) < 0.5 and sure > 0.8
    gray, steps = images.prepare_for_ocr(lines_at(degrees))
    assert ("deskew" in steps) == (degrees != 0)
    assert abs(images.skew_angle(images.find_lines(gray))[0]) < 0.7
    assert images.find_lines(np.full((20, 20), 255, np.uint8)) == []


def test_preparation_steps():
    clean = np.full((100, 100), 255, np.uint8)
    clean[10:40, 10:40] = 120
    assert images.prepare_for_ocr(clean)[1] == ["binarise_skipped"]
    dark = np.full((100, 100), 200, np.uint8)
    dark[:40] = 10
    dark[::7] += 3
    gray, steps = images.prepare_for_ocr(np.repeat(dark[..., None], 3, axis=2))
    assert steps == ["otsu_binarise"] and set(np.unique(gray)) == {0, 255} and gray[10, 50] == 0 and gray[80, 50] == 255
    flat, steps = images.prepare_for_ocr(np.full((60, 60), 20, np.uint8))
    assert steps == ["adaptive_binarise"] and (flat == 255).all()
    assert images.gray_of(np.full((2, 2, 3), 90, np.uint8)).tolist() == [[90, 90], [90, 90]]


def test_distances_and_strokes():
    mask = np.zeros((40, 60), bool)
    mask[10:21, 5:50] = True
    d = images.distances(mask)
    y, x = np.nonzero(~mask)
    for p in ((10, 5), (15, 30), (12, 8), (20, 49)):
        assert abs(d[p] - np.sqrt((y - p[0]) ** 2 + (x - p[1]) ** 2).min()) < 1e-9
    assert (d[~mask] == 0).all()
    assert images.stroke_consistency(images.stroke_widths(squares(), compatible=False)) is not None
    assert images.stroke_consistency(images.stroke_widths(squares())) is None  # ten erosions leave nothing of such strokes


def test_photo_blocks():
    rng = np.random.default_rng(0)
    smooth = (np.add.outer(np.arange(64), np.arange(64)) + rng.integers(0, 3, (64, 64))).astype(np.uint8)
    page = np.full((64, 128), 255, np.uint8)
    page[:, 64:] = smooth
    assert images.text_photo_mask(page).tolist() == [[False, False, True, True]] * 2


# == pages to structs


def page(**kw):
    return backends.DecodedPage(0, width=200.0, height=100.0, **kw)


def test_page_objects():
    p = page(tables=[((0, 0, 100, 50), [["h", None], [1, ""]]), ((0, 0, 1, 1), [])], images=[(20, 10, 60, 30)], widgets=[(None, "v", (0, 0, 20, 10))], blocks=[("Big", 16.0, (0, 0, 1, 1)), (" ", 20.0, (0, 0, 1, 1)), ("short", 9.0, (0, 0, 1, 1)), ("x" * 40, 9.0, (0, 0, 1, 1))])
    assert backends.page_tables(p) == [{"headers": ["h", ""], "rows": [["1", ""]], "position": {"x": 0, "y": 0, "width": 0.5, "height": 0.5}, "confidence": 0.8}]
    assert backends.page_images(p)[0]["position"] == {"x": 0.1, "y": 0.1, "width": 0.2, "height": 0.2} and backends.page_images(p)[0]["confidence"] == 0.7
    assert [(f["field_name"], f["value"], f["confidence"]) for f in backends.page_forms(p)] == [("", "v", 0.9)]
    assert [b["block_type"] for b in backends.native_blocks(p)] == ["heading", "caption", "paragraph"]
    assert backends.place((1, 1, 2, 2), 0, 0) == {"x": 0.0, "y": 0.0, "width": 0.0, "height": 0.0}


class Layout:
    def __init__(self, *regions):
        self.regions = regions

    def analyse(self, image, confidence):
        if not self.regions:
            raise RuntimeError("no weights")
        return [backends.Region(box, label=label, confidence=c) for box, label, c in self.regions]


def test_layout_blocks():
    p = page(image=np.full((100, 200), 255, np.uint8))
    some = Layout(((0, 50, 200, 100), "dining table", 0.9), ((0, 0, 50, 10), "person", 0.8), ((0, 0, 200, 100), "tv", 0.1))
    assert [r.label for r in backends.layout_regions(some, p.image)] == ["person", "dining table"]
    assert [(b["text"], b["block_type"], b["confidence"]) for b in backends.layout_blocks(p, some, "said", 80.0)] == [("said", "table", 0.8)]
    assert [(b["text"], b["block_type"]) for b in backends.layout_blocks(p, some, " ", 0.0)] == [("", "paragraph"), ("[TABLE]", "table")]
    assert backends.layout_blocks(p, some, " ", 0.0)[1]["position"] == {"x": 0.0, "y": 0.5, "width": 1.0, "height": 0.5}
    for broken in (Layout(), None):
        assert [(b["text"], b["block_type"]) for b in backends.layout_blocks(p, broken, "said", 50.0)] == [("said", "paragraph")]
    assert backends.ocr_block(" ", 50.0) == []


def test_sampled_confidence():
    class Reader:
        def __init__(self, *seen):
            self.seen = seen

        def read(self, image):
            if not self.seen:
                raise RuntimeError("no model")
            return [backends.Region((0, 0, 1, 1), t, confidence=c) for t, c in self.seen]

    image = np.full((5, 5), 255, np.uint8)
    assert backends.sample_confidence(image, Reader(("a", 0.5), (" ", 0.0), ("b", 0.9))) == pytest.approx(70)
    assert backends.sample_confidence(image, Reader((" ", 0.5))) is None and backends.sample_confidence(image, Reader()) is None and backends.sample_confidence(None, None) is None


def test_models_folder(tmp_path, monkeypatch):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / "models" / "m" / "refs").mkdir(parents=True)
    (tmp_path / "models" / "plain.pt").write_text("x")
    assert backends.find_models_dir(str(deep)) == str(tmp_path / "models")
    assert backends.model_path("plain.pt", str(deep)) == str(tmp_path / "models" / "plain.pt")
    assert backends.model_path("m", str(deep)) == str(tmp_path / "models" / "m") and backends.model_path("other/name", str(deep)) == "other/name"
    (tmp_path / "models" / "m" / "refs" / "main").write_text("abc\n")
    (tmp_path / "models" / "m" / "snapshots" / "abc").mkdir(parents=True)
    assert backends.model_path("m", str(deep)) == str(tmp_path / "models" / "m" / "snapshots" / "abc")
    monkeypatch.setenv("SOME_MODELS", str(tmp_path / "nowhere"))
    assert backends.find_models_dir(str(deep), "SOME_MODELS") is None and backends.model_path("m", str(deep), "SOME_MODELS") == "m"


# == documents


class Decoder:
    """The content says what is in the file: n for a native page, t for one with a table, s for typed and h for written scans."""

    def pages(self, content):
        if content == b"broken":
            raise RuntimeError("cannot open")
        for k, c in enumerate(content.decode()):
            if c in "nt":
                text = f"page {k} " + "native words in a row " * 10
                tables = [((0, 0, 50, 50), [["a", "b"], ["1", "2"]])] if c == "t" else []
                yield backends.DecodedPage(k, text, None, 100, 100, tables, [(0, 0, 10, 10)] if c == "t" else [], [("f", "v", (0, 0, 5, 5))] if c == "t" else [], [(text, 10.0, (0, 0, 100, 100))])
            else:
                yield backends.DecodedPage(k, "", squares() if c == "s" else scribbles(), 100, 100, images=[(0, 0, 100, 100)])


class Reader:
    def read(self, image):
        return [backends.Region((0, 0, 1, 1), "seen on the page", confidence=0.9), backends.Region((0, 0, 1, 1), " ", confidence=0.1)]


def documents(spark, contents, plan, **kw):
    found = spark.createDataFrame([(f"/x/{name}.pdf", c) for name, c in contents.items()], "path string, content binary")
    return {r["document_id"]: r for r in backends.collect_documents(backends.decode_pages(found, plan, Decoder, Reader, **kw)).collect()}


def test_strategies(spark):
    r = documents(spark, {"a": b"nn", "b": b"broken"}, "native_narrative")
    assert r["a"]["metadata"]["confidence"] == pytest.approx(0.95) and r["a"]["metadata"]["page_count"] == 2 and len(r["a"]["text_blocks"]) == 2 and r["a"]["tables"] == [] and r["a"]["metadata"]["content_mix"] is None
    assert r["b"]["status"] == "error" and "cannot open" in r["b"]["error"] and r["b"]["text"] == ""
    r = documents(spark, {"a": b"nt"}, "native_with_structured")["a"]
    assert r["metadata"]["confidence"] == 0.85 and r["tables"][0]["headers"] == ["a", "b"] and r["forms"][0]["field_name"] == "f" and len(r["images"]) == 1
    r = documents(spark, {"a": b"t", "b": b"n"}, "structured")
    assert (r["a"]["metadata"]["confidence"], r["b"]["metadata"]["confidence"]) == (0.8, 0.6) and r["a"]["forms"] == []
    r = documents(spark, {"a": b"ss"}, "ocr_machinewritten", make_layout=lambda: Layout(((0, 0, 9, 9), "book", 0.9)))["a"]
    assert r["metadata"]["confidence"] == pytest.approx(0.9) and [b["block_type"] for b in r["text_blocks"]] == ["paragraph"] * 2 and r["text"] == "seen on the page\n\nseen on the page" and r["metadata"]["preprocessing_steps"] and r["metadata"]["processing_time"] > 0
    r = documents(spark, {"a": b"sshs"}, "ocr_mixed")["a"]
    kinds = [b["block_type"] for b in r["text_blocks"]]
    assert kinds == ["typed", "typed", "typed" if images.contour_regularity(scribbles()) > 0.5 else "handwritten", "typed"]
    assert r["metadata"]["content_mix"] == {"typed": kinds.count("typed") / 4, "handwritten": kinds.count("handwritten") / 4}
    r = documents(spark, {"a": b"nsn"}, "hybrid", max_pages=2)["a"]
    assert r["metadata"]["content_mix"] == {"native": 0.5, "scanned": 0.5} and r["metadata"]["confidence"] == pytest.approx((0.95 + 0.9) / 2)
    assert documents(spark, {"a": b"s"}, "image")["a"]["images"][0]["position"]["width"] == 1.0


def test_profiles_route_each_file(spark):
    found = spark.createDataFrame([(f"/x/{n}.pdf", c) for n, c in {"native": b"nnn", "tables": b"ttt", "scan": b"sss", "mix": b"nssssss", "bad": b"broken"}.items()], "path string, content binary")
    got = {r["path"][3:-4]: r for r in backends.profile_files(found, Decoder, Reader).collect()}
    assert {k: r["strategy"] for k, r in got.items()} == {"native": "native_narrative", "tables": "structured", "scan": "ocr_machinewritten", "mix": "hybrid", "bad": "native_narrative"}
    assert "cannot open" in got["bad"]["profile_error"] and got["native"]["profile_error"] is None
    docs = {r["document_id"]: r for r in extraction.page_documents(found, Decoder, Reader).collect()}
    assert {k: r["method"] for k, r in docs.items() if r["status"] == "completed"} == {"native": "native_narrative", "tables": "structured", "scan": "ocr_machinewritten", "mix": "hybrid"} and docs["bad"]["status"] == "error"


def test_sheets_to_documents(spark, tmp_path):
    (tmp_path / "data.csv").write_text("no,the name,note\n1,Ann/Lee,x\n2, ,y\n3,,\n,,\nHead,,\nHead2,,\nHead3,,\n")
    (tmp_path / "form.csv").write_text("key,value\nsize,12\ncolour,red\n")
    (tmp_path / "prose.csv").write_text("text\none line\n")
    (tmp_path / "terms.csv").write_text("term,meaning\n" + "".join(f"t{i},m{i}\n" for i in range(60)))
    (tmp_path / "empty.csv").write_text("\n")
    (tmp_path / "old.xls").write_bytes(b"x")
    make_xlsx(tmp_path / "book.xlsx")
    rows = office.sheet_rows(office.contents(spark, str(tmp_path)))
    kinds = {(r["stem"], r["sheet"]): (r["sheet_type"], r["key_column"], r["has_sub_headers"]) for r in classify.sheet_profiles(rows).collect()}
    assert kinds == {("data", "default"): ("data", "the name", True), ("form", "default"): ("key_value", "key", False), ("prose", "default"): ("narrative", "text", False), ("terms", "default"): ("glossary", "term", False), ("book", "S1"): ("data", "id", False)}
    docs = {r["document_id"]: r for r in extraction.sheet_documents(rows).collect()}
    assert docs["data:Ann-Lee"]["text"] == "no: 1\nthe name: Ann/Lee\nnote: x" and docs["data:row:1"]["text"] == "no: 2\nnote: y" and not any("Head" in r["text"] for r in docs.values())
    assert docs["form"]["text"].split() == ["key", "value", "size", "12", "colour", "red"] and docs["form"]["tables"][0]["rows"] == [["size", "12"], ["colour", "red"]] and docs["prose"]["text"].split("\n")[1].strip() == "one line"
    assert docs["terms:t7"]["text"] == "term: t7\nmeaning: m7" and docs["book:S1:7"]["text"] == "id: 7\nnote: True"
    assert docs["empty"]["error"] and "backend" in docs["old"]["error"] and docs["form"]["metadata"]["confidence"] == 0.95
    sampled = {r["sheet_type"] for r in classify.sheet_profiles(rows.filter("stem = 'terms'"), sample=40).collect()}
    assert sampled == {"key_value"}
    large = {r["document_id"]: r["text"] for r in extraction.sheet_documents(extraction.large_csv(spark, str(tmp_path / "terms.csv"))).collect()}
    assert large == {k: r["text"] for k, r in docs.items() if k.startswith("terms:")}


def test_extract_has_one_plan_a_kind(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"t{k}.csv").write_text(f"id,a{k},b,c\n{k},x,y,z\n")
    make_docx(tmp_path / "w.docx")
    (tmp_path / "p.pdf").write_bytes(b"tt")
    (tmp_path / "q.pdf").write_bytes(b"broken")
    out = extraction.extract(spark, str(tmp_path), make_decoder=Decoder, make_ocr=Reader, cfg=config.Detection())
    got = {r["document_id"]: r for r in out.collect()}
    assert set(got) == {f"t{k}:{k}" for k in range(6)} | {"w", "p", "q"} and [c for c in out.columns if c not in ("method", "status", "error")] == sinks.schema_of(spark, sinks.DOCUMENTS).names
    assert got["t3:3"]["text"] == "id: 3\na3: x\nb: y\nc: z" and got["p"]["tables"] and got["q"]["status"] == "error" and got["q"]["metadata"]["confidence"] == 0.0
    # no branch a file: as many scans for six tables as for one
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    for k in range(6, 12):
        (tmp_path / f"t{k}.csv").write_text(f"id,a{k},b,c\n{k},x,y,z\n")
    more = extraction.extract(spark, str(tmp_path), make_decoder=Decoder, make_ocr=Reader)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == more.count("Relation")
    assert extraction.extract(spark, str(tmp_path), limit=1).count() == 1
    parts = extraction.extract(spark, str(tmp_path), make_decoder=Decoder, make_ocr=Reader, large=1)
    assert {r["document_id"] for r in parts.collect()} == {f"t{k}:{k}" for k in range(12)} | {"w", "p", "q"}
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.png").write_text("x")
    assert extraction.extract(spark, str(tmp_path / "none")).count() == 0
