"""Word, Excel, CSV and shape files as tables: contents come from Spark's own file reader, so any shared storage will do.

A file that can't be read gives a row with its error.
"""

from __future__ import annotations

import csv
import io
import os
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_BAD_FILE = (OSError, KeyError, ValueError, IndexError, TypeError, struct.error, zipfile.BadZipFile, ElementTree.ParseError, csv.Error)
_POS = "position:struct<x:double,y:double,width:double,height:double>"
DOCX = f"path string, document_id string, text string, confidence double, text_blocks array<struct<text:string,{_POS},block_type:string,confidence:double>>, tables array<struct<headers:array<string>,rows:array<array<string>>,{_POS},confidence:double>>, n_images int, error string"
SHEETS = "path string, stem string, sheet string, row_index int, headers array<string>, cells array<string>, error string"
SHAPES = "path string, feature int, attributes map<string,string>, geometry_type string, geometry binary, valid boolean, crs string, error string"
#: Rows that leave a Python worker at once.
ROWS = 1000


def contents(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, content) of files or of those right under a folder."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")


def stem_of_path(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


def each_file(files: DataFrame, parse: Callable[..., Iterator[tuple]], failed: Callable[[str, str], tuple], schema: str) -> DataFrame:
    """The rows that ``parse`` makes of each file's path and other columns."""
    arrow = to_arrow_schema(files.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        rows: list[tuple] = []

        def out():
            cols = list(zip(*rows)) if rows else [()] * len(arrow)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for batch in batches:
            for k in range(batch.num_rows):
                path, *rest = (c[k].as_py() for c in batch.columns)
                try:
                    for row in parse(path, *rest):
                        rows.append(row)
                        if len(rows) >= ROWS:
                            yield out()
                except _BAD_FILE as error:
                    rows.append(failed(path, f"{type(error).__name__}: {error}"))
        yield out()

    return files.mapInArrow(run, schema)


def parse_docx(data: bytes) -> dict:
    """Paragraph texts, blocks and tables of a document."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        images = sum(n.startswith("word/media/") for n in z.namelist())
    said = lambda p: "".join((t.text or "") if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
    blocks, tables = [], []
    for p in body.findall(f"{_W}p"):
        text = said(p)
        if text.strip():
            style = p.find(f"{_W}pPr/{_W}pStyle")
            head = style is not None and "heading" in style.get(f"{_W}val", "").lower()
            blocks.append((text, "heading" if head else "paragraph", 0.9))
    for t in body.findall(f"{_W}tbl"):
        rows = [["\n".join(said(p) for p in c.findall(f"{_W}p")).strip() for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")]
        if rows:
            tables.append((rows[0], rows[1:], 0.85))
    return {"text": "\n\n".join(b[0] for b in blocks), "blocks": blocks, "tables": tables, "images": images}


_WHOLE = (0.0, 0.0, 1.0, 1.0)


def docx_rows(files: DataFrame) -> DataFrame:
    """One row a Word file. ``files``: path, content."""

    def parse(path, content):
        d = parse_docx(content)
        place = dict(zip(("x", "y", "width", "height"), _WHOLE))
        blocks = [{"text": t, "position": place, "block_type": k, "confidence": c} for t, k, c in d["blocks"]]
        tables = [{"headers": h, "rows": r, "position": place, "confidence": c} for h, r, c in d["tables"]]
        yield path, stem_of_path(path), d["text"], 0.9, blocks, tables, d["images"], None

    return each_file(files.select("path", "content"), parse, lambda path, error: (path, stem_of_path(path), "", 0.0, [], [], 0, error), DOCX)


def docx_profiles(rows: DataFrame) -> DataFrame:
    """(path, doc_type, total_pages, text_coverage, has_images, has_tables, confidence) of Word files; one that can't be read is unknown."""
    ok = F.col("error").isNull()
    said = F.exists("text_blocks", lambda b: F.length(b["text"]) > 0)
    return rows.select(
        "path", F.when(ok, "docx").otherwise("unknown").alias("doc_type"), ok.cast("int").alias("total_pages"), (ok & said).cast("double").alias("text_coverage"),
        (F.col("n_images") > 0).alias("has_images"), (F.size("tables") > 0).alias("has_tables"), F.when(ok, 0.85).otherwise(0.3).alias("confidence"),
    )


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def parse_xlsx(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(sheet name, rows of strings) of a workbook, in its order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_X}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_X}t")))
        rel = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_X}sheet"):
            target = rel[s.get(f"{_R}id")].lstrip("/")
            xml = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows = []
            for r in xml.iter(f"{_X}row"):
                cells: dict[int, str] = {}
                for k, c in enumerate(r.findall(f"{_X}c")):
                    at = _column(c.get("r")) if c.get("r") else k
                    kind, v = c.get("t"), c.find(f"{_X}v")
                    if kind == "s":
                        value = shared[int(v.text)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{_X}t"))
                    elif kind == "b":
                        value = "True" if v is not None and v.text == "1" else "False"
                    else:
                        value = v.text or "" if v is not None else ""
                    cells[at] = value
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            out.append((s.get("name"), rows))
    return out


def parse_csv(data: bytes) -> list[list[str]]:
    """Rows of a comma-separated file, UTF-8 or Latin-1, quotes doubled."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


def sheet_rows(files: DataFrame) -> DataFrame:
    """One row a sheet row of CSV and Excel files, cells as strings; a CSV file is one sheet called ``default``. ``files``: path, content."""

    def parse(path, content):
        stem, kind = stem_of_path(path), path.lower().rsplit(".", 1)[-1]
        if kind == "xls":
            raise ValueError("the binary workbook format needs a backend that isn't there")
        sheets = [("default", parse_csv(content))] if kind == "csv" else parse_xlsx(content)
        if not any(rows for _, rows in sheets):
            raise ValueError("no sheets, or all of them empty")
        for name, rows in sheets:
            headers = rows[0] if rows else []
            for i, row in enumerate(rows[1:]):
                yield path, stem, name, i, headers, (row + [""] * len(headers))[: max(len(headers), len(row))], None

    return each_file(files.select("path", "content"), parse, lambda path, error: (path, stem_of_path(path), None, None, [], [], error), SHEETS)


_KINDS = {1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint"}


def _area(ring) -> float:
    return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, ring[1:])) / 2


def _wkb(kind: int, raw: bytes) -> tuple[bytes | None, bool]:
    """Well-known binary and validity of a shape record's content."""
    if kind == 0:
        return None, True
    if kind == 1:
        return struct.pack("<BI2d", 1, 1, *struct.unpack_from("<2d", raw, 4)), True
    if kind == 8:
        (n,) = struct.unpack_from("<i", raw, 36)
        pts = [struct.unpack_from("<2d", raw, 40 + 16 * i) for i in range(n)]
        return struct.pack("<BII", 1, 4, n) + b"".join(struct.pack("<BI2d", 1, 1, *p) for p in pts), n > 0
    n_parts, n_points = struct.unpack_from("<2i", raw, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", raw, 44), n_points]
    base = 44 + 4 * n_parts
    pts = [struct.unpack_from("<2d", raw, base + 16 * i) for i in range(n_points)]
    rings = [pts[a:b] for a, b in zip(starts, starts[1:])]
    body = lambda r: struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r)
    if kind == 3:
        if len(rings) == 1:
            return struct.pack("<BI", 1, 2) + body(rings[0]), len(rings[0]) >= 2
        return struct.pack("<BII", 1, 5, len(rings)) + b"".join(struct.pack("<BI", 1, 2) + body(r) for r in rings), all(len(r) >= 2 for r in rings)
    valid = all(len(r) >= 4 and r[0] == r[-1] and not crosses(r) for r in rings)
    groups: list[list] = []
    for r in rings:  # outer rings run clockwise, the holes after one belong to it
        if _area(r) <= 0 or not groups:
            groups.append([r])
        else:
            groups[-1].append(r)
    poly = lambda g: struct.pack("<BII", 1, 3, len(g)) + b"".join(body(r) for r in g)
    if len(groups) == 1:
        return poly(groups[0]), valid
    return struct.pack("<BII", 1, 6, len(groups)) + b"".join(poly(g) for g in groups), valid


def crosses(ring) -> bool:
    """Whether two edges of a closed ring cross."""
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    edges = list(zip(ring, ring[1:]))
    order = sorted(range(len(edges)), key=lambda i: min(edges[i][0][0], edges[i][1][0]))
    for k, i in enumerate(order):
        a, b = edges[i]
        right = max(a[0], b[0])
        for j in order[k + 1 :]:
            c, d = edges[j]
            if min(c[0], d[0]) > right:
                break
            if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                return True
    return False


def read_dbf(data: bytes) -> tuple[list[str], list[list[str]]]:
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    rows = []
    for i in range(n):
        p, row = head + i * size + 1, []
        for _, width in fields:
            row.append(data[p : p + width].decode("latin-1").strip())
            p += width
        rows.append(row)
    return [f[0] for f in fields], rows


def shape_rows(files: DataFrame) -> DataFrame:
    """One row a feature, geometry as well-known binary. ``files``: path, content of .shp files and of the .dbf and .prj beside them."""
    base, kind = F.regexp_replace("path", r"\.[^.]+$", ""), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    each = files.select("path", base.alias("base"), kind.alias("kind"), "content")
    side = lambda k: each.filter(F.col("kind") == k).select("base", F.col("content").alias(k))
    joined = each.filter("kind = 'shp'").join(side("dbf"), "base", "left").join(side("prj"), "base", "left").select("path", "content", "dbf", "prj")

    def parse(path, shp, dbf, prj):
        names, attrs = read_dbf(dbf) if dbf is not None else ([], [])
        crs = prj.decode("latin-1").strip() if prj is not None else None
        at, i = 100, 0
        while at + 12 <= len(shp):
            (words,) = struct.unpack_from(">i", shp, at + 4)
            raw = shp[at + 8 : at + 8 + 2 * words]
            (kind,) = struct.unpack_from("<i", raw, 0)
            flat = kind % 10 if kind > 10 else kind  # shapes with z or m keep x and y
            wkb, valid = _wkb(flat, raw)
            row = attrs[i] if i < len(attrs) else []
            yield path, i, list(zip(names, row)), _KINDS.get(flat), wkb, valid, crs, None
            at, i = at + 8 + 2 * words, i + 1

    return each_file(joined, parse, lambda path, error: (path, None, [], None, None, None, None, error), SHAPES)
