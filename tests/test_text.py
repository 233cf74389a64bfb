import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillmill.functions import spans as S, text as X
from quillmill.operators import chunking, pii


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items())).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("the child’$ file", "the child’s file"), ("the child’ $ file", "the child’s file"), ("it' $ late", "it's late"), ("a'€ b’€", "a's b’s"), ("costs $5", "costs $5"),
        ("see http:llwww.x.org", "see http://www.x.org"), ("see http: //www.x.org", "see http://www.x.org"), ("see http://www.x.org", "see http://www.x.org"), ("http:llfoo", "http:llfoo"),
        ("a\n12 | P a g e\nb", "a\n\nb"), ("a\n7 & F' & 8 €\nb", "a\n\nb"), ("page 12 of 20", "page 12 of 20"), ("a\n12 |\nP a g e\nb", "a\n\nb"), ("12\nPatients agree", "12\nPatients agree"),
    ],
)
def test_normalise(spark, raw, want):
    assert one(spark, X.normalise_text(F.col("t")), t=raw) == want
    assert one(spark, X.normalise_text(F.col("t")), t=want) == want


def test_ratios(spark):
    r = lambda f, t: one(spark, f(F.col("t")), t=t)
    assert r(X.garbled_ratio, "") == 0 and r(X.garbled_ratio, "plain, text!") == 0 and r(X.garbled_ratio, "xxxxx ====") == 0
    assert r(X.garbled_ratio, "a%b&") == 0.5 and r(X.garbled_ratio, "é中1") == 0
    assert r(X.garbled_redaction_ratio, "none here") == 0 and r(X.garbled_redaction_ratio, "*** x_x") == 0.5
    assert one(spark, X.is_valid_redaction(F.col("t")), t="***") and not one(spark, X.is_valid_redaction(F.col("t")), t="**") and not one(spark, X.is_valid_redaction(F.col("t")), t="**x")


def test_weak_signals_in_order(spark):
    df = spark.createDataFrame([("1", "%%&&%% %&", 0.5, 0), ("2", "fine", 0.9, 3), ("3", None, None, None), ("4", "ok *x x# *", 0.8, 500)], "document_id string, text string, confidence double, page_count int")
    got = {r["document_id"]: r["s"] for r in df.select("document_id", X.weak_signals(F.col("text"), F.col("confidence"), F.col("page_count")).alias("s")).collect()}
    assert got == {"1": ["low_confidence", "page_count_anomaly", "garbled_text"], "2": [], "3": [], "4": ["page_count_anomaly", "redaction_garbled"]}


def test_error_rates(spark):
    df = spark.createDataFrame([("abcd", "abxd"), ("", ""), ("", "x"), ("ab", "abcdef")], "r string, h string")
    assert [r[0] for r in df.select(X.character_error_rate(F.col("r"), F.col("h"))).collect()] == [0.25, 0.0, 1.0, 2.0]
    df = spark.createDataFrame([("the cat sat", "the dog sat"), ("", ""), ("", "x"), ("a b", "a")], "r string, h string")
    assert [round(r[0], 4) for r in df.select(X.word_error_rate("r", "h")).collect()] == [0.3333, 0.0, 1.0, 0.5]
    assert one(spark, X.metric_form("t"), t="  ÉCOUTE  Le ") == "écoute le"


def test_markdown(spark):
    df = spark.createDataFrame([(["a", "b"], [["1", "2"], ["3"], ["4", "5", "6"]]), ([], [["x", "y"]]), ([], [])], "h array<string>, r array<array<string>>")
    got = [r[0] for r in df.select(X.table_to_markdown(F.col("h"), F.col("r"))).collect()]
    assert got == ["| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 |  |\n| 4 | 5 |", "|  |  |\n| --- | --- |\n| x | y |", ""]


def test_boxes_and_vectors(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"))])
    r = spark.range(1).select(X.iou(box(0, 0, 2, 2), box(1, 1, 3, 3)).alias("a"), X.iou(box(0, 0, 1, 1), box(2, 2, 3, 3)).alias("b"), X.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c"), X.variation_score(F.lit(0.3)).alias("d")).first()
    assert abs(r["a"] - 1 / 7) < 1e-12 and r["b"] == 0 and abs(r["c"] - 0.70710678) < 1e-6 and abs(r["d"] - 0.5) < 1e-9


def test_finders():
    spans = lambda t, e=("PERSON", "ADDRESS"): [(t[a:b], k) for a, b, k, *_ in S.candidates_in([t], e, scorer=lambda c: [1.0] * len(c))[0]]
    assert spans("Dr Jane O'Brien spoke") == [("Dr Jane O'Brien", "PERSON")]
    assert spans("met John Smith today") == [("John Smith", "PERSON")]
    assert spans("the Department Secretary and New South Wales") == []
    assert spans("at 12 Long Street, Perth WA 6000 now", ("ADDRESS",)) == [("12 Long Street, Perth WA 6000", "ADDRESS")]
    assert spans("Unit 3, 10-12 Main Rd here", ("ADDRESS",)) == [("Unit 3, 10-12 Main Rd", "ADDRESS")]
    assert spans("PO Box 123", ("ADDRESS",)) == [] and spans("John\nSmith was") == []


def test_overlaps_and_splice(spark):
    rows = [(0, 5, "A", 0.5, 0), (3, 9, "B", 0.9, 1), (9, 12, "C", 0.4, 2), (0, 4, "D", 0.9, 3)]
    df = spark.createDataFrame([("0123456789abcdef", rows)], f"t string, s {S.SPANS}")
    kinds = lambda c: [x["entity_type"] for x in df.select(c.alias("r")).first()["r"]]
    assert kinds(S.keep_first(F.col("s"))) == ["A", "C"] and kinds(S.keep_first(F.col("s"), by_score=True)) == ["D", "C"]
    assert df.select(S.splice(F.col("t"), S.keep_first(F.col("s")))).first()[0] == "<A>5678<C>cdef"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8)), max_size=12))
def test_resolved_spans_never_overlap(spark, raw):
    rows = [(a, a + n, "X", 0.5, i) for i, (a, n) in enumerate(raw)]
    got = spark.createDataFrame([(rows,)], f"s {S.SPANS}").select(S.keep_first(F.col("s")).alias("r")).first()["r"]
    want, last = [], -1
    for a, b, *_ in sorted(rows, key=lambda r: r[0]):
        if a >= last:
            want.append((a, b))
            last = b
    assert [(x["start"], x["end"]) for x in got] == want


def test_clean_and_known_spans(spark):
    df = spark.createDataFrame([("1", "Dr Jane Doe wrote to the clerk", 100), ("2", "", 0), ("3", None, 0)], "document_id string, text string, off int")
    got = {r["document_id"]: (r["text_clean"], r["pii_count"]) for r in pii.clean(df, scorer=lambda c: [1.0] * len(c)).collect()}
    assert got["1"] == ("<PERSON> wrote to the clerk", 1) and got["2"] == ("", 0)
    known = spark.createDataFrame([("1", "the clerk came in", 100, [(90, 102, "PERSON"), (104, 109, "PERSON"), (115, 400, "EMAIL"), (500, 510, "EMAIL")])], "document_id string, text string, off int, known array<struct<start:int,end:int,entity_type:string>>")
    r = pii.clean_with_known(known, "known", "off").first()
    assert r["text_clean"] == "<PERSON>e <PERSON> came <EMAIL>" and r["pii_count"] == 3


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .,;\n!é", max_size=200), st.integers(1, 12), st.sampled_from([0, 0.2, 0.5]))
def test_chunk_contract(text, size, overlap):
    got = chunking.split_text(text, size, overlap=overlap)
    assert bool(got) == bool(text.strip())
    for a, b in got:
        assert 0 <= a < b <= len(text) and chunking.word_count(text[a:b]) <= size and text[a:b].strip() == text[a:b]
    if not overlap:
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
        assert "".join(text.split()) == "".join("".join(text[a:b].split()) for a, b in got)


def test_chunk_bounds():
    with pytest.raises(ValueError):
        chunking.split_text("a b", 0)
    with pytest.raises(ValueError):
        chunking.split_text("a b", 2, overlap=2)
    text = " ".join(f"w{i}" for i in range(200))
    assert sum(b - a for a, b in chunking.split_text(text, 20, overlap=0.25)) > len(text)
    assert chunking.split_text("x" * 50, 10, count=len) and all(b - a <= 10 for a, b in chunking.split_text("x" * 50, 10, count=len))


def test_chunk_documents_with_tables(spark):
    df = spark.createDataFrame([("d", "one two three four five. six seven.", [(["h"], [["c1"], ["c2"]])]), ("e", " ", [])], "document_id string, text string, tables array<struct<headers:array<string>,rows:array<array<string>>>>")
    got = chunking.chunk_documents(df, 5, tables_col="tables").orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in got] == list(range(len(got))) and {r["content_type"] for r in got} == {"narrative", "table"} and all(r["document_id"] == "d" for r in got)
    assert chunking.chunk_counts(chunking.chunk_documents(df, 5, tables_col="tables")).first()["n_table"] >= 1


def test_torn_markers_are_mended(spark):
    kind = "array<struct<start_char:int,end_char:int,text:string,content_type:string,has_redaction:boolean>>"
    c = lambda *ts: [(i * 10, i * 10 + 5, t, "narrative", i == 0) for i, t in enumerate(ts)]
    mend = lambda *ts: [r["text"] for r in spark.createDataFrame([(c(*ts),)], f"c {kind}").select(chunking.repair_splits(F.col("c")).alias("r")).first()["r"]]
    assert mend("see [REDA", "CTED] now", "rest") == ["see [REDACTED] now", "rest"]
    assert mend("a [RED", "ACTED] b [RE", "DACTED] c") == ["a [REDACTED] b [RE", "DACTED] c"]
    assert mend("a", "b") == ["a", "b"] and mend() == []
