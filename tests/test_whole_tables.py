"""Queries that SQL can't say, over the whole tables against plain versions; small cases of the graph and the sinks."""

import re
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from quillmill.functions import spans as S, text as X
from quillmill.operators import chunking, graph, metrics, pii
from quillmill.plans import registry, tables as T
from quillmill.sources import sinks


def test_chunks_of_every_document(spark, small):
    texts = {r["document_id"]: r["text"] for r in T.documents(spark, small).collect()}
    got: dict = {}
    for r in registry.queries()["chunk_documents"](spark, small).orderBy("document_id", "chunk_index").collect():
        got.setdefault(r["document_id"], []).append(r)
    assert set(got) == {i for i, t in texts.items() if t.strip()}
    several = 0
    for i, chunks in got.items():
        t = texts[i]
        assert [c["chunk_index"] for c in chunks] == list(range(len(chunks)))
        words = [m.span() for m in re.finditer(r"\S+", t)]
        seen = set()
        for c in chunks:
            assert c["text"] == t[c["start_char"] : c["end_char"]] and 0 < len(c["text"].split()) <= 200 and c["content_type"] == "narrative"
            seen |= {w for w in words if c["start_char"] <= w[0] and w[1] <= c["end_char"]}
        assert seen == set(words)
        for a, b in zip(chunks, chunks[1:]):
            both = sum(b["start_char"] <= x and y <= a["end_char"] for x, y in words)
            assert a["start_char"] <= b["start_char"] and a["end_char"] < b["end_char"] and both <= 20
            # no chunk could have taken in its neighbour's own part
            fresh = sum(x >= a["end_char"] and y <= b["end_char"] for x, y in words)
            own = sum(a["start_char"] <= x and y <= a["end_char"] for x, y in words)
            assert own + fresh > 160
            several += 1
    assert several > 50
    counts = {r["document_id"]: r["n_chunks"] for r in registry.queries()["chunk_summary"](spark, small).collect()}
    assert counts == {i: len(chunking.split_text(t, 200)) for i, t in texts.items() if t.strip()}


def test_counters(spark):
    asked = []
    count = chunking.remembered(lambda t: asked.append(t) or len(t))
    text = "one two three. four five six. " * 30
    plain = chunking.split_text(text, 40, len)
    assert chunking.split_text(text, 40, count) == plain and len(asked) == len(set(asked))
    before = len(asked)
    assert chunking.split_text(text, 40, count) == plain and len(asked) == before
    lengths = []
    assert chunking.split_text(text, 40, lambda t: lengths.append(len(t)) or len(t), longest=1) == plain and max(lengths) <= 40
    tokens = chunking.token_count_of("/opt/tokenizers/byte_bpe_50k.json")
    assert tokens("some words <|endoftext|>") > 3 and all(tokens(text[a:b]) <= 20 for a, b in chunking.split_text(text, 20, tokens))
    df = spark.createDataFrame([("d", text)], "document_id string, text string")
    got = chunking.chunk_documents(df, 20, tokens).orderBy("chunk_index").collect()
    assert [(r["start_char"], r["end_char"]) for r in got] == chunking.split_text(text, 20, tokens)


def words_apart(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def test_word_errors_of_every_pair(spark, small):
    form = lambda t: unicodedata.normalize("NFC", t).lower().split()
    texts = {r["item_id"]: form(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    want = {i: words_apart(t, texts[i + 1]) / len(t) for i, t in texts.items() if i + 1 in texts}
    got = {r["item_id"]: r["wer"] for r in registry.queries()["word_errors"](spark, small).collect()}
    assert got == want and len(got) > 10
    assert X.word_distance([], ["a"]) == 1 and X.word_distance(["a", "b", "c"], ["b", "c", "d"]) == 2 and X.word_distance(["a"], []) == 1 and X.word_distance([], []) == 0


def cosine_by_hand(a: str, b: str) -> float:
    def vector(t):
        t, out, mask = " " + " ".join(t.lower().split()) + " ", {}, (1 << 64) - 1
        for x, y, z in zip(t, t[1:], t[2:]):
            g = (ord(x) * 0x9E3779B97F4A7C15 & mask) ^ (ord(y) * 0xC2B2AE3D27D4EB4F & mask) ^ (ord(z) * 0x165667B19E3779F9 & mask)
            k = ((g ^ g >> 29) * 0xBF58476D1CE4E5B9 & mask) >> 56
            out[k] = out.get(k, 0) + 1
        return out

    u, v = vector(a), vector(b)
    norm = sum(x * x for x in u.values()) ** 0.5 * sum(x * x for x in v.values()) ** 0.5
    return sum(x * v.get(k, 0) for k, x in u.items()) / norm if norm else 0.0


def clean_by_hand(t: str) -> tuple[str, int]:
    found = [(*m.span(), "ADDRESS") for m in S.ADDRESS.finditer(t)] + [(*m.span(), "PERSON") for m in S.HONORIFIC.finditer(t)]
    sure = list(found)
    for m in S.TITLE_CASE.finditer(t):
        if not any(a <= m.start() and m.end() <= b for a, b, _ in sure) and not all(w in S.COMMON for w in m.group().split()):
            context = t[max(0, m.start() - 100) : m.end() + 100]
            if max(cosine_by_hand(context, c) for c in S.CONTEXTS) >= 0.35:
                found.append((*m.span(), "PERSON"))
    out, last, n = [], 0, 0
    for a, b, kind in sorted(found, key=lambda x: x[0]):
        if a >= last:
            out += [t[last:a], f"<{kind}>"]
            last, n = b, n + 1
    return "".join([*out, t[last:]]), n


def test_every_document_is_cleaned_as_by_hand(spark, small):
    docs = {r["document_id"]: r["text"] for r in T.documents(spark, small).collect()}
    got = {r["document_id"]: (r["text_clean"], r["pii_count"]) for r in registry.queries()["pii_clean"](spark, small).collect()}
    assert got == {i: clean_by_hand(t) for i, t in docs.items()}
    letter = "Yours sincerely, signed by the officer Jane Miller for the department. She spoke with Mr Lee at 12 High Street, Perth WA 6000 and New South Wales."
    df = spark.createDataFrame([("1", letter)], "document_id string, text string")
    assert pii.clean(df, entities=("PERSON", "ADDRESS")).first()["text_clean"] == clean_by_hand(letter)[0] != letter
    assert len(S.CONTEXTS) == 12 and S.hashed_context_scores([]) == []


def test_pages_are_cleaned_and_scores_count_tags(spark):
    page = "array<struct<page_number:int,text:string>>"
    df = spark.createDataFrame([("a", [(0, "Dr Jane Doe came"), (1, ""), (2, "and Mr John Roe left")]), ("b", [])], f"document_id string, pages {page}")
    got = {r["document_id"]: r for r in pii.clean_pages(df).collect()}
    assert [p["text"] for p in got["a"]["pages"]] == ["<PERSON> came", "", "and <PERSON> left"] and got["a"]["pii_count"] == 2 and got["b"]["pii_count"] == 0
    rows = [("a", "Ann and Bob", "<PERSON> and Bob <EMAIL>", "Ann", "PERSON"), ("a", "Ann and Bob", "<PERSON> and Bob <EMAIL>", "Bob", "PERSON"), ("b", "at 5 Low St", "at <ADDRESS>", "5 Low St", "ADDRESS"), ("b", "at 5 Low St", "at <ADDRESS>", "12", "DATE")]
    truth = spark.createDataFrame(rows, "document_id string, raw string, clean string, span_text string, entity_type string")
    r = pii.cleaning_scores(truth).first()
    assert (r["recall"], r["precision"], r["coverage"], r["n"], r["found"], r["tags"]) == (0.5, 2 / 3, 0.75, 4, 2, 3)
    assert pii.cleaning_scores(truth.filter("false")).first().asDict() == {"recall": 0.0, "precision": 0.0, "coverage": 0.0, "n": 0, "found": 0, "tags": 0}


def test_enrichment_tables_and_their_readers(spark, small, tmp_path):
    e, c = T.enriched(spark, small), T.windows(spark, small)
    out = sinks.write_enrichment(e, c, str(tmp_path))
    assert set(out) == {"entities", "graph_edges", "enrichment_meta"}
    key = lambda df: sorted(map(str, df.collect()))
    kept = graph.load_mentions(spark, out["entities"])
    assert key(kept) == key(graph.entity_mentions(e, c)) and kept.filter("role IS NULL").count() == 0
    assert key(spark.read.parquet(out["graph_edges"])) == key(graph.edges_to_rows(graph.edges(e, c))) and spark.read.parquet(out["enrichment_meta"]).count() == e.count()
    none = e.withColumn("e", F.when(F.lit(False), F.col("e")))
    assert sinks.write_enrichment(none, c, str(tmp_path)) is None
    half = e.withColumn("e", F.when(F.col("document_id").cast("int") % 2 == 0, F.col("e")))
    out = sinks.write_enrichment(half, c, str(tmp_path / "half"))
    assert 0 < spark.read.parquet(out["enrichment_meta"]).count() < e.count() and spark.read.parquet(out["graph_edges"]).filter("CAST(document_id AS INT) % 2 = 1").count() == 0
    n = graph.nodes(e, c)
    assert graph.nodes_by_label(n, "person").count() == 2 * e.count()


def test_spans_without_a_chunk_and_nodes_with_one_id(spark):
    spans = spark.createDataFrame([("d", 0, 5), ("d", 50, 60), ("x", 0, 5)], "document_id string, start int, end int")
    chunks = spark.createDataFrame([("d", 0, 0, 10, "narrative"), ("d", 1, 4, 20, "narrative"), ("d", 2, 45, 70, "table")], "document_id string, chunk_index int, start_char int, end_char int, content_type string")
    got = {(r["document_id"], r["start"]): r["chunk_index"] for r in graph.first_chunk(spans, chunks, ["document_id", "start", "end"]).collect()}
    assert got == {("d", 0): 0, ("d", 50): -1, ("x", 0): -1}
    from quillmill.functions.enrichment import parse

    json = '{"text": "abcdef", "type": "t", "persons": [{"id": "p", "name": {"start": 0, "end": 2}, "mentions": [{"start": 50, "end": 60}, {"start": 5, "end": 6}]}, {"id": "p", "name": {"start": 2, "end": 4}}]}'
    e = spark.createDataFrame([("d", json)], "document_id string, j string").select("document_id", parse(F.col("j")).alias("e"))
    body = chunks.withColumn("text", F.lit("t"))
    for parts in (1, 5):
        n = graph.nodes(e.repartition(parts), body.repartition(parts)).filter("node_id = 'd:p'").first()
        assert n["props"]["name"] == "cd"
    assert {(r["mention_start"], r["chunk_index"]) for r in graph.entity_mentions(e, body).collect()} == {(50, -1), (5, 0)}


def test_forms_on_pages(spark):
    from quillmill.operators import classify

    df = spark.createDataFrame([(2, []), (1, ["a"] * 10), (0, ["a"] * 9 + ["x" * 31, " "])], "n int, spans array<string>")
    assert [r[0] for r in df.select(classify.has_form_structure(F.col("n"), F.col("spans"))).collect()] == [True, True, False]


def test_matching_of_words_and_regions():
    boxes = [("a", (0, 0, 10, 10)), ("b", (20, 0, 30, 10)), ("c", (21, 0, 31, 10))]
    assert metrics.match_words([("x", (20, 0, 30, 10)), ("y", (21, 0, 31, 10)), ("z", (90, 0, 99, 9))], boxes) == [1, 2]
    assert metrics.match_words([], boxes) == [] and metrics.match_words([("x", (0, 0, 1, 1))], []) == []
    assert metrics.concordance([3, 1, 2]) == 1 / 3 and metrics.concordance([1]) == 1.0


def match_by_hand(p, t, least):
    free, out = list(range(len(t))), []
    for box in p:
        with np.errstate(all="ignore"):
            best = max(((float(metrics.box_ious(box, np.array([t[k]], float))[0]), -k) for k in free), default=(-9.0, 0))
        out.append(-best[1] if best[0] >= least else -1)
        free = [k for k in free if k != out[-1]]
    return out


def random_boxes(rng, n, most, sizes=(1, 6)):
    corner, size = rng.integers(0, most, (n, 2)), rng.integers(*sizes, (n, 2))
    return np.column_stack([corner, corner + size]) + rng.random((n, 4)) * rng.integers(0, 2)


def test_boxes_are_matched_as_one_by_one():
    rng, hits = np.random.default_rng(5), 0
    for trial in range(200):
        n, m = rng.integers(0, 30, 2)
        docs, others = np.sort(rng.integers(0, 3, n)), np.sort(rng.integers(0, 3, m))
        p, t = (random_boxes(rng, k, (3, 9, 40)[trial % 3], (-1 if trial % 4 == 0 else 1, 8)) for k in (n, m))
        if trial % 5 == 0 and n and m:  # no numbers, infinite ones
            p[0, trial % 4], t[m - 1, trial // 2 % 4] = np.nan, np.inf
        least = (0.3, 0.05, 0.9, 0.0, -2.0)[trial // 5 % 5]
        want = np.full(n, -1)
        for d in range(3):
            at = np.flatnonzero(others == d)
            want[docs == d] = [-1 if k < 0 else at[k] for k in match_by_hand(p[docs == d], t[at], least)]
        for at_once in (1, 50, 1 << 20):
            assert metrics.match_boxes(docs, p, others, t, least, at_once).tolist() == want.tolist()
        hits += (want >= 0).sum()
    assert hits > 500


def test_pairs_of_a_large_page_stay_few(monkeypatch):
    """Boxes side by side, columns of lines: pairs compared grow far less than their square, and no comparison takes them all."""
    asked, plain = [], metrics.box_ious
    monkeypatch.setattr(metrics, "box_ious", lambda one, boxes: asked.append(len(boxes)) or plain(one, boxes))
    n = 3000
    k = np.arange(n)
    columns = np.column_stack([k % 3 * 100, k // 3 * 10, k % 3 * 100 + 90, k // 3 * 10 + 8.0])
    assert (metrics.match_boxes(k * 0, columns, k * 0, columns + 1, at_once=1000) == k).all()
    assert sum(asked) < 10 * n and max(asked) <= 1000
    asked.clear()
    same = np.tile([0.0, 0.0, 5.0, 5.0], (400, 1))
    assert (metrics.match_boxes(k[:400] * 0, same, k[:400] * 0, same, at_once=1000) == k[:400]).all() and max(asked) <= 1000


def test_layouts_are_matched_many_documents_at_a_time(spark):
    rng, names, sides = np.random.default_rng(6), ["a", "b", None, "?"], []
    for _ in range(2):
        rows = []
        for d in [None, *map(str, range(60))]:
            n = int(rng.integers(0, 12)) if d != "7" else 150
            ords = rng.permutation(n).tolist()
            rows += [(d, o, names[rng.integers(0, 4)], *map(float, b)) for o, b in zip(ords, random_boxes(rng, n, 4 if d != "7" else 30, (3, 8)))]
        sides.append([rows[k] for k in rng.permutation(len(rows))])
    want: dict = {}
    add = lambda label, k: want.setdefault(label, [0, 0, 0]).__setitem__(k, want[label][k] + 1)
    for d in [None, *map(str, range(60))]:
        p, t = (sorted((r for r in rows if r[0] == d), key=lambda r: r[1]) for rows in sides)
        partner = match_by_hand([r[3:] for r in p], [r[3:] for r in t], 0.3)
        right = {k for r, k in zip(p, partner) if k >= 0 and t[k][2] == r[2]}
        for r, k in zip(p, partner):
            add(r[2], 0 if k in right else 1)
        for k, r in enumerate(t):
            if k not in right:
                add(r[2], 2)
    p, t = (spark.createDataFrame(rows, "document_id string, ord int, label string, x0 double, y0 double, x1 double, y1 double") for rows in sides)
    got = metrics.match_layout(p, t)
    assert {r["label"]: [r["tp"], r["fp"], r["fn"]] for r in got.collect()} == want and sum(v[0] for v in want.values()) > 20
    assert {r["label"]: [r["tp"], r["fp"], r["fn"]] for r in metrics.match_layout(p.filter("false"), t.filter("ord = 0")).collect()} == {r["label"]: [0, 0, r["n"]] for r in t.filter("ord = 0").groupBy("label").agg(F.count("*").alias("n")).collect()}
    # no call of Python for each document
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan


def test_pages_are_drawn_without_python(spark):
    """Python gets pages in bounded batches and never makes a batch of them from small rows."""
    from quillmill.operators import redaction
    from quillmill.plans.rasters import pages_with_boxes

    ids = [0, 1, 2, 3, 4, 7, -1, 10**15 + 2, None]
    docs = spark.createDataFrame([(str(k), i) for k, i in enumerate(ids)], "document_id string, doc_id long")
    pages = pages_with_boxes(docs)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan(pages) for x in ("MapIn", "Python", "Pandas")) and "MapIn" not in plan(redaction.redaction_reports(pages))
    assert pages.dtypes == [("document_id", "string"), ("page_number", "int"), ("width", "int"), ("height", "int"), ("pixels", "binary")]
    got = {int(r["document_id"]): r for r in pages.collect()}
    for k, i in enumerate(ids[:-1]):
        want = np.full((60, 80), 255, np.uint8)
        for n in range(i % 4):
            for y in range(5 + 18 * n, 13 + 18 * n):
                for x in range(10, 22 + n):
                    want[y, x] = 0
        assert bytes(got[k]["pixels"]) == want.tobytes() and (got[k]["page_number"], got[k]["width"], got[k]["height"]) == (0, 80, 60)
    assert got[8]["pixels"] is None
    totals = {int(r["document_id"]): r["total"] for r in redaction.redaction_reports(pages).collect()}
    assert totals == {k: (i or 0) % 4 for k, i in enumerate(ids)}
    other = pages_with_boxes(docs, 30, 20)
    assert all(len(r["pixels"]) == 600 for r in other.filter("pixels IS NOT NULL").collect())
