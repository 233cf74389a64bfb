import itertools
import sys

import public_tokenizers
import tiktoken

import corpus_pipeline
from quillmill.llm import bpe_codec, pii_anchors, shared, source_mixing
from quillmill.llm.bpe_core import DEFAULT_VOCAB, Ranks

from .common import empty, nasty, rows
from .test_documents import by_hand, verdict_by_hand
from .test_tokens import blocks_by_hand

ENCODE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=Ranks.load().rank, special_tokens={}).encode_ordinary


def stages_by_hand(table, columns):
    """What each of the first three stages leaves of rows, one at a time or by all pairs; (rows, texts) after each."""
    good = [r for r in table if verdict_by_hand((r["text"] or "").encode())[2]]
    groups = {}
    for i, c, _, keep in by_hand([(r["doc_id"], r["text"]) for r in good]):
        groups[i] = keep
    seen, kept = set(), []
    for r in sorted(good, key=lambda r: str([r[c] for c in columns])):
        mine = (r["doc_id"], r["text"])
        if r["doc_id"] is None or groups[r["doc_id"]] and mine not in seen:
            kept.append(r)
            seen.add(mine)
    return good, kept, [(r["doc_id"], pii_anchors.redact(r["text"], pii_anchors.find_items(r["text"]))) for r in kept]


def test_stages_against_a_brute_force_version(spark, small):
    """Each stage of the pipeline on the whole table, one document at a time or by all pairs, and blocks drawn by hand."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    table = {r["doc_id"]: r for r in docs.collect()}
    good, kept, clean = stages_by_hand(list(table.values()), docs.columns)
    assert len(table) > len(good) > len(kept) > 50

    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality"](spark, docs, small)
    assert {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in good} and one.columns == docs.columns

    two = stages["near_copies"](spark, shared.written(one, "t1"), small)
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(r["doc_id"] for r in kept) and two.columns == docs.columns

    three = stages["private_data"](spark, shared.written(two, "t2"), small)
    assert sorted((r["doc_id"], r["text"]) for r in three.collect()) == sorted(clean) and three.columns == docs.columns
    assert any(t != table[i]["text"] for i, t in clean)

    pieces = shared.written(stages["mixture"](spark, shared.written(three, "t3"), small), "t4")
    assert pieces.columns == docs.columns
    ranks = Ranks.load()
    whole = blocks_by_hand(spark, [(i, t, table[i]["source"]) for i, t in clean], ENCODE, source_mixing.BLOCK_TOKENS, source_mixing.LANE_DOCS)
    want: dict = {}
    for r in source_mixing.draw_slots(spark, {s: len(b) for s, b in whole.items()}).collect():
        for i, run in itertools.groupby(whole[r["source"]][r["index"]], key=lambda x: x[0]):
            want.setdefault(i, []).append(b"".join(ranks.tokens[x] for _, x in run if x != ranks.size))
    got: dict = {}
    for r in pieces.collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"]) and (r["source"], r["lang"]) == (table[r["doc_id"]]["source"], table[r["doc_id"]]["lang"])
    assert set(got) == {i for i, x in want.items() if any(x)}
    for i, texts in got.items():
        # a character that is cut belongs to the piece with its first byte
        mine = sorted(x.decode("utf-8", "ignore") for x in want[i] if x)
        assert len(mine) == len(texts) and all(y in (x, x + y[-1:]) for x, y in zip(mine, sorted(texts)))

    five = stages["tokens"](spark, pieces, small)
    assert sorted((r["doc_id"], r["decoded"], r["token_ids"]) for r in five.collect()) == sorted((r["doc_id"], r["text"], ENCODE(r["text"])) for r in pieces.collect())


def test_run_gives_the_stages_result(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, small), "step")
    key = lambda df: sorted((r["doc_id"], r["decoded"], tuple(r["token_ids"])) for r in df.collect())
    assert key(corpus_pipeline.run(spark, small)) == key(docs)


def test_nasty_rows_come_out_as_defined(spark, small):
    docs, after = nasty(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, small), "nasty")
        after[name] = [r.asDict() for r in docs.collect()]
        if name != "tokens":
            assert docs.columns == nasty(spark).columns and docs.dtypes == nasty(spark).dtypes
    ids = {k: sorted((r["doc_id"] for r in v), key=str) for k, v in after.items()}
    # null, empty and blank texts and the long repetitive one go; of 1, 2 and 2 again one stays; null ids stay
    assert ids["quality"] == [1, 2, 2, 7, 8, 9, None]
    assert ids["near_copies"] == ids["private_data"] == [1, 7, 8, 9, None]
    texts = {r["doc_id"]: r["text"] for r in after["private_data"]}
    assert texts[7] == "écoute é 中文 😀 mail <EMAIL> now" and texts[8] == "%%% $$$ ###"
    # every piece lies in its document, keeps its other columns and comes back from its tokens
    origin = {r[0]: r for r in rows()}
    for r in after["mixture"]:
        assert r["text"] in texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
        assert [r[c] for c in nasty(spark).columns if c not in ("text", "n_chars")] == [x for c, x in zip(nasty(spark).columns, origin[r["doc_id"]]) if c not in ("text", "n_chars")]
    assert sorted(r["decoded"] for r in after["tokens"]) == sorted(r["text"] for r in after["mixture"]) and after["mixture"]


def test_empty_table_gives_empty_stages(spark, small):
    docs = empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, small), "none")
        assert docs.count() == 0 and (name == "tokens" or docs.columns == empty(spark).columns)


def test_stages_with_string_ids_other_cases_and_without_other_columns(spark, small):
    bad = "again " * 400
    data = [("a", "The quick brown fox jumps over the lazy dog again", "s"), ("b", "The quick brown fox jumps over the lazy dog again", "s"), ("b", "Another text altogether, to a.b@c.example.org", None), ("c", bad, "s"), (None, None, "s")]
    docs = spark.createDataFrame(data, "DOC_ID string, Text string, Source string")
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, small), "strings")
        if name == "private_data":
            assert sorted(map(tuple, docs.collect())) == [data[0], ("b", "Another text altogether, to <EMAIL>", None)]
        if name == "mixture":
            assert docs.columns == ["DOC_ID", "Text", "Source"]
    assert all(r["decoded"] for r in docs.collect())


def test_shared_folder_comes_from_the_session(spark):
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_language_model_package_is_used_by_nothing_else():
    import ast
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent / "quillmill"
    for f in root.rglob("*.py"):
        if "llm" in f.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names)
    assert "quillmill.llm" in sys.modules


def test_codec_keeps_results_when_its_memory_starts_afresh(monkeypatch):
    import pyarrow as pa

    from quillmill.llm.arrays import buffers

    codec = bpe_codec.HeapCodec.load(DEFAULT_VOCAB)
    buf, offs = buffers(pa.array(["some words and more words that go on"] * 3, pa.large_string()))
    a = codec.encode_slice(buf, offs)[0].tolist()
    codec.kept.clear()
    monkeypatch.setattr(bpe_codec, "KEPT", 2)
    assert codec.encode_slice(buf, offs)[0].tolist() == a
