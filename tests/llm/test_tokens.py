import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import zstandard
from hypothesis import given, settings, strategies as st

from quillmill.llm import bpe_codec, source_mixing, token_counts, token_store
from quillmill.llm.arrays import buffers, slices
from quillmill.llm.bpe_core import DEFAULT_VOCAB, Ranks

from .common import empty, nasty, rows


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(DEFAULT_VOCAB, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def both(texts):
    buf, offs = buffers(pa.array(texts, pa.large_string()))
    for encode in (Ranks.load().encode_slice, bpe_codec.HeapCodec.load(DEFAULT_VOCAB).encode_slice):
        ids, o = encode(buf, offs)
        yield [ids[a:b].tolist() for a, b in zip(o, o[1:])]


def test_both_encoders_match_the_reference_on_odd_texts(reference):
    rnd = random.Random(3)
    parts = ["a", "'", "s", "'re", "'ll", "ve", " ", "  ", "\n", "\t", "7", "é", "中", " ", "　", "!", "😀", "=", "E", "don't", "'S"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 40))) for _ in range(1500)] + ["=" * 3000, "ab" * 999, " " * 500, "", "abab" * 70 + "a", "".join(rnd.choice("ACGT") for _ in range(5000)), "é" * 1001]
    want = [reference(t) for t in texts]
    for got in both(texts):
        assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=8))
def test_round_trip_of_any_text(texts):
    ranks = Ranks.load()
    buf, offs = buffers(pa.array(texts, pa.large_string()))
    ids, o = ranks.encode_slice(buf, offs)
    raw, b = ranks.decode_flat(ids, o)
    assert [raw[x:y].tobytes().decode() for x, y in zip(b, b[1:])] == texts


def test_counts_and_codec_on_nasty_rows(spark, reference):
    want = sorted((str(r[0]), len(reference(r[1] or ""))) for r in rows())
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts.token_counts(nasty(spark)).collect()) == want
    got = bpe_codec.encode_decode(nasty(spark)).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == want
    assert sorted(str(r["decoded"]) for r in got) == sorted(str(r[1]) for r in rows())
    back = bpe_codec.decode(bpe_codec.encode_decode(nasty(spark))).collect()
    assert sorted(r["text"] for r in back) == sorted(r[1] or "" for r in rows())


def test_empty_tables(spark):
    e = empty(spark)
    assert token_store.check_manifests(token_store.build_store(e), token_store.manifests(token_store.build_store(e))).count() == 0
    assert token_counts.token_counts(e).count() == 0
    assert bpe_codec.encode_decode(e).count() == 0
    assert token_store.content_store(e).count() == 0
    assert source_mixing.mix_sources(e).count() == 0
    assert source_mixing.mix_documents(e).count() == 0


def cuts_by_hand(ids, window=16, bits=8, least=64, most=4096):
    """One id at a time."""
    from quillmill.llm.arrays import mix64

    base, mask = 0xD6E8FEB86659FD93, (1 << 64) - 1
    each = [int(x) for x in mix64(np.array(ids, np.uint64) + np.uint64(0x517CC1B7))]
    ends, last = [], 0
    for i in range(len(ids)):
        h = sum(each[i - k] * pow(base, k, 1 << 64) for k in range(min(window, i + 1))) & mask
        n = i + 1 - last
        if n > most:
            ends.append(last + most)
            last += most
            n -= most
        if n >= least and h >> (64 - bits) == 0:
            ends.append(i + 1)
            last = i + 1
    if len(ids) > last:
        ends.append(len(ids))
    return ends


def test_cut_points_match_a_plain_loop():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50000, n) for n in (0, 1, 63, 64, 700, 5000)] + [np.full(9000, 5), np.arange(12000)]
    offs = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    got = token_store.cut_points(np.concatenate(docs).astype(np.int32), offs)
    assert got == [cuts_by_hand(d.tolist()) for d in docs]


def test_store_rebuilds_every_document_and_shares_chunks(spark):
    store = token_store.build_store(nasty(spark))
    back = token_store.reconstruct(store).collect()
    want = {(r[0], r[1] or "") for r in rows()}
    assert {(r["doc_id"], r["text"]) for r in back} == want and all(r["exact"] for r in back)
    docs = {r["doc_id"]: r for r in store.filter("kind = 'document'").collect()}
    assert docs[1]["recipe"] == docs[2]["recipe"] and docs[2]["refs"] == 2
    assert docs[4]["recipe"] == [] and docs[4]["digest"] == token_store.EMPTY_ROOT
    chunks = [r["digest"] for r in store.filter("kind = 'chunk'").collect()]
    assert len(chunks) == len(set(chunks))
    assert all(r["verified"] for r in token_store.verify(store).collect())


def test_refs_count_references_whatever_the_partitions(spark):
    rnd = random.Random(8)
    block = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "river", "stone"]) for _ in range(9000))
    data = [(i, f"{block} {block}" if i % 2 else block) for i in range(12)] + [(1, f"{block} {block}")]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    for parts in (1, 5):
        store = token_store.build_store(df.repartition(parts)).collect()
        want = {}
        for r in store:
            if r["kind"] == "document":
                for c in r["recipe"]:
                    want[c] = want.get(c, 0) + r["refs"]
        assert {r["digest"]: r["refs"] for r in store if r["kind"] == "chunk"} == want and max(want.values()) > 12


def test_verification_sees_a_lost_and_a_changed_chunk(spark):
    from pyspark.sql import functions as F

    store = token_store.build_store(nasty(spark))
    whole = store.filter("kind = 'document' AND doc_id = 1").first()["recipe"][0]
    for bad in (store.filter((F.col("kind") != "chunk") | (F.col("digest") != F.lit(whole))), store.withColumn("payload", F.when(F.col("digest") == F.lit(whole), F.lit(b"no frame")).otherwise(F.col("payload")))):
        seen = {r["doc_id"]: r["verified"] for r in token_store.verify(bad).collect()}
        assert seen[1] is False and seen[2] is False and seen[7] is True


def store_by_hand(data, reference):
    """Chunks, recipes and roots one document at a time: {digest: (ids, refs)}, {(id, root): (recipe, ids, refs)}."""
    chunks: dict = {}
    docs: dict = {}
    for i, t in data:
        ids = reference(t or "")
        recipe, start = [], 0
        for end in cuts_by_hand(ids):
            part = ids[start:end]
            digest = hashlib.sha256(np.array(part, "<u2").tobytes()).digest()
            chunks[digest] = (part, chunks.get(digest, (None, 0))[1] + 1)
            recipe.append(digest)
            start = end
        level = recipe or [b""]
        while len(level) > 1:
            level = [hashlib.sha256(b"\x01" + level[k] + level[k + 1]).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        root = level[0] if recipe else hashlib.sha256(b"").digest()
        docs[i, root] = (recipe, len(ids), docs.get((i, root), (None, None, 0))[2] + 1)
    return chunks, docs


def test_store_query_against_a_plain_version(spark, reference, tmp_path):
    rnd = random.Random(21)
    passage = " ".join(rnd.choice(["alpha", "beta", "gamma", "river", "stone", "écoute"]) for _ in range(1500))
    data = [(r[0], r[1]) for r in rows()] + [(20 + i, f"{passage} {'x' * i} {passage}" if i % 2 else passage) for i in range(8)] + [(20, "another text of the same id")]
    spark.createDataFrame(data, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    chunks, docs = store_by_hand(data, reference)
    got = token_store.QUERIES["op5_token_store"](spark, str(tmp_path)).collect()
    un = zstandard.ZstdDecompressor().decompress
    assert {bytes.fromhex(r["digest"]): (np.frombuffer(un(r["payload"]), "<u2").tolist(), r["refs"]) for r in got if r["kind"] == "chunk"} == chunks
    mine = [r for r in got if r["kind"] == "document"]
    assert {(r["doc_id"], bytes.fromhex(r["digest"])): ([bytes.fromhex(c) for c in r["recipe"]], r["n_ids"], r["refs"]) for r in mine} == docs and len(mine) == len(docs)
    assert all(r["verified"] for r in got if r["kind"] != "chunk")
    by_shard: dict = {}
    for r in mine:
        leaf = hashlib.sha256(token_store.leaf_bytes(None if r["doc_id"] is None else str(r["doc_id"]), bytes.fromhex(r["digest"]), r["refs"])).digest()
        by_shard.setdefault(r["shard"], []).append(leaf)
    want = {s: (len(x), token_store.merkle_root(sorted(x)).hex().upper()) for s, x in by_shard.items()}
    assert {r["shard"]: (r["n_ids"], r["digest"]) for r in got if r["kind"] == "manifest"} == want


def test_manifests_in_buckets_see_lost_added_and_changed_documents(spark):
    store = token_store.build_store(spark.createDataFrame([(f"d{i}", f"text number {i} " * (i % 7)) for i in range(200)] + [(None, f"no id {i}") for i in range(50)], "doc_id string, text string"), shards=4)
    kept = token_store.manifests(store, leaves=8).cache()
    assert kept.count() == 4 and kept.agg({"n_docs": "sum"}).first()[0] == 250
    assert {r["root"] for r in kept.collect()} != {r["root"] for r in token_store.manifests(store).collect()}
    assert all(r["intact"] for r in token_store.check_manifests(store, kept, leaves=8).collect())
    one = store.filter("doc_id = 'd17'")
    shard = one.first()["shard"]
    from pyspark.sql import functions as F

    for bad in (store.filter("doc_id IS NULL OR doc_id <> 'd17'"), store.unionByName(one.withColumn("doc_id", F.lit("d17b"))), store.withColumn("refs", F.when(F.col("doc_id") == "d17", 9).otherwise(F.col("refs")))):
        assert {r["shard"]: r["intact"] for r in token_store.check_manifests(bad, kept, leaves=8).collect()} == {s: s != shard for s in range(4)}


def test_a_lost_chunk_shows_in_its_documents_and_manifests(spark, monkeypatch):
    from pyspark.sql import functions as F

    build = token_store.build_store

    def lossy(*args):
        store = build(*args)
        return store.filter((F.col("kind") != "chunk") | (F.col("digest") != F.lit(whole)))

    whole = build(nasty(spark)).filter("kind = 'document' AND doc_id = 1").first()["recipe"][0]
    monkeypatch.setattr(token_store, "build_store", lossy)
    got = token_store.content_store(nasty(spark)).collect()
    bad = {r["shard"] for r in got if r["kind"] == "document" and not r["verified"]}
    assert {r["doc_id"] for r in got if r["kind"] == "document" and not r["verified"]} == {1, 2}
    assert {r["shard"] for r in got if r["kind"] == "manifest" and not r["verified"]} == bad


def test_long_pretokens_take_seconds(reference):
    import time

    rnd = random.Random(4)
    text = "".join(rnd.choice("abcdefghij") for _ in range(1_000_000))
    buf, offs = buffers(pa.array([text], pa.large_string()))
    began = time.time()
    ids, _ = Ranks.load().encode_slice(buf, offs)
    assert time.time() - began < 20
    assert b"".join(Ranks.load().tokens[k] for k in ids.tolist()).decode() == text
    for n in (255, 256, 257, 20_000):
        buf, offs = buffers(pa.array([text[:n], f"{text[-n:]} short"], pa.large_string()))
        ids, o = Ranks.load().encode_slice(buf, offs)
        assert [ids[a:b].tolist() for a, b in zip(o, o[1:])] == [reference(text[:n]), reference(f"{text[-n:]} short")]


def test_permutations_are_permutations():
    for n in (1, 2, 3, 5, 8, 1000, 1025):
        for key in (0, 1, 2**60):
            assert sorted(source_mixing.permute(np.arange(n), n, key).tolist()) == list(range(n))


def test_blocks_tile_every_document(spark, reference):
    b = source_mixing.pack_blocks(nasty(spark), block=32, lane_docs=2, with_text=True).collect()
    import zstandard

    eos = Ranks.load().size
    for r in b:
        ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["ids"]), "<u4")
        assert len(ids) == 32 and sum(r["lens"]) == r["n_tokens"] <= 32 and (ids[r["n_tokens"] :] == eos).all()
    total = sum(r["n_tokens"] for r in b)
    assert total == sum(len(reference(r[1] or "")) + 1 for r in rows())
    said: dict = {}
    for r in b:
        for d, t in zip(r["doc_ids"], r["texts"]):
            said[d] = said.get(d, 0) + len(t)
    want: dict = {}
    for r in rows():
        want[r[0]] = want.get(r[0], 0) + len(r[1] or "")
    assert said == want


def test_texts_of_pieces_are_those_of_their_tokens(spark):
    import zstandard

    rnd = random.Random(12)
    data = [(i, " ".join(rnd.choice(["river", "stone", "écoute", "green", "中文", "😀"]) for _ in range(rnd.randrange(1, 60))), "en", "a") for i in range(60)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string")
    ranks = Ranks.load()
    said: dict = {}
    for r in source_mixing.pack_blocks(df, block=32, lane_docs=2, with_text=True).collect():
        ids, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["ids"]), "<u4"), 0
        for d, n, t in zip(r["doc_ids"], r["lens"], r["texts"]):
            raw = b"".join(ranks.tokens[k] for k in ids[at : at + n].tolist() if k != ranks.size)
            at += n
            # a character that is cut belongs to the piece with its first byte
            assert abs(len(t.encode()) - len(raw)) <= 6
            said[d] = said.get(d, 0) + len(t)
    assert said == {i: len(t) for i, t, *_ in data}


def test_mixture_against_a_plain_version(spark):
    """Slots, epochs and weights as drawn by hand."""
    sizes, w = {"a": 7, "b": 3, "c": 0}, {"a": 1.0, "b": 3.0, "zzz": 5.0}
    got = source_mixing.draw_slots(spark, sizes, w, epochs=3.0, shard_blocks=8).collect()
    assert len(got) == 30 and {r["source"] for r in got} <= {"a", "b"}
    assert len({(r["shard"], r["slot"]) for r in got}) == 30
    start = {"a": 0, "b": 0}
    for shard in range(4):
        size = min(8, 30 - 8 * shard)
        counts = np.random.Generator(np.random.Philox(key=np.array([source_mixing.SEED, shard], np.uint64))).multinomial(size, [0.25, 0.75])
        for k, s in enumerate("ab"):
            mine = [(r["epoch"], r["index"]) for r in got if r["shard"] == shard and r["source"] == s]
            assert len(mine) == counts[k]
            want = []
            for x in range(start[s], start[s] + counts[k]):
                e, at = divmod(x, sizes[s])
                want.append((e, int(source_mixing.permute(np.array([at]), sizes[s], source_mixing._key(source_mixing.SEED, k, e))[0])))
            assert sorted(mine) == sorted(want)
            start[s] += counts[k]
    # no block comes again before all of its source had their turn
    for s in "ab":
        seen = [(r["epoch"], r["index"]) for r in got if r["source"] == s]
        assert len(seen) == len(set(seen)) and max(e for e, _ in seen) == (len(seen) - 1) // sizes[s]


def test_draws_over_groups_of_sources_against_a_plain_version(spark):
    sizes = {f"s{k:02}": (k * 7) % 5 for k in range(23)}
    w = {f"s{k:02}": float(k % 4) for k in range(30)}
    for weights in (None, w):
        names = sorted(s for s, n in sizes.items() if n and (weights is None or weights.get(s, 0) > 0))
        each = np.array([sizes[s] ** source_mixing.TEMPER if weights is None else weights[s] for s in names])
        total = round(sum(sizes.values()) * 3)
        want, start = set(), [0] * len(names)
        for shard in range(-(-total // 16)):
            size, at = min(16, total - 16 * shard), 0
            groups = [range(k, min(k + 4, len(names))) for k in range(0, len(names), 4)]
            sums = np.array([each[list(g)].sum() for g in groups])
            rng = lambda key: np.random.Generator(np.random.Philox(key=np.array([key & (1 << 64) - 1, shard], np.uint64)))  # noqa: B023, E731
            for g, n in enumerate(rng(source_mixing.SEED ^ 1 << 63).multinomial(size, sums / sums.sum())):
                mine = each[list(groups[g])]
                for k, taken in zip(groups[g], rng(source_mixing.SEED + g * 0x9E3779B97F4A7C15).multinomial(n, mine / mine.sum()) if n else []):
                    for x in range(start[k], start[k] + taken):
                        e, i = divmod(x, sizes[names[k]])
                        index = int(source_mixing.permute(np.array([i]), sizes[names[k]], source_mixing._key(source_mixing.SEED, k, e))[0])
                        slot = int(source_mixing.permute(np.array([at]), size, source_mixing._key(source_mixing.SEED, shard, 1 << 40))[0])
                        want.add((names[k], index, e, shard, slot))
                        at += 1
                    start[k] += taken
        for rows_ in (0, 100):
            got = source_mixing.draw_slots(spark, sizes, weights, epochs=3.0, shard_blocks=16, group=4, broadcast_rows=rows_).collect()
            assert len(got) == total == len(want) and {(r["source"], r["index"], r["epoch"], r["shard"], r["slot"]) for r in got} == want


def blocks_by_hand(spark, data, reference, block, lane_docs):
    """{source: blocks in order of their index}, each a list of (id, ids); ``data``: (id, text, source, ...)."""
    eos = Ranks.load().size
    sizes: dict = {}
    for r in data:
        sizes[r[2] or ""] = sizes.get(r[2] or "", 0) + 1
    spread = spark.createDataFrame([(k, r[0], r[1]) for k, r in enumerate(data)], "k int, doc_id bigint, text string").selectExpr("k", "xxhash64(IF(doc_id IS NULL, text, NULL), doc_id) AS h").collect()
    lanes: dict = {}
    for r in spread:
        i, t, s = data[r["k"]][:3]
        lane = r["h"] % -(-sizes[s or ""] // lane_docs)
        lanes.setdefault((s or "", lane), []).append((i is not None, i or 0, reference(t or "") + [eos], i))
    out: dict = {}
    rests: dict = {}
    for (s, lane), docs in sorted(lanes.items()):
        stream = [(i, x) for _, _, ids, i in sorted(docs, key=lambda d: (d[0], d[1], zstd_ids(d[2][:-1]))) for x in ids]
        whole = len(stream) // block * block
        out.setdefault(s, []).extend(stream[k : k + block] for k in range(0, whole, block))
        rests.setdefault(s, []).extend(stream[whole:])
    for s, stream in rests.items():
        out[s] = [stream[k : k + block] for k in range(0, len(stream), block)] + out.get(s, [])
    return out


def zstd_ids(ids):
    return zstandard.ZstdCompressor(level=1).compress(np.array(ids, "<u4").tobytes())


def test_mixing_query_against_a_plain_version(spark, reference):
    rnd = random.Random(41)
    word = lambda: rnd.choice(["river", "stone", "écoute", "green", "中文", "😀", "1234"])
    data = [(i, " ".join(word() for _ in range(rnd.randrange(0, 80))), rnd.choice(["hot", "hot", "hot", "a", "b", None])) for i in range(150)] + [(None, f"no id {i}", "hot") for i in range(20)] + [(r[0], r[1], r[3]) for r in rows() if r[0] != 6]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string").repartition(6)
    blocks = blocks_by_hand(spark, data, reference, 32, 8)
    weights = {"hot": 1.0, "a": 2.0, "": 1.5, "nothing": 9.0}
    sizes = {s: len(b) for s, b in blocks.items()}
    for epochs, w in ((1.0, None), (2.5, weights)):
        got = source_mixing.mix_sources(df, block=32, lane_docs=8, shard_blocks=16, epochs=epochs, weights=w).collect()
        slots = {(r["shard"], r["slot"]): (r["source"], r["index"], r["epoch"]) for r in source_mixing.draw_slots(spark, sizes, w, epochs, 16).collect()}
        assert len(got) == len(slots) == round(sum(sizes.values()) * epochs)
        eos = Ranks.load().size
        for r in got:
            s, index, epoch = slots[r["shard"], r["slot"]]
            assert (r["source"], r["block_index"], r["epoch"]) == (s, index, epoch)
            want = blocks[s][index]
            assert r["token_ids"] == [x for _, x in want] + [eos] * (32 - len(want)) and r["n_tokens"] == len(want)
            assert [i for i, n in zip(r["doc_ids"], r["lens"]) for _ in range(n)] == [i for i, _ in want]


def test_pieces_of_the_mixture_are_the_drawn_tokens_texts(spark):
    rnd = random.Random(43)
    data = [(f"d{i}", " ".join(rnd.choice(["river", "stone", "green", "hill"]) for _ in range(rnd.randrange(0, 90))), "ab"[i % 2], f"http://x/{i}", [i, i + 1]) for i in range(80)]
    df = spark.createDataFrame(data, "Doc_Id string, TEXT string, source string, `url.of` string, k array<int>")
    want: dict = {}
    blocks = source_mixing.mix_sources(df, block=32, lane_docs=8, shard_blocks=16).collect()
    ranks = Ranks.load()
    for r in blocks:
        at = 0
        for d, n in zip(r["doc_ids"], r["lens"]):
            t = b"".join(ranks.tokens[x] for x in r["token_ids"][at : at + n] if x != ranks.size).decode()
            at += n
            if t:
                want[d, t] = want.get((d, t), 0) + 1
    out = source_mixing.mix_documents(df, block=32, lane_docs=8, shard_blocks=16)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got: dict = {}
    table = {r[0]: r for r in data}
    for r in out.collect():
        got[r[0], r[1]] = got.get((r[0], r[1]), 0) + 1
        assert tuple(r)[2:] == table[r[0]][2:]
    assert got == want and len(want) > 80


def test_running_sums_over_many_neighbours(spark):
    data = [(g, k * 3 - 50, (k * 7 + g) % 11) for g in range(3) for k in range(200)]
    for wide in (1, 7, 4096):
        got = source_mixing.sums_before(spark.createDataFrame(data, "g int, at bigint, n bigint"), "g", "at", "n", "start", wide).collect()
        assert {(r["g"], r["at"]): r["start"] for r in got} == {(g, at): sum(n for g2, a2, n in data if g2 == g and a2 < at) for g, at, _ in data} and len(got) == 600


def test_mixing_does_not_depend_on_partitions_or_broadcasts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    key = lambda df: sorted((r["shard"], r["slot"], r["source"], r["block_index"], tuple(r["token_ids"])) for r in df.collect())
    one = key(source_mixing.mix_sources(docs, block=256, shard_blocks=32))
    two = key(source_mixing.mix_sources(docs.repartition(7), block=256, shard_blocks=32, broadcast_rows=0))
    assert one == two


def test_slices_cover_all():
    offs = np.array([0, 5, 5, 90, 91, 300])
    for limit in (1, 10, 100, 1000):
        got = list(slices(offs, limit))
        assert got[0][0] == 0 and got[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(got, got[1:]))
