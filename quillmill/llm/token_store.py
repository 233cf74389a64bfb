"""Content-addressed store of token-id streams.

A rolling hash over the last ``WINDOW`` ids cuts each document's id stream
where its top bits are zero, so equal passages give equal chunks wherever
they stand.  A chunk is stored once under its SHA-256, a document becomes a
recipe (the ordered chunk digests), and a Merkle tree over the digests gives
the document's root.  A shard's manifest is the root of a Merkle tree over its
documents: their leaves in order of digest, in buckets of about ``LEAVES``, whose
roots are the leaves of the upper tree.  Verification recomputes every chunk's
digest from its bytes and every root from the chunks that are really stored; a
manifest is verified if all its documents are, and ``check_manifests`` holds
stored manifests against the documents that are there.

Ids are little-endian in digest and payload, two bytes wide where the
vocabulary allows, and payloads are compressed by zstandard.  One shuffle groups equal chunks, one more small one checks recipes.

Defined cases: a null or empty text has an empty recipe, 0 ids and the root
of the empty tree; very long texts are whole streams of many chunks; repeated
rows (same id, same text) share one recipe whose ``refs`` counts them; two texts
of one id are two documents; a null id makes a recipe with a null id; ids keep
their type; nothing depends on ties or partitions, chunks and documents go by
digest; an empty table gives no rows; other columns of the input are never
looked at.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillmill.llm.arrays import mix64, text_slices
from quillmill.llm.bpe_core import DEFAULT_VOCAB, Ranks
from quillmill.llm.shared import read_table, written

WINDOW = 16
#: A cut where the top bits of the rolling hash are zero: 2**8 ids apart on average beyond the least length.
CUT_BITS = 8
LEAST, MOST = 64, 4096
#: Documents of one manifest: those whose id hashes alike modulo this.
SHARDS = 64
#: Leaves of a lower tree of a manifest, on average.
LEAVES = 4096
EMPTY_ROOT = hashlib.sha256(b"").digest()


def cut_points(ids: np.ndarray, offs: np.ndarray, window: int = WINDOW, bits: int = CUT_BITS, least: int = LEAST, most: int = MOST) -> list[list[int]]:
    """For each document of a ragged array its chunk ends, counted from its own start."""
    h = mix64(ids.astype(np.uint64) + np.uint64(0x51_7C_C1_B7))
    step, base = 1, 0xD6E8FEB86659FD93
    with np.errstate(over="ignore"):
        while step < window:
            h = h.copy()
            h[step:] += np.uint64(pow(base, step, 1 << 64)) * h[:-step].copy()
            step *= 2
    cand = np.flatnonzero(h >> np.uint64(64 - bits) == 0) + 1
    lo = np.searchsorted(cand, offs[:-1], side="right")
    hi = np.searchsorted(cand, offs[1:], side="right")
    out = []
    for d in range(len(offs) - 1):
        start, n = int(offs[d]), int(offs[d + 1] - offs[d])
        ends, last = [], 0
        for c in (cand[lo[d] : hi[d]] - start).tolist():
            # the window must lie inside the document: least >= window sees to that
            while c - last > most:
                last += most
                ends.append(last)
            if c - last >= least:
                ends.append(c)
                last = c
        while n - last > most:
            last += most
            ends.append(last)
        if n > last:
            ends.append(n)
        out.append(ends)
    return out


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of SHA-256; an odd node moves up as it is."""
    if not leaves:
        return EMPTY_ROOT
    level = leaves
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def _emit(vocab: str, id_type: pa.DataType):
    def run(batches):
        import zstandard

        ranks = Ranks.load(vocab)
        wide = np.dtype(ranks.kind).itemsize
        comp = zstandard.ZstdCompressor(level=1).compress
        schema = pa.schema(
            [("kind", pa.string()), ("doc_id", id_type), ("shard", pa.int32()), ("digest", pa.binary()), ("payload", pa.binary()), ("recipe", pa.list_(pa.binary())), ("n_ids", pa.int64()), ("stream", pa.binary()), ("refs", pa.int64())]
        )
        for batch in batches:
            doc_ids, shards = batch.column(0), batch.column(1).to_pylist()
            for i, j, buf, offs in text_slices(batch, "text"):
                ids, io = ranks.encode_slice(buf, offs)
                ends = cut_points(ids, io)
                raw = ids.astype(ranks.kind).tobytes()
                chunks: dict[bytes, tuple[bytes, int]] = {}
                times: Counter[bytes] = Counter()
                docs = []
                for d, cuts in enumerate(ends):
                    base, recipe = int(io[d]) * wide, []
                    start = base
                    for c in cuts:
                        part = raw[start : base + c * wide]
                        digest = hashlib.sha256(part).digest()
                        if digest not in chunks:
                            chunks[digest] = (comp(part), len(part) // wide)
                        recipe.append(digest)
                        times[digest] += 1
                        start = base + c * wide
                    docs.append((recipe, int(io[d + 1] - io[d]), hashlib.sha256(raw[base : int(io[d + 1]) * wide]).digest()))
                k, n = len(chunks), len(docs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["chunk"] * k + ["document"] * n),
                        pa.concat_arrays([pa.nulls(k, id_type), doc_ids.slice(i, n).cast(id_type)]),
                        pa.array([None] * k + shards[i:j], pa.int32()),
                        pa.array([*chunks, *(merkle_root(x[0]) for x in docs)], pa.binary()),
                        pa.array([*(c[0] for c in chunks.values()), *[None] * n], pa.binary()),
                        pa.array([*[None] * k, *(x[0] for x in docs)], pa.list_(pa.binary())),
                        pa.array([*(c[1] for c in chunks.values()), *(x[1] for x in docs)], pa.int64()),
                        pa.array([*[None] * k, *(x[2] for x in docs)], pa.binary()),
                        pa.array([*(times[c] for c in chunks), *[1] * n], pa.int64()),
                    ],
                    schema=schema,
                )

    return run


def build_store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT_VOCAB, shards: int = SHARDS) -> DataFrame:
    """The store as one written table: ``chunk`` rows (digest, payload) and ``document`` rows (digest = root, recipe).

    ``refs`` counts how often a chunk stands in the recipes of all rows, or the repeated rows of a document.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(shards)).cast("int").alias("shard"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType
    rows = src.mapInArrow(_emit(vocab, to_arrow_type(kind)), f"kind string, doc_id {kind.simpleString()}, shard int, digest binary, payload binary, recipe array<binary>, n_ids bigint, stream binary, refs bigint")
    # one row for each chunk digest and each (document, root); only chunks carry payloads
    one = rows.groupBy("kind", "doc_id", "digest").agg(
        F.first("shard").alias("shard"), F.first("payload").alias("payload"), F.first("recipe").alias("recipe"), F.first("n_ids").alias("n_ids"), F.first("stream").alias("stream"), F.sum("refs").alias("refs")
    )
    return written(one, "token-store")


def _chunk_facts(store: DataFrame, vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(digest, sound, n_ids) of each stored chunk, its digest recomputed from the payload."""

    def run(batches):
        import zstandard

        un = zstandard.ZstdDecompressor().decompress
        wide = np.dtype(Ranks.load(vocab).kind).itemsize
        for batch in batches:
            good, n = [], []
            for digest, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    raw = un(payload)
                except (zstandard.ZstdError, TypeError):
                    raw = None
                good.append(raw is not None and hashlib.sha256(raw).digest() == digest)
                n.append(len(raw) // wide if raw is not None else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(good, pa.bool_()), pa.array(n, pa.int64())], names=["digest", "sound", "stored_ids"])

    return store.filter("kind = 'chunk'").select("digest", "payload").mapInArrow(run, "digest binary, sound boolean, stored_ids bigint")


def verify(store: DataFrame, vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(doc_id, shard, root, verified): every chunk of the recipe is stored and sound, the lengths add up, the root follows from the recipe."""
    kind = store.schema["doc_id"].dataType.simpleString()

    def roots(batches):
        for batch in batches:
            ok = [merkle_root(r or []) == d for r, d in zip(batch.column("recipe").to_pylist(), batch.column("root").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_())], names=[*batch.schema.names, "root_ok"])

    docs = store.filter("kind = 'document'").select("doc_id", "shard", F.col("digest").alias("root"), "n_ids", "recipe").mapInArrow(roots, f"doc_id {kind}, shard int, root binary, n_ids bigint, recipe array<binary>, root_ok boolean")
    parts = docs.select("doc_id", "shard", "root", "n_ids", "root_ok", F.explode_outer("recipe").alias("digest"))
    return (
        parts.join(_chunk_facts(store, vocab), "digest", "left")
        .groupBy("doc_id", "shard", "root", "n_ids", "root_ok")
        .agg(F.min(F.coalesce("sound", F.col("digest").isNull())).alias("all_sound"), F.sum(F.coalesce("stored_ids", F.lit(0))).alias("got"))
        .select("doc_id", "shard", "root", (F.col("root_ok") & F.col("all_sound") & (F.col("got") == F.col("n_ids"))).alias("verified"))
    )


def leaf_bytes(doc_id, root: bytes, refs: int) -> bytes:
    """What a manifest's leaf is the SHA-256 of; ``doc_id`` as a string, or None."""
    return ("0" if doc_id is None else f"1{doc_id}").encode() + b"\x00" + root + str(refs).encode()


def manifests(store: DataFrame, leaves: int = LEAVES) -> DataFrame:
    """(shard, n_docs, root): for each shard the Merkle root over its documents, in two levels, so that no array grows with the shard."""
    docs = store.filter("kind = 'document'")
    per_shard = docs.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-per_shard // leaves))
    name = F.coalesce(F.concat(F.lit("1"), F.col("doc_id").cast("string")), F.lit("0"))
    leaf = F.sha2(F.concat(name.cast("binary"), F.unhex(F.lit("00")), F.col("digest"), F.col("refs").cast("string").cast("binary")), 256)
    # by the leaf's own hash, so that one id, or none, can't fill a bucket
    lower = docs.select("shard", leaf.alias("leaf")).select("shard", (F.conv(F.substring("leaf", 1, 12), 16, 10).cast("bigint") % buckets).alias("bucket"), F.unhex("leaf").alias("leaf"))

    def trees(names: list[str]):
        def run(batches):
            for batch in batches:
                roots = [merkle_root([x["leaf"] if isinstance(x, dict) else x for x in leaf]) for leaf in batch.column("leaves").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(roots, pa.binary())], names=[*names, "leaf"])

        return run

    roots = lower.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("leaf")).alias("leaves")).mapInArrow(trees(["shard", "bucket", "n"]), "shard int, bucket bigint, n bigint, leaf binary")
    upper = roots.groupBy("shard").agg(F.sum("n").alias("n_docs"), F.array_sort(F.collect_list(F.struct("bucket", "leaf"))).alias("leaves"))
    return upper.mapInArrow(trees(["shard", "n_docs"]), "shard int, n_docs bigint, leaf binary").withColumnRenamed("leaf", "root")


def check_manifests(store: DataFrame, stored: DataFrame, leaves: int = LEAVES) -> DataFrame:
    """(shard, intact): whether the documents that are in the store give the stored manifest."""
    now = manifests(store, leaves).select("shard", F.col("root").alias("now"))
    return stored.select("shard", "root").join(now, "shard", "full").select("shard", F.coalesce(F.col("root") == F.col("now"), F.lit(False)).alias("intact"))


def reconstruct(store: DataFrame, vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(doc_id, token_ids, text, exact): documents rebuilt from the chunks; ``exact`` compares with the digest of the whole stream."""
    parts = store.filter("kind = 'document'").select("doc_id", "digest", "stream", F.posexplode_outer("recipe").alias("pos", "chunk"))
    chunks = store.filter("kind = 'chunk'").select(F.col("digest").alias("chunk"), "payload")
    whole = parts.join(chunks, "chunk", "left").groupBy("doc_id", "digest", "stream").agg(F.sort_array(F.collect_list(F.struct("pos", "payload"))).alias("parts"))

    def run(batches):
        import zstandard

        ranks, un = Ranks.load(vocab), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids, texts, exact = [], [], []
            for stream, parts in zip(batch.column("stream").to_pylist(), batch.column("parts").to_pylist()):
                raw = b"".join(un(p["payload"]) for p in parts if p["payload"] is not None)
                got = np.frombuffer(raw, ranks.kind)
                ids.append(got.tolist())
                texts.append(b"".join(ranks.tokens[k] for k in got.tolist()).decode("utf-8", "replace"))
                exact.append(hashlib.sha256(raw).digest() == stream)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string()), pa.array(exact, pa.bool_())], names=["doc_id", "token_ids", "text", "exact"])

    return whole.mapInArrow(run, f"doc_id {store.schema['doc_id'].dataType.simpleString()}, token_ids array<int>, text string, exact boolean")


def content_store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT_VOCAB, shards: int = SHARDS) -> DataFrame:
    """Chunks, verified document recipes and shard manifests in one table."""
    store = build_store(docs, id_col, text_col, vocab, shards)
    checked = written(verify(store, vocab), "verified")
    none = lambda kind: F.lit(None).cast(kind)
    id_type = store.schema["doc_id"].dataType
    chunk = store.filter("kind = 'chunk'").select("kind", "doc_id", "shard", F.hex("digest").alias("digest"), "payload", none("array<string>").alias("recipe"), "n_ids", "refs", none("boolean").alias("verified"))
    documents = (
        store.filter("kind = 'document'")
        .join(checked.select(F.col("doc_id").alias("_d"), F.col("root").alias("_r"), "verified"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("digest") == F.col("_r")), "left")
        .select("kind", "doc_id", "shard", F.hex("digest").alias("digest"), none("binary").alias("payload"), F.transform("recipe", F.hex).alias("recipe"), "n_ids", "refs", "verified")
    )
    manifest = (
        manifests(store)
        .join(checked.groupBy("shard").agg(F.min("verified").alias("verified")), "shard", "left")
        .select(F.lit("manifest").alias("kind"), none(id_type).alias("doc_id"), "shard", F.hex("root").alias("digest"), none("binary").alias("payload"), none("array<string>").alias("recipe"), F.col("n_docs").alias("n_ids"), F.lit(1).cast("bigint").alias("refs"), "verified")
    )
    return chunk.unionByName(documents).unionByName(manifest)


QUERIES = {"op5_token_store": lambda spark, sf_dir: content_store(read_table(spark, sf_dir, "documents"))}
ORACLE: dict[str, str] = {}
