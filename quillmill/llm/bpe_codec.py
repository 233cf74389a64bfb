"""BPE encoding and decoding, one pre-token at a time.

A pre-token is a doubly linked list of symbols and a priority queue of merge
ranks.  A popped entry whose rank is no longer that of the pair at its place
is stale and skipped.  Decoding concatenates the vocabulary's strings.
Distinct pre-tokens of a batch are encoded once, and each Python worker keeps
the results of recent ones; the kept ones never change a result.

Defined cases: a null or empty text has no ids and decodes to null or the
empty text; a null id passes through and ids keep their type; repeated rows
stay; very long texts are encoded whole, also where they are one pre-token; of
equal ranks the leftmost pair merges first; an empty table gives an empty
result; other columns of the input are never looked at.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillmill.llm.arrays import list_array, ragged_take, text_column, text_slices
from quillmill.llm.bpe_core import DEFAULT_VOCAB, Ranks, pretokens
from quillmill.llm.shared import read_table, type_of

#: Pre-tokens whose ids a worker keeps before it starts afresh.
KEPT = 200_000


class HeapCodec:
    _loaded: dict[str, "HeapCodec"] = {}

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self.byte_id = ranks.byte_id.tolist()
        self.pairs = ranks.pairs()
        self.kept: dict[bytes, list[int]] = {}

    @classmethod
    def load(cls, path: str) -> "HeapCodec":
        if path not in cls._loaded:
            cls._loaded[path] = cls(Ranks.load(path))
        return cls._loaded[path]

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        byte_id = self.byte_id
        sym = [byte_id[b] for b in piece]
        if n < 2:
            return sym
        pairs = self.pairs.get
        rank = [pairs(sym[i] << 20 | sym[i + 1], -1) for i in range(n - 1)]
        rank.append(-1)
        heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
        if not heap:
            return sym
        heapify(heap)
        prev = list(range(-1, n - 1))
        nxt = list(range(1, n + 1))
        while heap:
            top = heappop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            if rank[i] != r:
                continue  # stale
            j = nxt[i]
            sym[i], sym[j], rank[j] = r, -1, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                rank[i] = new = pairs(r << 20 | sym[k], -1)
                if new >= 0:
                    heappush(heap, new << 32 | i)
            else:
                rank[i] = -1
            p = prev[i]
            if p >= 0:
                rank[p] = new = pairs(sym[p] << 20 | r, -1)
                if new >= 0:
                    heappush(heap, new << 32 | p)
        return [s for s in sym if s >= 0]

    def encode_slice(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tok, doc = pretokens(buf, offs)
        if len(tok) < 2:
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        arr = pa.Array.from_buffers(pa.large_binary(), len(tok) - 1, [None, pa.py_buffer(np.ascontiguousarray(tok, np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])
        d = arr.dictionary_encode()
        kept, encode, out = self.kept, self.encode_piece, []
        for piece in d.dictionary.to_pylist():
            ids = kept.get(piece)
            if ids is None:
                ids = encode(piece)
                if len(kept) >= KEPT:
                    kept.clear()
                if len(piece) <= 64:
                    kept[piece] = ids
            out.append(ids)
        lens = np.fromiter(map(len, out), np.int64, len(out))
        io = np.concatenate([[0], np.cumsum(lens)])
        flat = np.fromiter((x for ids in out for x in ids), np.int32, int(io[-1]))
        ids, fo = ragged_take(flat, io, d.indices.to_numpy().astype(np.int64))
        return ids, fo[doc]


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decoded) of every row; ``decoded`` comes from the ids alone."""

    def run(batches):
        codec = HeapCodec.load(vocab)
        for batch in batches:
            null = text_null(batch)
            for i, j, buf, offs in text_slices(batch, "text"):
                ids, io = codec.encode_slice(buf, offs)
                raw, bo = codec.ranks.decode_flat(ids, io)
                decoded = pa.Array.from_buffers(pa.string(), j - i, [None, pa.py_buffer(bo.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
                if null[i:j].any():
                    decoded = pa.array([None if gone else s for s, gone in zip(decoded.to_pylist(), null[i:j])], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(io), pa.int64()), list_array(pa.array(ids, pa.int32()), io), decoded],
                    names=["doc_id", "n_tokens", "token_ids", "decoded"],
                )

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {type_of(src, 'doc_id')}, n_tokens bigint, token_ids array<int>, decoded string")


def text_null(batch: pa.RecordBatch) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index("text"))
    return np.asarray(col.is_null()) if col.null_count else np.zeros(len(col), bool)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(doc_id, text) from stored ids; null ids give a null text, ids outside the vocabulary an error."""

    def run(batches):
        ranks = Ranks.load(vocab)
        for batch in batches:
            col = batch.column(1)
            texts = [None if ids is None else b"".join(ranks.tokens[k] for k in ids).decode("utf-8", "replace") for ids in col.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    src = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("token_ids"))
    return src.mapInArrow(run, f"doc_id {type_of(src, 'doc_id')}, text string")


QUERIES = {"op8_bpe_encode_decode": lambda spark, sf_dir: encode_decode(read_table(spark, sf_dir, "documents"))}
ORACLE: dict[str, str] = {}
__all__ = ["HeapCodec", "encode_decode", "decode", "text_column"]
