"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Each vector is scaled to length 1 and quantised to int8, v = s q + e, and its
own error length |e| is kept (rounded up).  For two vectors

    |u.v - s_u s_v (q_u . q_v)| <= |e_u| + |e_v| (1 + |e_u|)

so a pair whose int8 product plus this bound stays below the threshold cannot
qualify.  Integer products of a tile are computed exactly, as float32 matrix
products of slices of at most 1024 dimensions (127*127*1024 < 2**24).  Only the
pairs that may qualify are recomputed from the full vectors in double
precision, in one fixed order of summation.

Equal vectors are collapsed first, so thousands of copies are compared once.
The distinct ones are grouped into blocks, blocks into stripes; a task takes a
pair of stripes, holds the first and streams the second.  With G stripes a
block is sent to G tasks, so G is the square root of what parallel tasks need,
or as many as keep a stripe within ``STRIPE_BYTES``.  No row is left out: every
vector is a query against all others.

A task never hands on pairs: for each vector it gives the number of links and
the greatest cosine, and a spanning forest of its links.  So what is shuffled
and returned grows with the vectors, not with the pairs of a group of near
copies.  Counts are summed, forests closed to connected groups.

Defined cases: rows with a null id, or a vector that is null, without elements,
with a null, NaN or infinite element or of zero length have no cosine: they
come back without class and links; vectors of different dimensions are never
linked; repeated rows (same id, same vector) are one; different vectors of one
id are items of their own; ids keep their type; a class is named by its least
id, so ties don't matter; an empty table gives an empty result; other columns
of the input are never looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillmill.llm.groups import components, least_ids, roots_of, unite
from quillmill.llm.shared import read_table, written

THRESHOLD = 0.95
#: Vectors in a block, on average, and bytes of a stripe that a task holds, at most.
BLOCK = 1024
STRIPE_BYTES = 128 << 20
TILE = 1024
#: Parts into which the items of a vector with copies are split where they find its row.
SALTS = 32
_EXACT = 1024


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scale, error bound) of unit rows; the bound covers the rounding of its own computation."""
    scale = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    err = np.sqrt(((x - scale[:, None] * q) ** 2).sum(axis=1))
    return q, scale, err * (1 + 1e-6) + 1e-9


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows, as float64 where several slices are added; float32 forms of the rows do as well."""
    if a.shape[1] <= _EXACT:
        return a.astype(np.float32, copy=False) @ b.astype(np.float32, copy=False).T
    out = np.zeros((len(a), len(b)), np.float64)
    for k in range(0, a.shape[1], _EXACT):
        out += a[:, k : k + _EXACT].astype(np.float32) @ b[:, k : k + _EXACT].astype(np.float32).T
    return out


@dataclass
class Block:
    """Vectors with their int8 form; ``full`` keeps the original values, ``weight`` counts the items of a vector."""

    ids: np.ndarray
    weight: np.ndarray
    q: np.ndarray
    scale: np.ndarray
    err: np.ndarray
    norm: np.ndarray
    full: np.ndarray

    @cached_property
    def wide(self) -> np.ndarray:
        """The int8 rows as float32, turned once."""
        return self.q.astype(np.float32)

    def pack(self) -> bytes:
        kind = b"f" if self.full.dtype == np.float32 else b"d"
        return b"".join([kind, *(np.ascontiguousarray(x).tobytes() for x in (self.ids, self.weight, self.scale, self.err, self.norm, self.full, self.q))])

    @classmethod
    def unpack(cls, blob: bytes, n: int, dim: int) -> "Block":
        at, parts = 1, []
        for kind, shape in ((np.int64, (n,)), (np.int64, (n,)), (np.float64, (n,)), (np.float64, (n,)), (np.float64, (n,)), (np.float32 if blob[:1] == b"f" else np.float64, (n, dim)), (np.int8, (n, dim))):
            x = np.frombuffer(blob, kind, int(np.prod(shape)), at).reshape(shape)
            at += x.nbytes
            parts.append(x)
        ids, weight, scale, err, norm, full, q = parts
        return cls(ids, weight, q, scale, err, norm, full)


def block_of(ids: np.ndarray, weight: np.ndarray, full: np.ndarray) -> Block | None:
    """The rows that have a direction, or None."""
    x = full.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = x / norm[:, None]
    good = np.isfinite(unit).all(axis=1) & (norm > 0)
    if not good.any():
        return None
    q, scale, err = quantise(unit[good])
    return Block(ids[good], weight[good], q, scale, err, norm[good], full[good])


def tile_pairs(a: Block, b: Block, threshold: float, same: bool, tile: int = TILE):
    """(rows of a, rows of b, cosines) of all pairs at or above the threshold between two blocks, each pair once."""
    for i in range(0, len(a.ids), tile):
        for j in range(i if same else 0, len(b.ids), tile):
            prod = int8_products(a.wide[i : i + tile], b.wide[j : j + tile])
            si, sj, ei, ej = a.scale[i : i + tile], b.scale[j : j + tile], a.err[i : i + tile], b.err[j : j + tile]
            # one bound a row, from the tile's greatest scale and error; then each pair's own
            least = threshold - 1e-9 - ei - ej.max() * (1 + ei)
            least = np.where(least > 0, least / (si * sj.max()) * (1 - 1e-6), -np.inf)
            r, c = np.nonzero(prod >= least.astype(prod.dtype)[:, None])
            m = prod[r, c] * si[r] * sj[c] + ei[r] + ej[c] * (1 + ei[r]) >= threshold - 1e-9
            r, c = r[m], c[m]
            if same and i == j:
                m = r < c
                r, c = r[m], c[m]
            for k in range(0, len(r), 1 << 16):
                rr, cc = r[k : k + (1 << 16)] + i, c[k : k + (1 << 16)] + j
                dot = np.zeros(len(rr))
                for d in range(a.full.shape[1]):  # one order of summation everywhere
                    dot += a.full[rr, d].astype(np.float64) * b.full[cc, d]
                dot /= a.norm[rr] * b.norm[cc]
                m = dot >= threshold
                if m.any():
                    yield rr[m], cc[m], dot[m]


def _blocks(batches):
    """Rows sorted by (dim, block) to one row a block."""
    key, parts = None, []

    def close():
        ids, weight, full = (np.concatenate(x) for x in zip(*parts))
        b = block_of(ids, weight, full)
        if b is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([len(b.ids)], pa.int32()), pa.array([b.pack()], pa.binary())], names=["dim", "block", "n", "data"])

    for batch in batches:
        if not batch.num_rows:
            continue
        dim, block, ids, weight = (batch.column(c).to_numpy() for c in range(4))
        values = batch.column(4).flatten().to_numpy()
        at = np.concatenate([[0], np.cumsum(dim, dtype=np.int64)])
        cuts = np.flatnonzero((dim[1:] != dim[:-1]) | (block[1:] != block[:-1])) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if (now := (int(dim[i]), int(block[i]))) != key:
                if parts:
                    yield from close()
                key, parts = now, []
            parts.append((ids[i:j].copy(), weight[i:j].copy(), values[at[i] : at[j]].reshape(j - i, now[0]).copy()))
    if parts:
        yield from close()


class _Links:
    """Number of links, greatest cosine and spanning forest of the vectors that a task has seen."""

    def __init__(self):
        self.ids = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.best = np.zeros(0)
        self.parent = np.zeros(0, np.int64)

    def add(self, b: Block) -> int:
        base, n = len(self.ids), len(b.ids)
        self.ids = np.concatenate([self.ids, b.ids])
        self.count = np.concatenate([self.count, np.zeros(n, np.int64)])
        self.best = np.concatenate([self.best, np.full(n, -np.inf)])
        self.parent = np.concatenate([self.parent, np.arange(base, base + n)])
        return base

    def link(self, a: Block, base_a: int, b: Block, base_b: int, pairs) -> None:
        for r, c, cosine in pairs:
            for base, rows, weight in ((base_a, r, b.weight[c]), (base_b, c, a.weight[r])):
                lo, hi = int(rows.min()), int(rows.max()) + 1
                self.count[base + lo : base + hi] += np.bincount(rows - lo, weight, hi - lo).astype(np.int64)
                np.maximum.at(self.best, base + rows, cosine)
            unite(self.parent, base_a + r, base_b + c)

    def facts(self):
        """(node, other, n, best): counts where ``other`` is null, edges of the forest elsewhere."""
        some = np.flatnonzero(self.count)
        top = roots_of(self.parent, np.arange(len(self.parent)))
        tree = np.flatnonzero(top != np.arange(len(top)))
        if some.size:
            k = len(tree)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(self.ids[np.concatenate([some, tree])]),
                    pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(self.ids[top[tree]])]),
                    pa.array(np.concatenate([self.count[some], np.zeros(k, np.int64)])),
                    pa.concat_arrays([pa.array(self.best[some]), pa.nulls(k, pa.float64())]),
                ],
                names=["node", "other", "n", "best"],
            )


def _compare(threshold: float):
    """Rows sorted by task and side: the blocks of side 0 are held, those of side 1 stream by."""

    def run(batches):
        now, held, links = None, [], _Links()
        for batch in batches:
            for dim, s, t, side, n, blob in zip(*(batch.column(c).to_pylist() for c in range(5)), batch.column(5)):
                if (dim, s, t) != now:
                    yield from links.facts()
                    now, held, links = (dim, s, t), [], _Links()
                b = Block.unpack(blob.as_buffer().to_pybytes(), n, dim)
                base = links.add(b)
                if side == 1 or s == t:
                    for h, at in held:
                        links.link(h, at, b, base, tile_pairs(h, b, threshold, False))
                if side == 0:
                    if s == t:
                        links.link(b, base, b, base, tile_pairs(b, b, threshold, True))
                    held.append((b, base))
        yield from links.facts()

    return run


def vector_classes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK, stripe_bytes: int = STRIPE_BYTES) -> DataFrame:
    """(vec_id, class_id, n_links, best_cosine), one row an item.

    Two items are linked if their cosine is at least ``threshold``.  ``n_links``
    counts the other items linked to this one, copies with their number,
    ``best_cosine`` is the greatest of theirs; ``class_id`` is the least id of
    all that chains of links reach.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.select(F.col(vec_col).alias("v")).dtypes)["v"]
    src = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<float>" if kind == "array<float>" else "array<double>").alias("v"))
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    good = F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") > 0) & (size > 0) & (size < F.lit(float("inf"))), F.lit(False))
    items = src.filter(good).distinct()
    # numbers for the distinct vectors are fixed by writing them
    reps = written(items.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    n_blocks = max(1, math.ceil(reps.count() / block))
    keyed = reps.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("node"), F.lit(n_blocks)).cast("int").alias("block"), F.col("node").alias("id"), F.col("n").alias("weight"), "v")
    packed = written(keyed.repartition(F.col("dim"), F.col("block")).sortWithinPartitions("dim", "block", "id").mapInArrow(_blocks, "dim int, block int, n int, data binary"), "vector-blocks")
    total = packed.agg(F.sum(F.length("data").cast("bigint"))).first()[0] or 0
    parallel = math.ceil((math.sqrt(1 + 24 * int(spark.conf.get("spark.sql.shuffle.partitions"))) - 1) / 2)
    stripes = min(n_blocks, max(parallel, math.ceil(total / stripe_bytes)))
    stripe = F.col("block") % stripes
    sent = packed.withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).select(
        "dim", F.least(stripe, "u").alias("s"), F.greatest(stripe, "u").alias("t"), F.when(stripe <= F.col("u"), 0).otherwise(1).alias("side"), "n", "data", "block"
    )
    work = sent.repartition(F.col("dim"), F.col("s"), F.col("t")).sortWithinPartitions("dim", "s", "t", "side", "block").drop("block")
    facts = written(work.mapInArrow(_compare(threshold), "node bigint, other bigint, n bigint, best double"), "vector-links")
    sums = facts.filter("other IS NULL").groupBy("node").agg(F.sum("n").alias("links"), F.max("best").alias("best"))
    classes = written(least_ids(reps.select("node", "rep"), components(facts.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))), "vector-classes")
    copies = F.col("n") - 1
    known = (
        reps.join(sums, "node", "left")
        .join(classes, "node", "left")
        .select("v", "rep", "n", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + copies).alias("n_links"), F.round(F.when(copies > 0, F.greatest(F.lit(1.0), F.coalesce("best", F.lit(1.0)))).otherwise(F.col("best")), 6).alias("best_cosine"))
    )
    single = known.filter("n = 1").select(F.col("rep").alias("vec_id"), "class_id", "n_links", "best_cosine")
    lost = src.filter(~good).select("vec_id", F.lit(None).cast(src.schema["vec_id"].dataType).alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(None).cast("double").alias("best_cosine"))
    out = single.unionByName(lost)
    if reps.filter("n > 1").isEmpty():
        return out
    # the copies find their vector's row; salted, as one vector may have a third of all rows
    salted = known.filter("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copied = items.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")).join(salted, ["v", "salt"])
    return out.unionByName(copied.select("vec_id", "class_id", "n_links", "best_cosine"))


QUERIES = {"op2_int8_tiles": lambda spark, sf_dir: vector_classes(read_table(spark, sf_dir, "embeddings"))}
ORACLE = {
    "op2_int8_tiles": f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
l AS (SELECT x, count(*) AS n_links, round(max(c), 6) AS best_cosine FROM p GROUP BY x)
SELECT v.vec_id, g.class_id, coalesce(l.n_links, 0) AS n_links, l.best_cosine
FROM v JOIN (SELECT x, min(y) AS class_id FROM r GROUP BY x) g ON g.x = v.vec_id LEFT JOIN l ON l.x = v.vec_id
"""
}
