"""Mixing of sources to target weights by blocks.

1. Documents are tokenised and packed, per source, into blocks of exactly
   ``BLOCK_TOKENS`` tokens, an end-of-text token after each document.  A source
   is split by a hash of the id into as many lanes as it has ``LANE_DOCS``
   documents, so lanes stay alike however much or hot a source is; what lanes
   have left over is packed in a second step, ``REST_LANES`` lanes together,
   and only the last block of these is filled up with end-of-text tokens.
2. Every output shard draws how many of its slots go to each source from a
   multinomial with the target weights (a generator keyed by seed and shard).
3. A source's slots are numbered over all shards; number x of epoch e takes the
   block that a keyed pseudorandom permutation of the source's block indices
   (a Feistel network with cycle walking) gives.  So a source repeats no block
   before all of its blocks had their turn.
4. Slots and blocks are joined on (source, index).

Nothing depends on how the input is partitioned.  With many sources a shard
draws over groups of ``GROUP`` of them first, then within the groups that got
slots, so neither the driver nor a task ever holds more than a number a group.

Defined cases: a null or empty text packs as a lone end-of-text token; a very
long one is cut over as many blocks as it takes; a null source counts as the
source ''; rows without an id are spread over the lanes by their texts and pack
first in them; repeated rows are packed each for itself, and ties have the order
of their tokens; weights of sources without blocks are left out and the others
scaled up; ids keep their type; a table without rows gives an empty result;
``mix_sources`` never looks at other columns, ``mix_documents`` returns them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, IntegerType, LongType, StringType, StructField, StructType

from quillmill.llm.arrays import mix64, text_slices
from quillmill.llm.bpe_core import DEFAULT_VOCAB, Ranks
from quillmill.llm.shared import column, read_table, resolved, written
from quillmill.operators.fidelity import with_row_index

BLOCK_TOKENS = 2048
#: Blocks of an output shard.
SHARD_BLOCKS = 1024
#: Documents of a lane, on average, and lanes whose rests are packed together.
LANE_DOCS = 1024
REST_LANES = 1024
SEED = 20240
#: Default weights: block counts to this power, scaled to 1.
TEMPER = 0.7
#: Rows up to which a table of lanes or slots is broadcast, at about 160 bytes a row some 64 MB; beyond, both sides shuffle.
BROADCAST_ROWS = 400_000
#: Sources of a group, which one draw knows.
GROUP = 1024
#: Neighbours that are summed up by one task before the sums are.
NEIGHBOURS = 4096


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at the places ``x``."""
    half = max(1, ((max(1, n - 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for r in range(4)]
    out = np.asarray(x).astype(np.uint64)
    todo = np.arange(len(out))
    while todo.size:
        v = out[todo]
        a, b = v >> np.uint64(half), v & mask
        for k in keys:
            a, b = b, a ^ (mix64(b ^ k) & mask)
        v = a << np.uint64(half) | b
        out[todo] = v
        todo = todo[v >= n]
    return out.astype(np.int64)


def _key(*parts: int) -> int:
    h = 0
    for p in parts:
        h = int(mix64(np.array([(h * 31 + p + 1) & (1 << 64) - 1], np.uint64))[0])
    return h >> 8


class _Packer:
    """Pieces in, blocks out, in order."""

    def __init__(self, size: int, compress, schema: pa.Schema):
        self.size, self.compress, self.schema = size, compress, schema
        self.rows: list[tuple] = []
        self.open(None, 0)

    def open(self, source, lane):
        self.source, self.lane, self.k = source, lane, 0
        self.clear()

    def clear(self):
        self.ids, self.docs, self.lens, self.texts, self.meta, self.have = [], [], [], [], [], 0

    def add(self, doc, meta, ids: np.ndarray, text):
        """``text``: a function from a range of ids to its text, or None."""
        at = 0
        while at < len(ids):
            n = min(self.size - self.have, len(ids) - at)
            self.ids.append(ids[at : at + n])
            self.docs.append(doc)
            self.lens.append(n)
            if text:
                self.texts.append(text(at, at + n))
                self.meta.append(meta)
            self.have += n
            at += n
            if self.have == self.size:
                self.emit(False)

    def emit(self, rest: bool, fill: int | None = None):
        if not self.have:
            return
        ids = np.concatenate(self.ids).astype("<u4")
        if fill is not None:
            ids = np.concatenate([ids, np.full(self.size - self.have, fill, "<u4")])
        self.rows.append((self.source, self.lane, self.k, rest, self.have, self.compress(ids.tobytes()), self.docs, self.lens, self.texts, self.meta))
        self.k += 1
        self.clear()

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) if self.rows else [[] for _ in range(10)]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, self.schema)], schema=self.schema)


def _packed(id_type: DataType, meta: DataType | None) -> StructType:
    """Blocks as they are written; texts and other columns of the pieces where they are wanted."""
    kinds = {"source": StringType(), "lane": IntegerType(), "k": LongType(), "rest": BooleanType(), "n_tokens": IntegerType(), "ids": BinaryType(), "doc_ids": ArrayType(id_type), "lens": ArrayType(IntegerType())}
    if meta is not None:
        kinds |= {"texts": ArrayType(StringType()), "meta": ArrayType(meta)}
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


def pack_blocks(docs: DataFrame, block: int = BLOCK_TOKENS, lane_docs: int = LANE_DOCS, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocab: str = DEFAULT_VOCAB, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The blocks of all sources as written tables; (source, lane, k) names a block.

    ``with_text``: with the text of each piece and, as ``meta``, all other columns of its document.
    """
    own = [resolved(docs, c) for c in (id_col, text_col)]
    rest_cols = [c for c in docs.columns if c not in own] if with_text else []
    plain = docs.select(
        column(own[0]).alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        (F.struct(*map(column, rest_cols)) if rest_cols else F.struct(F.lit(None).cast("int").alias("none"))).alias("meta"),
        column(own[1]).cast("string").alias("text"),
    )
    lanes = written(plain.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / lane_docs).alias("lanes")), "lanes")
    if lanes.count() <= broadcast_rows:
        lanes = F.broadcast(lanes)
    spread = F.xxhash64(F.when(F.col("doc_id").isNull(), F.col("text")), "doc_id")
    src = plain.join(lanes, "source").select("doc_id", "source", "meta", F.pmod(spread, F.col("lanes")).cast("int").alias("lane"), "text")
    id_type, meta_type = plain.schema["doc_id"].dataType, plain.schema["meta"].dataType
    layout = _packed(id_type, meta_type if with_text else None)
    arrow = to_arrow_schema(layout)

    def tokenise(batches):
        import zstandard

        ranks, comp = Ranks.load(vocab), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for i, j, buf, offs in text_slices(batch, "text"):
                ids, io = ranks.encode_slice(buf, offs)
                raw, io = ids.astype("<u4").tobytes(), (io * 4).tolist()
                blobs = [comp(raw[io[d] : io[d + 1]]) for d in range(j - i)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(4)), pa.array(blobs, pa.binary())], names=["doc_id", "source", "meta", "lane", "ids"])

    def pack(batches):
        import zstandard

        ranks, un = Ranks.load(vocab), zstandard.ZstdDecompressor().decompress
        eos = ranks.size
        p = _Packer(block, zstandard.ZstdCompressor(level=1).compress, arrow)
        key = None
        for batch in batches:
            meta = batch.column(2).to_pylist() if with_text else [None] * batch.num_rows
            for d, s, m, lane, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), meta, *(batch.column(c).to_pylist() for c in (3, 4))):
                if (s, lane) != key:
                    p.emit(True)
                    key = (s, lane)
                    p.open(s, lane)
                ids = np.frombuffer(un(blob), "<u4")
                p.add(d, m, np.append(ids, np.uint32(eos)), _texts(ranks, ids) if with_text else None)
                if len(p.rows) >= 256:
                    yield p.take()
        p.emit(True)
        yield p.take()

    def pack_rest(batches):
        import zstandard

        ranks, un = Ranks.load(vocab), zstandard.ZstdDecompressor().decompress
        eos = ranks.size
        p = _Packer(block, zstandard.ZstdCompressor(level=1).compress, arrow)
        key = None
        for batch in batches:
            meta = batch.column(5).to_pylist() if with_text else [None] * batch.num_rows
            for s, group, blob, docs_, lens, m in zip(*(batch.column(c).to_pylist() for c in range(5)), meta):
                if (s, group) != key:
                    p.emit(False, eos)
                    key = (s, group)
                    p.open(s, -1 - group)
                ids, at = np.frombuffer(un(blob), "<u4"), 0
                for d, n, x in zip(docs_, lens, m or [None] * len(lens)):
                    piece = ids[at : at + n]
                    p.add(d, x, piece, _texts(ranks, piece[piece != eos]) if with_text else None)
                    at += n
                if len(p.rows) >= 256:
                    yield p.take()
        p.emit(False, eos)
        yield p.take()

    tokens = src.mapInArrow(tokenise, StructType([StructField(c, kind) for c, kind in (("doc_id", id_type), ("source", StringType()), ("meta", meta_type), ("lane", IntegerType()), ("ids", BinaryType()))]))
    packed = written(tokens.repartition("source", "lane").sortWithinPartitions("source", "lane", "doc_id", "ids").mapInArrow(pack, layout), "packed-blocks")
    rest = packed.filter("rest").select("source", F.floor(F.col("lane") / REST_LANES).cast("int").alias("group"), "ids", "doc_ids", "lens", *["meta"] * with_text, "lane").repartition("source", "group").sortWithinPartitions("source", "group", "lane")
    last = written(rest.drop("lane").mapInArrow(pack_rest, layout), "packed-rest")
    return packed.filter("NOT rest").unionByName(last)


def _texts(ranks: Ranks, ids: np.ndarray):
    """Text of a range of a document's ids; a cut inside a character moves to its end."""
    raw, offs = ranks.decode_flat(ids, np.arange(len(ids) + 1))
    data = raw.tobytes()

    def edge(token: int) -> int:
        b = int(offs[min(token, len(ids))])
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b += 1
        return b

    return lambda a, b: data[edge(a) : edge(b)].decode("utf-8", "replace")


def _counts(seed: int, shard: int, size: int, w: np.ndarray) -> np.ndarray:
    """Multinomial counts of a shard, by a generator of its own."""
    return np.random.Generator(np.random.Philox(key=np.array([seed & (1 << 64) - 1, shard], np.uint64))).multinomial(size, w / w.sum())


def group_seed(seed: int, group: int) -> int:
    return seed + group * 0x9E3779B97F4A7C15


def draw_slots(spark, sizes: DataFrame | dict[str, int], weights: dict[str, float] | None = None, epochs: float = 1.0, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, temper: float = TEMPER, group: int = GROUP, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(source, index, epoch, shard, slot): which block every slot of every shard takes.

    ``sizes``: (source, n) blocks of each source.  A shard draws over groups of
    ``group`` neighbouring sources, then within those that got slots; the
    driver sees one number a group.
    """
    if isinstance(sizes, dict):
        sizes = spark.createDataFrame([*sizes.items()], "source string, n bigint")
    if weights is None:
        wanted = sizes.filter("n > 0").withColumn("w", F.pow("n", F.lit(temper)))
    else:
        wanted = sizes.filter("n > 0").join(spark.createDataFrame([(k, float(v)) for k, v in weights.items() if v > 0], "source string, w double"), "source")
    total, sources = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], wanted.count()
    if sources <= group:  # few enough for one task to number
        known = wanted.withColumn("s", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("source")) - 1)
    else:
        known = with_row_index(wanted, "source", name="s")
    known = written(known.select("source", "n", "w", F.col("s").cast("int").alias("s")), "sources")
    groups = written(known.groupBy(F.floor(F.col("s") / group).cast("int").alias("g")).agg(F.sum("w").alias("sum"), F.sort_array(F.collect_list(F.struct("s", "w"))).alias("members")), "source-groups")
    whole = np.array([r["sum"] for r in groups.select("g", "sum").orderBy("g").collect()], float)
    slots = int(round(total * epochs)) if len(whole) else 0
    shards = math.ceil(slots / shard_blocks)

    def draw(batches):
        for batch in batches:
            out = []
            for shard in batch.column(0).to_pylist():
                size = min(shard_blocks, slots - shard * shard_blocks)
                got = _counts(seed ^ 1 << 63, shard, size, whole)
                before = np.cumsum(got) - got
                out += [(shard, k, int(got[k]), int(before[k])) for k in np.flatnonzero(got).tolist()]
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["shard", "g", "taken", "before"])

    def draw_members(batches):
        for batch in batches:
            out = []
            for shard, g, taken, before, members in zip(*(batch.column(c).to_pylist() for c in range(5))):
                got = _counts(group_seed(seed, g), shard, taken, np.array([m["w"] for m in members], float))
                ahead = before + np.cumsum(got) - got
                out += [(shard, members[k]["s"], int(got[k]), int(ahead[k])) for k in np.flatnonzero(got).tolist()]
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["shard", "s", "taken", "before"])

    def expand(batches):
        for batch in batches:
            for shard, s, taken, before, start, source, n in zip(*(batch.column(c).to_pylist() for c in range(7))):
                x = np.arange(start, start + taken)
                epoch, at = x // n, x % n
                index = np.empty(taken, np.int64)
                for e in np.unique(epoch).tolist():
                    m = epoch == e
                    index[m] = permute(at[m], n, _key(seed, s, e))
                size = min(shard_blocks, slots - shard * shard_blocks)
                slot = permute(np.arange(before, before + taken), size, _key(seed, shard, 1 << 40))
                yield pa.RecordBatch.from_arrays([pa.array([source] * taken, pa.string()), pa.array(index), pa.array(epoch), pa.array(np.full(taken, shard, np.int64)), pa.array(slot)], names=["source", "index", "epoch", "shard", "slot"])

    few = F.broadcast if sources <= broadcast_rows else (lambda df: df)
    if len(whole) > 1:
        by_group = written(spark.range(shards).mapInArrow(draw, "shard bigint, g int, taken bigint, before bigint"), "group-draws")
    else:  # one group takes all
        by_group = spark.range(shards).select(F.col("id").alias("shard"), F.lit(0).alias("g"), F.least(F.lit(shard_blocks), slots - F.col("id") * shard_blocks).cast("bigint").alias("taken"), F.lit(0).cast("bigint").alias("before"))
    drawn = by_group.join(few(groups.select("g", "members")), "g").select("shard", "g", "taken", "before", "members")
    each = written(drawn.mapInArrow(draw_members, "shard bigint, s int, taken bigint, before bigint"), "draws")
    placed = sums_before(each, "s", "shard", "taken", "start").join(few(known.select("s", "source", "n")), "s")
    return placed.select("shard", "s", "taken", "before", "start", "source", "n").mapInArrow(expand, "source string, index bigint, epoch bigint, shard bigint, slot bigint")


def mixed_blocks(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, block: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, lane_docs: int = LANE_DOCS, seed: int = SEED, temper: float = TEMPER, with_text: bool = False, broadcast_rows: int = BROADCAST_ROWS, **columns) -> DataFrame:
    """Every slot of every shard with its block (ids still compressed)."""
    spark = docs.sparkSession
    blocks = pack_blocks(docs, block, lane_docs, with_text, broadcast_rows=broadcast_rows, **columns)
    per_lane = written(blocks.groupBy("source", "lane").agg(F.count(F.lit(1)).alias("n")), "lane-blocks")
    base = written(sums_before(per_lane, "source", "lane", "n", "base"), "lane-bases")
    sizes = base.groupBy("source").agg(F.sum("n").alias("n"))
    n_bases, n_blocks = base.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    slots = draw_slots(spark, sizes, weights, epochs, shard_blocks, seed, temper, broadcast_rows=broadcast_rows)
    bases = base.select("source", "lane", "base")
    if n_bases <= broadcast_rows:
        bases = F.broadcast(bases)
    if n_blocks * epochs <= broadcast_rows:
        slots = F.broadcast(slots)
    indexed = blocks.join(bases, ["source", "lane"]).withColumn("index", F.col("base") + F.col("k"))
    return indexed.join(slots, ["source", "index"]).select("shard", "slot", "source", F.col("index").alias("block_index"), "epoch", "n_tokens", "doc_ids", "lens", *["texts", "meta"] * with_text, "ids")


def sums_before(df: DataFrame, group: str, order: str, value: str, name: str, wide: int = NEIGHBOURS) -> DataFrame:
    """``df`` and the sum of ``value`` over the rows before each of its group: first in runs of ``wide``, then over the runs, so that no task orders a large group."""
    near = df.withColumn("_run", F.floor(F.col(order) / wide))
    runs = near.groupBy(group, "_run").agg(F.sum(value).alias("_sum"))

    def before(column, at, *keys):
        return F.coalesce(F.sum(column).over(Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    runs = runs.withColumn("_before", before("_sum", "_run", group)).drop("_sum")
    inside = before(value, order, group, "_run")
    return near.withColumn(name, inside).join(runs, [group, "_run"]).withColumn(name, F.col(name) + F.col("_before")).drop("_run", "_before")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """(shard, slot, source, block_index, epoch, n_tokens, doc_ids, lens, token_ids), one row a slot."""

    def run(batches):
        import zstandard

        un = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            k = batch.schema.get_field_index("ids")
            raw = [un(b) for b in batch.column(k).to_pylist()]
            offs = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])])
            ids = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4"), pa.int32()))
            cols = [batch.column(c) for c in range(batch.num_columns) if c != k] + [ids]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "slot", "source", "block_index", "epoch", "n_tokens", "doc_ids", "lens", "token_ids"])

    slots = mixed_blocks(docs, **options)
    schema = StructType([f for f in slots.schema if f.name != "ids"]).add("token_ids", ArrayType(IntegerType()))
    return slots.mapInArrow(run, schema)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars", **options) -> DataFrame:
    """The mixture as documents: each slot's pieces, with the columns of ``docs``.

    A piece is the part of a document that lies in the block, with the document's
    other columns as they are; ``count_col``, where there is one, has the piece's
    characters.  Pieces of end-of-text tokens only are left out.
    """
    own = {resolved(docs, id_col): "p.doc_ids", resolved(docs, text_col): "p.texts"}
    same = [c for c in docs.columns if c.lower() == count_col.lower()]
    rows = mixed_blocks(docs, with_text=True, id_col=id_col, text_col=text_col, **options).select(F.explode(F.arrays_zip("doc_ids", "meta", "texts")).alias("p")).filter("p.texts <> ''")
    kept = [F.col(own[c]).alias(c) if c in own else F.length("p.texts").cast(docs.schema[c].dataType).alias(c) if c in same[:1] else F.col("p.meta")[c].alias(c) for c in docs.columns]
    return rows.select(*kept)


QUERIES = {"op10_source_mixing": lambda spark, sf_dir: mix_sources(read_table(spark, sf_dir, "documents"))}
ORACLE: dict[str, str] = {}
