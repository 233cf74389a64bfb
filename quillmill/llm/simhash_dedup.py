"""SimHash near-duplicates by anchor-point covering.

Fingerprint: 120 bits, eight parts of 15, over the set of a text's words
(lower case, between white space, without one stop or comma at the end).  Two
documents are near copies when their fingerprints differ in at most ``most`` bits.

Covering: each part has a part distance, and these plus one add up to most + 1,
so two near copies lie within it in one of the parts at least.  For 22 it is 2
in seven parts and 1 in one.

Anchors of a part are the 2048 words of the perfect Hamming code of length 15:
every part lies within its covering radius 1 of one anchor, its home.  If x and
y differ by at most the part distance, y lies within reach = distance + 1 of x's
home.  So each fingerprint goes to its home and to anchors within reach, and per
anchor the fingerprints at home are compared with all that are there.  Of two
homes only one side sends copies to the other (the one with the lowest bit in
which they differ), which halves the copies and still finds every pair, exactly.

A cell (part and anchor) with more than ``HOMES`` fingerprints at home is split:
each task holds a share of the homes and streams everything else that is there.
A task hands on a spanning forest of its pairs and, where asked for, how many
links each fingerprint has; a pair that meets in several parts counts in the
first.  So no pair is lost and no list of pairs of a large group is ever made.

Equal fingerprints are collapsed first, so thousands of exact copies cost one
comparison.  Groups are closed transitively; the least id stays.

Defined cases: a document is an (id, text); repeated rows are one document, of
which the stage keeps one row; two texts of one id are two documents, each
judged by its own text; of equal least ids the text with the least hash stays,
of repeated rows the least by their other columns.  A text without a word
(null, empty, white space) has no fingerprint, a null id no name: these are
never grouped and stay.  Very long texts count whole.  Ids keep their type, an
empty table gives an empty result, other columns pass through.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quillmill.llm.arrays import buffers, mix64, slices, span_hashes, text_column, trim
from quillmill.llm.bpe_core import byte_classes
from quillmill.llm.groups import components, least_ids, roots_of, unite
from quillmill.llm.shared import column, read_table, unused, written

PARTS, PART_BITS = 8, 15
#: Chosen on pairs of edited copies without further partners.
DISTANCE = 22
#: Fingerprints at home that a task holds of a cell.
HOMES = 1 << 15
#: Fingerprints that a task gathers before it hands its cells on, and that stream by at once.
GATHER = 1 << 14
STREAMED = 1 << 15
#: Rows up to which the removed ids are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 2_000_000
#: The bits of each byte, highest first, as the eight bytes of a word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]
_STOP = np.isin(np.arange(256), np.frombuffer(b".,;:?!", np.uint8))
_MASK = np.uint64(0x7FFF7FFF7FFF7FFF)


def fingerprints(buf: np.ndarray, offs: np.ndarray, slab: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """((documents, 2) uint64, number of distinct words) of a slice of lower-case text."""
    n = len(offs) - 1
    acc, count = np.zeros((n, 128), np.int32), np.zeros(n, np.int64)
    if len(buf):
        cls = byte_classes(buf)
        word = cls != 3
        edge = np.zeros(len(buf) + 1, bool)
        edge[0] = word[0]
        np.not_equal(word[1:], word[:-1], out=edge[1:-1])
        edge[-1] = word[-1]
        # a word may not reach over the end of its document
        inner = offs[1:-1]
        inner = inner[(inner > 0) & (inner < len(buf))]
        cut = np.unique(inner[word[inner - 1] & word[inner]]) if inner.size else inner
        marks = np.flatnonzero(edge)
        starts, ends = np.sort(np.concatenate([marks[::2], cut])), np.sort(np.concatenate([marks[1::2], cut]))
        if starts.size:
            # one full stop, comma or the like at the end isn't part of the word; other signs are
            ends = ends - ((ends - starts > 1) & _STOP[buf[ends - 1]])
            doc = np.searchsorted(offs, starts, side="right") - 1
            key = np.sort(doc.astype(np.uint64) << np.uint64(44) | span_hashes(buf, starts, ends) >> np.uint64(20))
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
            h = key & np.uint64((1 << 44) - 1)
            count = np.bincount((key >> np.uint64(44)).astype(np.int64), minlength=n)
            # bits are counted eight to a word of eight bytes, so in runs of at most 255 words of a text
            runs = -(-count // 255)
            of = np.repeat(np.arange(n), runs)
            at = np.repeat(np.cumsum(count) - count, runs) + 255 * (np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs))
            i = 0
            while i < len(of):
                j = max(i + 1, int(np.searchsorted(at, at[i] + slab)))
                part = h[at[i] : at[j] if j < len(at) else len(h)]
                two = np.stack([mix64(part ^ np.uint64(0xA5A5_0000_0000_0000)), mix64(part ^ np.uint64(0x3C3C_0000_0000_0000))], axis=1)
                lanes = np.add.reduceat(_LANES[two.astype(">u8").view(np.uint8).reshape(-1, 16)], at[i:j] - at[i], axis=0)
                np.add.at(acc, of[i:j], lanes.view(np.uint8).reshape(-1, 128))
                i = j
    packed = np.packbits(2 * acc > count[:, None], axis=1).view(">u8").astype(np.uint64)
    return packed & _MASK, count


def simhashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, fa, fb, n_words) of every row; th: hash of the text; the fingerprint is fa and fb together."""

    def run(batches):
        for batch in batches:
            buf, offs = buffers(pc.utf8_lower(text_column(batch, "text")))
            got = [fingerprints(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in slices(offs)]
            f = np.concatenate([np.zeros((0, 2), np.uint64), *(x[0] for x in got)]).view(np.int64)
            n = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in got)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.ascontiguousarray(f[:, 0])), pa.array(np.ascontiguousarray(f[:, 1])), pa.array(n)], names=["doc_id", "th", "fa", "fb", "n_words"])
            del buf, offs
            trim()

    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, th bigint, fa bigint, fb bigint, n_words bigint")


def part_values(f: np.ndarray) -> np.ndarray:
    """(n, 8) parts of 15 bits."""
    out = np.empty((len(f), PARTS), np.int64)
    for w in range(2):
        for k in range(4):
            out[:, w * 4 + k] = (f[:, w] >> np.uint64(48 - 16 * k)).astype(np.int64) & 0x7FFF
    return out


def _syndromes() -> np.ndarray:
    v = np.arange(1 << PART_BITS)
    s = np.zeros(1 << PART_BITS, np.int64)
    for i in range(PART_BITS):
        s ^= np.where(v >> i & 1, i + 1, 0)
    return s


def _flips(reach: int) -> np.ndarray:
    """For a syndrome the bit patterns that lead to the anchors within reach, the home first; -1 where there are fewer."""
    near: list[list[int]] = [[] for _ in range(16)]
    for size in range(reach + 1):
        for bits in combinations(range(PART_BITS), size):
            v = sum(1 << i for i in bits)
            near[int(_SYN[v])].append(v)
    out = np.full((16, max(map(len, near))), -1, np.int64)
    for s, x in enumerate(near):
        out[s, : len(x)] = x
    return out


_SYN = _syndromes()
_FLIPS: dict[int, np.ndarray] = {}
_HOME = _flips(1)[:, 0]


def reaches(most: int) -> list[int]:
    """How far from an anchor each part is sent, so that pairs within ``most`` meet; the reaches add up to most + 1."""
    least, more = divmod(most + 1, PARTS)
    return [least + (p < more) for p in range(PARTS)]


def cells_of(f: np.ndarray, most: int = DISTANCE, one_way: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, row, is home) for every anchor within reach of every part; ``one_way``: of two homes only one sends copies to the other."""
    parts = part_values(f)
    cell, row, home = [], [], []
    idx = np.arange(len(f), dtype=np.int32)
    for p, reach in enumerate(reaches(most)):
        if reach not in _FLIPS:
            _FLIPS[reach] = _flips(reach)
        v = parts[:, p]
        flips = _FLIPS[reach][_SYN[v]]
        own = v ^ flips[:, 0]
        for k in range(flips.shape[1]):
            m = flips[:, k] >= 0
            if one_way and k:
                c = flips[:, 0] ^ flips[:, k]
                m &= own & c & -c != 0
            cell.append((p << PART_BITS | (v[m] ^ flips[m, k])).astype(np.int32))
            row.append(idx[m])
            home.append(np.full(int(m.sum()), k == 0))
    return np.concatenate(cell), np.concatenate(row), np.concatenate(home)


def homes_of(f: np.ndarray) -> np.ndarray:
    """(n, 8) home cells."""
    parts = part_values(f)
    return np.arange(PARTS) << PART_BITS | parts ^ _HOME[_SYN[parts]]


def cell_tasks(reps: DataFrame, homes: int = HOMES) -> dict[int, int]:
    """Into how many tasks each of the large cells is split; the counts are at most one number a cell."""

    def run(batches):
        for batch in batches:
            f = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1).view(np.uint64)
            cell, n = np.unique(homes_of(f), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(n, pa.int64())], names=["cell", "n"])

    large = reps.select("fa", "fb").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).filter(F.col("n") > homes)
    return {r["cell"]: -(-r["n"] // homes) for r in large.collect()}


def _to_cells(most: int, tasks: dict[int, int]):
    """Fingerprints to rows (cell, task, side, entries): side 0 is at home there, side 1 streams by."""

    def run(batches):
        split = np.ones(PARTS << PART_BITS, np.int64)
        for c, n in tasks.items():
            split[c] = n
        held: list[np.ndarray] = []

        def flush():
            rec = np.concatenate(held)
            held.clear()
            cell, row, home = cells_of(rec[:, 1:3].view(np.uint64), most, one_way=True)
            side, task = (~home).astype(np.int64), None
            if tasks:
                n = split[cell]
                mine = (mix64(rec[:, 0].view(np.uint64)) & np.uint64((1 << 62) - 1)).astype(np.int64)[row] % n
                # a home is held by its own task and passes those before it; what isn't at home passes all
                times = np.where(home, mine + 1, n)
                at = np.repeat(np.arange(len(cell)), times)
                task = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                cell, row = cell[at], row[at]
                side = (~home[at] | (task != mine[at])).astype(np.int64)
            key = cell.astype(np.int64) << 40 | side
            if task is not None:
                key |= task << 1
            order = np.argsort(key, kind="stable")
            key, row = key[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends, key, wide = np.append(first[1:], len(key)), key[first], rec.shape[1] * 8
            del cell, home, side, order
            for a in range(0, len(first), 8192):
                b = min(a + 8192, len(first))
                lo, hi = first[a], ends[b - 1]
                offs = (np.append(first[a:b], hi) - lo) * wide
                blob = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rec[row[lo:hi]]))])
                k = key[a:b]
                yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in (k >> 40, (k >> 1) & ((1 << 39) - 1), k & 1)), blob], names=["cell", "task", "side", "entries"])
            del key, row, rec
            trim()

        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
                size += batch.num_rows
            if size >= GATHER:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return run


def near_pairs(x: np.ndarray, y: np.ndarray, most: int, same: bool, rows: int = 256, cols: int = 8192):
    """(rows of x, rows of y) of the pairs within ``most`` bits; ``same``: y is x, and each pair comes once."""
    xa, xb, ya, yb = (np.ascontiguousarray(f[:, k]) for f in (x, y) for k in (0, 1))
    for i in range(0, len(xa), rows):
        for j in range(i // cols * cols if same else 0, len(ya), cols):
            da = np.bitwise_count(xa[i : i + rows, None] ^ ya[None, j : j + cols])
            r, c = np.nonzero(da <= most)
            if r.size:
                ok = da[r, c].astype(np.int64) + np.bitwise_count(xb[r + i] ^ yb[c + j]) <= most
                if same:
                    ok &= r + i < c + j
                if ok.any():
                    yield r[ok] + i, c[ok] + j


def met_before(x: np.ndarray, y: np.ndarray, part: int, most: int) -> np.ndarray:
    """Whether each pair of fingerprints meets in a part before ``part`` already."""
    out = np.zeros(len(x), bool)
    if part:
        vx, vy, hx, hy = part_values(x), part_values(y), homes_of(x), homes_of(y)
        for p, reach in enumerate(reaches(most)[:part]):
            c = hx[:, p] ^ hy[:, p]
            sends = hx[:, p] & c & -c != 0  # x goes to y's home, or y to x's
            far = np.where(sends, vx[:, p] ^ hy[:, p], vy[:, p] ^ hx[:, p]) & 0x7FFF
            out |= (c == 0) | (np.bitwise_count(far) <= reach)
    return out


def _compare(most: int, links: bool):
    """Rows sorted by (cell, task, side) to edges (a, b, 0) of a spanning forest and, with ``links``, counts (a, null, n)."""

    def run(batches):
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        counts: list[tuple[np.ndarray, np.ndarray]] = []

        def meet(part: int, home: np.ndarray, other: np.ndarray, same: bool):
            n = len(home)
            parent = np.arange(n if same else n + len(other))
            links_of = np.zeros(len(parent), np.int64)
            for r, c in near_pairs(home[:, 1:3].view(np.uint64), other[:, 1:3].view(np.uint64), most, same):
                at = c if same else c + n
                unite(parent, r, at)
                if links:
                    new = ~met_before(home[r, 1:3].view(np.uint64), other[c, 1:3].view(np.uint64), part, most)
                    np.add.at(links_of, r[new], other[c[new], 3])
                    np.add.at(links_of, at[new], home[r[new], 3])
            top = roots_of(parent, np.arange(len(parent))) if len(parent) else parent
            ids = home[:, 0] if same else np.concatenate([home[:, 0], other[:, 0]])
            m = np.flatnonzero(top != np.arange(len(top)))
            if m.size:
                edges.append((ids[m], ids[top[m]]))
            m = np.flatnonzero(links_of)
            if m.size:
                counts.append((ids[m], links_of[m]))

        def out():
            if edges or counts:
                e = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*edges)] or [np.zeros(0, np.int64)] * 2
                k = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*counts)] or [np.zeros(0, np.int64)] * 2
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([e[0], k[0]])), pa.concat_arrays([pa.array(e[1]), pa.nulls(len(k[0]), pa.int64())]), pa.array(np.concatenate([np.zeros(len(e[0]), np.int64), k[1]]))], names=["a", "b", "n"])
                edges.clear()
                counts.clear()

        now, home, held, size, settled = (-1, -1), None, [], 0, False

        def flush():
            """Compare what is held: homes among themselves, or what streams by with the homes."""
            nonlocal home, size, settled
            if held:
                rec = np.concatenate(held)
                held.clear()
                size = 0
                if not settled:
                    home, settled = rec, True
                    meet(now[0] >> PART_BITS, home, home, True)
                elif home is not None:
                    meet(now[0] >> PART_BITS, home, rec, False)

        for batch in batches:
            wide = 4 if links else 3
            for cell, task, side, blob in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3)):
                if (cell, task) != now:
                    flush()
                    now, home, settled = (cell, task), None, False
                if side and not settled:
                    flush()
                    settled = True
                if side and home is None:
                    continue
                held.append(np.frombuffer(blob.as_buffer(), np.int64).reshape(-1, wide))
                size += len(held[-1])
                if side and size >= STREAMED:
                    flush()
            yield from out()
        flush()
        yield from out()

    return run


def _classes(prints: DataFrame, most: int, homes: int, links: bool) -> DataFrame:
    """(fa, fb, kept, n_links) of every fingerprint; kept: (id, text hash) of the document that stays of its group."""
    known = prints.filter("n_words > 0 AND doc_id IS NOT NULL").select("doc_id", "th", "fa", "fb").distinct()
    # numbers for the fingerprints are fixed by writing them
    reps = written(known.groupBy("fa", "fb").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("node", F.monotonically_increasing_id()), "simhash-prints")
    cells = reps.select("node", "fa", "fb", *["n"] * links).mapInArrow(_to_cells(most, cell_tasks(reps, homes)), "cell int, task int, side int, entries binary")
    found = written(cells.repartition("cell", "task").sortWithinPartitions("cell", "task", "side").mapInArrow(_compare(most, links), "a bigint, b bigint, n bigint"), "simhash-links")
    classes = least_ids(reps.select("node", "rep"), components(found.filter("b IS NOT NULL").select("a", "b"))).withColumnRenamed("class_id", "least")
    out = reps.join(classes, "node", "left").withColumn("kept", F.coalesce("least", "rep"))
    if not links:
        return out.select("fa", "fb", "kept")
    sums = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    return out.join(sums, "node", "left").select("fa", "fb", "kept", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = DISTANCE, homes: int = HOMES) -> DataFrame:
    """(doc_id, class_id, n_links, keep), one row a document.

    ``n_links`` counts the other documents whose fingerprint is equal or near,
    ``class_id`` is the least id of the group, and ``keep`` is true for the one
    document of each group that stays.
    """
    prints = written(simhashes(docs, id_col, text_col), "simhash")
    classes = _classes(prints, most, homes, True)
    every = prints.distinct().withColumn("known", F.expr("n_words > 0 AND doc_id IS NOT NULL"))
    known = every.filter("known").join(classes, ["fa", "fb"]).select("doc_id", F.col("kept.doc_id").alias("class_id"), "n_links", (F.struct("doc_id", "th") == F.col("kept")).alias("keep"))
    return known.unionByName(every.filter("NOT known").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("keep")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, most: int = DISTANCE, homes: int = HOMES) -> DataFrame:
    """The rows of ``docs`` without the near copies; one document of each group stays."""
    prints = written(simhashes(docs, id_col, text_col), "simhash")
    key, th = unused("key", docs.columns), unused("th", docs.columns)
    known = prints.filter("n_words > 0 AND doc_id IS NOT NULL").select("doc_id", "th", "fa", "fb").distinct()
    gone = written(known.join(_classes(prints, most, homes, False), ["fa", "fb"]).filter(F.struct("doc_id", "th") != F.col("kept")).select(F.col("doc_id").alias(key), F.col("th").alias(th)), "near-copies")
    is_gone = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    same = (docs[id_col] == F.col(key)) & (F.xxhash64(docs[text_col].cast("string")) == F.col(th))
    kept = docs.join(is_gone, same, "left_anti")
    twice = prints.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(key), F.col("th").alias(th)).count().filter("count > 1").drop("count").join(gone, [key, th], "left_anti")
    if twice.isEmpty():
        return kept
    # of repeated rows the least stays, merged before they meet; columns without an order don't count
    name, row = unused("row", docs.columns), F.struct(*map(column, docs.columns))
    ordered = [column(c.name) for c in docs.schema if "map<" not in c.dataType.simpleString() and "variant" not in c.dataType.simpleString()]
    one = kept.join(twice, same, "left_semi").groupBy(F.col(id_col).alias(key), F.xxhash64(F.col(text_col).cast("string")).alias(th)).agg(F.min_by(row, F.struct(*ordered)).alias(name))
    return kept.join(twice, same, "left_anti").unionByName(one.select(f"`{name}`.*"))


QUERIES = {"op3_simhash_anchors": lambda spark, sf_dir: near_copies(read_table(spark, sf_dir, "documents"))}
ORACLE: dict[str, str] = {}
