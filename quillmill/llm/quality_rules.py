"""Quality rules by compression bands.

A text's zstandard ratio (bytes over compressed bytes) falls into a band that
depends on its length: above the band it repeats itself, below it hardly
compresses at all (encoded or random data).  Fixed chunks of the text are held
to the band of the chunk's own length, so that a bad stretch inside a long
document counts too.  Everything is one pass without a shuffle.

Defined cases: a null text or one of white space only, Unicode's included, is
rejected as ``empty``; texts shorter than the first band's bound cannot be
judged by compression and stay; very long texts are compressed whole; a ratio on
a bound lies inside the band; repeated rows are judged alike, each for itself; a
null id passes through and ids keep their type; a text column that isn't there
is an error, one in another case is found as Spark finds it; an empty table
gives an empty result; other columns pass through the stage untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillmill.llm.arrays import text_column
from quillmill.llm.shared import read_table, resolved, type_of

LEVEL = 3
#: (bytes below which the band holds, least ratio, greatest ratio); the last one holds for all longer texts.
BANDS = (
    (64, 0.0, float("inf")),
    (256, 0.0, 2.4),
    (512, 0.75, 2.6),
    (1024, 1.05, 2.9),
    (4096, 1.2, 3.4),
    (16384, 1.4, 3.8),
    (float("inf"), 1.4, 4.5),
)
CHUNK_BYTES = 4096
#: A document goes when at least this share of its bytes lies in chunks outside their band.
BAD_CHUNK_SHARE = 0.4


def band(n: int, bands=BANDS) -> tuple[float, float]:
    for below, low, high in bands:
        if n < below:
            return low, high
    return bands[-1][1:]


def judge(raw: bytes, compress, level_bands=BANDS, chunk: int = CHUNK_BYTES, share: float = BAD_CHUNK_SHARE) -> tuple[float, float, str | None]:
    """(ratio of the whole, share of bytes in bad chunks, reason or None) of one text."""
    n = len(raw)
    rest = raw.lstrip()
    if not rest or rest[0] >= 0x80 and rest.decode("utf-8", "replace").isspace():
        return 0.0, 0.0, "empty"
    ratio = n / len(compress(raw))
    bad = 0
    if n > chunk:
        for k in range(0, n, chunk):
            part = raw[k : k + chunk]
            low, high = band(len(part), level_bands)
            r = len(part) / len(compress(part))
            if not low <= r <= high:
                bad += len(part)
    low, high = band(n, level_bands)
    why = "repetitive" if ratio > high else "incompressible" if ratio < low else "bad_chunks" if bad / n >= share else None
    return ratio, bad / n, why


def _verdicts(batch: pa.RecordBatch, name: str, params) -> tuple[list, list, list]:
    import zstandard

    compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False).compress
    texts = text_column(batch, name)
    whole, chunks, why = [], [], []
    for t in texts:
        a, b, c = judge(t.as_buffer().to_pybytes() if len(t.as_buffer() or b"") else b"", compress, *params)
        whole.append(a)
        chunks.append(b)
        why.append(c)
    return whole, chunks, why


def compression_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS, chunk: int = CHUNK_BYTES, share: float = BAD_CHUNK_SHARE) -> DataFrame:
    """(doc_id, ratio, bad_chunk_share, keep, reason) of every row."""

    def run(batches):
        for batch in batches:
            whole, chunks, why = _verdicts(batch, "text", (bands, chunk, share))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(whole, pa.float64()), pa.array(chunks, pa.float64()), pa.array([w is None for w in why], pa.bool_()), pa.array(why, pa.string())],
                names=["doc_id", "ratio", "bad_chunk_share", "keep", "reason"],
            )

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {type_of(src, 'doc_id')}, ratio double, bad_chunk_share double, keep boolean, reason string")


def keep_by_compression(docs: DataFrame, text_col: str = "text", bands=BANDS, chunk: int = CHUNK_BYTES, share: float = BAD_CHUNK_SHARE) -> DataFrame:
    """The rows that stay, with all their columns."""
    name = resolved(docs, text_col)

    def run(batches):
        for batch in batches:
            why = _verdicts(batch, name, (bands, chunk, share))[2]
            yield batch.filter(pa.array(np.array([w is None for w in why], bool)))

    return docs.mapInArrow(run, docs.schema)


QUERIES = {"op7_compression_bands": lambda spark, sf_dir: compression_verdicts(read_table(spark, sf_dir, "documents"))}
ORACLE: dict[str, str] = {}
