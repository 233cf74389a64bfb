"""Flat byte buffers for Arrow text columns.

Every vectorised operator of this package works on one contiguous ``uint8``
buffer per slice of a batch plus an offset per document, so that numpy sees
whole slices instead of one Python string at a time.  A null text counts as
the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single document forms its own slice.
SLICE_BYTES = 2 << 20


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    col = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    return pc.fill_null(col, "") if col.null_count else col


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n+1 offsets of a large_string or large_binary array."""
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offs = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Document ranges of about ``limit`` bytes that cover all documents."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


_libc: list = []


def trim() -> None:
    """Give freed memory back to the system; a worker lives on between tasks, next to an executor's heap."""
    if not _libc:
        import ctypes

        try:
            _libc.append(ctypes.CDLL("libc.so.6").malloc_trim)
        except (OSError, AttributeError):  # another C library
            _libc.append(lambda _: 0)
    pa.default_memory_pool().release_unused()
    _libc[0](0)


def text_slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES):
    """(first row, last row + 1, bytes, offsets) for each slice of a batch."""
    buf, offs = buffers(text_column(batch, name))
    for i, j in slices(offs, limit):
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
    del buf, offs
    trim()


def ragged_take(flat: np.ndarray, offs: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the rows ``pick`` of a ragged array."""
    lens = (offs[1:] - offs[:-1])[pick]
    out = np.zeros(len(pick) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    if out[-1] == 0:
        return flat[:0], out
    pos = np.arange(out[-1], dtype=np.int64)
    pos += np.repeat(offs[:-1][pick] - out[:-1], lens)
    return flat[pos], out


def list_array(flat: pa.Array, offs: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), flat)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on an unsigned array."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 1 << 64)
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _pow.get("p")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        with np.errstate(over="ignore"):
            for key, base in (("p", _B), ("q", _BINV)):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                _pow[key] = np.cumprod(a)
    return _pow["p"], _pow["q"]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes hash equally anywhere."""
    n = len(buf)
    p, q = _powers(n + 1)
    with np.errstate(over="ignore"):
        acc = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[:n], out=acc[1:])
        return mix64((acc[ends] - acc[starts]) * q[starts])
