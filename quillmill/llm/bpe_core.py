"""Byte-level BPE on ragged numpy arrays.

``pretokens`` cuts a buffer of documents into pre-tokens exactly as the
pattern of the public 50k vocabularies does.  ``Ranks`` holds a vocabulary
read from a ``.tiktoken`` rank file and merges many pre-tokens at once:
each round finds the lowest-rank pair of every sequence and applies it.

The file's path is a parameter; it has to be readable on every executor.
"""

from __future__ import annotations

import base64
import unicodedata
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa

from quillmill.llm.arrays import ragged_take

DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_NONE = np.int32(2**31 - 1)
#: Bytes of a sequence beyond which it is merged by ranks over linked arrays.
LONG_BYTES = 256
_tables: dict[str, np.ndarray] = {}


def _class_table() -> np.ndarray:
    if "cp" not in _tables:
        kind = {"L": _LETTER, "N": _NUMBER}
        cat = unicodedata.category
        t = np.fromiter((kind.get(cat(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        t[_WHITE] = _SPACE
        _tables["ascii"] = np.concatenate([t[:128], np.zeros(128, np.uint8)])
        _tables["cp"] = t
    return _tables["cp"]


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = _class_table()
    cls = _tables["ascii"][buf]
    hi = np.flatnonzero(buf >= 0xC0)
    if hi.size:
        pad = np.concatenate([buf, np.zeros(3, np.uint8)])
        b0 = buf[hi].astype(np.int32)
        c1, c2, c3 = (pad[hi + k].astype(np.int32) & 63 for k in (1, 2, 3))
        cp = np.where(b0 < 0xE0, (b0 & 31) << 6 | c1, np.where(b0 < 0xF0, (b0 & 15) << 12 | c1 << 6 | c2, (b0 & 7) << 18 | c1 << 12 | c2 << 6 | c3))
        k = table[np.minimum(cp, 0x10FFFF)]
        cls[hi] = k
        n = len(buf)
        for extra, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            m = (b0 >= least) & (hi + extra < n)
            cls[hi[m] + extra] = k[m]
    return cls


def pretokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the pre-tokens (they tile the buffer), and the index of each document's first one."""
    n = len(buf)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(len(offs), np.int64)
    cls = byte_classes(buf)
    flag = np.zeros(n + 1, bool)
    np.not_equal(cls[1:], cls[:-1], out=flag[1:n])
    doc = np.zeros(n + 1, bool)
    doc[offs] = True
    flag |= doc
    runs = np.flatnonzero(flag)
    rs, re = runs[:-1], runs[1:]
    more = ~doc[re]
    kind = cls[rs]
    # white space before something else: its last character goes alone or, if a blank, with what follows
    sp = (kind == _SPACE) & more
    s, e = rs[sp], re[sp]
    last = e - 1
    for _ in range(3):
        last = np.where((buf[last] & 0xC0) == 0x80, last - 1, last)
    flag[last[last > s]] = True
    blank = buf[last] == 0x20
    flag[e[blank]] = False
    # 's 't 're 've 'm 'll 'd
    ap = (re - rs == 1) & (buf[rs] == 0x27) & (kind == _OTHER) & more & flag[rs]
    at = np.flatnonzero(ap)
    if at.size:
        at = at[cls[re[at]] == _LETTER]
    if at.size:
        start, stop = rs[at], re[at + 1]
        pad = np.concatenate([buf, np.zeros(3, np.uint8)])
        x, y = pad[start + 1], pad[start + 2]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = (stop - start >= 3) & (((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108)))
        length = np.where(one, 2, np.where(two, 3, 0))
        m = length > 0
        flag[start[m] + 1] = False
        flag[start[m] + length[m]] = True
    tok = np.flatnonzero(flag)
    return tok, np.searchsorted(tok, offs)


def distinct(buf: np.ndarray, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens as (bytes, offsets), and the number of each pre-token's own."""
    n = len(tok) - 1
    if n <= 0:
        return buf[:0], np.zeros(1, np.int64), np.zeros(0, np.int64)
    arr = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(tok, np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])
    d = arr.dictionary_encode()
    _, off, data = d.dictionary.buffers()
    m = len(d.dictionary)
    o = np.frombuffer(off, np.int64)[: m + 1]
    return np.frombuffer(data, np.uint8)[: o[-1]], o, d.indices.to_numpy().astype(np.int64)


def _leftmost(at: np.ndarray, nxt: np.ndarray | None = None) -> np.ndarray:
    """Of ascending places that follow each other only every other one; ``nxt``: the place after each, if not the next number."""
    if at.size > 1:
        brk = np.concatenate([[True], (nxt[at[:-1]] if nxt is not None else at[:-1] + 1) != at[1:]])
        if not brk.all():
            k = np.arange(at.size)
            at = at[(k - np.maximum.accumulate(np.where(brk, k, 0))) % 2 == 0]
    return at


def _in_order(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, n+1 offsets) from parts of (sequence numbers, their ids, how many each has)."""
    count = np.zeros(n, np.int64)
    if not parts:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    who = np.concatenate([p[0] for p in parts])
    size = np.concatenate([p[2] for p in parts])
    count[who] = size
    at = np.zeros(n, np.int64)
    at[who] = np.arange(len(who))
    have = np.flatnonzero(count)
    flat, _ = ragged_take(np.concatenate([p[1] for p in parts]), np.concatenate([[0], np.cumsum(size)]), at[have])
    return flat, np.concatenate([[0], np.cumsum(count)])


class Ranks:
    """A byte-level vocabulary whose ids are its merge ranks."""

    _loaded: dict[str, "Ranks"] = {}

    def __init__(self, path: str):
        pairs = [line.split() for line in open(path, "rb") if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.size = max(self.rank.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for t, r in self.rank.items():
            self.tokens[r] = t
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        # every way to put a token together from two others
        get = self.rank.get
        keys, vals = array("q"), array("i")
        for t, r in self.rank.items():
            for k in range(1, len(t)):
                a = get(t[:k])
                if a is not None and (b := get(t[k:])) is not None:
                    keys.append(a << 20 | b)
                    vals.append(r)
        self._hash(np.array(keys, np.int64), np.array(vals, np.int32))
        both = np.arange(1 << 16)
        self.byte_rank = self.lookup(self.byte_id[both >> 8], self.byte_id[both & 255])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.blob_offs = np.concatenate([[0], np.cumsum([len(t) for t in self.tokens])]).astype(np.int64)

    @property
    def kind(self) -> str:
        """Least unsigned type, little-endian, that holds every id and the one after the last."""
        return "<u2" if self.size < 1 << 16 else "<u4"

    @classmethod
    def load(cls, path: str = DEFAULT_VOCAB) -> "Ranks":
        """One copy in each Python worker."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def pairs(self) -> dict[int, int]:
        """Ranks by pair, for looking up one at a time."""
        some = np.flatnonzero(self.slots >= 0)
        return dict(zip(self.slots[some].tolist(), self.values[some].tolist()))

    def _hash(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """Open addressing with linear probing, filled a probe distance at a time."""
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        size = 1 << self.bits
        self.slots = np.full(size + 64, -1, np.int64)
        self.values = np.full(size + 64, _NONE, np.int32)
        left, probe = np.arange(len(keys)), 0
        while left.size:
            at = self._slot(keys[left]) + probe
            assert probe < 63
            free = self.slots[at] < 0
            at_free, idx = at[free], left[free]
            first = np.unique(at_free, return_index=True)[1]
            self.slots[at_free[first]] = keys[idx[first]]
            self.values[at_free[first]] = vals[idx[first]]
            done = np.zeros(len(keys), bool)
            done[idx[first]] = True
            left, probe = left[~done[left]], probe + 1
        self.probes = probe

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the largest int32."""
        key = a.astype(np.int64) << 20 | b
        at = self._slot(key)
        found = self.slots[at]
        out = np.where(found == key, self.values[at], _NONE)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(1, self.probes):
            if not open_.size:
                break
            at[open_] += 1
            found = self.slots[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def merge_all(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every sequence of bytes: rank-synchronous rounds over the ragged arrays.

        In a round each sequence applies its own lowest-rank pair, the leftmost
        of equal ones; a sequence without a pair is done.  Symbols are linked, so
        that only the pairs next to a merge are looked up again.
        Sequences over ``LONG_BYTES`` go by ranks instead of rounds, so that a
        round never walks the untouched part of a long one.
        """
        lens = np.diff(offs)
        long = lens > LONG_BYTES
        if not long.any():
            return self._merge_short(raw, offs)
        parts = []
        for pick, merge in ((np.flatnonzero(~long), self._merge_short), (np.flatnonzero(long), self._merge_long)):
            ids, io = merge(*ragged_take(raw, offs, pick))
            parts.append((pick, ids, np.diff(io)))
        return _in_order(parts, len(lens))

    def _merge_short(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, lens = len(raw), np.diff(offs)
        some = np.flatnonzero(lens)
        own, count = offs[:-1][some], lens[some]
        sym = np.append(self.byte_id[raw], np.int32(-1))
        nxt, prv = np.arange(1, m + 2, dtype=np.int32), np.arange(-1, m, dtype=np.int32)
        nxt[own + count - 1] = prv[own] = m
        rank = np.full(m, _NONE, np.int32)
        if m > 1:
            rank[:-1] = self.byte_rank[raw[:-1].astype(np.int32) << 8 | raw[1:]]
            rank[own + count - 1] = _NONE
        key = rank.astype(np.int64) << 32 | np.arange(m)  # (rank, place); places keep their numbers when keys are packed
        none, starts = np.int64(_NONE) << 32, own
        while own.size:
            # between the sequences that are left only keys without a rank lie
            low = np.minimum.reduceat(key, starts)
            left = low < none
            if not left.all():
                low, own, count, starts = low[left], own[left], count[left], starts[left]
                if not own.size:
                    break
                if 2 * (size := int(count.sum())) < len(key):
                    packed = np.cumsum(count) - count
                    key = key[np.arange(size) + np.repeat(starts - packed, count)]
                    starts = packed
            shift = starts - own
            r, at = (low >> 32).astype(np.int32), low & 0xFFFFFFFF
            gone = nxt[at]
            after, before = nxt[gone], prv[at]
            sym[at], sym[gone], nxt[at] = r, -1, after
            prv[after] = at
            key[gone + shift] = none
            ranks = np.where(after < m, self.lookup(r, sym[after]), _NONE)
            key[at + shift] = ranks.astype(np.int64) << 32 | at
            has = np.flatnonzero(before < m)
            p = before[has]
            key[p + shift[has]] = self.lookup(sym[p], r[has]).astype(np.int64) << 32 | p
        keep = sym[:m] >= 0
        return sym[:m][keep], np.concatenate([[0], np.cumsum(keep)])[offs]

    def _merge_long(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lowest rank of all sequences at all its places at once, over linked arrays; places wait in a queue of ranks."""
        n = len(raw)
        sym = np.append(self.byte_id[raw], np.int32(-1))
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        nxt[offs[1:] - 1] = n
        prv[offs[:-1]] = n
        nxt[n] = prv[n] = n
        rank = np.full(n + 1, _NONE, np.int32)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def look(at):
            """Ranks of the pairs that begin at the places, which are queued."""
            to = nxt[at]
            got = np.where(to < n, self.lookup(sym[at], sym[to]), _NONE)
            rank[at] = got
            some = got != _NONE
            at, got = at[some], got[some]
            order = np.argsort(got, kind="stable")
            at, got = at[order], got[order]
            cuts = np.flatnonzero(got[1:] != got[:-1]) + 1
            for r, part in zip(got[np.concatenate([[0], cuts])].tolist() if got.size else [], np.split(at, cuts)):
                if r not in waiting:
                    waiting[r] = []
                    heappush(queue, r)
                waiting[r].append(part)

        look(np.arange(n))
        while queue:
            r = heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not at.size:
                continue
            at = _leftmost(at, nxt)
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone], rank[gone] = r, -1, _NONE
            nxt[at] = after
            prv[after] = at
            prv[n] = n
            before = prv[at]
            look(np.unique(np.concatenate([at, before[before < n]])))
        keep = sym[:n] >= 0
        return sym[:n][keep], np.concatenate([[0], np.cumsum(keep)])[offs]

    def encode_slice(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a slice: (ids, n+1 offsets)."""
        tok, doc = pretokens(buf, offs)
        raw, uo, which = distinct(buf, tok)
        ids, io = self.merge_all(raw, uo)
        flat, fo = ragged_take(ids, io, which)
        return flat, fo[doc]

    def count_slice(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Number of ids of each document of a slice."""
        tok, doc = pretokens(buf, offs)
        raw, uo, which = distinct(buf, tok)
        _, io = self.merge_all(raw, uo)
        total = np.zeros(len(which) + 1, np.int64)
        np.cumsum(np.diff(io)[which], out=total[1:])
        return np.diff(total[doc])

    def decode_flat(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ragged ids: the vocabulary's strings one after the other."""
        raw, bo = ragged_take(self.blob, self.blob_offs, ids)
        return raw, bo[offs]
