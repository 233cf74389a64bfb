"""Language spans of mixed-language text.

The script of a word's letters (code-point ranges) narrows its candidate
languages; among candidates the word is scored by byte trigrams with word
bounds, smoothed log probabilities of a model fitted on labelled rows.  A
Viterbi pass over the words with a penalty for each switch then labels the
whole text, so one odd word doesn't break a span.

The pass is exact for texts of any length and vectorised over them: words are
laid out in lanes of ``LANE`` words, every lane's transfer matrix is computed
for all entry states at once, the matrices are chained per document, and a
second run over the lanes recovers the path.

Model: fitted on at most ``TRAIN_ROWS`` labelled rows, as many of each language,
those with the least hash of (id, text, seed); this bound is a parameter.  Their
trigrams are counted on the executors, and only the counts reach the driver.
Everything else reads all data.

Defined cases: a null or empty text, or one without letters, has language
``und`` and no span; letters of scripts without a language are ``und``; rows
with a null label or text don't train; a null id passes through and ids keep
their type; repeated rows are labelled alike, each for itself; very long texts
are labelled whole; without labelled rows only scripts decide; ties go to the
language first in alphabetical order; an empty table gives an empty result;
other columns of the input are never looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from quillmill.llm.arrays import buffers, slices, text_column, trim
from quillmill.llm.bpe_core import byte_classes
from quillmill.llm.shared import read_table, type_of

#: Upper bound on the labelled rows that a model is fitted on, and their seed.
TRAIN_ROWS, SEED = 1500, 17
SWITCH, CLIP, LANE = 10.0, 6.0, 128
_BITS = 17
_NEG = np.float32(-1e4)

#: script: (first, last) ranges; languages told by their script alone where no labelled row is written in it.
SCRIPTS = {
    "Latn": [(0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "Grek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrl": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armn": [(0x530, 0x58F)],
    "Hebr": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "Arab": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Deva": [(0x900, 0x97F)],
    "Beng": [(0x980, 0x9FF)],
    "Taml": [(0xB80, 0xBFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Geor": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "Hang": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)],
    "Hani": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
SCRIPT_LANGUAGE = {"Grek": "el", "Cyrl": "ru", "Armn": "hy", "Hebr": "he", "Arab": "ar", "Deva": "hi", "Beng": "bn", "Taml": "ta", "Thai": "th", "Geor": "ka", "Hang": "ko", "Kana": "ja", "Hani": "zh"}
_NAMES = [*SCRIPTS, "Zyyy"]
_script_table: list[np.ndarray] = []


def _scripts() -> np.ndarray:
    if not _script_table:
        t = np.full(0x110000, len(SCRIPTS), np.uint8)
        for k, ranges in enumerate(SCRIPTS.values()):
            for a, b in ranges:
                t[a : b + 1] = k
        _script_table.append(t)
    return _script_table[0]


@dataclass
class Words:
    """Runs of letters of one script, as byte ranges of a slice."""

    starts: np.ndarray
    ends: np.ndarray
    script: np.ndarray
    doc: np.ndarray
    grams: np.ndarray  # hashed trigram of each byte of each word, words one after the other
    gram_offs: np.ndarray


def words_of(buf: np.ndarray, offs: np.ndarray) -> Words:
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n == 0:
        return Words(none, none, none, none, none, np.zeros(1, np.int64))
    cls = byte_classes(buf)
    letter = cls == 1
    # the script of each byte's character, 255 where it is no letter
    script = np.full(n, 255, np.uint8)
    script[letter] = 0
    hi = np.flatnonzero((buf >= 0xC0) & letter)
    if hi.size:
        pad = np.concatenate([buf, np.zeros(3, np.uint8)])
        b0 = buf[hi].astype(np.int32)
        c1, c2, c3 = (pad[hi + k].astype(np.int32) & 63 for k in (1, 2, 3))
        cp = np.where(b0 < 0xE0, (b0 & 31) << 6 | c1, np.where(b0 < 0xF0, (b0 & 15) << 12 | c1 << 6 | c2, (b0 & 7) << 18 | c1 << 12 | c2 << 6 | c3))
        k = _scripts()[np.minimum(cp, 0x10FFFF)]
        script[hi] = k
        for extra, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            m = (b0 >= least) & (hi + extra < n)
            script[hi[m] + extra] = k[m]
    edge = np.ones(n + 1, bool)
    np.not_equal(script[1:], script[:-1], out=edge[1:n])
    edge[offs] = True
    runs = np.flatnonzero(edge)
    rs, re = runs[:-1], runs[1:]
    m = script[rs] != 255
    # letters next to digits of the same document are parts of numbers or codes, not words
    digit = np.concatenate([cls == 2, [False]])
    border = np.zeros(n + 1, bool)
    border[offs] = True
    m &= ~((digit[rs - 1] & ~border[rs]) | (digit[re] & ~border[re]))
    starts, ends = rs[m], re[m]
    if not starts.size:
        return Words(none, none, none, none, none, np.zeros(1, np.int64))
    lens = ends - starts
    go = np.concatenate([[0], np.cumsum(lens)])
    pos = np.arange(go[-1]) + np.repeat(starts - go[:-1], lens)
    cur = buf[pos].astype(np.uint32)
    prev = np.full(len(pos), 0x20, np.uint32)
    prev[1:] = cur[:-1]
    prev[go[:-1]] = 0x20
    nxt = np.full(len(pos), 0x20, np.uint32)
    nxt[:-1] = cur[1:]
    nxt[go[1:] - 1] = 0x20
    with np.errstate(over="ignore"):
        grams = ((prev << np.uint32(16) | cur << np.uint32(8) | nxt) * np.uint32(2654435761)) >> np.uint32(32 - _BITS)
    return Words(starts, ends, script[starts].astype(np.int64), np.searchsorted(offs, starts, side="right") - 1, grams, go)


@dataclass
class Model:
    languages: list[str]  # states, in alphabetical order
    trained: list[int]  # states that the trigram table scores
    table: np.ndarray  # (2**17, trained) log probabilities
    allowed: np.ndarray  # (scripts, states)

    def scores(self, w: Words) -> np.ndarray:
        """(words, states), the best candidate of each word at 0."""
        s = np.where(self.allowed[w.script], np.float32(0), _NEG)
        if self.trained and len(w.starts):
            # only words whose script leaves a choice need the table
            choice = np.flatnonzero(self.allowed[w.script][:, self.trained].sum(axis=1) > 1)
            if choice.size:
                lens = np.diff(w.gram_offs)[choice]
                o = np.concatenate([[0], np.cumsum(lens)])
                pos = np.arange(o[-1]) + np.repeat(w.gram_offs[:-1][choice] - o[:-1], lens)
                sums = np.add.reduceat(self.table[w.grams[pos]], o[:-1], axis=0)
                ok = self.allowed[w.script[choice]][:, self.trained]
                sums = np.where(ok, sums, -np.inf)
                sums = np.maximum(sums - sums.max(axis=1, keepdims=True), np.float32(-CLIP))
                s[np.ix_(choice, self.trained)] = np.where(ok, sums, _NEG)
        return s


def tally(texts: pa.Array, langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the language in alphabetical order, key, count): trigrams by their hash, letters by 2**17 + script."""
    names = sorted({x for x in langs if x})
    buf, offs = buffers(pc.utf8_lower(texts))
    label = np.array([names.index(x) if x else -1 for x in langs], np.int64)
    got = [np.zeros(0, np.int64)]
    wide = (1 << _BITS) + len(_NAMES)
    for i, j in slices(offs):
        w = words_of(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        lab, lens = label[i + w.doc], np.diff(w.gram_offs)
        for key, of in ((w.grams.astype(np.int64), np.repeat(lab, lens)), (np.repeat(w.script, lens) + (1 << _BITS), np.repeat(lab, lens))):
            got.append((of * wide + key)[of >= 0])
    both, n = np.unique(np.concatenate(got), return_counts=True)
    return both // wide, both % wide, n


def model_of(names: list[str], lang: np.ndarray, key: np.ndarray, n: np.ndarray) -> Model:
    """The trigram model from tallies; ``names`` in alphabetical order."""
    all_counts = np.zeros(((1 << _BITS) + len(_NAMES), len(names)), np.float64)
    np.add.at(all_counts, (key, lang), n)
    counts, letters = all_counts[: 1 << _BITS], all_counts[1 << _BITS :]
    total = counts.sum(axis=0)
    seen = max(1, int((counts.sum(axis=1) > 0).sum()))
    table = np.log((counts + 0.5) / (total + 0.5 * (seen + 1))).astype(np.float32)
    states = sorted({*names, *SCRIPT_LANGUAGE.values(), "und"})
    allowed = np.zeros((len(_NAMES), len(states)), bool)
    share = letters / np.maximum(1, letters.sum(axis=0))
    for s, script in enumerate(_NAMES):
        own = [n for k, n in enumerate(names) if share[s, k] >= 0.1]
        own = own or ([SCRIPT_LANGUAGE[script]] if script in SCRIPT_LANGUAGE else ["und"])
        allowed[s, [states.index(n) for n in own]] = True
    return Model(states, [states.index(n) for n in names], table, allowed)


def fit(texts: pa.Array, langs: list[str]) -> Model:
    """Trigram model of labelled texts."""
    return model_of(sorted({x for x in langs if x}), *tally(texts, langs))


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, seed: int = SEED) -> DataFrame:
    """(l, t): of each of n languages the rows // n labelled rows with the least hash of (id, text, seed), one at least.

    A histogram of the hashes gives each language the bound below which it has
    enough rows, so that hardly more than these are ordered.
    """
    named = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).filter("t IS NOT NULL AND l IS NOT NULL AND l <> ''")
    named = named.withColumn("h", F.xxhash64("i", "t", F.lit(seed)))
    bars = named.groupBy("l", F.shiftright("h", 48).cast("int").alias("bar")).count()
    n_langs = named.select("l").distinct().count()
    quota = max(1, rows // max(1, n_langs))
    before = Window.partitionBy("l").orderBy("bar").rowsBetween(Window.unboundedPreceding, -1)
    needed = bars.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).filter(F.col("before") < quota).groupBy("l").agg(F.max("bar").alias("bound"))
    some = named.join(F.broadcast(needed), "l").filter(F.shiftright("h", 48) <= F.col("bound"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "i", "t"))
    return some.withColumn("rank", rank).filter(F.col("rank") <= quota).select("l", "t")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, seed: int = SEED) -> Model:
    """Fit on ``training_rows``; what the driver gets is at most 2**17 numbers a language."""

    def count(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            lang, key, n = tally(text_column(batch, "t"), langs)
            names = np.array(sorted(set(langs)), object)
            yield pa.RecordBatch.from_arrays([pa.array(names[lang].tolist(), pa.string()), pa.array(key, pa.int32()), pa.array(n, pa.int64())], names=["l", "key", "n"])

    counts = training_rows(docs, id_col, text_col, lang_col, rows, seed).mapInArrow(count, "l string, key int, n bigint").groupBy("l", "key").agg(F.sum("n").alias("n")).toArrow()
    langs = counts["l"].to_pylist()
    names = sorted(set(langs))
    at = {x: k for k, x in enumerate(names)}
    return model_of(names, np.array([at[x] for x in langs], np.int64), counts["key"].to_numpy().astype(np.int64), counts["n"].to_numpy())


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH, lane: int = LANE) -> np.ndarray:
    """Best state of every word.  ``first``: offsets of the documents' words, n+1 of them."""
    total, k = scores.shape
    if total == 0:
        return np.zeros(0, np.int64)
    p = np.float32(penalty)
    n_words = np.diff(first)
    n_lanes = -(-n_words // lane)
    lane_doc = np.repeat(np.arange(len(n_words)), n_lanes)
    lane_first = np.concatenate([[0], np.cumsum(n_lanes)])
    in_doc = np.arange(len(lane_doc)) - lane_first[lane_doc]
    begin = first[lane_doc] + in_doc * lane
    size = np.minimum(lane, first[lane_doc + 1] - begin)
    m = len(begin)
    order = np.argsort(-size, kind="stable")  # longest first: a step handles a prefix of the lanes
    begin, size, back_order = begin[order], size[order], np.argsort(order, kind="stable")
    steps = int(size.max())
    live = np.searchsorted(-size, -np.arange(steps), side="left")  # lanes with more than t words
    # transfer matrices: from each entry state
    v = np.full((m, k, k), _NEG * 4, np.float32)
    v[:, np.arange(k), np.arange(k)] = 0
    for t in range(steps):
        a = live[t]
        cur = v[:a]
        np.maximum(cur, cur.max(axis=2, keepdims=True) - p, out=cur)
        cur += scores[begin[:a] + t][:, None, :]
    v = v[back_order]
    # chain them per document
    enter = np.zeros((m, k))
    leave = np.zeros((m, k))
    longest = int(n_lanes.max())
    docs = np.argsort(-n_lanes, kind="stable")
    ranked = n_lanes[docs]
    for t in range(longest):
        d = docs[: np.searchsorted(-ranked, -t, side="left")]
        at = lane_first[d] + t
        if t:
            e = leave[at - 1]
            enter[at] = e - e.max(axis=1, keepdims=True)
        leave[at] = (enter[at][:, :, None] + v[at]).max(axis=1)
    into, out = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for t in range(longest - 1, -1, -1):
        d = docs[: np.searchsorted(-ranked, -t, side="left")]
        at = lane_first[d] + t
        final = n_lanes[d] == t + 1
        out[at[final]] = leave[at[final]].argmax(axis=1)
        if (~final).any():
            out[at[~final]] = into[at[~final] + 1]
        into[at] = (enter[at] + v[at, :, out[at]]).argmax(axis=1)
    # the first lane of a document is entered from every state alike
    head = in_doc == 0
    # recover the path inside each lane
    into, out, head = into[order], out[order], head[order]
    cur = np.full((m, k), _NEG * 4, np.float32)
    cur[np.arange(m), into] = 0
    cur[head] = 0
    frm = np.zeros((steps, m, k), np.int8 if k < 128 else np.int16)
    for t in range(steps):
        a = live[t]
        c = cur[:a]
        best = c.argmax(axis=1)
        top = c[np.arange(a), best][:, None] - p
        stay = c >= top
        frm[t, :a] = np.where(stay, np.arange(k)[None, :], best[:, None])
        cur[:a] = np.where(stay, c, top) + scores[begin[:a] + t]
    path = np.zeros(total, np.int64)
    state = out.copy()
    for t in range(steps - 1, -1, -1):
        a = live[t]
        path[begin[:a] + t] = state[:a]
        state[:a] = frm[t, np.arange(a), state[:a]]
    return path


def label_slice(model: Model, buf: np.ndarray, offs: np.ndarray, penalty: float = SWITCH):
    """(document, start, end, language number, letters' bytes) of all spans, in code points of the lower-case text."""
    w = words_of(buf, offs)
    if not len(w.starts):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    used = np.flatnonzero(model.allowed[np.unique(w.script)].any(axis=0))
    s = model.scores(w)[:, used]
    first = np.searchsorted(w.doc, np.arange(len(offs)))
    path = used[viterbi(np.ascontiguousarray(s), first, penalty)]
    new = np.concatenate([[True], (path[1:] != path[:-1]) | (w.doc[1:] != w.doc[:-1])])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(path)) - 1
    lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    base = lead[offs[w.doc[a]]]
    size = np.add.reduceat(w.ends - w.starts, a)
    return w.doc[a], lead[w.starts[a]] - base, lead[w.ends[b]] - base, path[a], size


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def label_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH) -> DataFrame:
    """(doc_id, lang, n_spans, spans) of every row; ``lang`` has most letters, offsets count characters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array(m.languages, object)
        for batch in batches:
            # a lower-case form may differ in length, so offsets are taken where it doesn't
            texts = text_column(batch, "text")
            low = pc.utf8_lower(texts)
            same = pc.equal(pc.utf8_length(low), pc.utf8_length(texts))
            buf, offs = buffers(pc.if_else(same, low, texts))
            for i, j in slices(offs):
                doc, a, b, lang, size = label_slice(m, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], penalty)
                n = j - i
                per = np.bincount(doc, minlength=n)
                so = np.concatenate([[0], np.cumsum(per)])
                weight = np.zeros((n, len(names)))
                np.add.at(weight, (doc, lang), size)
                top = np.where(per > 0, names[weight.argmax(axis=1)], "und")
                spans = pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(names[lang].tolist(), pa.string())], fields=list(_SPANS.value_type))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(top.tolist(), pa.string()), pa.array(per, pa.int32()), pa.ListArray.from_arrays(pa.array(so, pa.int32()), spans)],
                    names=["doc_id", "lang", "n_spans", "spans"],
                )
            del buf, offs
            trim()

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {type_of(src, 'doc_id')}, lang string, n_spans int, spans array<struct<start:int,end:int,lang:string>>")


def document_languages(docs: DataFrame, **options) -> DataFrame:
    return label_languages(docs, train(docs), **options)


QUERIES = {"op4_language_spans": lambda spark, sf_dir: document_languages(read_table(spark, sf_dir, "documents"))}
ORACLE: dict[str, str] = {}
