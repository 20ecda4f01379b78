"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order, up to ORDER bytes. A
context predicts the bytes it has seen by their counts; the rest of its
probability is its escape (as many as it has different bytes), dealt over the
other bytes as the next shorter context predicts them; below the empty context
all 256 bytes are alike. A text's start is a context symbol of its own that is
never predicted, so the probabilities of the 256 bytes sum to one everywhere. The
statistics are frozen after training.

The trees of all languages are one sparse tree: a context (with what it adds to
the code length of a byte it has not seen) or a context with a byte (with its code
length) is an entry of a hash table over arrays, a column for each language. A
byte takes the entry of its longest context, else that context's escape and so on
with the next shorter one; contexts of up to one byte are a dense table.

A text's language is the one with the shortest code for all of its bytes. Its
score is a product of two shares: by how much the code is shorter than the next
one, a byte, against what is usual for texts of that language (a text that is 60 %
in one language and 40 % in another has about a fifth), and how far below eight
bits a byte takes, again against the usual. What is usual is measured on training
texts that the measuring model has not seen.

Training takes a bounded sample, a documented parameter: of each language the
different texts with the smallest hashes, whole, up to SAMPLE_DOCS texts and
SAMPLE_BYTES bytes (a longer text trains nothing); equal texts count once. A model
has MOST_LANGUAGES languages at most, those with most different texts, and takes
TOTAL_BYTES bytes together. Only those texts reach the driver, whatever ids repeat.
Contexts of two bytes or more that are seen seldom go until the tables fit in
MODEL_BYTES (the dense table takes 0.3 MB a language).

Defined cases: a null text, an empty one or one without a letter is ``und`` with
score 0; equal code lengths go to the first language by name; without a labelled
training document all texts are ``und``; rows that repeat and a null doc_id are
judged as they come (a null doc_id is not held out and never trains); an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.llm.common import drawn, held_out, text_slices

ORDER = 4
SAMPLE_DOCS = 600
SAMPLE_BYTES = 1_500_000
TOTAL_BYTES = 32 << 20
MOST_LANGUAGES = 256
MODEL_BYTES = 64 << 20
#: A context of two bytes or more is a node of the tree from so many occurrences on, in any language.
LEAST_SEEN = 2
#: Bytes that are priced at one time.
CHUNK = 1 << 17
#: A text's evidence is dealt over so many bytes more than it has, as a few bytes prove little.
FEW = 4
UNKNOWN = "und"
#: Scores below it are too unsure for ``accepted``.
LEAST = 0.2

#: The symbol before a text's first byte, and the bits of a symbol.
START, WIDTH = 256, 9
_EMPTY = np.uint64(2**64 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Places:
    """Where each of some different numbers stands, by open addressing over arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.place = np.full(1 << bits, _EMPTY), np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = self._slots(keys)
        while len(left):
            free = self.keys[slot] == _EMPTY
            self.keys[slot[free]] = keys[left[free]]
            won = self.keys[slot] == keys[left]
            self.place[slot[won]] = left[won]
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Their places, -1 for a number that isn't there."""
        slot = self._slots(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.place[slot], -1)
        left = np.flatnonzero((held != keys) & (held != _EMPTY))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            held = self.keys[slot]
            same = held == keys[left]
            out[left[same]] = self.place[slot[same]]
            on = ~same & (held != _EMPTY)
            left, slot = left[on], slot[on]
        return out


@dataclass
class Level:
    """The contexts of one order. bits: of each entry; escape: of each node, what a byte without an entry pays."""

    entries: Places
    bits: np.ndarray
    nodes: Places
    escape: np.ndarray


@dataclass
class Model:
    """dense: code lengths by (byte before or START) * 256 + byte; levels: of the orders from two on.

    All tables have a column for each language. usual: margin and code length in
    bits a byte of a language's own texts.
    """

    languages: list[str]
    dense: np.ndarray
    levels: list[Level] = field(default_factory=list)
    usual: np.ndarray | None = None

    def size(self) -> int:
        parts = (x for v in self.levels for x in (v.entries.keys, v.entries.place, v.bits, v.nodes.keys, v.nodes.place, v.escape))
        return self.dense.nbytes + sum(x.nbytes for x in parts)

    def prices(self, code: np.ndarray) -> np.ndarray:
        """The code length of each byte (rows) in each language; code as ``codes`` gives it."""
        out = np.zeros((len(code), len(self.languages)), np.float32)
        open_ = np.arange(len(code))
        for order in range(len(self.levels) + 1, 1, -1):
            level = self.levels[order - 2]
            own = _lowest(code[open_], order + 1)
            at = level.entries.of(own)
            hit = at >= 0
            out[open_[hit]] += level.bits[at[hit]]
            open_, own = open_[~hit], own[~hit]
            at = level.nodes.of(own >> np.uint64(WIDTH))
            hit = at >= 0
            out[open_[hit]] += level.escape[at[hit]]
        out[open_] += self.dense[_pairs(code[open_])]
        return out

    def lengths(self, data: list[bytes]) -> np.ndarray:
        """Code length in bits of each text (rows) in each language (columns).

        Texts up to CHUNK bytes are priced some at a time, a longer one by itself in
        chunks, so that memory does not grow with a text and equal texts give equal sums.
        """
        order = len(self.levels) + 1
        out = np.zeros((len(data), len(self.languages)))
        first = size = 0
        for i, d in enumerate(data):
            if size + len(d) > CHUNK:
                out[first:i] = self._sums(data[first:i], order)
                first, size = i, 0
            if len(d) > CHUNK:
                for at in range(0, len(d), CHUNK):
                    back = min(at, order)
                    out[i] += self.prices(codes([d[at - back : at + CHUNK]], order)[0][back:]).sum(0, dtype=np.float64)
                first = i + 1
            else:
                size += len(d)
        out[first:] = self._sums(data[first:], order)
        return out

    def _sums(self, data: list[bytes], order: int) -> np.ndarray:
        out = np.zeros((len(data), len(self.languages)))
        code, sizes = codes(data, order)
        full = np.flatnonzero(sizes)
        if len(full):
            out[full] = np.add.reduceat(self.prices(code), (np.cumsum(sizes) - sizes)[full], axis=0, dtype=np.float64)
        return out

    def measured(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, margin to the next one and code length in bits a byte) of each text; eight bits a byte is always a next one."""
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        bits, sizes = self.lengths(data), np.array([max(1, len(d)) for d in data])
        best = bits.argmin(1)
        rows = np.arange(len(data))
        own = bits[rows, best].copy()
        bits[rows, best] = np.inf
        return best, np.maximum(0, np.minimum(bits.min(1), 8 * sizes) - own) / (sizes + FEW), own / sizes

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        real = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if real and self.languages:
            best, margin, length = self.measured([texts[i] for i in real])
            usual_margin, usual_length = self.usual[best].T
            clear = np.minimum(1, margin / usual_margin)
            fits = np.clip((8 - length) / (8 - usual_length), 0, 1)
            for i, k, p in zip(real, best.tolist(), (clear * fits).tolist(), strict=True):
                names[i], scores[i] = self.languages[k], p
        return names, scores


def _lowest(code: np.ndarray, symbols: int) -> np.ndarray:
    return code & np.uint64((1 << WIDTH * symbols) - 1)


def _pairs(code: np.ndarray) -> np.ndarray:
    low = _lowest(code, 2).astype(np.int64)
    return (low >> WIDTH) * 256 + (low & 511)


def codes(data: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(of each byte of all texts itself and the order symbols before it, the byte in the lowest bits; the texts' sizes)."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    s = np.full(int((sizes + order).sum()), START, np.uint64)
    own = np.ones(len(s), bool)
    own[((np.cumsum(sizes + order) - sizes - order)[:, None] + np.arange(order)).ravel()] = False
    s[own] = np.frombuffer(b"".join(data), np.uint8)
    at = np.flatnonzero(own)
    code = s[at]
    for k in range(1, order + 1):
        code |= s[at - k] << np.uint64(WIDTH * k)
    return code, sizes


def _mixed(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities in contexts with these counts (rows) over those of their shorter contexts."""
    total, kinds = counts.sum(-1, keepdims=True), (counts > 0).sum(-1, keepdims=True)
    rest = np.where(counts > 0, 0, shorter)
    left = rest.sum(-1, keepdims=True)
    escape = np.where(total > 0, np.where(kinds < 256, kinds / np.maximum(total + kinds, 1), 0.0), 1.0)
    return counts / np.maximum(total, 1) * (1 - escape) + escape * rest / np.maximum(left, 1e-300)


def _level(seen: list[np.ndarray], order: int, least: int, below) -> tuple[np.ndarray, np.ndarray, Level]:
    """(keys of the entries, their bits, level) of one order; below: code lengths of entries of the next shorter one."""
    counted = [np.unique(_lowest(c, order + 1), return_counts=True) for c in seen]
    kept = np.zeros(0, np.uint64)
    for key, n in counted:
        context, at = np.unique(key >> np.uint64(WIDTH), return_inverse=True)
        kept = np.union1d(kept, context[np.bincount(at, n, len(context)) >= least])
    inside = [np.isin(key >> np.uint64(WIDTH), kept) for key, _ in counted]
    counted = [(key[m], n[m]) for (key, n), m in zip(counted, inside, strict=True)]
    keys = np.unique(np.concatenate([key for key, _ in counted]))
    node = np.searchsorted(kept, keys >> np.uint64(WIDTH))
    shorter = below(_lowest(keys, order)).astype(float)
    bits, escape = np.zeros((len(keys), len(seen))), np.zeros((len(kept), len(seen)))
    for j, (key, n) in enumerate(counted):
        at = np.searchsorted(keys, key)
        own = node[at]
        total, kinds = np.bincount(own, n, len(kept)), np.bincount(own, minlength=len(kept))
        # What the shorter context leaves for bytes that this one has not seen.
        left = np.maximum(1 - np.bincount(own, np.exp2(-shorter[at, j]), len(kept)), 1e-12)
        share = np.where(kinds < 256, kinds / np.maximum(total + kinds, 1), 0)
        has = total > 0
        escape[has, j] = np.log2(left[has]) - np.log2(np.maximum(share[has], 1e-300))
        bits[:, j] = escape[node, j] + shorter[:, j]
        bits[at, j] = -np.log2(n / total[own] * (1 - share[own]))
    bits = bits.astype(np.float32)
    return keys, bits, Level(Places(keys), bits, Places(kept), escape.astype(np.float32))


def fit(samples: dict[str, list[str]], order: int = ORDER, most_bytes: int = MODEL_BYTES) -> Model:
    """samples: the training texts of each language. What is usual comes from each half of them by a model of the other."""
    model = _fitted(samples, order, most_bytes)
    model.usual = np.tile([4.0, 3.0], (len(model.languages), 1))
    halves = [{k: [t for t in texts if t][h::2] for k, texts in samples.items()} for h in (0, 1)]
    found: dict[int, list] = {}
    for mine, others in (halves, halves[::-1]):
        half = _fitted(mine, order, most_bytes)
        for j, k in enumerate(half.languages):
            if others[k]:
                best, margin, length = half.measured(others[k])
                found.setdefault(j, []).append(np.stack([margin, length], 1)[best == j])
    for j, parts in found.items():
        if sum(map(len, parts)):
            model.usual[j] = np.maximum(np.median(np.concatenate(parts), axis=0), [0.05, 0])
    model.usual[:, 1] = np.minimum(model.usual[:, 1], 7)
    return model


def fitted(docs: DataFrame, *most: int):
    """The model of a sample of docs (doc_id, text, lang), as a broadcast variable.

    Training frees about as much as the driver's Python holds besides; the C library keeps that unless told, for as long as the driver lives.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(docs.select("doc_id", "text", "lang"), *most)))
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
    return model


def _fitted(samples: dict[str, list[str]], order: int, most_bytes: int) -> Model:
    languages = sorted(samples)
    if not languages:
        return Model([], np.zeros((257 * 256, 0), np.float32))
    seen = [codes([t.encode("utf-8", "surrogatepass") for t in samples[k] if t], order)[0] for k in languages]
    zero = np.stack([np.bincount(_lowest(c, 1).astype(np.int64), minlength=256) for c in seen])
    one = np.stack([np.bincount(_pairs(c), minlength=257 * 256).reshape(257, 256) for c in seen])
    dense = -np.log2(_mixed(one, _mixed(zero, np.full(256, 1 / 256))[:, None])).reshape(len(languages), -1).T.astype(np.float32)
    least = LEAST_SEEN
    while True:
        model = Model(languages, dense)
        below = lambda key: dense[_pairs(key)]
        for k in range(2, order + 1):
            keys, bits, level = _level(seen, k, least, below)
            model.levels.append(level)
            below = lambda key, keys=keys, bits=bits: bits[np.searchsorted(keys, key)]
        if model.size() <= most_bytes or not any(len(v.escape) for v in model.levels):
            return model
        least *= 2


def sample(docs: DataFrame, most_docs: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES, most_languages: int = MOST_LANGUAGES) -> dict[str, list[str]]:
    """The training texts of each language; at most most_docs different ones, and no more than most_bytes."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select("lang", F.xxhash64("text").alias("h"), F.octet_length("text").alias("size"), "text")
    pairs = rows.filter(F.col("size") <= most_bytes).select("lang", "h", "size").distinct()
    counts = {r["lang"]: r["count"] for r in pairs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    if not counts:
        return {}
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("h"))
    first = drawn(pairs, "lang", most_docs, counts).withColumn("sum", before).filter(F.col("sum") <= min(most_bytes, max(TOTAL_BYTES // len(counts), 1)))
    # most_docs rows for each language; equal texts of a language are one row after the aggregate.
    chosen = rows.join(F.broadcast(first.select("lang", "h")), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    found: dict[str, list[str]] = {}
    for r in sorted(chosen.select("lang", "text").collect(), key=lambda r: (r["lang"], r["text"])):
        found.setdefault(r["lang"], []).append(r["text"])
    return found


def identified(docs: DataFrame, most_docs: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs (doc_id, text, lang)."""
    model = fitted(docs, most_docs, most_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in text_slices(batch.column("text"), 1 << 20):
                names, scores = model.value.judge(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], batch.column("held_out")[i:j], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs, with all columns, whose text has a language with a score of at least least."""
    model = fitted(docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in text_slices(batch.column(at), 1 << 20):
                names, scores = model.value.judge(texts)
                yield batch.slice(i, j - i).filter(pa.array([n != UNKNOWN and p >= least for n, p in zip(names, scores, strict=True)], pa.bool_()))
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)
