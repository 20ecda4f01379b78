"""Quality by the votes of labelled neighbours in a latent semantic space.

A text's features are its trigrams: of character classes (letters, capitals, digits,
kinds of marks and blanks), which tell its style in any language, and of lower-cased
bytes, hashed, which tell its words; and how many words repeat the one before, times
their share, as REPEATS equal features. Counts are damped by a logarithm, weighted by
inverse document frequency over all documents and scaled to length one; the leading
singular vectors of the labelled texts make the latent space. The labelled vectors
are broadcast, and blocks of documents are multiplied with all of them, exactly:
the NEIGHBOURS nearest by cosine, and all that tie with the last of them, vote for
their labels by similarity, to the power of SHARPNESS, and by how many labelled
texts each stands for. The share of label 1 among all labels votes too, with weight
PRIOR, so that a text without neighbours has that share as its score.

Training takes a bounded sample, a documented parameter: of each label the MOST
different texts with the smallest hashes, among the labels of documents that may be
learned from. Their features, not their texts, reach the driver, some KB each; the
broadcast vectors take MOST * 2 * DIMENSIONS floats. Document frequencies come from
all documents.

Defined cases: a null text counts as empty and has the share of label 1 as its
score, as has a text of up to two bytes; without labels all scores are 0.5; labels
other than 0 and 1 and null ones are ignored, a document with both labels votes for
both; equal texts of one label train once; rows that repeat and a null doc_id are
scored as they come (a null doc_id is not held out and never trains); an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import drawn, held_out, text_slices, texts_of

MOST = 2000
NEIGHBOURS = 25
DIMENSIONS = 32
SHARPNESS = 4
PRIOR = 0.01
ACCEPTED = 0.7
#: Classes of bytes: letters, capitals, digits, blanks, line ends, and marks in groups; bytes of other letters are letters.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", "|", "#*", "$%&", "-_=+~", "()[]{}<>", "\"'`", ":;@/\\^"]
STYLES, WORDS, REPEATS = 4096, 2048, 16
WIDTH = STYLES + WORDS + REPEATS
#: Bytes and texts that are counted at one time.
CHUNK = 1 << 19
TEXTS = 512

_CLASS = np.zeros(256, np.int32)
_CLASS[:128] = len(CLASSES)
for _k, _own in enumerate(CLASSES):
    _CLASS[list(_own.encode())] = _k
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def counts_of(texts: list[str]) -> np.ndarray:
    """Counts of the features of each text, a row each."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(p) for p in parts])
    data, owner = np.frombuffer(b"".join(parts), np.uint8), np.repeat(np.arange(len(parts), dtype=np.int64), sizes)
    out = np.zeros((len(texts), WIDTH), np.float32)
    for k in range(0, len(data) - 2, CHUNK):
        own, at = data[k : k + CHUNK + 2], owner[k : k + CHUNK + 2]
        style, low = _CLASS[own], _LOWER[own]
        style = style[:-2] * 256 + style[1:-1] * 16 + style[2:]
        word = ((low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 11)
        first, last = at[0], at[-1] + 1
        row, size = (at[:-2] - first) * WIDTH, (last - first) * WIDTH
        across = np.flatnonzero(at[:-2] != at[2:])
        for code in (row + style, row + STYLES + word):
            code[across] = size
            out[first:last] += np.bincount(code, minlength=size + 1)[:size].reshape(-1, WIDTH)
    out[:, -REPEATS:] = np.array([repeats(t) for t in texts])[:, None]
    return out


def repeats(text: str) -> float:
    words = text.split()
    n = sum(map(eq, words, words[1:]))
    return n * n / len(words) if n else 0.0


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, last, counts) of runs of a string column."""
    for i, j, texts in text_slices(column, CHUNK):
        for k in range(0, len(texts), TEXTS):
            yield i + k, min(j, i + k + TEXTS), counts_of(texts[k : k + TEXTS])


@dataclass
class Model:
    """Weights of features, the latent axes, and the labelled vectors with their labels and weights."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        x = scaled(np.log1p(counts) * self.idf)
        return scaled(x @ self.axes)

    def score(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        near = self.embed(counts) @ self.vectors.T
        if not near.shape[1]:
            return np.full(len(near), self.prior)
        k = min(neighbours, near.shape[1])
        least = np.partition(near, -k, axis=1)[:, -k:].min(1, keepdims=True)
        vote = np.where(near >= least, np.maximum(near, 0) ** SHARPNESS, 0) * self.weights
        return np.clip((vote @ self.labels + PRIOR * self.prior) / (vote.sum(1) + PRIOR), 0, 1).astype(np.float64)


def scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def latent_axes(x: np.ndarray, dimensions: int = DIMENSIONS, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    width = min(dimensions + 16, *x.shape)
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((x.shape[1], width)).astype(np.float32))[0]
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T[:, : min(dimensions, width)]).astype(np.float32)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """How many documents there are and how many hold each feature, over all of docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(WIDTH + 1, np.int64)
        for batch in batches:
            for i, j, counts in blocks(batch.column(0)):
                held[:-1] += (counts > 0).sum(0)
                held[-1] += j - i
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["held"])

    rows = docs.select("text").mapInArrow(run, "held binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    held = rows.treeReduce(np.add) if rows.getNumPartitions() else np.zeros(WIDTH + 1, np.int64)
    return int(held[-1]), held[:-1]


def sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int = MOST) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Feature counts and labels of a bounded sample, and how many documents have each label, among those that train."""
    may = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    said = labels.filter(may & F.col(label_col).isin(0, 1)).select("doc_id", F.col(label_col).cast("int").alias("label")).distinct()
    said = said.join(docs.filter(may).select("doc_id").distinct(), "doc_id")  # unique on both sides
    said = said.withColumn("h", F.xxhash64("doc_id"))
    total = {r["label"]: r["count"] for r in said.groupBy("label").count().collect()}
    if not total:
        return np.zeros((0, WIDTH), np.float32), np.zeros(0), {}
    some = F.broadcast(drawn(said, "label", 2 * most, total).select("doc_id", "label"))
    texts = docs.filter(may).join(some, "doc_id").select("label", F.xxhash64("text").alias("h"), "text")
    chosen = drawn(texts.select("label", "h").distinct(), "label", most)
    texts = texts.join(F.broadcast(chosen.select("label", "h")), ["label", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, counts in blocks(batch.column(2)):
                sparse = [np.flatnonzero(c) for c in counts]
                packed = [s.astype("<u2").tobytes() + c[s].astype("<f4").tobytes() for s, c in zip(sparse, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(packed, pa.binary())], ["label", "h", "features"])

    # Equal texts have equal features; partial aggregates leave one.
    rows = texts.mapInArrow(run, "label int, h long, features binary").groupBy("label", "h").agg(F.min("features").alias("features")).collect()
    rows.sort(key=lambda r: (r["label"], r["h"]))
    x = np.zeros((len(rows), WIDTH), np.float32)
    for own, r in zip(x, rows, strict=True):
        n = len(r["features"]) // 6
        own[np.frombuffer(r["features"], "<u2", n)] = np.frombuffer(r["features"], "<f4", n, 2 * n)
    return x, np.array([r["label"] for r in rows], np.float32), total


def fitted(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = MOST) -> Model:
    docs = texts_of(docs)
    counts, y, total = sample(docs, labels, label_col, most)
    n, held = document_frequencies(docs) if len(y) else (0, np.zeros(WIDTH))
    idf = np.log((1 + n) / (1 + held)).astype(np.float32) + 1
    x = scaled(np.log1p(counts) * idf)
    axes = latent_axes(x) if len(y) else np.zeros((WIDTH, 0), np.float32)
    # Each sampled text stands for its label's share of all labelled documents.
    per = {k: total[k] / max(1, int((y == k).sum())) for k in total}
    mean = sum(total.values()) / max(1, len(y))
    weights = np.array([per[int(k)] / mean for k in y], np.float32)
    return Model(idf, axes, scaled(x @ axes) if len(y) else np.zeros((0, 0), np.float32), y, weights, total.get(1, 0) / sum(total.values()) if total else 0.5)


def scored(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = MOST) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text), learned from labels (doc_id, label_col)."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, label_col, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, counts in blocks(batch.column(2)):
                score = model.value.score(counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(1)[i:j], pa.array(score), pa.array((score >= ACCEPTED).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts_of(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
