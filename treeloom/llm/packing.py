"""Packing of documents' tokens into sequences of a fixed length.

Documents are dealt at random to partitions and put in a fixed order there, so
that each run of GROUP documents of a partition is a randomised group. A group's
documents are encoded (``bpe``), closed with an end id and cut into pieces of at
most one sequence; first-fit decreasing runs on the group alone, finding the
first bin with room in a tournament tree of the bins' capacities. Texts are
shuffled once, ids never.

Whole pieces fill a sequence of their own and leave at once; of each document at
most one shorter piece waits for its group, so a task holds GROUP such pieces. A
group leaves one sequence or two unfilled; with thousands of documents to a
group, that is the padding.

Defined cases: a null or empty text is the end id alone; a text beyond one
sequence gives several pieces; rows that repeat are packed each; ids of any type
and size pass through unchanged, nulls included, and no row's place depends on
its id; ties in size go by the order of the deal; an empty table gives an empty
result; further columns are ignored. docs must give the same rows in the same
order when a lost task runs again, as tables and checkpoints do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm import bpe
from treeloom.llm.common import text_slices, texts_of

LENGTH = 4096
END = 2
#: Documents to a group.
GROUP = 4096
#: Bytes of text that are split into words at one time.
SLICE = 1 << 20


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; sizes are placed from large to small, equal ones in their given order.

    A node of the tournament tree holds the largest room below it, so a descent
    to the left wherever that suffices ends at the first bin with room.
    """
    n = len(sizes)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-sizes, kind="stable")
    whole = int((sizes == capacity).sum())
    bins[order[:whole]] = np.arange(whole)
    rest = order[whole:].tolist()
    leaves = 1 << max(0, (len(rest) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    for i in rest:
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], offsets[i] = whole + node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


class _Pieces:
    """Pieces in the order they came in; ids as little-endian unsigned 32-bit numbers."""

    def __init__(self):
        self.doc_ids, self.start, self.doc_tokens, self.ids = [], [], [], []

    def add(self, doc_ids: pa.Array, rows: list[tuple[int, int, int, bytes]]) -> None:
        """rows: (place in doc_ids, start, tokens of the document, ids)."""
        if rows:
            at, start, tokens, ids = zip(*rows, strict=True)
            self.doc_ids.append(doc_ids.take(pa.array(at, pa.int64())))
            self.start += start
            self.doc_tokens += tokens
            self.ids += ids

    def sizes(self) -> np.ndarray:
        return np.fromiter(map(len, self.ids), np.int64, len(self.ids)) // 4


Placed = tuple[_Pieces, np.ndarray, np.ndarray]


def _placed(batches: Iterator[pa.RecordBatch], path: str, length: int, end: int, group: int) -> Iterator[Placed]:
    """(pieces, sequence_id, offset): whole pieces as they come, the others group by group."""
    words_of = bpe.WordTable(own := bpe.loaded(path), bpe.id_bytes)
    close = np.array([end], "<u4").tobytes()
    free = TaskContext.get().partitionId() << 32
    waiting, held = _Pieces(), 0
    for batch in batches:
        doc_ids = batch.column("doc_id")
        for i, _, texts in text_slices(batch.column("text"), SLICE):
            docs = [own.split(t) for t in texts]
            known = words_of.of(docs)
            whole, short = [], []
            for k, words in enumerate(docs, i):
                ids = b"".join([*[known[w] for w in words], close])
                n = len(ids) // 4
                full = n // length * length
                whole += [(k, s, n, ids[4 * s : 4 * (s + length)]) for s in range(0, full, length)]
                if full < n:
                    short.append((k, full, n, ids[4 * full :]))
            if whole:
                out = _Pieces()
                out.add(doc_ids, whole)
                yield out, free + np.arange(len(whole)), np.zeros(len(whole), np.int64)
                free += len(whole)
            waiting.add(doc_ids, short)
            held += len(texts)
            if held >= group:
                bins, offsets = first_fit_decreasing(waiting.sizes(), length)
                yield waiting, free + bins, offsets
                free += int(bins.max(initial=-1)) + 1
                waiting, held = _Pieces(), 0
    if waiting.ids:
        bins, offsets = first_fit_decreasing(waiting.sizes(), length)
        yield waiting, free + bins, offsets


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) in random partitions, in a fixed order there; by the rows' places, so that neither ids nor texts that repeat meet."""
    deal = F.xxhash64(F.monotonically_increasing_id(), F.lit(17))
    return texts_of(docs, id_col, text_col).withColumn("deal", deal).repartition("deal").sortWithinPartitions("deal").select("doc_id", "text")


def packed(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32 bits each), doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces, sequence, offset in _placed(batches, path, length, end, group):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays(pieces.doc_ids), pa.array(pieces.start, pa.int64()), pa.array(pieces.sizes()), pa.array(pieces.ids, pa.binary()),
                    pa.array(pieces.doc_tokens, pa.int64()), pa.array(sequence), pa.array(offset),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            pa.default_memory_pool().release_unused()

    kind = docs.schema[id_col].dataType.simpleString()
    return _dealt(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, group: int = GROUP, pad: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sequence of ``packed``: sequence_id, n_tokens, ids (array<int> of length ids, filled with pad)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces, sequence, offset in _placed(batches, path, length, end, group):
            order = np.lexsort((offset, sequence))
            names, first = np.unique(sequence[order], return_index=True)
            sizes = np.add.reduceat(pieces.sizes()[order], first)
            ids = np.full((len(names), length), pad, np.int32)
            ids[np.arange(length) < sizes[:, None]] = np.frombuffer(b"".join([pieces.ids[k] for k in order]), "<u4")
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1) * length, pa.int32()), pa.array(ids.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes), rows], ["sequence_id", "n_tokens", "ids"])

    return _dealt(docs, id_col, text_col).mapInArrow(run, "sequence_id long, n_tokens long, ids array<int>")


def digests(rows: DataFrame) -> DataFrame:
    """rows of ``packed`` with the ids' crc32 in place of the ids."""
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
