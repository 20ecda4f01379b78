"""Whitening of embeddings by pairwise merged covariance.

An entry c becomes the whole number x = floor(1024 * c) + 100000. Each partition
computes, in one pass over Arrow batches, the count, the exact sums, the mean and
the scatter around its own mean; ``treeReduce`` merges two such states by the
pairwise formula of Chan, so that nothing is ever squared before it is centred and
no state is larger than one matrix. The eigenvectors are found on the driver. A
second pass merges the covariance of the whitened vectors the same way and compares
it with the identity; the third one returns the rows. Nothing is shuffled but the
states.

Defined cases: a null vector, and one with a null, infinite or NaN entry, is
dropped. Vectors of each other length are a fit list of their own, so that none is
lost; an empty vector has no component and no row. Vectors that repeat and a null
vec_id count as they come. Entries beyond 2^52 count as 2^52, so that x is exact.
A component whose eigenvalue is no more than TINY times the largest one has no
variance to divide by: its whitened values are 0 and the identity leaves it out;
explained is 0 where there is no variance at all. A deviation that no long holds is
null (``exact_deviation``, a decimal, has it up to 38 digits). Equal eigenvalues
share their space in any way; a vector's sign makes its largest entry positive. An
empty table gives an empty result, further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

COMPONENTS = 8
#: Rows that are centred and multiplied at one time.
ROWS = 4096
TINY = 1e-13
_MOST = 2**63 - 1


@dataclass
class State:
    """Count, exact sums, mean and scatter around the mean, of vectors of one length."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray


def state_of(rows: np.ndarray, sums: list[int] | None = None) -> State:
    mean = rows.mean(0)
    centred = rows - mean
    return State(len(rows), sums or [], mean, centred.T @ centred)


def merged(a: State, b: State) -> State:
    """Chan's pairwise formula."""
    n, gap = a.n + b.n, b.mean - a.mean
    return State(n, [x + y for x, y in zip(a.sums, b.sums, strict=True)], a.mean + gap * (b.n / n), a.scatter + b.scatter + np.outer(gap, gap) * (a.n * (b.n / n)))


def merge_all(a: dict[int, State], b: dict[int, State]) -> dict[int, State]:
    """States by vector length."""
    return a | {k: merged(a[k], s) if k in a else s for k, s in b.items()}


def whole_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows' numbers, their vectors as doubles), by length and ROWS at most; nulls and vectors with other entries are left out."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    values = pc.list_flatten(column)
    values = pc.fill_null(pc.cast(values, pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(sizes, 0))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (sizes > 0) & (bad[ends] == bad[ends - np.maximum(sizes, 0)])
    for size in np.unique(sizes[good]):
        at = np.flatnonzero(good & (sizes == size))
        for k in range(0, len(at), ROWS):
            own = at[k : k + ROWS]
            yield own, values[(ends[own] - size)[:, None] + np.arange(size)]


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(1024 * np.clip(vectors, -(2.0**52), 2.0**52)).astype(np.int64) + 100000


def _sums(x: np.ndarray) -> list[int]:
    """Exact sums of each column: both halves of 32 bits on their own."""
    return [(int(high) << 32) + int(low) for high, low in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), strict=True)]


def total(vectors: DataFrame, vec_col: str, each) -> dict[int, State]:
    """States of all partitions, merged in a tree; each turns the vectors of one length into a state."""

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        found: dict[int, State] = {}
        for batch in batches:
            for _, own in whole_vectors(batch.column(0)):
                found = merge_all(found, {own.shape[1]: each(own)})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["state"])

    import pickle

    rows = vectors.select(vec_col).mapInArrow(states, "state binary").rdd.map(lambda r: pickle.loads(r[0]))
    return rows.treeReduce(merge_all) if rows.getNumPartitions() else {}


@dataclass
class Whitener:
    """n, exact sums S, and the leading components with their eigenvalues."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    error: float = 0.0

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S exactly (longs, or whole numbers of any size where longs may not do), and x - S/n."""
        far = max(1, int(np.abs(x).max(initial=0)))
        wide = self.n * far + max(map(abs, self.sums)) > _MOST
        exact = (x.astype(object) * self.n if wide else x * self.n) - np.array(self.sums, object if wide else np.int64)
        return exact, (exact / self.n).astype(np.float64)

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        some = self.values > TINY * max(self.values[0], 0)
        return np.where(some, centred @ self.vectors / np.sqrt(np.where(some, self.values, 1)), 0.0)

    def deviations(self, exact: np.ndarray) -> list[int]:
        far = int(np.abs(exact).max(initial=0))
        if far * far * exact.shape[1] <= _MOST:
            return (exact.astype(np.int64) ** 2).sum(1).tolist()
        return [int(v) for v in (exact.astype(object) ** 2).sum(1)]


def solved(state: State, components: int = COMPONENTS) -> Whitener:
    values, vectors = np.linalg.eigh(state.scatter / state.n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return Whitener(state.n, state.sums, vectors, values, float(np.trace(state.scatter)) / state.n)


def fitted(vectors: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> dict[int, Whitener]:
    """The whitener of each vector length, with the largest error of the whitened covariance against the identity."""
    found = {k: solved(s, components) for k, s in total(vectors, vec_col, _counted).items()}
    if not found:
        return {}
    shared = vectors.sparkSession.sparkContext.broadcast(found)

    def white(own: np.ndarray) -> State:
        by = shared.value[own.shape[1]]
        return state_of(by.whiten(by.centred(whole_numbers(own))[1]))

    for k, s in total(vectors, vec_col, white).items():
        some = found[k].values > TINY * max(found[k].values[0], 0)
        found[k].error = float(np.abs((s.scatter / s.n - np.eye(len(some)))[some][:, some]).max(initial=0))
    return found


def _counted(own: np.ndarray) -> State:
    x = whole_numbers(own)
    return state_of(x.astype(np.float64), _sums(x))


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, exact_deviation of each vector that stays and each component."""
    own = vectors.select(id_col, vec_col)
    shared = vectors.sparkSession.sparkContext.broadcast(fitted(own, vec_col, components))
    wide = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in whole_vectors(batch.column(1)):
                by = shared.value[part.shape[1]]
                exact, centred = by.centred(whole_numbers(part))
                white, m = by.whiten(centred), len(by.values)
                deviation = by.deviations(exact)
                rows = np.repeat(np.arange(len(at)), m)
                share = np.tile(by.values / by.trace if by.trace > 0 else np.zeros(m), len(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at[rows])), pa.array(np.tile(np.arange(1, m + 1), len(at)), pa.int32()), pa.array(np.full(len(rows), by.n), pa.int64()),
                        pa.array([d if d <= _MOST else None for d in deviation], pa.int64()).take(pa.array(rows)), pa.array(white.ravel()), pa.array(share),
                        pa.array(np.full(len(rows), by.error)), pa.array([d if d < 10**38 else None for d in deviation], wide).take(pa.array(rows)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "exact_deviation"],
                )

    kind = vectors.schema[id_col].dataType.simpleString()
    return own.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, exact_deviation decimal(38,0)")
