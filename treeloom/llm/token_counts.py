"""Token counts of documents' parts, by offset-mapped attribution.

A document is encoded once, as a whole. A byte-level token's character span
follows from the running sum of the tokens' byte lengths. The spans are joined to
the parts' intervals by binary search in both ends, within the document's own row,
so nothing is shuffled. A token that crosses a border is allocated by a rule:

first  to the part that holds its first character (default)
last   to the part that holds its last character
most   to the part that holds most of its characters, the earliest of equals
split  to each part by its share of the token's characters

Characters outside all parts count towards part -1. A token that is a part of a
character covers that character.

Defined cases: a null or empty text has one empty part with no tokens; parts
that are empty have no tokens; rows that repeat and a null doc_id are counted as
they come; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from treeloom.llm.common import text_slices, texts_of

RULES = ("first", "last", "most", "split")


def line_spans(text: str) -> list[tuple[int, int]]:
    """Lines with their ends, so that they cover the text."""
    out, at = [], 0
    while (end := text.find("\n", at) + 1) > 0:
        out.append((at, end))
        at = end
    return [*out, (at, len(text))] if at < len(text) or not out else out


#: A run of white space from which on the other encoder is used: the first one's time grows with the square of a run, and its
#: expression engine gives up on very long ones. Both give the same ids; at this length they take about the same time.
LONG_BLANK = 300
_LONG_BLANK = re.compile(rf"\s{{{LONG_BLANK}}}")


class ByteBpe:
    """path: the vocabulary as ranks; library_path: the same one for the tokenizers library, which takes any text."""

    def __init__(self, path: str, library_path: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(library_path or public_tokenizers.path("byte_bpe_50k.json"))
        self.library.encode_special_tokens = True

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)

    def ids(self, text: str) -> list[int]:
        if _LONG_BLANK.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.encoding.encode_ordinary(text)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last character of each token."""
        ids = np.array(self.ids(text), np.int64)
        ends = np.cumsum(self.sizes[ids])
        starts = ends - self.sizes[ids]
        if len(ends) and ends[-1] != len(text):
            data = np.frombuffer(text.encode("utf-8"), np.uint8)
            char = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
            starts, ends = char[starts], char[ends - 1] + 1
        return starts, ends


_loaded: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def allocate(starts: np.ndarray, ends: np.ndarray, parts: np.ndarray, rule: str = "first") -> tuple[np.ndarray, int, np.ndarray]:
    """(tokens of each part, as fractions if split; tokens outside; tokens of each part that cross its border).

    parts: rows (start, end), sorted and disjoint.
    """
    n = len(parts)
    count, cross = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    full = np.flatnonzero(parts[:, 1] > parts[:, 0])
    if not len(full) or not len(starts):
        count[n] = len(starts)
        return count[:n], count[n], cross[:n]
    begin, stop = parts[full, 0], parts[full, 1]
    # Parts lo..hi-1 (among those that aren't empty) meet the token.
    lo, hi = np.searchsorted(stop, starts, "right"), np.searchsorted(begin, ends, "left")

    def holding(at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(begin, at, "right") - 1
        return np.where((k >= 0) & (at < stop[np.maximum(k, 0)]), full[np.maximum(k, 0)], n)

    inside = (hi - lo == 1) & (starts >= begin[np.minimum(lo, len(full) - 1)]) & (ends <= stop[np.minimum(lo, len(full) - 1)])
    np.add.at(count, full[lo[inside]], 1)
    odd = np.flatnonzero(~inside)
    for t in odd if rule in ("most", "split") else ():
        over = [(max(0, min(ends[t], stop[k]) - max(starts[t], begin[k])), k) for k in range(lo[t], hi[t])]
        free = ends[t] - starts[t] - sum(x for x, _ in over)
        if rule == "split":
            for x, k in over:
                count[full[k]] += x / (ends[t] - starts[t])
            count[n] += free / (ends[t] - starts[t])
        else:
            best, k = max(over, key=lambda x: (x[0], -x[1]), default=(0, 0))
            count[full[k] if best and best >= free else n] += 1
    if rule in ("first", "last"):
        np.add.at(count, holding(starts[odd] if rule == "first" else ends[odd] - 1), 1)
    for t in odd:
        cross[full[lo[t] : hi[t]]] += 1
    return count[:n], count[n], cross[:n]


def part_counts(
    docs: DataFrame, path: str, rule: str = "first", spans: Callable[[str], list[tuple[int, int]]] = line_spans, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per part: doc_id, part, start, end, tokens (double), crossing, doc_tokens; part -1 only where tokens lie outside."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for i, _, texts in text_slices(batch.column("text")):
                cols = [[] for _ in range(7)]
                for k, text in enumerate(texts, i):
                    starts, ends = bpe.spans(text)
                    parts = np.array(spans(text), np.int64).reshape(-1, 2)
                    count, outside, cross = allocate(starts, ends, parts, rule)
                    found = [np.arange(len(parts)), parts[:, 0], parts[:, 1], count, cross]
                    if outside:
                        found = [np.append(x, y) for x, y in zip(found, (-1, -1, -1, outside, 0), strict=True)]
                    m = len(found[0])
                    for c, x in zip(cols, [np.full(m, k), *found, np.full(m, len(starts))], strict=True):
                        c.append(x)
                at, part, start, end, count, cross, total = map(np.concatenate, cols)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(at)), *(pa.array(x, pa.int64()) for x in (part, start, end)), pa.array(count, pa.float64()), pa.array(cross, pa.int64()), pa.array(total, pa.int64())],
                    ["doc_id", "part", "start", "end", "tokens", "crossing", "doc_tokens"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, part long, start long, end long, tokens double, crossing long, doc_tokens long"
    return texts_of(docs, id_col, text_col).mapInArrow(run, schema)
