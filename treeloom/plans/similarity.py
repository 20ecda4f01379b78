"""Similarity of two nodes of one pair, for the steps that are sequential within a pair.

The same formulas as ``functions.similarity``, which has them for whole tables.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

from treeloom.functions.similarity import CONTAINER, HEADING_FULL, HEADING_LEAF, PARAGRAPH
from treeloom.plans.document import Node, grams
from treeloom.plans.kernels import bit_masks

#: From so many tokens on sets are compared by minimum hashes; and how many.
MINHASH_FROM, MINHASHES = 256, 64
#: Characters up to which code is compared by character, else by line.
CODE_CHARS = 5000

# Recall by signatures, and the scores of the structural fallback.
RECALL_DISTANCE, RECALL_BONUS = 24, 0.05
PATH_BONUS, RANGE_BONUS = 0.1, 0.05
FALLBACK_BASE, FALLBACK_SHAPE, FALLBACK_PATH, FALLBACK_RANGE, FALLBACK_SAME = 0.35, 0.3, 0.15, 0.1, 0.2
OTHER_PATH, LINES_APART, NO_RANGE = 0.7, 10, 0.7


def levenshtein(a, b) -> int:
    """Edit distance, by rows of bits: one step an element of a, over whole numbers of len(b) bits."""
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[head:], b[head:]
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    mask = bit_masks(a, b)
    full, last, distance = (1 << len(b)) - 1, len(b) - 1, len(b)
    more, less = full, 0
    for x in a:
        equal = mask(x)
        zero = (((equal & more) + more) ^ more) | equal | less
        up, down = less | (full & ~(zero | more)), more & zero
        distance += (up >> last & 1) - (down >> last & 1)
        up = up << 1 | 1
        more, less = (down << 1 | ~(zero | up)) & full, up & zero & full
    return distance


def sequence(a, b) -> float:
    n = max(len(a), len(b))
    return 1 - levenshtein(a, b) / n if n else 1.0


def sets(a, b) -> float:
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def multisets(a: Counter, b: Counter) -> float:
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 1.0


def sketch(tokens) -> np.ndarray:
    """The least of each of 64 seeded hashes of tokens, of which there is one at least."""
    found = sorted(set(tokens), key=len)
    lengths = np.array([len(t) for t in found])
    codes, starts = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(lengths) - lengths
    # The factors of the seeded hash and of the seeds. Products wrap at 32 bits.
    hashes = np.tile(np.arange(1, MINHASHES + 1, dtype=np.uint32) * np.uint32(2654435761), (len(found), 1))
    for at in range(lengths[-1]):
        first = int(np.searchsorted(lengths, at, side="right"))
        hashes[first:] = (hashes[first:] ^ codes[starts[first:] + at, None]) * np.uint32(16777619)
    return hashes.min(0)


def minhash(a, b) -> float:
    """Estimated likeness of two token sets by 64 seeded hashes; 0 if one is empty."""
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    return int((sketch(a) == sketch(b)).sum()) / MINHASHES


def tokens(a, b) -> float:
    return minhash(a, b) if max(len(a), len(b)) > MINHASH_FROM else sets(a, b)


def ratio(a: float, b: float) -> float:
    return 1.0 if not a and not b else min(a, b) / max(a, b, 1)


def content(a: Node, b: Node) -> float:
    """The best of token sets, token sequences and 3-grams; of characters if neither has a token.

    A sequence is no more alike than its elements are as multisets over the longer
    length, so the costly comparison only runs where it can raise the result.
    """
    if not a.tokens and not b.tokens:
        return sequence(a.text, b.text)
    best = max(tokens(a.tokens, b.tokens), multisets(a.grams, b.grams))
    longest = max(len(a.tokens), len(b.tokens))
    if sum((a.counts & b.counts).values()) / longest > best:
        best = max(best, sequence(a.tokens, b.tokens))
    return best


def _weighted(a: Node, b: Node, context: float, weights) -> float:
    w_text, w_structure, (base, ws, wl, wc) = weights
    structure = sequence(a.structure, b.structure)
    fallback = base + ws * structure + wl * ratio(len(a.tokens), len(b.tokens)) + wc * context if structure >= 0.5 and (a.text or b.text) else 0.0
    return max(w_text * content(a, b) + w_structure * structure, fallback)


def _table(a: Node, b: Node) -> float:
    rows, cols = max(len(a.rows), len(b.rows)), max([0, *map(len, a.rows), *map(len, b.rows)])
    cell = lambda n, i, j: n.rows[i][j][0] if i < len(n.rows) and j < len(n.rows[i]) else None
    total = 0.0
    for i in range(rows):
        for j in range(cols):
            x, y = cell(a, i, j), cell(b, i, j)
            total += 0.0 if x is None or y is None else 1.0 if x == y else sets(x.lower().split(), y.lower().split())
    shape = (ratio(len(a.rows), len(b.rows)) + ratio(max([0, *map(len, a.rows)]), max([0, *map(len, b.rows)]))) / 2
    same = [x == y for x, y in zip(a.align, b.align)]
    return 0.3 * shape + 0.5 * (total / (rows * cols) if rows * cols else 1.0) + 0.2 * (sum(same) / len(same) if same else 1.0 if not a.align and not b.align else 0.0)


def similarity(a: Node, b: Node, context: float = 1.0) -> float:
    """0 for different shapes, 1 for equal selves, else by kind."""
    if a.shape != b.shape:
        return 0.0
    if a.keys["self"] == b.keys["self"]:
        return 1.0
    if a.kind == "heading" and a.entity == "section":
        title = max(sets(words_of(a.title), words_of(b.title)), multisets(grams(a.title), grams(b.title)) if not words_of(a.title) else 0.0)
        w = HEADING_FULL if a.children and b.children else HEADING_LEAF
        return w[0] * title + w[1] * (1.0 if a.keys["body"] == b.keys["body"] else 0.5) + w[2] * (1.0 if a.heading_depth == b.heading_depth else 0.6) + w[3] * context
    if a.kind == "paragraph":
        return _weighted(a, b, context, PARAGRAPH)
    if a.kind in ("listItem", "blockquote"):
        return _weighted(a, b, context, CONTAINER)
    if a.kind == "code":
        x, y = ([line.strip() for line in (n.value or "").split("\n") if line.strip()] for n in (a, b))
        chars = sequence(a.text, b.text) if max(len(a.text), len(b.text)) <= CODE_CHARS else 0.0
        return min(1.0, max(sets(x, y), sequence(x, y), chars) + 0.1 * (a.lang == b.lang))
    if a.kind == "table":
        return _table(a, b)
    if a.kind in ("definition", "footnote"):
        if a.keys["identity"] == b.keys["identity"]:
            return 1.0
        if a.kind == "definition":
            return 0.5 * (a.url == b.url) + 0.25 * (a.link_title == b.link_title) + 0.25 * (a.identifier == b.identifier)
        return content(a, b)
    return 0.95 if a.keys["content"] == b.keys["content"] else tokens(a.tokens, b.tokens) if a.tokens or b.tokens else sequence(a.text, b.text)


def words_of(x: str) -> list[str]:
    from treeloom.plans.document import normal_title, words

    return words(normal_title(x))


def signature_distance(a: Node, b: Node) -> int | None:
    """Bits in which the signatures differ; None if one has none."""
    return None if a.sim is None or b.sim is None else (a.sim ^ b.sim).bit_count()


def recallable(a: Node, b: Node) -> bool:
    """Whether two nodes are near enough for a tree edit to pair them: an equal hash, or a near signature."""
    same = any(a.keys[h] == b.keys[h] for h in ("self", "identity", "content"))
    headings = a.kind == b.kind == "heading" and a.keys["body"] == b.keys["body"]
    if same or headings:
        return True
    distance = signature_distance(a, b)
    return distance is None or distance <= RECALL_DISTANCE


def recall_bonus(a: Node, b: Node) -> float:
    distance = signature_distance(a, b)
    return 0.0 if distance is None else max(0.0, (RECALL_DISTANCE - distance) / RECALL_DISTANCE) * RECALL_BONUS


def closeness(a: Node, b: Node) -> float:
    """By the first lines; some if one is not known."""
    return max(0.0, 1 - abs(a.line - b.line) / LINES_APART) if a.line and b.line else NO_RANGE


def same_path(a: Node, b: Node) -> bool:
    return bool(a.path) and a.path == b.path


def relabel_score(a: Node, b: Node) -> float:
    """How well b stands for a in a tree edit."""
    if a.shape != b.shape:
        return 0.0
    if a.keys["self"] == b.keys["self"]:
        return 1.0
    return min(1.0, similarity(a, b) + PATH_BONUS * same_path(a, b) + RANGE_BONUS * closeness(a, b) + recall_bonus(a, b))


def child_shapes(a: Node, b: Node) -> float:
    return multisets(Counter(c.shape for c in a.children), Counter(c.shape for c in b.children))


def fallback_score(a: Node, b: Node, context: float) -> float:
    """A pair of the structural fallback by content, children's shapes, path and place."""
    shapes = child_shapes(a, b)
    same = FALLBACK_SAME if len(a.children) == len(b.children) and shapes == 1 else 0.0
    path = 1.0 if same_path(a, b) else OTHER_PATH
    return min(1.0, FALLBACK_BASE * similarity(a, b, context) + FALLBACK_SHAPE * shapes + FALLBACK_PATH * path + FALLBACK_RANGE * closeness(a, b) + same)


def margin(scores: list[float]) -> float:
    """The best score less the second best; 1 if there is one only."""
    top = sorted(scores, reverse=True)[:2]
    return top[0] - top[1] if len(top) == 2 else 1.0
