"""Algorithms that are sequential within one pair: edit scripts, anchors, assignment, tree edits.

They work on plain Python sequences. A pair is a row (or a group) of a table, so
Spark spreads pairs over executors and each kernel sees one pair at a time.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np

#: (op, old index or -1, new index or -1); ops are equal, delete, insert.
Edit = tuple[str, int, int]

# When which strategy is used.
SHORT, MOST_CELLS, HECKEL_RATIO = 80, 6400, 0.6
#: Edits beyond which a shortest script is found by rows of bits, and cells of which the rows are kept at one time.
MOST_EDITS, ROW_CELLS = 2000, 1 << 28
#: Cells of a tree edit's table beyond which only some of its rows are kept.
MOST_TREE_CELLS = 10_000


def interned(old: Sequence, new: Sequence) -> tuple[list[int], list[int]]:
    """Both sequences as small integers, equal where they are equal."""
    table: dict = {}
    return [table.setdefault(x, len(table)) for x in old], [table.setdefault(x, len(table)) for x in new]


def longest_increasing(values: Sequence[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails: list[int] = []
    places: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before.append(places[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            places.append(i)
        else:
            tails[k], places[k] = v, i
    out, i = [], places[-1] if places else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def shortest_script(old: Sequence, new: Sequence) -> list[Edit]:
    """A shortest edit script by greedy furthest-reaching diagonals; common ends are cut off first.

    Only the diagonals that a round reaches are kept for walking back, so memory
    grows with the square of the number of edits, not with the lengths. Beyond
    MOST_EDITS edits a script of the same length is found by ``common_subsequence``.
    """
    a, b = interned(old, new)
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    n, m = len(x), len(y)
    ends = [("equal", len(a) - tail + t, len(b) - tail + t) for t in range(tail)]
    start = [("equal", h, h) for h in range(head)]
    if not set(x) & set(y):
        return start + _shifted(replaced(x, y), head, head) + ends
    reach, rounds = {1: 0}, []
    for d in range(n + m + 1):
        if d > MOST_EDITS:
            del rounds, reach
            return start + _shifted(between_anchors(x, y, common_subsequence(x, y), replaced), head, head) + ends
        now: dict[int, int] = {}
        for k in range(-d, d + 1, 2):
            down = k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1))
            i = reach.get(k + 1, -1) if down else reach.get(k - 1, -1) + 1
            j = i - k
            if i < 0 or i > n or j > m or j < 0:
                continue
            while i < n and j < m and x[i] == y[j]:
                i, j = i + 1, j + 1
            now[k] = i
        rounds.append(now)
        reach = {**reach, **now}
        if now.get(n - m, -1) >= n:
            break
    middle: list[Edit] = []
    i, j = n, m
    for d in range(len(rounds) - 1, 0, -1):
        k, known = i - j, rounds[d - 1]
        from_left, from_above = known.get(k - 1, -1), known.get(k + 1, -1)
        down = from_left + 1 < 0 or k == -d or (k != d and from_left < from_above)
        pi = from_above if down else from_left
        pj = pi - (k + 1 if down else k - 1)
        while i > pi + (0 if down else 1) and j > pj + (1 if down else 0):
            i, j = i - 1, j - 1
            middle.append(("equal", head + i, head + j))
        if down:
            j -= 1
            middle.append(("insert", -1, head + j))
        else:
            i -= 1
            middle.append(("delete", head + i, -1))
    while i and j:
        i, j = i - 1, j - 1
        middle.append(("equal", head + i, head + j))
    return start + middle[::-1] + ends


def _shifted(edits: list[Edit], i: int, j: int) -> list[Edit]:
    return [(op, o + i if o >= 0 else -1, n + j if n >= 0 else -1) for op, o, n in edits]


def between_anchors(old: Sequence, new: Sequence, anchors: list[tuple[int, int]], fill: Callable = shortest_script) -> list[Edit]:
    """The script that holds the anchors equal and fills each gap."""
    out: list[Edit] = []
    i = j = 0
    for p, q in [*anchors, (len(old), len(new))]:
        out += _shifted(fill(old[i:p], new[j:q]), i, j)
        if p < len(old):
            out.append(("equal", p, q))
        i, j = p + 1, q + 1
    return out


def replaced(old: Sequence, new: Sequence) -> list[Edit]:
    return [("delete", i, -1) for i in range(len(old))] + [("insert", -1, j) for j in range(len(new))]


def bit_masks(x: Sequence, y: Sequence) -> Callable:
    """mask(e): the places of e in y, as bits of a whole number. Those of x's most frequent elements are kept, as many as ROW_CELLS bits hold."""
    places: dict = {}
    for j, e in enumerate(y):
        places.setdefault(e, []).append(j)
    width = (len(y) + 7) // 8

    def made(e) -> int:
        bits = bytearray(width)
        for j in places[e]:
            bits[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(bits, "little")

    often = heapq.nlargest(ROW_CELLS // (8 * width + 1), set(x) & places.keys(), key=lambda e: len(places[e]))
    masks = {e: made(e) for e in often}
    return lambda e: masks[e] if e in masks else made(e) if e in places else 0


def _bit_rows(x: Sequence, y: Sequence) -> Iterator[int]:
    """After each element of x: the places of y, as bits, where the longest common subsequence does not grow."""
    mask = bit_masks(x, y)
    row = full = (1 << len(y)) - 1
    for e in x:
        if both := row & mask(e):
            row = ((row + both) | (row - both)) & full
        yield row


def _lengths(x: Sequence, y: Sequence) -> np.ndarray:
    """Lengths of the longest common subsequence of x and the first 0, 1, ... elements of y."""
    row = (1 << len(y)) - 1
    for row in _bit_rows(x, y):  # noqa: B007
        pass
    flat = np.unpackbits(np.frombuffer(row.to_bytes((len(y) + 7) // 8, "little"), np.uint8), count=len(y), bitorder="little")
    return np.concatenate(([0], np.cumsum(1 - flat.astype(np.int64))))


def common_subsequence(x: Sequence, y: Sequence) -> list[tuple[int, int]]:
    """Places (in x, in y) of a longest common subsequence, of inputs of any length.

    Bit-parallel rows, one whole number each. x is halved and y cut where both
    halves' lengths add up to most, until a part's rows fit ROW_CELLS bits; then they
    are kept and walked back.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        i, p, j, q = todo.pop()
        if i == p or j == q:
            continue
        if p - i > 1 and (p - i) * (q - j) > ROW_CELLS:
            half = (i + p) // 2
            cut = j + int((_lengths(x[i:half], y[j:q]) + _lengths(x[half:p][::-1], y[j:q][::-1])[::-1]).argmax())
            todo += [(half, p, cut, q), (i, half, j, cut)]
            continue
        rows = [(1 << (q - j)) - 1, *_bit_rows(x[i:p], y[j:q])]
        found, a, b = [], p - i, q - j
        while a and b:
            if rows[a] >> (b - 1) & 1:
                b -= 1
            elif not rows[a - 1] >> (b - 1) & 1:
                a -= 1
            else:
                a, b = a - 1, b - 1
                found.append((i + a, j + b))
        out += found[::-1]
    return out


def unique_anchors(old: Sequence, new: Sequence) -> list[tuple[int, int]]:
    """Elements that occur once on each side, as far as they keep their order."""
    a, b = Counter(old), Counter(new)
    place = {x: j for j, x in enumerate(new)}
    pairs = [(i, place[x]) for i, x in enumerate(old) if a[x] == 1 and b.get(x) == 1]
    return [pairs[k] for k in longest_increasing([j for _, j in pairs])]


def heckel_script(old: Sequence, new: Sequence) -> list[Edit]:
    return between_anchors(old, new, unique_anchors(old, new))


def histogram_script(old: Sequence, new: Sequence) -> list[Edit]:
    """Splits at the rarest shared element (the earliest of equals) again and again."""
    out: list[Edit] = []
    todo = [(0, len(old), 0, len(new), -1)]
    while todo:
        i, p, j, q, anchor = todo.pop()
        if anchor >= 0:
            out.append(("equal", i, j))
            continue
        a, b = Counter(old[i:p]), Counter(new[j:q])
        best = min(((a[x] * b[x], k) for k, x in enumerate(old[i:p], i) if x in b), default=None)
        if best is None or p - i <= 1 or q - j <= 1:
            out += _shifted(shortest_script(old[i:p], new[j:q]), i, j)
            continue
        k = best[1]
        at = j + list(new[j:q]).index(old[k])
        todo += [(k + 1, p, at + 1, q, -1), (k, k, at, at, 0), (i, k, j, at, -1)]
    return out


def unique_ratio(old: Sequence, new: Sequence) -> float:
    a, b = Counter(old), Counter(new)
    return sum(1 for x, n in a.items() if n == 1 and b.get(x) == 1) / max(len(old), len(new), 1)


def align(old: Sequence, new: Sequence, strategy: str = "auto") -> list[Edit]:
    """auto: the exact script for short or small inputs, unique anchors where most elements are unique, else the histogram."""
    if strategy == "auto":
        small = max(len(old), len(new)) <= SHORT or len(old) * len(new) <= MOST_CELLS
        strategy = "myers" if small else "heckel" if unique_ratio(old, new) > HECKEL_RATIO else "histogram"
    return {"myers": shortest_script, "heckel": heckel_script, "histogram": histogram_script}[strategy](old, new)


def optimal_assignment(costs: Sequence[Sequence[float | None]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, each row and column at most once; None or infinite cost is no pair.

    As many pairs as possible come first, then their cost. Shortest augmenting paths
    over potentials, a row at a time; a missing cell costs more than all others together.
    """
    n, m = len(costs), max((len(r) for r in costs), default=0)
    if not n or not m:
        return []
    given = np.full((n, m), np.inf)
    for i, row in enumerate(costs):
        for j, c in enumerate(row):
            if c is not None:
                given[i, j] = c
    real = np.isfinite(given)
    far = (np.abs(given[real]).sum() + 1) if real.any() else 1.0
    size = max(n, m)
    cost = np.full((size, size), far)
    cost[:n, :m] = np.where(real, given, far)
    u, v = np.zeros(size), np.zeros(size)
    owner = np.full(size, -1)
    for row in range(size):
        least, via, done = np.full(size, np.inf), np.full(size, -1), np.zeros(size, bool)
        i, last, delta = row, -1, 0.0
        while True:
            slack = delta + cost[i] - u[i] - v
            better = ~done & (slack < least)
            least[better], via[better] = slack[better], last
            j = int(np.where(done, np.inf, least).argmin())
            delta, last = least[j], j
            done[j] = True
            if owner[j] < 0:
                break
            i = owner[j]
        seen = np.flatnonzero(done)
        for j in seen:
            gain = delta - least[j]
            v[j] -= gain
            if owner[j] >= 0:
                u[owner[j]] += gain
        u[row] += delta
        while last >= 0:
            owner[last] = owner[via[last]] if via[last] >= 0 else row
            last = via[last]
    return sorted((int(i), int(j)) for j, i in enumerate(owner) if i < n and j < m and real[i, j])


def tree_edit_matches(
    old: list, new: list, children: Callable, matchable: Callable, relabel: Callable, delete: float = 1.0, insert: float = 1.0, kinds: Callable | None = None
) -> tuple[list[tuple], float]:
    """(matched nodes, cost) of a constrained edit between two ordered forests: matched nodes' children are compared with each other.

    matchable(a, b) and relabel(a, b) judge nodes; a subtree is deleted or inserted as a whole, node by node in cost.
    Of forests beyond MOST_TREE_CELLS each so many rows of the table are kept and the rows between
    are made again on the way back, so memory grows with the length to the power of 1.5. There, nodes
    of equal kinds(node) are judged once, for all; it must tell apart what the callables do.
    """
    size: dict[int, int] = {}
    pair_cost: dict[tuple, float] = {}
    kind_of: dict[int, object] = {}

    def count(x) -> int:
        if id(x) not in size:
            size[id(x)] = 1 + sum(map(count, children(x)))
        return size[id(x)]

    def judge(a, b) -> float:
        """What it costs to match a and b, with all below them."""
        return relabel(a, b) + cost_of(children(a), children(b)) if matchable(a, b) else math.inf

    def known(x):
        """What tells a node without children from others in pair_cost."""
        if id(x) not in kind_of:
            kind_of[id(x)] = id(x) if kinds is None or children(x) else (kinds(x),)
        return kind_of[id(x)]

    def costs_of(x, ys: list) -> list[float]:
        out, key = [], known(x)
        for y in ys:
            at = (key, known(y))
            found = pair_cost.get(at)
            if found is None:
                found = pair_cost[at] = judge(x, y)
            out.append(found)
        return out

    def table(xs: list, ys: list) -> list[list[float]]:
        """The least cost of the first i of xs and the first j of ys."""
        come, row = [insert * count(y) for y in ys], [0.0]
        for c in come:
            row.append(row[-1] + c)
        rows = [row]
        for x in xs:
            gone, last, left = delete * count(x), row, row[0] + delete * count(x)
            row = [left]
            for j, kept in enumerate(costs_of(x, ys)):
                best, other, kept = last[j + 1] + gone, left + come[j], last[j] + kept
                left = other if other < best else best
                if kept < left:
                    left = kept
                row.append(left)
            rows.append(row)
        return rows

    def cost_of(xs: list, ys: list) -> float:
        return long_forest(xs, ys)[0] if len(xs) * len(ys) > MOST_TREE_CELLS else table(xs, ys)[-1][-1]

    def matched(a, b) -> list:
        return [(a, b), *forest(children(a), children(b))[1]]

    def forest(xs: list, ys: list) -> tuple[float, list]:
        if len(xs) * len(ys) > MOST_TREE_CELLS:
            return long_forest(xs, ys)
        rows = table(xs, ys)
        parts, i, j = [], len(xs), len(ys)
        while i and j:
            best, other = rows[i - 1][j] + delete * count(xs[i - 1]), rows[i][j - 1] + insert * count(ys[j - 1])
            # Of equal costs a deletion comes before an insertion, and both before a match.
            if rows[i][j] < min(best, other):
                i, j = i - 1, j - 1
                parts.append(matched(xs[i], ys[j]))
            elif other < best:
                j -= 1
            else:
                i -= 1
        return rows[-1][-1], [m for part in reversed(parts) for m in part]

    def long_forest(xs: list, ys: list) -> tuple[float, list]:
        added = np.cumsum([0.0, *(insert * count(y) for y in ys)])
        costs = _pair_costs(xs, ys, children, matchable, relabel, delete, insert, kinds) if kinds else None
        if costs is None:
            costs = lambda i: np.array([judge(xs[i], y) for y in ys])

        def row_after(row: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
            gone, kept = row + delete * count(xs[i]) - added, np.append(np.inf, row[:-1] + costs(i)) - added
            best = np.minimum.accumulate(np.minimum(gone, kept))
            come = np.append(np.inf, best[:-1])
            return best + added, np.where(kept < np.minimum(gone, come), 3, np.where(come < gone, 2, 1)).astype(np.int8)

        every = math.isqrt(len(xs))
        saved, row = [], added
        for i in range(len(xs)):
            if i % every == 0:
                saved.append(row)
            row = row_after(row, i)[0]
        cost, parts, j = float(row[-1]), [], len(ys)
        for block in reversed(range(len(saved))):
            row, steps = saved[block], []
            for i in range(block * every, min(len(xs), (block + 1) * every)):
                row, how = row_after(row, i)
                steps.append(how)
            for k in reversed(range(len(steps))):
                while steps[k][j] == 2:
                    j -= 1
                if steps[k][j] == 3:
                    j -= 1
                    parts.append(matched(xs[block * every + k], ys[j]))
        return cost, [m for part in reversed(parts) for m in part]

    cost, found = forest(old, new)
    return found, cost


def _pair_costs(xs: list, ys: list, children: Callable, matchable: Callable, relabel: Callable, delete: float, insert: float, kinds: Callable) -> Callable | None:
    """costs(i) of matching xs[i] with each of ys, all of ys at one time; None where a child has children of its own."""
    if any(children(c) for side in (xs, ys) for n in side for c in children(n)):
        return None
    by_kind: dict = {}
    of = lambda n: by_kind.setdefault(kinds(n), (len(by_kind), n))[0]
    heads, width = np.array([of(y) for y in ys]), max(len(children(y)) for y in ys)
    below, lengths = np.full((width, len(ys)), -1), np.array([len(children(y)) for y in ys])
    for j, y in enumerate(ys):
        for k, c in enumerate(children(y)):
            below[k, j] = of(c)
    theirs = [n for _, n in by_kind.values()]

    @lru_cache(maxsize=max(16, (1 << 23) // len(theirs)))
    def against(kind) -> np.ndarray:
        a = mine[kind]
        return np.array([relabel(a, b) if matchable(a, b) else np.inf for b in theirs] + [np.inf])

    mine: dict = {}

    def judged(n) -> np.ndarray:
        kind = kinds(n)
        mine.setdefault(kind, n)
        return against(kind)

    def costs(i: int) -> np.ndarray:
        x = xs[i]
        rows = [np.full(len(ys), k * insert) for k in range(width + 1)]
        for c in children(x):
            one, now = judged(c), [rows[0] + delete]
            for k in range(width):
                now.append(np.minimum(np.minimum(rows[k + 1] + delete, now[k] + insert), rows[k] + one[below[k]]))
            rows = now
        return judged(x)[heads] + np.stack(rows)[lengths, np.arange(len(ys))]

    return costs


def non_crossing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs in order of the first, without those that do not raise the second."""
    out, top = [], -1
    for i, j in sorted(pairs):
        if j > top:
            out.append((i, j))
            top = j
    return out
