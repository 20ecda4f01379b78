import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from treeloom.plans import kernels as k

WORDS = st.lists(st.sampled_from("abcde"), max_size=14)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def check(a, b, edits):
    assert [o for _, o, _ in edits if o >= 0] == list(range(len(a)))
    assert [n for _, _, n in edits if n >= 0] == list(range(len(b)))
    assert all(a[o] == b[n] for op, o, n in edits if op == "equal")
    assert all((op == "delete") == (n < 0) and (op == "insert") == (o < 0) for op, o, n in edits)
    return sum(op == "equal" for op, _, _ in edits)


@settings(max_examples=400, deadline=None)
@given(WORDS, WORDS)
def test_scripts(a, b):
    assert check(a, b, k.shortest_script(a, b)) == lcs(a, b)
    for strategy in ("heckel", "histogram", "auto"):
        check(a, b, k.align(a, b, strategy))


def test_long_inputs():
    a = [f"l{i}" for i in range(3000)]
    b = a[:1000] + ["x"] * 30 + a[1100:]
    for strategy in ("auto", "myers", "heckel", "histogram"):
        assert check(a, b, k.align(a, b, strategy)) == 2900
    assert check(["x"] * 500, ["x"] * 300 + ["y"], k.align(["x"] * 500, ["x"] * 300 + ["y"])) == 300


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS, st.integers(0, 6))
def test_beyond_the_most_edits_a_script_is_still_valid(a, b, most):
    kept, k.MOST_EDITS = k.MOST_EDITS, most
    try:
        check(a, b, k.shortest_script(a, b))
    finally:
        k.MOST_EDITS = kept


def test_very_different_long_inputs():
    a, b = [str(i * 7 % 97) for i in range(9000)], [str(i * 11 % 89) for i in range(8000)]
    check(a, b, k.align(a, b))
    assert check([f"a{i}" for i in range(50_000)], [f"b{i}" for i in range(50_000)], k.align([f"a{i}" for i in range(50_000)], [f"b{i}" for i in range(50_000)])) == 0


@given(st.lists(st.integers(0, 12), max_size=12))
def test_longest_increasing(v):
    found = k.longest_increasing(v)
    assert all(v[a] < v[b] for a, b in zip(found, found[1:])) and found == sorted(found)
    assert len(found) == max((len(c) for n in range(len(v) + 1) for c in itertools.combinations(v, n) if all(x < y for x, y in zip(c, c[1:]))), default=0)
    assert k.longest_increasing([2, 0, 1, 3]) == [1, 2, 3]


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.data())
def test_assignment(n, m, data):
    cells = st.one_of(st.none(), st.integers(0, 9))
    costs = [[data.draw(cells) for _ in range(m)] for _ in range(n)]
    best = None
    for size in range(min(n, m), -1, -1):
        for rows in itertools.combinations(range(n), size):
            for cols in itertools.permutations(range(m), size):
                if all(costs[i][j] is not None for i, j in zip(rows, cols)):
                    total = sum(costs[i][j] for i, j in zip(rows, cols))
                    best = total if best is None or best[0] < size else best
                    best = (size, min(total, best[1] if isinstance(best, tuple) else total))
        if best:
            break
    got = k.optimal_assignment(costs)
    assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
    assert (len(got), sum(costs[i][j] for i, j in got)) == best


def test_tree_edit():
    leaf = lambda x: (x, [])
    old, new = [("a", [leaf("b"), leaf("c")]), leaf("d")], [("a", [leaf("c")]), leaf("e"), leaf("d")]
    found, cost = k.tree_edit_matches(old, new, lambda x: x[1], lambda a, b: a[0] == b[0], lambda a, b: 0.0)
    assert [(a[0], b[0]) for a, b in found] == [("a", "a"), ("c", "c"), ("d", "d")] and cost == 2
    assert k.non_crossing([(0, 3), (1, 2), (2, 4)]) == [(0, 3), (2, 4)]
