"""Rows of the merged view against a plain reading of their rules, and on small documents."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from treeloom.plans import pairs, rows
from treeloom.plans.similarity import levenshtein


def plain_matches(old, new):
    """The rules as they are written: a longest common subsequence by a table, then the best of the rest, one by one."""
    x, y = ([" ".join(t.split()) for t in s] for s in (old, new))
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in reversed(range(len(x))):
        for j in reversed(range(len(y))):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0], x, y


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["one two", "one  two", "one tow", "", "three", "four five six", "four five"]), max_size=9), st.lists(st.sampled_from(["one two", "one tow", "", "three!", "four five sox", "seven"]), max_size=9))
def test_line_matches(old, new):
    longest, x, y = plain_matches(old, new)
    found = rows.line_matches(old, new)
    assert all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:]))
    assert sum(x[i] == y[j] for i, j in found) >= longest
    for i, j in found:
        n = max(len(x[i]), len(y[j]))
        assert x[i] == y[j] or 1 - levenshtein(x[i], y[j]) / n >= 0.5
    # No pair is left out that would cross none and whose lines are free and alike.
    for i in set(range(len(x))) - {a for a, _ in found}:
        for j in set(range(len(y))) - {b for _, b in found}:
            n = max(len(x[i]), len(y[j]))
            alike = not n or 1 - levenshtein(x[i], y[j]) / n >= 0.5
            assert not alike or any((i - a) * (j - b) <= 0 for a, b in found)


def lines(*some):
    return [rows.Line(i + 1, *x) for i, x in enumerate(some)]


def numbers(found):
    return [tuple(x and x.number for x in r) for r in found]


def test_blocks_and_their_places():
    old = lines(("title", "a", "plain", "match"), ("", None), ("gone", "d", "delete"), ("text one", "p", "replace", "aligned"), ("tail", "z", "plain", "match"))
    new = lines(("title", "a", "plain", "match"), ("", None), ("fresh", "i", "insert"), ("text two", "p", "replace", "aligned"), ("more", "p", "replace", "aligned"), ("tail", "z", "plain", "match"))
    assert [b.mode for b in rows.blocks(old, "old")] == ["pair", "plain", "alone", "pair", "pair"]
    assert numbers(rows.merged(old, new)) == [(1, 1), (2, 2), (None, 3), (3, None), (4, 4), (None, 5), (5, 6)]
    assert numbers(rows.merged(old, [])) == [(i, None) for i in range(1, 6)] and numbers(rows.merged([], new)) == [(None, i) for i in range(1, 7)]


def test_moved_lines_know_the_other_end():
    old = lines(("a", "m1", "move", "match", False, "", "move:1"), ("b", "k", "plain", "match"))
    new = lines(("b", "k", "plain", "match"), ("a", "m2", "move", "match", False, "", "move:1"))
    found = rows.merged(old, new)
    assert numbers(found) == [(1, None), (2, 1), (None, 2)] and rows.peers(found) == [2, None, 0]


def test_plain_blocks_go_to_the_most_alike():
    old = lines(("apples and pears", None), ("x", "k", "delete"), ("wheels and tyres", None))
    new = lines(("wheels and tyres too", None), ("y", "j", "insert"), ("apples", None))
    assert (3, 1) in numbers(rows.merged(old, new)) and (1, 3) in numbers(rows.merged(old, new))


def test_every_line_stands_in_one_row(spark):
    """Three hundred pairs of small documents: all lines of both sides, each once, new ones in order, equal documents line by line."""
    rng = random.Random(4)
    parts = ["# Alpha", "## Beta", "some words here", "- item one", "- item two", "> said", "```\ncode\n```", "| a | b |\n| - | - |\n| 1 | 2 |", "[x]: /there", "[^n]: a note"]
    some = []
    for k in range(300):
        old = [rng.choice(parts) for _ in range(rng.randrange(1, 8))]
        new = old[:]
        for _ in range(k % 4):
            at = rng.randrange(len(new) + 1)
            kind = rng.randrange(4)
            if kind == 0:
                new.insert(at, rng.choice(parts))
            elif kind == 1 and len(new) > 1:
                del new[min(at, len(new) - 1)]
            elif kind == 2:
                new[min(at, len(new) - 1)] += " more"
            else:
                rng.shuffle(new)
        some.append((k, "\n\n".join(old), "\n\n".join(new)))
    df = spark.createDataFrame(some, "pair_id long, old_md string, new_md string")
    changes = pairs.compared(df).cache()
    found: dict = {}
    for r in pairs.merged_rows(df, changes).orderBy("pair_id", "row").collect():
        found.setdefault(r["pair_id"], []).append(r)
    for k, old, new in some:
        own = found[k]
        left, right = [r["old_line"] for r in own if r["old_line"]], [r["new_line"] for r in own if r["new_line"]]
        assert sorted(left) == list(range(1, old.count("\n") + 2)) and right == list(range(1, new.count("\n") + 2))
        assert all(r["old_line"] or r["new_line"] for r in own)
        if old == new:
            assert all(r["old_line"] == r["new_line"] for r in own)
