"""Tree edits judge leaves of equal kinds once, also below MOST_TREE_CELLS."""

from treeloom.plans import kernels


def test_leaves_of_equal_kinds_are_judged_once():
    asked = []

    def relabel(a, b):
        asked.append((a["l"], b["l"]))
        return 0.0 if a["l"] == b["l"] else 0.5

    old, new = ([{"l": "abc"[i * k % 3], "c": []} for i in range(30)] for k in (1, 2))
    found, cost = kernels.tree_edit_matches(old, new, lambda n: n["c"], lambda a, b: True, relabel, kinds=lambda n: n["l"])
    assert len(asked) <= 9 and len(found) == 30
    again = kernels.tree_edit_matches(old, new, lambda n: n["c"], lambda a, b: True, relabel)
    assert [(id(a), id(b)) for a, b in again[0]] == [(id(a), id(b)) for a, b in found] and again[1] == cost
