"""Scripts stay shortest beyond the number of edits up to which diagonals are walked."""

import random

from hypothesis import given, settings
from test_kernels import WORDS, check, lcs

from treeloom.plans import kernels as k


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_bit_rows_find_a_longest_common_subsequence(a, b):
    kept = k.MOST_EDITS, k.ROW_CELLS
    try:
        for k.MOST_EDITS, k.ROW_CELLS in ((0, 1 << 20), (2, 4), (1, 40)):
            assert check(a, b, k.shortest_script(a, b)) == lcs(a, b)
    finally:
        k.MOST_EDITS, k.ROW_CELLS = kept


def test_more_than_two_thousand_edits():
    rng = random.Random(3)
    a, b = ([rng.randrange(40) for _ in range(2600)] for _ in range(2))
    found = check(a, b, k.shortest_script(a, b))
    assert found == lcs(a, b) and len(a) + len(b) - 2 * found > 2000


def test_a_document_of_many_lines():
    a = [f"l{i}" for i in range(30_000)]
    b = [x + " *" if i % 3 == 1 else x for i, x in enumerate(a) if i % 11]
    b[100], b[5000] = b[5000], b[100]
    assert check(a, b, k.shortest_script(a, b)) == len(set(a) & set(b)) - 2
