"""Similarity counts texts of every length."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from treeloom.plans import engine as e
from treeloom.plans import similarity as s
from treeloom.plans.document import Document

WORDS = st.lists(st.sampled_from("abcd"), max_size=12)


def table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=500, deadline=None)
@given(WORDS, WORDS)
def test_levenshtein(a, b):
    assert s.levenshtein(a, b) == s.levenshtein("".join(a), "".join(b)) == table(a, b)


def test_levenshtein_of_long_inputs():
    rng = random.Random(2)
    a, b = ([rng.randrange(20) for _ in range(900)] for _ in range(2))
    assert s.levenshtein(a, b) == table(a, b)


def block(text, kind):
    return next(n for n in Document(text).nodes if n.kind == kind)


def test_code_of_a_few_long_lines():
    lines = [f"{i} " + f"value{i} = call(argument) " * 30 for i in range(4)]
    a, b = ("```\n" + "\n".join(x) + "\n```" for x in (lines, [x + "!" for x in lines]))
    assert 1000 < len(a) < 5000 and s.similarity(block(a, "code"), block(b, "code")) > 0.99
    root, _ = e.compare(a, b)
    assert e.summary(root)["replaces"] == 1 and not e.summary(root)["deletes"]


def test_code_of_many_lines():
    lines = [f"line {i % 50} of the code {i % 7}" for i in range(600)]
    a, b = ("```\n" + "\n".join(x) + "\n```" for x in (lines, [x + f" {i}" if i % 5 == 0 else x for i, x in enumerate(lines)]))
    assert s.similarity(block(a, "code"), block(b, "code")) >= 0.85


def test_a_long_paragraph():
    words = [f"w{i % 240}" for i in range(500)]
    other = [f"new{i}" if i % 10 == 0 else x for i, x in enumerate(words)]
    assert s.content(block(" ".join(words), "paragraph"), block(" ".join(other), "paragraph")) >= 0.9


def test_long_texts_without_words():
    a, b = "!" * 3000, "!" * 2500 + "?" * 500
    assert abs(s.content(block(a, "paragraph"), block(b, "paragraph")) - 2500 / 3000) < 1e-9
