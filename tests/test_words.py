"""Words by Unicode's rules: cases, the Column against the kernel on all documents, and both against the rules taken one by one."""

import functools
import random

import pytest
import regex
from pyspark.sql import functions as F

from treeloom.functions import text as t
from treeloom.plans.document import words

DIR = "/root/testdata/sf0.01"
CASES = {
    "Don't stop; the dogs' U.S.A. 3.14 and 1,000,000.5, a.1 x_y __ _": ["don't", "stop", "the", "dogs", "u.s.a", "3.14", "and", "1,000,000.5", "a", "1", "x_y", "__"],
    "ภาษาไทยดี": ["ภา", "าษ", "ษา", "าไ", "ไท", "ทย", "ยดี"],
    "กี่": ["กี่"],
    "السَّلَامُ عَلَيْكُم، ١٢٣٫٤": ["السَّلَامُ", "عَلَيْكُم", "١٢٣٫٤"],
    "ok 👍🏽 👩‍👩‍👧 café 🇩🇪 x": ["ok", "café", "x"],
    "café co­op l’été": ["café", "co­op", "l’été"],
    "漢字とカナ mixed テスト1": ["漢字", "字と", "とカ", "カナ", "mixed", "テス", "スト", "1"],
    "12:30 a:b e.g.: x..y": ["12", "30", "a", "b", "e.g", "x", "y"],
    "": [], " \t": [], "?!…": [],
}


def test_plain_texts(spark):
    """Texts of ASCII alone have a pattern of their own; with another character at the end they don't."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("aB1 2_.',;:\"-") for _ in range(rng.randrange(20))) for _ in range(5000)]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for x, plain, marked in df.select("x", t.tokenize_text(F.col("x")), t.tokenize_text(F.concat("x", F.lit(" €")))).collect():
        assert plain == marked == words(x)


@pytest.mark.parametrize("text", CASES)
def test_cases(spark, text):
    assert words(text) == CASES[text]
    assert spark.range(1).select(t.tokenize_text(F.lit(text)).alias("x")).first()["x"] == CASES[text]


def test_null(spark):
    assert spark.range(1).select(t.tokenize_text(F.lit(None).cast("string")).alias("x")).first()["x"] is None


@pytest.mark.parametrize(("text", "n"), [("a" * 300_000, 1), ("a." * 200_000, 1), ("é1_" * 100_000, 1), ("a " * 200_000, 200_000), ("好" * 100_000, 99_999), ("é" * 100_000, 1), ("." * 300_000, 0)])
def test_long_texts(spark, text, n):
    assert len(words(text)) == n
    df = spark.createDataFrame([(text,)], "text string").select(F.size(t.tokenize_text(F.col("text"))).alias("n"))
    assert df.first()["n"] == n


def test_column_and_kernel_agree_on_all_documents(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").filter("text IS NOT NULL").select("text", t.tokenize_text(F.col("text")).alias("x")).collect()
    assert rows and all(words(r["text"]) == r["x"] for r in rows)


# -- the rules, one by one

CLASSES = "ALetter Hebrew_Letter Numeric MidLetter MidNum MidNumLet Single_Quote ExtendNumLet Extend Format ZWJ".split()
PROPERTY = {c: regex.compile(rf"\p{{Word_Break={c}}}") for c in CLASSES}


@functools.cache
def word_class(c):
    """A colon joins nothing."""
    if c in ":﹕：":
        return "Other"
    found = next((k for k, p in PROPERTY.items() if p.match(c)), "Other")
    return {"Hebrew_Letter": "ALetter", "Format": "Extend", "ZWJ": "Extend"}.get(found, found)


def ruled(text):
    """Segments with a letter, a digit or two connectors: a boundary between two characters unless a rule forbids it, extenders skipped."""
    text = text.lower()
    kept = [(i, word_class(c)) for i, c in enumerate(text)]
    solid = [x for x in kept if x[1] != "Extend" or x[0] == 0]
    both = ("MidNumLet", "Single_Quote")
    starts = []
    for k, (i, c) in enumerate(solid):
        back = [x[1] for x in reversed(solid[max(0, k - 2) : k])] + ["", ""]
        ahead = solid[k + 1][1] if k + 1 < len(solid) else ""
        word = ("ALetter", "Numeric")
        joins = (
            (back[0] in word and c in word)
            or (back[0] == "ALetter" and c in ("MidLetter", *both) and ahead == "ALetter")
            or (back[1] == "ALetter" and back[0] in ("MidLetter", *both) and c == "ALetter")
            or (back[0] == "Numeric" and c in ("MidNum", *both) and ahead == "Numeric")
            or (back[1] == "Numeric" and back[0] in ("MidNum", *both) and c == "Numeric")
            or (back[0] in (*word, "ExtendNumLet") and c == "ExtendNumLet")
            or (back[0] == "ExtendNumLet" and c in word)
        )
        if not joins:
            starts.append(i)
    segments = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]
    has = lambda s, k: sum(word_class(c) == k for c in s)
    return [s for s in segments if has(s, "ALetter") or has(s, "Numeric") or has(s, "ExtendNumLet") > 1]


def test_the_rules_one_by_one():
    rng = random.Random(5)
    alphabet = "ab1 2é_.'’,;:·-́ñДب٣ 😀"
    for _ in range(20_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 14)))
        # A mark after a connector or a symbol extends what is no word here.
        text = regex.sub("(?<=[^\\p{L}\\p{N}.'’,;·́])́+|^́+", "", text)
        assert words(text) == ruled(text), text


def test_the_rules_on_documents(spark):
    for r in spark.read.parquet(f"{DIR}/documents.parquet").filter("text IS NOT NULL").select("text").collect():
        if not regex.search(t.CLUSTER, r["text"]):
            assert words(r["text"]) == ruled(r["text"])
