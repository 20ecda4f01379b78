"""Coloured runs, kept comparisons and table functions."""

import random

import pytest

from treeloom.plans import engine as e
from treeloom.plans import pairs, report, stale, surface

PAIR = "pair_id long, old_md string, new_md string"


def runs(old, new):
    root, _ = e.compare(old, new)
    (c,) = [c for c in e.walk(root) if c.node.kind == "paragraph"]
    spans = [dict(zip(("layer", "row", "col", "op", "old_text", "new_text"), s, strict=True)) for s in c.spans]
    return report.runs_of(spans, "old"), report.runs_of(spans, "new")


def test_words_in_their_colours():
    assert runs("Go now, Old friend of mine.", "Go now, New friend of mine.") == (
        [("Go now, ", "plain"), ("Old", "delete"), (" friend of mine.", "plain")], [("Go now, ", "plain"), ("New", "replace"), (" friend of mine.", "plain")],
    )
    assert runs("a b c d e", "a b, X-Y c d e")[1] == [("a b, ", "plain"), ("X", "insert"), ("-", "plain"), ("Y", "insert"), (" c d e", "plain")]
    assert report.placed_words("İx", [("x", "insert")]) is None and report.placed_words("abc", [("c", "plain"), ("a", "plain")]) is None


def test_runs_make_up_the_text():
    rng = random.Random(2)
    words = ["one", "Two", "three,", "*four*", "five.", "`six`", "SEVEN", "eight-nine", "中文字", "ten"]
    for _ in range(200):
        a = [rng.choice(words) for _ in range(12)]
        b = [w if rng.random() < 0.8 else rng.choice(words) for w in a]
        if a == b:
            continue
        found = pairs.change_rows(e.compare(" ".join(a), " ".join(b))[0], [])
        for row in (r for r in found if r["kind"] == "paragraph" and r["spans"] and r["old_id"] and r["new_id"]):
            for side, text in (("old", a), ("new", b)):
                want = " ".join(text).replace("*", "").replace("`", "")
                assert "".join(t for t, _ in report.runs_of(row["spans"], side)) == want


def test_kept_comparisons(spark):
    first = spark.createDataFrame([(1, "# A\n\nx y", "# A\n\nx z"), (2, "", None), (3, "a", "b"), (4, "q", "q")], PAIR)
    later = spark.createDataFrame([(1, "# A\n\nx y", "# A\n\nx y"), (2, "", ""), (3, "a", "b"), (5, "- n", "- m")], PAIR)
    kept, changes = stale.fingerprints(first), pairs.compared(first)
    assert dict(map(tuple, stale.states(later, kept).collect())) == {1: "changed", 2: "changed", 3: "same", 4: "gone", 5: "new"}
    got, keys = stale.refreshed(later, kept, changes)
    key = lambda df: sorted(tuple(str(x) for x in r) for r in df.collect())
    assert key(got) == key(pairs.compared(later)) and set(dict(map(tuple, stale.states(later, keys).collect())).values()) == {"same"}
    empty = spark.createDataFrame([], PAIR)
    assert stale.states(empty, stale.fingerprints(empty)).count() == 0


def test_table_functions(spark):
    surface.register(spark)
    spark.createDataFrame([(1, "# A\n\nsome words", "# A\n\nsome other words"), (2, None, "- x"), (3, "same", "same")], PAIR).createOrReplaceTempView("versions")
    got = spark.sql("SELECT pair_id, op, kind, new_line FROM markdown_changes(TABLE(versions)) ORDER BY ALL").collect()
    assert [tuple(r) for r in got] == [(1, "replace", "paragraph", 3), (2, "insert", "listItem", 1), (2, "insert", "paragraph", 1)]
    got = spark.sql("SELECT kind, count(*) AS n FROM markdown_outline(TABLE(SELECT pair_id, new_md AS md FROM versions)) GROUP BY kind").collect()
    assert dict(map(tuple, got)) == {"root": 3, "heading": 1, "paragraph": 3, "listItem": 1}
    with pytest.raises(Exception, match="old_md"):
        spark.sql("SELECT * FROM markdown_changes(TABLE(SELECT 1L AS pair_id))").collect()
