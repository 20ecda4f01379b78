"""Documents nested very deep, front matter beyond flat mappings, and many different tokens."""

from pyspark.sql import functions as F

from treeloom.functions.similarity import coded, edit_distance
from treeloom.plans import engine, pairs, report
from treeloom.sources.markdown import front_matter


def test_a_pair_nested_too_deep_gives_one_row(spark):
    deep = "> " * 3000 + "x"
    df = spark.createDataFrame([(1, deep, deep + " y"), (2, "a", "b"), (3, deep, deep)], "pair_id long, old_md string, new_md string")
    got = {r["pair_id"]: r for r in pairs.compared(df).filter("parent_change_id IS NULL").collect()}
    assert got[1]["op"] == "replace" and got[1]["warnings"] == ["nesting-too-deep"] and got[3]["op"] == "equal" and not got[2]["degraded"]
    assert pairs.nodes_of(df.select("pair_id", F.lit("old").alias("side"), F.col("old_md").alias("md"))).filter("pair_id = 1").count() == 1
    assert [r["warning"] for r in report.display_warnings(pairs.compared(df.filter("pair_id = 1"))).collect()] == ["nested too deep to be compared"]


def test_front_matter():
    assert front_matter("yaml", "a: |\n  one\n  two\nb: >-\n  one\n  two\nc: 3") == {"a": "one\ntwo\n", "b": "one two", "c": 3}
    assert front_matter("yaml", "people:\n  - name: x\n    age: 4\n  - name: y\n    age: 5\nlast: [p, q]") == {"people": [{"name": "x", "age": 4}, {"name": "y", "age": 5}], "last": ["p", "q"]}
    assert front_matter("yaml", "k:\n  - 'a: b'\n  - c") == {"k": ["a: b", "c"]}
    root, _ = engine.compare("---\na: |\n  one\n---", "---\na: |\n  two\n---")
    assert engine.summary(root)["meta_updates"] == 1


def test_many_different_tokens(spark):
    a = F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: F.concat(F.lit("t"), i.cast("string")))
    few = edit_distance(F.slice(a, 1, 3), F.slice(a, 2, 3))
    some = F.concat(F.slice(a, 1, 5), F.slice(a, 35_325, 8), F.slice(a, 39_996, 5))
    row = spark.range(1).select(few.alias("few"), coded(some, a).alias("coded")).first()
    assert row["few"] == 2 and len(row["coded"]) == len(set(row["coded"])) == 18


def test_runs_of_one_tone_are_joined(spark):
    spans = [("inline", "equal", "a", "a"), ("inline", "delete", "b", ""), ("inline", "replace", "c", "d"), ("inline", "equal", "e", "e"), ("word", "equal", "x", "x")] * 400
    df = spark.createDataFrame([(spans,), ([],)], "spans array<struct<layer:string,op:string,old_text:string,new_text:string>>")
    got = [r["x"] for r in df.select(report.segments(F.col("spans"), "old").alias("x")).collect()]
    assert [(r["text"], r["tone"]) for r in got[0][:3]] == [("a", "plain"), ("bc", "delete"), ("ea", "plain")] and len(got[0]) == 801 and got[1] == []
