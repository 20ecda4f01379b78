"""Markdown queries compare whole lines and texts of any length."""

from treeloom.plans import change_queries, pairs


def test_whole_lines_are_compared(spark, tmp_path):
    line = " ".join(f"w{i:03}" for i in range(20)) + " `x`" + " | *a* > b"
    line += "." * (-len(line) % 5)
    spark.createDataFrame([(1, line)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = change_queries.markdown_pairs(spark, str(tmp_path)).first()
    assert row["old_md"] == f"## {line}"
    made = change_queries.markdown_changes(spark, str(tmp_path)).filter("kind = 'heading'").collect()
    assert made and any(line.split("`")[0] in (r["title"] or "") for r in made)


def test_long_lines_differ_at_their_ends(spark, tmp_path):
    # (1 * 31 + 5 * 7) % 11 = 0 drops, (doc_id * 31 + ln * 7) % 11 = 1 appends " *": here the only line.
    text = "word " * 20
    spark.createDataFrame([(d, text) for d in range(11)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = change_queries.markdown_pairs(spark, str(tmp_path)).collect()
    assert all(text in r["old_md"] for r in rows) and any(r["new_md"].startswith(f"{text} *") or r["new_md"].startswith(f"## {text} *") for r in rows)


def test_texts_beyond_five_mebibytes(spark):
    large = "# A\n\nold words\n\n```\n" + "x" * (5 * 1024 * 1024 + 1) + "\n```"
    df = spark.createDataFrame([(1, large, large.replace("old words", "new words"))], "pair_id long, old_md string, new_md string")
    changes = pairs.compared(df)
    stats = pairs.statistics(changes).first()
    assert stats["replaces"] == 1 and stats["warnings"] == 0
