"""Registered queries look at all candidates of a document of any size."""

from treeloom.plans import change_queries as q
from treeloom.plans import engine as e


def documents(spark, path):
    """One document whose 400 lines are paragraphs of one parent, beyond every budget."""
    lines = [f"p{i} alpha beta gamma" for i in range(400)]
    lines = [x + "." * ((2 - len(x)) % 5) for x in lines]
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_markdown_queries_have_no_budget(spark, tmp_path):
    sf_dir = documents(spark, tmp_path)
    stats = q.markdown_stats(spark, sf_dir).first()
    assert stats["warnings"] == 0 and stats["inserts"] + stats["replaces"] > 30 and stats["deletes"] + stats["replaces"] > 30
    assert q.markdown_details(spark, sf_dir).count() > 60
    rows = q.change_navigation(spark, sf_dir).collect()
    assert len(rows) > 60 and sum(r["previous_id"] == "" for r in rows) == 1


def test_a_whole_comparison_goes_below_large_parents():
    old, new = ("\n\n".join(f"p{i} some words that stay {x if i % 3 == 0 else ''}" for i in range(300)) for x in ("alpha", "beta"))
    assert e.compare(old, new)[0].degraded
    root, _ = e.compare(old, new, e.WHOLE)
    assert not root.degraded and not root.warnings and e.summary(root)["replaces"] == 100


def test_recall_drops_no_candidate():
    olds, news = ("\n\n".join(f"word{i} {x} common text of all {i * 7}" for i in range(40)) for x in ("a", "b"))
    c = e.Comparison(e.Document(olds), e.Document(news), e.WHOLE)
    assert len(c.recalled(c.old.nodes[1], c.new.nodes[1:])) == 40
