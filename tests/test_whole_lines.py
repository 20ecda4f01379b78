"""text_sequence_similarity compares whole lines, of any length."""

import duckdb

from treeloom.plans import text_queries


def test_lines_differ_beyond_their_first_characters(spark, tmp_path):
    # doc_id 1: line 2 is swapped with the next, so both stand at other places of the new version.
    long = "word " * 500
    lines = [f"{long}{x}" for x in ("one", "two", "three", "four", "five")]
    spark.createDataFrame([(d, "\n".join(lines)) for d in range(11)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["pos"]): r["score"] for r in text_queries.QUERIES["text_sequence_similarity"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {(d, p): s for d, p, s in con.execute(text_queries.SQL["text_sequence_similarity"]).fetchall()}
    assert got == want and any(0.99 < s < 1 for s in got.values())
