from treeloom.streaming import revisions


def test_each_revision_is_compared_with_the_last(spark, tmp_path):
    schema = "doc_id long, revision long, text string"
    batches = [[(1, 1, "# A"), (2, 1, "x")], [(1, 2, "# A\n\nmore"), (1, 3, "# A\n\nmore\n\nyet more")], [(1, 2, "late"), (2, 2, None)]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = None
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = q or revisions.compared_stream(stream).writeStream.format("memory").queryName("revs").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").start()
        q.processAllAvailable()
    q.stop()
    got = sorted((r["doc_id"], r["revision"], r["late"], r["inserts"], r["deletes"]) for r in spark.sql("SELECT * FROM revs").collect())
    assert got == [(1, 1, False, 1, 0), (1, 2, False, 1, 0), (1, 2, True, 0, 0), (1, 3, False, 1, 0), (2, 1, False, 1, 0), (2, 2, False, 0, 1)]
