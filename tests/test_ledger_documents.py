"""Ledger documents: the lines of ``ledger_lines`` in their order, without a row for each line."""

from pyspark.sql import functions as F

from treeloom.sources.ledgers import ledger_lines, ledgers

SF = "/root/testdata/sf0.001"


def test_documents_are_their_lines(spark, tmp_path):
    own = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("customer", "orders", "lineitem")}
    # Null cells, a customer without orders, and orders without items or a customer.
    own["customer"] = own["customer"].withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")))
    own["orders"] = own["orders"].filter("o_custkey <> 1").withColumn("o_custkey", F.when(F.col("o_orderkey") % 11 == 0, -5).otherwise(F.col("o_custkey"))).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 13 > 0, F.col("o_totalprice")))
    own["lineitem"] = own["lineitem"].filter("l_orderkey % 9 <> 0").withColumn("l_returnflag", F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")))
    for name, t in own.items():
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    found = ledgers(spark, str(tmp_path))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    lines = ledger_lines(*(spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("customer", "orders", "lineitem"))).collect()
    want = {}
    for r in sorted(lines, key=lambda r: (r.a, r.b)):
        if r.md is not None:
            want.setdefault((r.pair_id, r.side), []).append(r.md)
    got = {(r.pair_id, s): r[f"{s}_md"].split("\n") for r in found.collect() for s in ("old", "new")}
    assert got == want
