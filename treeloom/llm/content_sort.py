"""Exact deduplication by content sort, with DataFrame operations only.

Texts are equal when they agree after the deletion of ASCII white space. The
normalised texts are range-partitioned at splitters that Spark samples, each
partition is sorted (Spark's external sorter), and a row's text is compared in
full with its neighbour's: a row that differs starts a run. The first row of a run
is its longest one with the smallest identifier; who stays and how many there are
comes from the numbered runs alone. The sort key is a bounded prefix of the text, a
64-bit hash and then the text itself: the driver samples only bounded keys, and
texts that share a long passage still fall into different ranges.

A group of copies can hold a large part of all rows. Groups above
rows / (8 x partitions) rows are cut into salts of about that size, by the rows'
places, so that not even one identifier on all of them keeps them together. There
are at most 8 x partitions such groups and 16 x partitions salts, so their hashes,
and what is decided about their runs, are broadcast. Each salt's first row is
compared in full with those of the others once more.

Defined cases: a null text counts as empty; a null doc_id counts as the
smallest; rows that repeat with their doc_id are one group, of which exactly one
row is kept; an empty table gives an empty result; further columns are ignored by
``groups`` and kept by ``distinct``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.llm.common import checkpointed

#: Deleted before texts are compared.
BLANK = r"[\x20\x09-\x0D]+"
PREFIX = 16
_RUN = ["prefix", "h", "salt", "run"]


def _runs(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """(doc_id, kept, keep_id, group_size, sha) of each row; with whole only rows that may stay, with all their columns as a struct row.

    Text goes through one exchange.
    """
    spark = docs.sparkSession
    most = max(32, -(-docs.count() // (8 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.regexp_replace(text, BLANK, "")
    own = F.struct(*docs.columns).alias("row") if whole else norm.alias("norm")
    base = docs.select(own, F.col(id_col).alias("doc_id"), F.length(text).alias("len"), F.xxhash64(norm).alias("h"), F.substring(norm, 1, PREFIX).alias("prefix"), F.monotonically_increasing_id().alias("place"))

    hot = base.groupBy("h").agg(F.count("*").alias("copies")).filter(F.col("copies") >= most)
    salts = F.ceil(F.col("copies") / most)
    keyed = base.join(F.broadcast(hot), "h", "left").withColumn("salt", F.when(F.col("copies").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("place"), salts)).cast("int"))
    ranged = keyed.repartitionByRange("prefix", "h", "salt")
    if whole:
        ranged = ranged.withColumn("norm", F.regexp_replace(F.coalesce(F.col("row").getField(text_col), F.lit("")), BLANK, ""))
    order = ["norm", F.desc("len"), "doc_id", "place"]
    w = Window.partitionBy("prefix", "h", "salt").orderBy(*order)
    rows = ranged.sortWithinPartitions("prefix", "h", "salt", *order).withColumn("head", F.coalesce(F.col("norm") != F.lag("norm").over(w), F.lit(True)))
    rows = rows.withColumn("run", F.sum(F.col("head").cast("int")).over(w))
    cut = F.col("copies").isNotNull()
    own = ["row"] if whole else []
    rows = rows.select(*own, "doc_id", "len", *_RUN, "head", cut.alias("cut"), F.sha2("norm", 256).alias("sha"), F.when(F.col("head") & cut, F.col("norm")).alias("norm"))
    if whole:
        rows = rows.filter("head").withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(None).cast("long"))
    else:  # Runs lie within the partitions, so this is no exchange.
        in_run = Window.partitionBy(*_RUN)
        rows = rows.withColumn("keep_id", F.max(F.when(F.col("head"), F.col("doc_id"))).over(in_run)).withColumn("group_size", F.count("*").over(in_run))
    seen = checkpointed(rows)

    # One row for each run of the cut groups; only those carry their text.
    parts = seen.filter("cut AND head").select(*_RUN, "doc_id", "len", "norm", "sha", "group_size")
    group = Window.partitionBy("sha", "norm")
    best = group.orderBy(F.desc("len"), "doc_id", "salt")
    decided = parts.select(
        *_RUN, F.first("doc_id").over(best).alias("best_id"), F.sum("group_size").over(group).alias("whole_size"), (F.row_number().over(best) == 1).alias("best"),
    )
    rows = seen.drop("norm").join(F.broadcast(decided), _RUN, "left")
    return rows.select(
        *own, "doc_id", (F.col("head") & F.coalesce("best", F.lit(True))).alias("kept"),
        F.when(F.col("cut"), F.col("best_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("whole_size", "group_size").alias("group_size"), "sha",
    )


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    return _runs(docs, id_col, text_col, False).select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return _runs(docs, id_col, text_col, True).filter("kept").select("row.*")


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(body) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
