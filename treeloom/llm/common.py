"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds as arrays at one time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, named by ``spark.checkpoint.dir``. Only in local mode, as in tests, a temporary one stands in for it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="ckpt"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of docs, null texts as empty ones; other columns go, so their names cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(texts: list[str], limit: int = SLICE_BYTES):
    """(first, last) positions that cut texts into runs of about limit characters; a longer text stands alone."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t)
        if i > first and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first, last, texts) of runs of a string column of about limit bytes; only one run's texts are Python strings at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    first = size = 0
    for i, n in enumerate(sizes):
        if i > first and size + n > limit:
            yield first, i, column.slice(first, i - first).to_pylist()
            first, size = i, 0
        size += n
    if first < len(sizes):
        yield first, len(sizes), column.slice(first).to_pylist()


def held_out(doc_id) -> F.Column:
    """Whether a document is held out of training; one without an id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def drawn(rows: DataFrame, group: str, most: int, counts: dict | None = None) -> DataFrame:
    """The rows of each group with the smallest hashes h, most of them at most.

    rows: different (group, h), h a 64-bit hash; so what repeats must have been made
    one row before. Only hashes in a share of their range meet in one task, one that
    holds most of a group's rows and eight standard deviations more. The groups must be few.
    """
    if counts is None:
        counts = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    share = [F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (most + 8 * most**0.5 + 32) / max(1, n)))]
    if not share:
        return rows.limit(0)
    near = rows.filter((F.col("h").cast("double") + 2.0**63) / 2.0**64 <= F.create_map(*share)[F.col(group)])
    return near.withColumn("__at", F.row_number().over(Window.partitionBy(group).orderBy("h"))).filter(F.col("__at") <= most).drop("__at")


def unused(name: str, taken: list[str]) -> str:
    """name, with underscores before it until no column of taken is called so (columns compare without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


#: Rows of a few numbers each that may be broadcast, some ten MB.
MOST_BROADCAST = 1_000_000


def broadcast_if_small(rows: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """rows, marked for a broadcast only if a count shows that there are no more than most; beyond that they are shuffled as usual."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def hot_keys(counts: DataFrame, key: str, rows: int, least: int = 1000) -> DataFrame:
    """(key, salts) of the keys with so many rows that they are cut, each salt of about the same size.

    counts: key, n. The result has 8 x partitions rows at most (rows / that size), so it may be broadcast.
    """
    partitions = max(1, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    most = max(least, -(-rows // (8 * partitions)))
    return counts.filter(F.col("n") >= most).select(key, F.ceil(F.col("n") / most).cast("int").alias("salts"))


def salted_join(many: DataFrame, one: DataFrame, key: str, hot: DataFrame, spread: str, how: str = "left") -> DataFrame:
    """many joined to one (a row for each key), with hot keys (``hot_keys``) cut by the hash of many's column spread."""
    left = many.join(F.broadcast(hot), key, "left").withColumn("salt", F.pmod(F.xxhash64(spread), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    right = one.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return left.join(right, [key, "salt"], how).drop("salt")
