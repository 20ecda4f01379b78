"""Comparisons that are kept: only pairs whose texts are not those of last time are compared again."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.plans.pairs import compared

#: How a pair stands to the kept comparison.
STATES = ("same", "changed", "new", "gone")


def fingerprints(pairs: DataFrame) -> DataFrame:
    """(pair_id, old_key, new_key): hashes of both texts; a missing text differs from an empty one."""
    key = lambda c: F.coalesce(F.sha2(c, 256), F.lit("")).alias(c.replace("md", "key"))
    return pairs.select("pair_id", key("old_md"), key("new_md"))


def states(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """(pair_id, state) of all pairs of now and of the kept fingerprints. Only ids and hashes are shuffled."""
    was = kept.select("pair_id", F.struct("old_key", "new_key").alias("was"))
    now = fingerprints(pairs).select("pair_id", F.struct("old_key", "new_key").alias("now"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("was") == F.col("now"), "same").otherwise("changed")
    return now.join(was, "pair_id", "full").select("pair_id", state.alias("state"))


def refreshed(pairs: DataFrame, kept: DataFrame, changes: DataFrame, columns: Iterable[str] = (), keep: str = "all") -> tuple[DataFrame, DataFrame]:
    """(changes of all pairs of now, their fingerprints), where kept and changes are those of last time.

    Changes of pairs that are the same are taken over, those of gone pairs go, and the others are compared.
    columns and keep: those of ``compared`` by which changes was made.
    """
    known = states(pairs, kept)
    redo = pairs.join(known.filter("state IN ('changed', 'new')").select("pair_id"), "pair_id", "left_semi")
    stay = changes.join(known.filter("state = 'same'").select("pair_id"), "pair_id", "left_semi").select(changes.columns)
    return stay.unionByName(compared(redo, columns=columns, keep=keep).select(changes.columns)), fingerprints(pairs)
