"""A stream of document revisions, each compared with the one before.

State is the last text of a document. Revisions of one document come to one task
(hash of doc_id); within a batch they go by their number, and one that is not newer
than the last is late and dropped from comparison, with a row that says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from treeloom.plans import engine

OUT = "doc_id long, revision long, late boolean, inserts long, deletes long, replaces long, moves long, renames long, meta_updates long"
STATE = "revision long, text string"
_COUNTS = ("inserts", "deletes", "replaces", "moves", "renames", "meta_updates")


def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    revision, text = state.get if state.exists else (-1, "")
    rows = []
    for r in pd.concat(list(frames)).sort_values("revision", kind="stable").itertuples():
        late = r.revision <= revision
        found = dict.fromkeys(_COUNTS, 0)
        if not late:
            found = engine.summary(engine.compare(text or "", r.text or "")[0])
            revision, text = int(r.revision), r.text or ""
        rows.append((key[0], int(r.revision), late, *(found[c] for c in _COUNTS)))
    state.update((revision, text))
    yield pd.DataFrame(rows, columns=["doc_id", "revision", "late", *_COUNTS])


def compared_stream(revisions: DataFrame) -> DataFrame:
    """revisions: a stream of (doc_id, revision, text); one row of counts for each, in append mode."""
    rows = revisions.select("doc_id", "revision", "text")
    return rows.groupBy("doc_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
