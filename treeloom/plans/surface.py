"""Comparisons from SQL text: table functions over tables of document pairs."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType

from treeloom.plans import engine
from treeloom.plans.document import readable

# Analysis runs without a session, so schemas are built by hand.
_TYPES = {"long": LongType(), "int": IntegerType(), "boolean": BooleanType(), "string": StringType()}


def _schema(fields: str) -> StructType:
    out = StructType()
    for name, kind in map(str.split, fields.split(", ")):
        out = out.add(name, _TYPES[kind])
    return out


_CHANGES = _schema("pair_id long, op string, kind string, renamed boolean, old_line int, new_line int, old_text string, new_text string")
_OUTLINE = _schema("pair_id long, preorder int, entity string, kind string, depth int, line int, title string")


def _column(table: AnalyzeArgument, name: str) -> str:
    if not table.isTable or name not in [f.name for f in table.dataType.fields]:
        raise ValueError(f"a table with the column {name} is wanted")
    return name


@udtf
class MarkdownChanges:
    """markdown_changes(TABLE(t)): t has pair_id, old_md, new_md; a row for each change. Null texts are empty."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        for name in ("pair_id", "old_md", "new_md"):
            _column(table, name)
        return AnalyzeResult(schema=_CHANGES)

    def eval(self, row):
        root, _ = engine.compare(row["old_md"] or "", row["new_md"] or "")
        for c in engine.walk(root):
            if c.op != "equal" or c.renamed:
                yield row["pair_id"], c.op, c.node.kind, c.renamed, c.old and c.old.line, c.new and c.new.line, c.old and c.old.text, c.new and c.new.text


@udtf
class MarkdownOutline:
    """markdown_outline(TABLE(t)): t has pair_id, md; a row for each section and block."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        for name in ("pair_id", "md"):
            _column(table, name)
        return AnalyzeResult(schema=_OUTLINE)

    def eval(self, row):
        for n in readable(row["md"] or "").nodes:
            yield row["pair_id"], n.preorder, n.entity, n.kind, n.depth, n.line, n.title


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session. A pair is a row, so they need no PARTITION BY and shuffle nothing."""
    spark.udtf.register("markdown_changes", MarkdownChanges)
    spark.udtf.register("markdown_outline", MarkdownOutline)
