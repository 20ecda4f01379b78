"""Comparison of a table of document pairs, and what is made of its changes.

``compared`` is one pass over rows (pair_id, old_md, new_md): a pair is a row, so
nothing is shuffled, and a pair too large for its budgets degrades by itself.
Texts of any length are compared; only the reader of files has a limit.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.plans import detail, engine, rows
from treeloom.plans.document import UNREADABLE, Document, Node, readable
from treeloom.sources.inline import plain

CHANGE = pa.struct(
    [
        ("change_id", pa.string()), ("parent_change_id", pa.string()), ("ord", pa.int32()), ("entity", pa.string()), ("kind", pa.string()), ("op", pa.string()),
        ("old_id", pa.string()), ("new_id", pa.string()), ("old_line", pa.int32()), ("old_end", pa.int32()), ("new_line", pa.int32()), ("new_end", pa.int32()),
        ("title", pa.string()), ("pair_kind", pa.string()), ("match_kind", pa.string()), ("score", pa.float64()), ("move_id", pa.string()), ("role", pa.string()),
        ("renamed", pa.bool_()), ("reordered", pa.bool_()), ("self_changed", pa.bool_()), ("below_changed", pa.bool_()), ("meta_changed", pa.bool_()), ("inline_changed", pa.bool_()), ("degraded", pa.bool_()),
        ("warnings", pa.list_(pa.string())),
        ("meta", pa.list_(pa.struct([("path", pa.string()), ("op", pa.string()), ("old_value", pa.string()), ("new_value", pa.string())]))),
        ("spans", pa.list_(pa.struct([("layer", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("op", pa.string()), ("old_text", pa.string()), ("new_text", pa.string())]))),
    ]
)
_SCHEMA = (
    "pair_id long, change_id string, parent_change_id string, ord int, entity string, kind string, op string, old_id string, new_id string, old_line int, old_end int, new_line int, new_end int, title string, "
    "pair_kind string, match_kind string, score double, move_id string, role string, renamed boolean, reordered boolean, self_changed boolean, below_changed boolean, meta_changed boolean, inline_changed boolean, degraded boolean, "
    "warnings array<string>, meta array<struct<path:string,op:string,old_value:string,new_value:string>>, spans array<struct<layer:string,row:int,col:int,op:string,old_text:string,new_text:string>>"
)


#: Rows from which on a batch is handed over: a pair alone has few of them.
BATCH_ROWS = 4096


def _batched(rows: Iterable[tuple], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of many pairs as Arrow batches."""
    kept: list[tuple] = []
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*kept, strict=True), kinds, strict=True)], names)
    for row in rows:
        kept.append(row)
        if len(kept) >= BATCH_ROWS:
            yield made()
            kept.clear()
    if kept:
        yield made()


def said(x) -> str | None:
    """A value of metadata as text."""
    return None if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, sort_keys=True, default=str)


def change_rows(root: engine.Change, warnings: list[str]) -> list[dict]:
    """The tree of changes as rows in document order."""
    ids = {id(c): f"c{i}" for i, c in enumerate(engine.walk(root))}
    up = {id(x): ids[id(c)] for c in engine.walk(root) for x in c.children}
    out = []
    for i, c in enumerate(engine.walk(root)):
        a, b = c.old, c.new
        out.append(
            {
                "change_id": ids[id(c)], "parent_change_id": up.get(id(c)), "ord": i, "entity": c.node.entity, "kind": c.node.kind, "op": c.op,
                "old_id": a and a.id, "new_id": b and b.id, "old_line": a and a.line, "old_end": a and a.end, "new_line": b and b.line, "new_end": b and b.end,
                "title": c.node.title, "pair_kind": c.pair_kind, "match_kind": c.match_kind, "score": c.score, "move_id": c.move_id, "role": c.role,
                "renamed": c.renamed, "reordered": c.reordered, "self_changed": c.self_changed, "below_changed": c.below_changed, "meta_changed": c.meta_changed, "inline_changed": c.inline_changed, "degraded": c.degraded,
                "warnings": c.warnings + (warnings if i == 0 else []),
                "meta": [{"path": p, "op": op, "old_value": said(x), "new_value": said(y)} for p, op, x, y in c.meta],
                "spans": [dict(zip(("layer", "row", "col", "op", "old_text", "new_text"), s, strict=True)) for s in c.spans],
            }
        )
    return out


#: Of one column its value for a change.
_VALUES = {
    "entity": lambda c: c.node.entity, "kind": lambda c: c.node.kind, "title": lambda c: c.node.title,
    "old_id": lambda c: c.old and c.old.id, "new_id": lambda c: c.new and c.new.id, "old_line": lambda c: c.old and c.old.line, "old_end": lambda c: c.old and c.old.end, "new_line": lambda c: c.new and c.new.line, "new_end": lambda c: c.new and c.new.end,
    "old_text": lambda c: c.old and c.old.text,
    "meta": lambda c: [(p, op, said(x), said(y)) for p, op, x, y in c.meta],
}
#: Which changes a table may hold alone: those that show in a view, those of moves, with metadata, spans or warnings; the root stays among those that are counted.
KEPT = {
    "all": lambda c, first: True, "shown": lambda c, first: c.op != "equal" or c.renamed or c.reordered, "counted": lambda c, first: first or c.op != "equal" or c.renamed or c.reordered or bool(c.warnings),
    "moved": lambda c, first: bool(c.move_id), "meta": lambda c, first: bool(c.meta), "spans": lambda c, first: bool(c.spans), "warned": lambda c, first: bool(c.warnings),
}


def some_rows(root: engine.Change, warnings: list[str], columns: list[str], keep: str = "all") -> Iterator[list]:
    """The wanted columns of the wanted changes, in document order."""
    kept = KEPT[keep]
    get = [_VALUES.get(c) or operator.attrgetter(c) for c in columns]
    own = {c: i for i, c in enumerate(columns) if c in ("change_id", "parent_change_id", "ord", "warnings")}
    for c in own.values():
        get[c] = lambda c: None
    root.warnings = root.warnings + warnings
    ids: dict[int, int] = {}
    for i, c in enumerate(engine.walk(root)):
        if "parent_change_id" in own:
            ids.update((id(x), i) for x in c.children)
        if not kept(c, i == 0):
            continue
        row = [f(c) for f in get]
        for name, at in own.items():
            row[at] = f"c{i}" if name == "change_id" else i if name == "ord" else c.warnings if name == "warnings" else f"c{ids[id(c)]}" if id(c) in ids else None
        yield row


def compared(pairs: DataFrame, options: engine.Options | None = None, columns: Iterable[str] = (), keep: str = "all") -> DataFrame:
    """The changes of each pair. Null texts count as empty; an empty table gives an empty result.

    columns: those wanted beside pair_id, all if none is named; keep: which changes are (``KEPT``). What nobody asks for is neither made nor handed over.
    """
    options = options or engine.Options()
    types = {f.name: f.type for f in CHANGE}
    kinds = dict(x.split(" ", 1) for x in _SCHEMA.split(", "))
    names = list(columns) or list(types)
    # Asked for by name alone: the old node's text.
    types["old_text"], kinds["old_text"] = pa.string(), "string"
    look = any(c in ("spans", "inline_changed") for c in names) or keep == "spans"

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for pair_id, old, new in zip(*(batch.column(c).to_pylist() for c in ("pair_id", "old_md", "new_md")), strict=True):
                yield from engine.told(old or "", new or "", options, look, lambda root, c, pair_id=pair_id: ((pair_id, *row) for row in some_rows(root, c.warnings, names, keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(rows_of(batches), [pa.int64(), *(types[c] for c in names)], ["pair_id", *names])

    return pairs.select("pair_id", "old_md", "new_md").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("pair_id", *names)))


_NODE = "entity string, kind string, preorder int, subtree_size int, sibling_index int, depth int, line_start int, line_end int, title string, identifier string, checked boolean, text string, self_hash string, direct_hash string, subtree_hash string, identity_hash string, content_hash string, body_hash string, path_hash string, simhash string, start_offset long, start_column int, end_offset long, end_column int"
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}


def nodes_of(docs: DataFrame, *columns: str) -> DataFrame:
    """Sections and blocks of documents (pair_id, side, md), with places, tokens and hashes.

    columns: those wanted beside pair_id, side, node_id and parent_id, all if none is named; texts, hashes and signatures that nobody asks for are not made.
    """
    kinds = {name: kind for name, kind in map(str.split, f"pair_id long, side string, node_id string, parent_id string, {_NODE}".split(", "))}
    names = ["pair_id", "side", "node_id", "parent_id", *(columns or list(kinds)[4:])]
    heavy = any(c in ("text", "simhash") or c.endswith("_hash") for c in names)
    own = {
        "subtree_size": "size", "sibling_index": "place", "line_start": "line", "line_end": "end", "start_column": "column",
    }

    def value(document: Document, n: Node, c: str):
        if c == "simhash":
            return None if n.sim is None else f"{n.sim:016x}"
        if c.endswith("_hash"):
            return n.hashes[c.removesuffix("_hash")]
        if c.endswith("_offset"):
            return document.offset(n.line, n.column) if c == "start_offset" else document.offset(n.end, n.end_column)
        return getattr(n, own.get(c, c))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for pair_id, side, md in zip(*(batch.column(c).to_pylist() for c in ("pair_id", "side", "md")), strict=True):
                document = readable(md or "", whole=heavy)
                for n in document.nodes:
                    yield (pair_id, side, n.id, n.parent and n.parent.id, *(value(document, n, c) for c in names[4:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(rows_of(batches), [_ARROW[kinds[c]] for c in names], names)

    return docs.select("pair_id", "side", "md").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))


def inlines_of(docs: DataFrame) -> DataFrame:
    """Inline parts of documents (pair_id, side, md) in document order: node_id of their block or heading, depth, kind, text and target (address or identifier). A document that can't be read has one row that says so."""
    names = ["pair_id", "side", "node_id", "ord", "depth", "kind", "text", "target"]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for pair_id, side, md in zip(*(batch.column(c).to_pylist() for c in ("pair_id", "side", "md")), strict=True):
                at, document = 0, readable(md or "")
                if document.root.kind == UNREADABLE:
                    yield pair_id, side, document.root.id, 0, 0, UNREADABLE, document.root.title, ""
                for n in document.nodes:
                    todo = [(0, x) for part in (n.inline, *(c for r in n.rows for _, c in r)) for x in part][::-1]
                    while todo:
                        depth, x = todo.pop()
                        yield pair_id, side, n.id, at, depth, x["type"], plain([x]), x.get("url") or x.get("identifier") or ""
                        at += 1
                        todo += [(depth + 1, c) for c in reversed(x.get("children", []))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(rows_of(batches), [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()], names)

    return docs.select("pair_id", "side", "md").mapInArrow(run, "pair_id long, side string, node_id string, ord int, depth int, kind string, text string, target string")


def statistics(changes: DataFrame) -> DataFrame:
    """Counts of a pair's changes; a move counts once."""
    on = lambda c, name: F.count_if(c).alias(name)
    op = F.col("op")
    return changes.groupBy("pair_id").agg(
        on(op == "insert", "inserts"), on(op == "delete", "deletes"), on(op == "replace", "replaces"), F.countDistinct(F.when(F.col("move_id") != "", F.col("move_id"))).alias("moves"),
        on(F.col("renamed"), "renames"), on(F.col("reordered"), "reorders"), on(op == "meta-update", "meta_updates"), on(F.col("pair_kind") == "match", "matched"), on(F.col("pair_kind") == "aligned", "aligned"),
        F.sum(F.size("warnings")).alias("warnings"),
    )


#: What ``statistics``, ``projected``, ``merged_rows``, ``change_index`` and ``move_peers`` look at.
COUNTED = ("op", "move_id", "renamed", "reordered", "pair_kind", "warnings")
PROJECTED = ("change_id", "ord", "entity", "op", "old_line", "old_end", "new_line", "new_end", "renamed", "reordered")
MERGED = (*PROJECTED, "parent_change_id", "pair_kind", "below_changed", "warnings", "move_id")
INDEXED = ("change_id", "ord", "old_id", "new_id", "pair_kind", "move_id")
ENDS = ("change_id", "move_id", "role", "old_line", "new_line")
# Tones in the order in which they win a line.
TONES = ("delete", "replace", "move", "insert", "meta", "rename", "reorder", "plain")


def tone_of() -> F.Column:
    op = F.col("op")
    return F.when(op.isin("delete", "replace", "move", "insert"), op).when(op == "meta-update", "meta").when(F.col("renamed"), "rename").when(F.col("reordered"), "reorder").otherwise("plain")


def projected(pairs: DataFrame, changes: DataFrame, plain: bool = False) -> DataFrame:
    """Lines of both sides with the change that shows on each: the strongest tone, then the shortest range.

    plain: also changes without a tone show, where no other does.
    """
    sides = []
    for side in ("old", "new"):
        lines = pairs.select("pair_id", F.posexplode(F.split(F.coalesce(f"{side}_md", F.lit("")), "\r?\n", -1)).alias("at", "text")).select("pair_id", F.lit(side).alias("side"), (F.col("at") + 1).alias("line"), "text")
        first = F.when(F.col("renamed") & (F.col("entity") == "section"), F.col(f"{side}_line")).otherwise(F.col(f"{side}_end"))
        shown = changes.filter((F.col(f"{side}_line") > 0) & (F.lit(plain) | (tone_of() != "plain"))).select(
            "pair_id", "change_id", "ord", tone_of().alias("tone"), (first - F.col(f"{side}_line")).alias("span"), F.explode(F.sequence(F.col(f"{side}_line"), F.greatest(first, f"{side}_line"))).alias("line")
        )
        rank = F.array_position(F.array(*(F.lit(x) for x in TONES)), F.col("tone"))
        best = F.row_number().over(Window.partitionBy("pair_id", "line").orderBy(rank, "span", F.col("ord") == 0, "ord"))
        top = shown.withColumn("best", best).filter("best = 1").select("pair_id", "line", "change_id", "tone")
        sides.append(lines.join(top, ["pair_id", "line"], "left").select("pair_id", "side", "line", "text", "change_id", F.coalesce("tone", F.lit("plain")).alias("tone")))
    return sides[0].unionByName(sides[1])


def merged_rows(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """(pair_id, row, old_line, new_line, peer_row): lines of both sides in aligned rows (``plans.rows``), and of a moved line the row of its other end."""
    about = changes.select(
        "pair_id", "change_id", F.when(F.col("parent_change_id").isNotNull(), F.col("change_id")).alias("key"), F.when(F.col("pair_kind") != "none", F.col("pair_kind")).otherwise("").alias("pair_kind"),
        "below_changed", F.array_join("warnings", "|").alias("warnings"), F.when(F.col("op") == "move", F.col("move_id")).otherwise("").alias("moved"),
    )
    lines = projected(pairs, changes, plain=True).join(about, ["pair_id", "change_id"], "left")
    line = F.struct(F.col("line").alias("number"), "text", "key", "tone", F.coalesce("pair_kind", F.lit("")).alias("pair_kind"), F.coalesce("below_changed", F.lit(False)).alias("below_changed"), F.coalesce("warnings", F.lit("")).alias("warnings"), F.coalesce("moved", F.lit("")).alias("moved"))
    whole = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, line))).alias(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair_id, old, new in zip(*(batch.column(c).to_pylist() for c in ("pair_id", "old", "new")), strict=True):
                found = rows.merged([rows.Line(**x) for x in old], [rows.Line(**x) for x in new])
                x, y = ([None if r[k] is None else r[k].number for r in found] for k in (0, 1))
                columns = [pa.array([pair_id] * len(found), pa.int64()), *(pa.array(c, pa.int32()) for c in (range(len(found)), x, y, rows.peers(found)))]
                yield pa.RecordBatch.from_arrays(columns, ["pair_id", "row", "old_line", "new_line", "peer_row"])

    return lines.groupBy("pair_id").agg(whole("old"), whole("new")).mapInArrow(run, "pair_id long, row int, old_line int, new_line int, peer_row int")


def _tone(c: engine.Change) -> str:
    """As ``tone_of``."""
    return c.op if c.op in ("delete", "replace", "move", "insert") else "meta" if c.op == "meta-update" else "rename" if c.renamed else "reorder" if c.reordered else "plain"


_RANK = {x: i for i, x in enumerate(TONES)}


def _on_lines(everything: list[engine.Change], side: str, count: int, plain: bool) -> list[int]:
    """Of each of count lines the place of the change that shows on it, as in ``projected``; -1 where none does."""
    ranges = []
    for i, c in enumerate(everything):
        n = c.old if side == "old" else c.new
        if n is None or n.line <= 0 or (not plain and _tone(c) == "plain"):
            continue
        last = n.line if c.renamed and c.node.entity == "section" else n.end
        ranges.append((_RANK[_tone(c)], last - n.line, i == 0, i, n.line, max(last, n.line)))
    found = [-1] * count
    for _, _, _, i, first, last in sorted(ranges):
        for at in range(first - 1, min(last, count)):
            if found[at] < 0:
                found[at] = i
    return found


def _split(md: str) -> list[str]:
    return re.split(r"\r?\n", md)


def shown_lines(pairs: DataFrame, options: engine.Options | None = None) -> DataFrame:
    """What ``projected`` gives of the pairs and their changes, in the pass that compares: no line is shuffled or written on its way."""
    options = options or engine.Options()

    def lines_of(pair_id: int, texts: tuple[str, str], root: engine.Change) -> Iterator[tuple]:
        everything = list(engine.walk(root))
        for side, md in zip(("old", "new"), texts, strict=True):
            lines = _split(md)
            for at, (text, i) in enumerate(zip(lines, _on_lines(everything, side, len(lines), False), strict=True), 1):
                yield pair_id, side, at, text, None if i < 0 else f"c{i}", "plain" if i < 0 else _tone(everything[i])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for pair_id, old, new in zip(*(batch.column(c).to_pylist() for c in ("pair_id", "old_md", "new_md")), strict=True):
                texts = (old or "", new or "")
                yield from engine.told(*texts, options, False, lambda root, c, pair_id=pair_id, texts=texts: lines_of(pair_id, texts, root))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(rows_of(batches), [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()], ["pair_id", "side", "line", "text", "change_id", "tone"])

    return pairs.select("pair_id", "old_md", "new_md").mapInArrow(run, "pair_id long, side string, line int, text string, change_id string, tone string")


def aligned_rows(pairs: DataFrame, options: engine.Options | None = None) -> DataFrame:
    """What ``merged_rows`` gives of the pairs and their changes, in the pass that compares."""
    options = options or engine.Options()

    def side_of(everything: list[engine.Change], side: str, md: str) -> list[rows.Line]:
        texts = _split(md)
        out = []
        for at, (text, i) in enumerate(zip(texts, _on_lines(everything, side, len(texts), True), strict=True), 1):
            if i < 0:
                out.append(rows.Line(number=at, text=text, key=None, tone="plain", pair_kind="", below_changed=False, warnings="", moved=""))
                continue
            c = everything[i]
            about = {"pair_kind": c.pair_kind if c.pair_kind != "none" else "", "below_changed": c.below_changed, "warnings": "|".join(c.warnings), "moved": c.move_id if c.op == "move" else ""}
            out.append(rows.Line(number=at, text=text, key=f"c{i}" if i else None, tone=_tone(c), **about))
        return out

    def rows_of_pair(pair_id: int, texts: tuple[str, str], root: engine.Change, warnings: list[str]) -> Iterator[tuple]:
        root.warnings = root.warnings + warnings
        everything = list(engine.walk(root))
        found = rows.merged(*(side_of(everything, side, md) for side, md in zip(("old", "new"), texts, strict=True)))
        for at, (r, peer) in enumerate(zip(found, rows.peers(found), strict=True)):
            yield pair_id, at, r[0] and r[0].number, r[1] and r[1].number, peer

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for pair_id, old, new in zip(*(batch.column(c).to_pylist() for c in ("pair_id", "old_md", "new_md")), strict=True):
                texts = (old or "", new or "")
                yield from engine.told(*texts, options, False, lambda root, c, pair_id=pair_id, texts=texts: rows_of_pair(pair_id, texts, root, c.warnings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(rows_of(batches), [pa.int64(), *[pa.int32()] * 4], ["pair_id", "row", "old_line", "new_line", "peer_row"])

    return pairs.select("pair_id", "old_md", "new_md").mapInArrow(run, "pair_id long, row int, old_line int, new_line int, peer_row int")


#: What ``detailed`` shows of one side of a change.
_SIDES = {"lines": detail.highlighted, "code": detail.code_lines, "table": detail.table_rows}


def detailed(pairs: DataFrame, options: engine.Options | None = None, about: bool = False, columns: Iterable[str] = ()) -> DataFrame:
    """What the detail view of each change shows (``plans.detail``); lines, code and tables as JSON, empty where there is none.

    about: also kind, op and renamed of the change, so that they need no comparison of their own. columns: those wanted beside these, pair_id and change_id, all if none is named.
    """
    options = options or engine.Options()
    own = list(columns) or [*(f"{s}_{c}" for c in ("text", *_SIDES) for s in ("old", "new")), "affected_lines"]
    look = own != ["old_text", "new_text"]
    kinds = {"pair_id": "long", "change_id": "string", **{c: "array<int>" if c == "affected_lines" else "string" for c in own}, **({"kind": "string", "op": "string", "renamed": "boolean"} if about else {})}
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}

    def value(x: engine.Change, c: engine.Comparison, name: str):
        if name == "affected_lines":
            return detail.affected_lines(x, c.old, c.new)
        side, what = name.split("_")
        if what == "text":
            return (n := detail.side_of(x, side)) and detail.preview(n)
        return json.dumps(found, ensure_ascii=False) if (found := _SIDES[what](x, side)) else ""

    def rows_of_pair(pair_id: int, root: engine.Change, c: engine.Comparison) -> Iterator[tuple]:
        for i, x in enumerate(engine.walk(root)):
            if x.op != "equal" or x.renamed or x.reordered:
                yield (pair_id, f"c{i}", *(value(x, c, name) for name in own), *((x.node.kind, x.op, x.renamed) if about else ()))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for pair_id, old, new in zip(*(batch.column(c).to_pylist() for c in ("pair_id", "old_md", "new_md")), strict=True):
                yield from engine.told(old or "", new or "", options, look, lambda root, c, pair_id=pair_id: rows_of_pair(pair_id, root, c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(rows_of(batches), [types[k] for k in kinds.values()], list(kinds))

    return pairs.select("pair_id", "old_md", "new_md").mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items()))


def change_index(changes: DataFrame) -> DataFrame:
    """(pair_id, kind, key, change_id): the first change of each old node, new node and pair, and all changes of each move."""
    of = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    pair = F.when(F.col("pair_kind") != "none", F.concat_ws(":", "pair_kind", "old_id", "new_id"))
    keys = F.array(of("old", F.col("old_id")), of("new", F.col("new_id")), of("pair", pair), of("move", F.when(F.col("move_id") != "", F.col("move_id"))))
    listed = changes.select("pair_id", "change_id", "ord", F.explode(keys).alias("x")).select("pair_id", "x.kind", "x.key", "change_id", "ord").filter("key IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("pair_id", "kind", "key").orderBy("ord"))
    return listed.withColumn("at", first).filter("at = 1 OR kind = 'move'").select("pair_id", "kind", "key", "change_id")


def move_peers(changes: DataFrame) -> DataFrame:
    """(pair_id, change_id, peer_id, peer_line): the other end of each move."""
    ends = changes.filter("move_id <> ''").select("pair_id", "change_id", "move_id", "role", F.coalesce("new_line", "old_line").alias("line"))
    other = ends.select("pair_id", "move_id", F.col("role").alias("peer_role"), F.col("change_id").alias("peer_id"), F.col("line").alias("peer_line"))
    return ends.join(other, ["pair_id", "move_id"]).filter("role <> peer_role").select("pair_id", "change_id", "peer_id", "peer_line")


def span_rows(changes: DataFrame) -> DataFrame:
    """(pair_id, change_id, pos, layer, row, col, op, old_text, new_text)."""
    return changes.select("pair_id", "change_id", F.posexplode("spans").alias("pos", "s")).select("pair_id", "change_id", "pos", "s.*")


def metadata_rows(changes: DataFrame) -> DataFrame:
    return changes.select("pair_id", "change_id", F.posexplode("meta").alias("pos", "m")).select("pair_id", "change_id", "pos", "m.*")
