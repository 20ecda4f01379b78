"""Queries over changes: whole comparisons of Markdown pairs, edit scripts, metadata, moves, renames and projections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import text as t
from treeloom.operators import matching as m
from treeloom.operators import tree
from treeloom.plans import kernels, pairs, report
from treeloom.plans.engine import WHOLE
from treeloom.plans.stages import dealt, materialized
from treeloom.plans.text_queries import _title
from treeloom.plans.tree_queries import EXACT_SQL, HASHES_SQL, _alike, _exact, _hashed, _nodes, _unique
from treeloom.sources.ledgers import LEDGER_TREES_SQL, ledger_trees
from treeloom.sources.tables import LINES_SQL, TREES_SQL, line_rule, line_versions, lines, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- Markdown pairs: kernels within a pair, so there is no SQL for them; tests hold them against fixtures


def markdown_pairs(spark, sf_dir) -> DataFrame:
    """(pair_id, old_md, new_md): a document's two line versions; some whole lines become headings or items, the others stay as they are."""
    v = line_versions(table(spark, sf_dir, "documents"))
    line = F.col("text")
    md = F.when(F.length(line) % 5 == 0, F.concat(F.lit("## "), line)).when(F.length(line) % 5 == 1, F.concat(F.lit("- [ ] "), line)).otherwise(line)
    whole = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("pos", "md")))), lambda x: x["md"]), "\n\n").alias(f"{s}_md")
    return dealt(v.select(F.col("doc_id").alias("pair_id"), "side", "pos", md.alias("md")), "pair_id").groupBy("pair_id").agg(whole("old"), whole("new"))


@query()
def markdown_changes(spark, sf_dir):
    c = pairs.compared(markdown_pairs(spark, sf_dir), WHOLE, columns=[f.name for f in pairs.CHANGE if f.name not in ("warnings", "meta", "spans")])
    return c.withColumn("score", F.round("score", 6))


@query()
def markdown_stats(spark, sf_dir):
    return pairs.statistics(pairs.compared(markdown_pairs(spark, sf_dir), WHOLE, columns=pairs.COUNTED))


@query()
def markdown_nodes(spark, sf_dir):
    both = markdown_pairs(spark, sf_dir)
    return pairs.nodes_of(both.select("pair_id", F.lit("old").alias("side"), F.col("old_md").alias("md")))


@query()
def markdown_spans(spark, sf_dir):
    return pairs.span_rows(pairs.compared(markdown_pairs(spark, sf_dir), WHOLE, columns=("change_id", "spans"), keep="spans"))


@query()
def markdown_projection(spark, sf_dir):
    return pairs.shown_lines(markdown_pairs(spark, sf_dir), WHOLE)


@query()
def markdown_merged_rows(spark, sf_dir):
    return pairs.aligned_rows(markdown_pairs(spark, sf_dir), WHOLE).fillna(-1, ["old_line", "new_line", "peer_row"])


@query()
def markdown_details(spark, sf_dir):
    return pairs.detailed(markdown_pairs(spark, sf_dir), WHOLE)


@query()
def markdown_change_index(spark, sf_dir):
    return pairs.change_index(pairs.compared(markdown_pairs(spark, sf_dir), WHOLE, columns=pairs.INDEXED))


@query()
def markdown_move_peers(spark, sf_dir):
    return pairs.move_peers(materialized(pairs.compared(markdown_pairs(spark, sf_dir), WHOLE, columns=pairs.ENDS, keep="moved")))


def _scripts(spark, sf_dir, strategy: str) -> DataFrame:
    """(doc_id, n_equal, n_delete, n_insert, script) of each document's line versions."""
    v = line_versions(table(spark, sf_dir, "documents"))
    whole = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("pos", "text")))), lambda x: x["text"]).alias(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for old, new in zip(batch.column("old").to_pylist(), batch.column("new").to_pylist(), strict=True):
                ops = "".join(op[0] for op, _, _ in kernels.align(old, new, strategy))
                out.append((ops.count("e"), ops.count("d"), ops.count("i"), ops))
            a, b, c, s = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (a, b, c)), pa.array(s, pa.string())], ["doc_id", "n_equal", "n_delete", "n_insert", "script"])

    rows = v.groupBy("doc_id").agg(whole("old"), whole("new"))
    return rows.mapInArrow(run, "doc_id long, n_equal long, n_delete long, n_insert long, script string")


@query()
def myers_edit_script(spark, sf_dir):
    return _scripts(spark, sf_dir, "myers")


@query()
def heckel_align(spark, sf_dir):
    return _scripts(spark, sf_dir, "heckel")


@query()
def histogram_align(spark, sf_dir):
    return _scripts(spark, sf_dir, "histogram")


@query()
def reorder_marks(spark, sf_dir):
    """Lines unique on both sides that leave the longest run in common order."""
    rows = m.unique_shared(line_versions(table(spark, sf_dir, "documents")).withColumn("hash", F.md5(F.col("text").cast("binary"))), "doc_id", "hash", "pos")
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("old_id", "new_id"))).alias("pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                steady = set(kernels.longest_increasing([p["new_id"] for p in found]))
                out += [(doc_id, p["old_id"], p["new_id"], i not in steady) for i, p in enumerate(found)]
            a, b, c, d = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int32()), pa.array(d, pa.bool_())], ["doc_id", "old_pos", "new_pos", "reordered"])

    return listed.mapInArrow(run, "doc_id long, old_pos int, new_pos int, reordered boolean")


# A longest increasing run, by the smallest last value of a run of each length; of values in order.
_RUN = "list_reduce(list_prepend([]::INT[], [[v] for v in {0}]), lambda runs, v: list_concat(list_concat(runs[1:len(list_filter(runs, lambda t: t < v[1]))], v), runs[len(list_filter(runs, lambda t: t < v[1])) + 2:]))"


@query(f"""
WITH {LINES_SQL}, met AS (SELECT o.doc_id, o.pos AS i, n.pos AS j FROM versions o JOIN versions n ON n.doc_id = o.doc_id AND n.text = o.text AND o.side = 'old' AND n.side = 'new'),
common AS (SELECT doc_id, len({_RUN.format('js')}) AS n FROM (SELECT doc_id, list(j ORDER BY i, j DESC) AS js FROM met GROUP BY doc_id)),
sizes AS (SELECT doc_id, count(*) FILTER (WHERE side = 'old') AS o, count(*) FILTER (WHERE side = 'new') AS n FROM versions GROUP BY doc_id)
SELECT doc_id, coalesce(c.n, 0)::BIGINT AS n_equal, (o - coalesce(c.n, 0))::BIGINT AS n_delete, (s.n - coalesce(c.n, 0))::BIGINT AS n_insert FROM sizes s LEFT JOIN common c USING (doc_id)""")
def shortest_edit_counts(spark, sf_dir):
    """How many lines a shortest script keeps, takes out and puts in."""
    return _scripts(spark, sf_dir, "myers").drop("script")


@query(f"""
WITH {LINES_SQL}, once AS (SELECT doc_id, text, min(pos) FILTER (WHERE side = 'old') AS i, min(pos) FILTER (WHERE side = 'new') AS j FROM versions GROUP BY ALL HAVING count(*) FILTER (WHERE side = 'old') = 1 AND count(*) FILTER (WHERE side = 'new') = 1)
SELECT doc_id, n AS lines, (n - len({_RUN.format('js')}))::BIGINT AS reordered FROM (SELECT doc_id, count(*) AS n, list(j ORDER BY i) AS js FROM once GROUP BY doc_id)""")
def reorder_counts(spark, sf_dir):
    """Lines that are unique on both sides, and how many of them leave the longest run in common order."""
    return reorder_marks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("reordered").alias("reordered"))


# -- trees and tables


@query(f"""WITH {HASHES_SQL}
SELECT o.pair_id, o.node_id, o.checked AS old_checked, n.checked AS new_checked FROM nodes o JOIN nodes n ON n.pair_id = o.pair_id AND n.parent_id = o.parent_id AND n.text = o.text AND n.sibling_index = o.sibling_index
WHERE o.side = 'old' AND n.side = 'new' AND o.kind = 'listItem' AND o.checked <> n.checked""")
def checkbox_meta(spark, sf_dir):
    """Items that stand at one place with one text, and whose checkbox changed."""
    nodes = materialized(_nodes(spark, sf_dir).filter("kind = 'listItem'").select("pair_id", "side", F.col("name").alias("node_id"), F.col("parent_name").alias("parent_id"), "text", "sibling_index", "checked"))
    new = nodes.filter("side = 'new'").select("pair_id", "parent_id", "text", "sibling_index", F.col("checked").alias("new_checked"))
    old = nodes.filter("side = 'old'").select("pair_id", "node_id", "parent_id", "text", "sibling_index", F.col("checked").alias("old_checked"))
    return old.join(new, ["pair_id", "parent_id", "text", "sibling_index"]).filter("old_checked <> new_checked").select("pair_id", "node_id", "old_checked", "new_checked")


_HEADS = f"""{HASHES_SQL}, bodies AS (SELECT pair_id, body_hash, old_id, new_id FROM ({_unique("(SELECT * FROM nodes WHERE kind = 'heading' AND body_hash <> md5(''))", 'pair_id', 'body_hash', 'node_id')}) WHERE n_old = 1 AND n_new = 1)"""


@query(f"""WITH {_HEADS} SELECT b.pair_id, b.old_id, b.new_id, {_title('o.title')} AS old_title, {_title('n.title')} AS new_title FROM bodies b
JOIN nodes o ON o.pair_id = b.pair_id AND o.side = 'old' AND o.node_id = b.old_id JOIN nodes n ON n.pair_id = b.pair_id AND n.side = 'new' AND n.node_id = b.new_id WHERE {_title('o.title')} <> {_title('n.title')}""")
def rename_recovery(spark, sf_dir):
    """Headings whose body is unique on both sides and whose name changed."""
    nodes = _hashed(spark, sf_dir).filter((F.col("kind") == "heading") & (F.col("body_hash") != F.md5(F.lit("").cast("binary")))).withColumn("norm", t.normalize_heading_title(F.col("title")))
    nodes = materialized(nodes.select("pair_id", "side", "node_id", "body_hash", "norm"))
    name = lambda s: nodes.filter(F.col("side") == s).select("pair_id", F.col("node_id").alias(f"{s}_id"), F.col("norm").alias(f"{s}_title"))
    found = m.unique_shared(nodes, "pair_id", "body_hash", "node_id").join(name("old"), ["pair_id", "old_id"]).join(name("new"), ["pair_id", "new_id"])
    return found.filter("old_title <> new_title").select("pair_id", "old_id", "new_id", "old_title", "new_title")


_MOVES = EXACT_SQL.replace(TREES_SQL, LEDGER_TREES_SQL)


def _move_nodes(spark, sf_dir) -> DataFrame:
    """The ledgers' nodes with hashes, without what moves don't look at: texts end in the hashes, and hashes are bytes."""
    own = ["pair_id", "side", "node_id", "parent_id", "kind", "depth"]
    trees = ledger_trees(spark, sf_dir).withColumn("self_hash", tree.self_hash()).select(*own, "sibling_index", "self_hash")
    nodes = tree.hashed(materialized(trees, "pair_id"))
    return materialized(nodes.select(*own, *(F.unhex(c).alias(c) for c in ("self_hash", "direct_hash", "subtree_hash"))), "pair_id")


@query(f"""WITH {_MOVES}, taken AS (SELECT pair_id, 'old' AS side, old_id AS node_id FROM exact UNION ALL SELECT pair_id, 'new', new_id FROM exact),
loose AS (SELECT n.* FROM nodes n WHERE depth > 0 AND NOT EXISTS (SELECT 1 FROM taken x WHERE x.pair_id = n.pair_id AND x.side = n.side AND x.node_id = n.node_id) AND NOT EXISTS (SELECT 1 FROM taken x WHERE x.pair_id = n.pair_id AND x.side = n.side AND x.node_id = n.parent_id)),
found AS (SELECT pair_id, old_id, new_id FROM exact UNION ALL SELECT pair_id, old_id, new_id FROM ({_unique('loose', 'pair_id', 'self_hash', 'node_id')}) WHERE n_old = 1 AND n_new = 1)
SELECT v.pair_id, v.old_id, v.new_id, CASE WHEN o.subtree_hash = n.subtree_hash THEN 'move-exact' WHEN o.kind = 'heading' AND o.direct_hash = n.direct_hash THEN 'move-direct' ELSE 'move-self' END AS move_kind
FROM found v JOIN nodes o ON o.pair_id = v.pair_id AND o.side = 'old' AND o.node_id = v.old_id JOIN nodes n ON n.pair_id = v.pair_id AND n.side = 'new' AND n.node_id = v.new_id WHERE o.parent_id <> n.parent_id""")
def move_candidates(spark, sf_dir):
    """Equal subtrees, and other nodes whose self is unique on both sides, under another parent."""
    nodes = _move_nodes(spark, sf_dir)
    exact = _exact(nodes)
    loose = m.uncovered(nodes.filter("depth > 0"), exact)
    of = lambda s: nodes.filter(F.col("side") == s).select("pair_id", F.col("node_id").alias(f"{s}_id"), *(F.col(c).alias(f"{s}_{c}") for c in ("parent_id", "kind", "subtree_hash", "direct_hash")))
    found = exact.select("pair_id", "old_id", "new_id").unionByName(m.unique_shared(loose, "pair_id", "self_hash", "node_id").select("pair_id", "old_id", "new_id"))
    found = found.join(of("old"), ["pair_id", "old_id"]).join(of("new"), ["pair_id", "new_id"]).filter("old_parent_id <> new_parent_id")
    kind = F.when(F.col("old_subtree_hash") == F.col("new_subtree_hash"), "move-exact").when((F.col("old_kind") == "heading") & (F.col("old_direct_hash") == F.col("new_direct_hash")), "move-direct").otherwise("move-self")
    return found.select("pair_id", "old_id", "new_id", kind.alias("move_kind"))


@query(f"""WITH {HASHES_SQL}, both_sides AS (SELECT pair_id, self_hash, kind, count(*) FILTER (WHERE side = 'old') AS o, count(*) FILTER (WHERE side = 'new') AS n FROM nodes WHERE depth > 0 GROUP BY ALL)
SELECT pair_id, kind, sum(greatest(o - n, 0))::BIGINT AS deletes, sum(greatest(n - o, 0))::BIGINT AS inserts, sum(least(o, n))::BIGINT AS kept FROM both_sides GROUP BY ALL""")
def tree_change_stats(spark, sf_dir):
    """Per pair and kind: selves that went, came and stayed."""
    on = lambda s: F.count(F.when(F.col("side") == s, 1))
    c = trees_selves(spark, sf_dir).groupBy("pair_id", "self_hash", "kind").agg(on("old").alias("o"), on("new").alias("n"))
    zero = F.lit(0)
    return c.groupBy("pair_id", "kind").agg(F.sum(F.greatest(F.col("o") - F.col("n"), zero)).alias("deletes"), F.sum(F.greatest(F.col("n") - F.col("o"), zero)).alias("inserts"), F.sum(F.least("o", "n")).alias("kept"))


def trees_selves(spark, sf_dir):
    from treeloom.sources.tables import trees

    return trees(spark, sf_dir).filter("depth > 0").withColumn("self_hash", tree.self_hash()).select("pair_id", "side", "kind", "self_hash")


@query(f"""WITH {HASHES_SQL} SELECT 'parent-missing' AS rule, count(*) AS broken FROM nodes c WHERE depth > 0 AND NOT EXISTS (SELECT 1 FROM nodes p WHERE p.pair_id = c.pair_id AND p.side = c.side AND p.node_id = c.parent_id)
UNION ALL SELECT 'node-repeats', count(*) FROM (SELECT 1 FROM nodes GROUP BY pair_id, side, node_id HAVING count(*) > 1)
UNION ALL SELECT 'sibling-gap', count(*) FROM (SELECT 1 FROM nodes WHERE depth > 0 GROUP BY pair_id, side, parent_id HAVING max(sibling_index) + 1 <> count(*))
UNION ALL SELECT 'depth-step', count(*) FROM nodes c JOIN nodes p ON p.pair_id = c.pair_id AND p.side = c.side AND p.node_id = c.parent_id WHERE c.depth <> p.depth + 1""")
def validate_tree(spark, sf_dir):
    """How often a rule of well-formed trees is broken."""
    from treeloom.sources.tables import trees

    nodes = materialized(trees(spark, sf_dir).select("pair_id", "side", "node_id", "parent_id", "depth", "sibling_index"))
    up = nodes.select("pair_id", "side", F.col("node_id").alias("parent_id"), F.col("depth").alias("above"))
    below = nodes.filter("depth > 0")
    rules = {
        "parent-missing": below.join(up, ["pair_id", "side", "parent_id"], "left_anti"), "node-repeats": nodes.groupBy("pair_id", "side", "node_id").count().filter("count > 1"),
        "sibling-gap": below.groupBy("pair_id", "side", "parent_id").agg(F.max("sibling_index").alias("top"), F.count("*").alias("n")).filter("top + 1 <> n"),
        "depth-step": below.join(up, ["pair_id", "side", "parent_id"]).filter("depth <> above + 1"),
    }
    counted = [rows.agg(F.count("*").alias("broken")).select(F.lit(rule).alias("rule"), "broken") for rule, rows in rules.items()]
    return counted[0].union(counted[1]).union(counted[2]).union(counted[3])


_CELLS = ("c_name", "c_mktsegment", "c_nationkey")


@query("""
WITH o AS (SELECT c_custkey AS r, unnest(['c_name', 'c_mktsegment', 'c_nationkey']) AS c, unnest([c_name, c_mktsegment, c_nationkey::VARCHAR]) AS v FROM customer),
n AS (SELECT c_custkey AS r, unnest(['c_name', 'c_mktsegment', 'c_nationkey']) AS c, unnest([c_name, CASE WHEN c_custkey % 9 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END, CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE c_nationkey::VARCHAR END]) AS v FROM customer WHERE c_custkey % 10 <> 3)
SELECT coalesce(o.r, n.r) AS row_key, coalesce(o.c, n.c) AS col_key, CASE WHEN n.r IS NULL THEN 'delete' WHEN o.r IS NULL THEN 'insert' ELSE 'replace' END AS op, coalesce(o.v, '') AS old_value, coalesce(n.v, '') AS new_value
FROM o FULL JOIN n ON o.r = n.r AND o.c = n.c WHERE o.v IS DISTINCT FROM n.v OR o.r IS NULL OR n.r IS NULL""")
def table_cell_diff(spark, sf_dir):
    """Cells of two versions of a table that differ, by row and column key; rows that went or came give all their cells."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_nationkey").cast("string").alias("c_nationkey"))
    n = c.filter("c_custkey % 10 <> 3").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 9 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))).withColumn("c_nationkey", F.when(F.col("c_custkey") % 14 != 0, F.col("c_nationkey")))
    cells = lambda x, v: x.select(F.col("c_custkey").alias("row_key"), F.explode(F.array(*(F.struct(F.lit(k).alias("col_key"), F.col(k).alias(v)) for k in _CELLS))).alias("x")).select("row_key", "x.*", F.lit(True).alias(f"has_{v}"))
    rows = cells(c, "o").join(cells(n, "n"), ["row_key", "col_key"], "full")
    op = F.when(F.col("has_n").isNull(), "delete").when(F.col("has_o").isNull(), "insert").otherwise("replace")
    same = F.col("o").eqNullSafe(F.col("n")) & F.col("has_o").isNotNull() & F.col("has_n").isNotNull()
    return rows.filter(~same).select("row_key", "col_key", op.alias("op"), F.coalesce("o", F.lit("")).alias("old_value"), F.coalesce("n", F.lit("")).alias("new_value"))


@query("""
WITH steps AS (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_id, event_type, props FROM events),
leaves AS (SELECT event_id, 'k' AS leaf, json_extract_string(props, '$.k') AS v FROM steps UNION ALL SELECT event_id, 'type', event_type FROM steps),
old AS (SELECT s.event_id, l.leaf, l.v FROM steps s JOIN leaves l ON l.event_id = s.before_id WHERE l.v IS NOT NULL),
new AS (SELECT s.event_id, l.leaf, l.v FROM steps s JOIN leaves l ON l.event_id = s.event_id WHERE s.before_id IS NOT NULL AND l.v IS NOT NULL)
SELECT coalesce(o.event_id, n.event_id) AS event_id, '$.' || coalesce(o.leaf, n.leaf) AS path, CASE WHEN n.leaf IS NULL THEN 'delete' WHEN o.leaf IS NULL THEN 'insert' ELSE 'replace' END AS op, coalesce(o.v, '') AS old_value, coalesce(n.v, '') AS new_value
FROM old o FULL JOIN new n ON n.event_id = o.event_id AND n.leaf = o.leaf WHERE o.v IS DISTINCT FROM n.v""")
def metadata_diff(spark, sf_dir):
    """Leaves of an event's metadata that differ from those of its user's last event."""
    e = table(spark, sf_dir, "events")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = e.select("event_id", before.alias("before_id"), "event_type", "props")
    leaf = lambda name, v: F.struct(F.lit(name).alias("leaf"), v.alias("v"))
    leaves = steps.select("event_id", "before_id", F.explode(F.array(leaf("k", F.get_json_object("props", "$.k")), leaf("type", F.col("event_type")))).alias("x")).select("event_id", "before_id", "x.*").filter("v IS NOT NULL")
    old = steps.select("event_id", "before_id").join(leaves.select(F.col("event_id").alias("before_id"), "leaf", F.col("v").alias("o")), "before_id").select("event_id", "leaf", "o")
    new = leaves.filter("before_id IS NOT NULL").select("event_id", "leaf", F.col("v").alias("n"))
    op = F.when(F.col("n").isNull(), "delete").when(F.col("o").isNull(), "insert").otherwise("replace")
    rows = old.join(new, ["event_id", "leaf"], "full").filter(~F.col("o").eqNullSafe(F.col("n")))
    return rows.select("event_id", F.concat(F.lit("$."), "leaf").alias("path"), op.alias("op"), F.coalesce("o", F.lit("")).alias("old_value"), F.coalesce("n", F.lit("")).alias("new_value"))


# -- projections

_TONES = ", ".join(f"'{x}'" for x in pairs.TONES)
_RANGES = f"""{LINES_SQL}, sized AS (SELECT doc_id, max(ln) AS top FROM lines GROUP BY doc_id),
changes AS (SELECT l.doc_id, ln AS ord, ln AS first, least(ln + (ln + l.doc_id) % 5, top) AS last, [{_TONES}][1 + (ln + l.doc_id) % 8] AS tone, (ln + l.doc_id) % 8 AS rank FROM lines l JOIN sized s ON s.doc_id = l.doc_id WHERE ln % 3 = 0),
shown AS (SELECT doc_id, ord, tone, unnest(range(first, last + 1))::INT AS ln, rank, last - first AS span FROM changes),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ln ORDER BY rank, span, ord) AS r FROM shown) WHERE r = 1)"""


def _shown(spark, sf_dir):
    """Ranges of lines with a tone, as points: (doc_id, ord, tone, ln, rank, span)."""
    all_lines = lines(table(spark, sf_dir, "documents")).select("doc_id", "ln")
    top = all_lines.groupBy("doc_id").agg(F.max("ln").alias("top"))
    rank = (F.col("ln") + F.col("doc_id")) % 8
    tone = F.element_at(F.array(*(F.lit(x) for x in pairs.TONES)), (rank + 1).cast("int"))
    c = all_lines.filter("ln % 3 = 0").join(top, "doc_id").select("doc_id", F.col("ln").alias("ord"), tone.alias("tone"), rank.alias("rank"), F.col("ln").alias("first"), F.least(F.col("ln") + (F.col("ln") + F.col("doc_id")) % 5, F.col("top").cast("long")).cast("int").alias("last"))
    return all_lines, c.select("doc_id", "ord", "tone", "rank", (F.col("last") - F.col("first")).alias("span"), F.explode(F.sequence("first", "last")).alias("ln"))


def _best(shown):
    r = F.row_number().over(Window.partitionBy("doc_id", "ln").orderBy("rank", "span", "ord"))
    return shown.withColumn("r", r).filter("r = 1").drop("r")


@query(f"WITH {_RANGES} SELECT l.doc_id, l.ln, coalesce(b.tone, 'plain') AS tone, coalesce(b.ord, -1)::INT AS change_ord FROM lines l LEFT JOIN best b ON b.doc_id = l.doc_id AND b.ln = l.ln")
def line_projection(spark, sf_dir):
    """Each line with the change that shows on it."""
    all_lines, shown = _shown(spark, sf_dir)
    return all_lines.join(_best(shown), ["doc_id", "ln"], "left").select("doc_id", "ln", F.coalesce("tone", F.lit("plain")).alias("tone"), F.coalesce("ord", F.lit(-1)).alias("change_ord"))


@query(f"WITH {_RANGES} SELECT doc_id, ord AS change_ord, min(ln) AS first_line, min_by(tone, ln) AS tone FROM best WHERE tone <> 'plain' GROUP BY ALL")
def change_positions(spark, sf_dir):
    """The first line that each change shows on."""
    _, shown = _shown(spark, sf_dir)
    return _best(shown).filter("tone <> 'plain'").groupBy("doc_id", F.col("ord").alias("change_ord")).agg(F.min("ln").alias("first_line"), F.min_by("tone", "ln").alias("tone"))


@query(f"""WITH {LINES_SQL}, hot AS (SELECT *, CASE WHEN r IN (0, 1) AND ln % 30 = 7 THEN ln END AS h, max(ln) OVER (PARTITION BY doc_id) AS top FROM ruled),
near AS (SELECT *, max(h) OVER (PARTITION BY doc_id ORDER BY ln) AS p, min(h) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM hot)
SELECT doc_id, ln FROM near WHERE ln < 20 OR ln > top - 20 OR ln - p <= 20 OR q - ln <= 20""")
def fold_long_code(spark, sf_dir):
    """Lines that stay when the rest is folded: within twenty of a change, and at both ends."""
    w = Window.partitionBy("doc_id")
    near = lambda order: F.last("h", ignorenulls=True).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = lines(table(spark, sf_dir, "documents")).select("doc_id", "ln", F.when((line_rule() <= 1) & (F.col("ln") % 30 == 7), F.col("ln")).alias("h"))
    rows = rows.withColumn("p", near(F.asc("ln"))).withColumn("q", near(F.desc("ln"))).withColumn("top", F.max("ln").over(w))
    return rows.filter("ln < 20 OR ln > top - 20 OR ln - p <= 20 OR q - ln <= 20").select("doc_id", "ln")


@query("""
WITH heads AS (SELECT page_id, regexp_extract_all(html, '<h1>(.*?)</h1>', 1) AS h, regexp_extract_all(html, '<li>', 0) AS li, regexp_extract_all(html, '<p>', 0) AS p, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links FROM pages)
SELECT page_id, len(h) AS headings, len(li) AS items, len(p) AS paragraphs, len(links) AS links, coalesce(h[1], '') AS title FROM heads""")
def page_outline(spark, sf_dir):
    """Headings, items, paragraphs and links of web pages."""
    all_of = lambda pattern, group: F.regexp_extract_all("html", F.lit(pattern), F.lit(group))
    h = all_of("<h1>(.*?)</h1>", 1)
    count = lambda pattern: F.size(all_of(pattern, 0)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", F.size(h).cast("long").alias("headings"), count("<li>").alias("items"), count("<p>").alias("paragraphs"), count('href="[^"]*"').alias("links"), F.coalesce(F.get(h, F.lit(0)), F.lit("")).alias("title"))


@query("""
WITH refs AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS identifier FROM pages)
SELECT lower(identifier) AS identifier, count(DISTINCT page_id) AS holders, min(page_id) AS first_holder FROM refs GROUP BY ALL""")
def backlinks(spark, sf_dir):
    """For each target of a reference: how many hold it, and the first."""
    refs = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("x"))
    return refs.groupBy(F.lower("x").alias("identifier")).agg(F.countDistinct("page_id").alias("holders"), F.min("page_id").alias("first_holder"))


@query(f"""
WITH {LINES_SQL}, counted AS (SELECT doc_id, text, count(*) FILTER (WHERE side = 'old') AS o, count(*) FILTER (WHERE side = 'new') AS n FROM versions GROUP BY ALL),
whole AS (SELECT sum(o) AS old_lines, sum(n) AS new_lines, sum(least(o, n)) AS common FROM counted)
SELECT unnest(['old_lines', 'new_lines', 'common']) AS card, unnest([old_lines, new_lines, common])::BIGINT AS value FROM whole""")
def stats_cards(spark, sf_dir):
    """Totals, one row for each counter."""
    v = line_versions(table(spark, sf_dir, "documents"))
    on = lambda s: F.count(F.when(F.col("side") == s, 1))
    whole = v.groupBy("doc_id", "text").agg(on("old").alias("o"), on("new").alias("n")).agg(F.sum("o").alias("old_lines"), F.sum("n").alias("new_lines"), F.sum(F.least("o", "n")).alias("common"))
    return whole.selectExpr("stack(3, 'old_lines', old_lines, 'new_lines', new_lines, 'common', common) AS (card, value)")


# -- reports


def _changes(spark, sf_dir, keep: str = "all", *columns: str):
    return pairs.compared(markdown_pairs(spark, sf_dir), WHOLE, columns=columns, keep=keep)


@query()
def change_details(spark, sf_dir):
    return report.details(_changes(spark, sf_dir, "counted", *report.DETAILS))


@query()
def debug_snapshot(spark, sf_dir):
    return report.snapshot(materialized(_changes(spark, sf_dir, "all", *pairs.COUNTED, "match_kind")))


@query()
def display_warnings(spark, sf_dir):
    return report.display_warnings(_changes(spark, sf_dir, "warned", "warnings"))


@query()
def change_navigation(spark, sf_dir):
    return report.navigation(_changes(spark, sf_dir, "shown", "change_id", "ord", "op", "renamed", "reordered", "old_line", "new_line")).fillna("", ["previous_id", "next_id"])


# -- assignment and tree edits


@query()
def hungarian_pairs(spark, sf_dir):
    """The optimal pairing of unmatched items of one parent, above the threshold."""
    scored = _alike(spark, sf_dir, m.MIN_SIMILARITY)
    scored = scored.select("pair_id", "parent_id", "old_id", "new_id", (1 - F.col("score") + 1e-6 * F.abs(F.col("old_index") - F.col("new_index"))).alias("cost"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, part in pdf.groupby("parent_id", sort=False):
            old, new = sorted(set(part["old_id"])), sorted(set(part["new_id"]))
            costs: list[list[float | None]] = [[None] * len(new) for _ in old]
            at_old, at_new = {x: i for i, x in enumerate(old)}, {x: i for i, x in enumerate(new)}
            for o, n, c in zip(part["old_id"], part["new_id"], part["cost"], strict=True):
                costs[at_old[o]][at_new[n]] = c
            rows += [(pdf["pair_id"].iloc[0], old[i], new[j], round(costs[i][j], 9)) for i, j in kernels.optimal_assignment(costs)]
        return pd.DataFrame(rows, columns=["pair_id", "old_id", "new_id", "cost"])

    # A group is one pair; its parents are assigned one after the other.
    return scored.groupBy("pair_id").applyInPandas(pick, "pair_id long, old_id string, new_id string, cost double")


@query()
def tree_edit_matches(spark, sf_dir):
    """Nodes that a constrained tree edit keeps, of each customer's two trees."""
    from treeloom.sources.tables import trees

    rows = trees(spark, sf_dir).withColumn("label", F.concat_ws("|", "kind", "title", "text"))
    listed = rows.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("side", "sort_a", "sort_b", "node_id", "parent_id", "label"))).alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pair_id, nodes in zip(batch.column("pair_id").to_pylist(), batch.column("nodes").to_pylist(), strict=True):
                forests: dict[str, list] = {"old": [], "new": []}
                by_id: dict[tuple, dict] = {}
                for x in nodes:
                    node = {"id": x["node_id"], "label": x["label"], "children": []}
                    by_id[x["side"], x["node_id"]] = node
                    up = by_id.get((x["side"], x["parent_id"]))
                    (up["children"] if up else forests[x["side"]]).append(node)
                kind = lambda n: n["label"].split("|", 1)[0]
                found, _ = kernels.tree_edit_matches(forests["old"], forests["new"], lambda n: n["children"], lambda a, b: kind(a) == kind(b), lambda a, b: 0.0 if a["label"] == b["label"] else 0.5, kinds=lambda n: n["label"])
                out += [(pair_id, a["id"], b["id"]) for a, b in found]
            a, b, c = zip(*out, strict=True) if out else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.string())], ["pair_id", "old_id", "new_id"])

    return listed.mapInArrow(run, "pair_id long, old_id string, new_id string")
