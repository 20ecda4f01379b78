"""Markdown documents in two versions, made of customers and their orders, with SQL that says what changed.

A customer is a pair. Its document has front matter, a title, a code block, a table,
a heading for each order with a task list and a paragraph, and definitions at the end.
What the new version changes depends on the customer's key, so that SQL can tell each
change and its lines from the tables alone:

0  another value in the front matter, items added, links of definitions changed
1  orders and items taken out
2  words added to items, a line of the code and a cell of the table changed
3  headings renamed, tasks ticked, the text of some of these changed as well
4  paragraphs moved to the top, the headings they leave renamed
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.plans.stages import dealt
from treeloom.sources.tables import table

#: Definitions come after all orders, added items after all others, and paragraphs after them.
_LAST, _ADDED, _TOTAL = 10**15, 900_000, 1_000_000


def ledger_lines(customer: DataFrame, orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """(pair_id, side, a, b, md): the lines of all documents, in the order of a and b."""
    c = customer.select(F.col("c_custkey").alias("pair_id"), "c_name", "c_nationkey", "c_mktsegment", F.col("c_acctbal").cast("long").alias("balance"))
    o = orders.select(F.col("o_custkey").alias("pair_id"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").cast("long").alias("price")).join(c.select("pair_id"), "pair_id")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    i = lineitem.select(F.col("l_orderkey").alias("k"), "l_partkey", (F.row_number().over(w) - 1).alias("place"), (F.col("l_returnflag") == "R").alias("ticked")).join(o.select("pair_id", "k"), "k")
    rule, key = F.col("pair_id") % 5, F.col("k")

    def lines(rows: DataFrame, side: str, *some: tuple) -> DataFrame:
        """some: (a, b, md) of each line that a row gives."""
        each = F.array(*(F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), md.alias("md")) for a, b, md in some))
        return rows.select("pair_id", F.lit(side).alias("side"), F.explode(each).alias("x")).select("pair_id", "side", "x.*")

    def version(side: str) -> DataFrame:
        new = side == "new"
        on = lambda r, what=F.lit(True): (rule == r) & what if new else F.lit(False)
        add = lambda base, when, more: F.concat(base, F.when(when, more).otherwise(F.lit("")))
        lit = F.lit
        head = lines(
            c, side, (lit(-4), lit(0), lit("---")), (lit(-4), lit(1), add(F.concat(lit("segment: "), "c_mktsegment"), on(0), lit(" LARGE"))), (lit(-4), lit(2), lit("---")), (lit(-4), lit(3), lit("")),
            (lit(-3), lit(0), F.concat(lit("# Customer "), "pair_id")), (lit(-3), lit(1), lit("")),
            (lit(-3), lit(2), lit("```txt")), (lit(-3), lit(3), F.concat(lit("name "), "c_name")), (lit(-3), lit(4), add(F.concat(lit("balance "), "balance"), on(2), lit("1"))), (lit(-3), lit(5), lit("```")), (lit(-3), lit(6), lit("")),
            (lit(-3), lit(7), lit("| nation | segment |")), (lit(-3), lit(8), lit("| --- | --- |")), (lit(-3), lit(9), F.concat(lit("| "), "c_nationkey", lit(" | "), "c_mktsegment", F.when(on(2), lit(" small |")).otherwise(lit(" |")))), (lit(-3), lit(10), lit("")),
        )
        kept = o.filter(~on(1, key % 3 == 0))
        title = add(F.concat(lit("## Order "), key, lit(" "), "priority"), on(3, key % 2 == 0) | on(4, key % 2 == 0), lit(" revised"))
        total = F.concat(lit("Total "), "price", lit(" of order "), key)
        moved = on(4, key % 2 == 0)
        body = lines(kept, side, (key, lit(0), title), (key, lit(1), lit("")), (key, lit(_TOTAL), lit("")))
        where: tuple[Column, Column] = (F.when(moved, lit(-2)).otherwise(key), F.when(moved, 2 * key).otherwise(lit(_TOTAL + 1)))
        totals = lines(kept, side, (where[0], where[1], total), (where[0], where[1] + 1, lit("")))
        items = i.filter(~on(1, (key % 3 == 0) | ((key + F.col("place")) % 4 == 0)))
        box = F.when(F.col("ticked") | on(3, (key % 2 == 1) & ((key + F.col("place")) % 3 == 0)), "- [x] ").otherwise("- [ ] ")
        changed = on(2, (key + F.col("place")) % 4 == 0) | on(3, (key % 2 == 1) & ((key + F.col("place")) % 3 == 0) & (F.col("place") % 2 == 1))
        text = add(F.concat(box, lit("part "), "l_partkey", lit(" as number "), key, lit(" "), "place"), changed, lit(" changed"))
        tasks = lines(items, side, (key, F.col("place") + 2, text))
        link = add(F.concat(lit("[o"), key, lit("]: /orders/"), key), on(0, key % 3 == 0), lit("/new"))
        out = head.unionByName(body).unionByName(totals).unionByName(tasks).unionByName(lines(o, side, (_LAST + key, lit(0), link)))
        if new:
            out = out.unionByName(lines(o.filter((rule == 0) & (key % 2 == 0)), side, (key, lit(_ADDED), F.concat(lit("- [ ] extra for "), key))))
        return out

    return version("old").unionByName(version("new"))


def ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, old_md, new_md).

    The lines of ``ledger_lines``, but a row is an order on its way to its customer,
    with what it gives to each part of the two versions, instead of a line.
    """
    customer, orders, lineitem = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    lit, key, rule = F.lit, F.col("k"), F.col("pair_id") % 5
    lines = lambda *some: F.array(*(lit(x) if isinstance(x, str) else x for x in some))
    joined = lambda parts: F.array_join(parts, "\n")
    on = lambda r, what=lit(True): (rule == r) & what
    add = lambda base, when, more: F.concat(base, F.when(when, more).otherwise(lit("")))

    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", (F.col("l_returnflag") == "R").alias("ticked"))
    items = dealt(lineitem.select(F.col("l_orderkey").alias("k"), item.alias("item")), "k").groupBy("k").agg(F.sort_array(F.collect_list("item")).alias("items"))
    o = orders.select(F.col("o_custkey").alias("pair_id"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").cast("long").alias("price")).join(items, "k", "left")
    revised, moved = on(3, key % 2 == 0) | on(4, key % 2 == 0), on(4, key % 2 == 0)

    def task(x: Column, place: Column, new: bool) -> Column:
        odd = on(3, (key % 2 == 1) & ((key + place) % 3 == 0))
        box = F.when(x["ticked"] | odd if new else x["ticked"], "- [x] ").otherwise("- [ ] ")
        text = F.concat(box, lit("part "), x["l_partkey"], lit(" as number "), key, lit(" "), place)
        return F.when(~on(1, (key + place) % 4 == 0), add(text, on(2, (key + place) % 4 == 0) | odd & (place % 2 == 1), lit(" changed"))) if new else text

    title, total = F.concat(lit("## Order "), key, lit(" "), "priority"), F.concat(lit("Total "), "price", lit(" of order "), key)
    tasks = [F.coalesce(F.transform("items", f), F.array().cast("array<string>")) for f in (lambda x, i: task(x, i, False), lambda x, i: task(x, i, True))]
    extra = F.when(on(0, key % 2 == 0), F.concat(lit("- [ ] extra for "), key))
    last = F.when(moved, F.array().cast("array<string>")).otherwise(lines(total, ""))
    link = F.concat(lit("[o"), key, lit("]: /orders/"), key)
    # What is null has no line.
    given = F.struct(
        key, joined(F.concat(lines(title, ""), tasks[0], lines("", total, ""))).alias("old"), F.when(~on(1, key % 3 == 0), joined(F.concat(lines(add(title, revised, lit(" revised")), ""), tasks[1], lines(extra, ""), last))).alias("new"),
        F.when(moved, joined(lines(total, ""))).alias("top"), link.alias("old_link"), add(link, on(0, key % 3 == 0), lit("/new")).alias("new_link"),
    )

    name = F.col("c_custkey").alias("pair_id")
    balance = F.concat(lit("balance "), F.col("c_acctbal").cast("long"))
    segment, cell = F.concat(lit("segment: "), "c_mktsegment"), F.concat(lit("| "), "c_nationkey", lit(" | "), "c_mktsegment")
    head = lambda new: joined(
        lines(
            "---", add(segment, on(0), lit(" LARGE")) if new else segment, "---", "", F.concat(lit("# Customer "), "pair_id"), "", "```txt", F.concat(lit("name "), "c_name"), add(balance, on(2), lit("1")) if new else balance, "```", "",
            "| nation | segment |", "| --- | --- |", F.concat(cell, F.when(on(2), lit(" small |")).otherwise(lit(" |"))) if new else F.concat(cell, lit(" |")), "",
        )
    )
    heads = customer.select(name, "c_name", "c_nationkey", "c_mktsegment", "c_acctbal").select("pair_id", F.struct(head(False).alias("old"), head(True).alias("new")).alias("head"))
    rows = heads.unionByName(o.select("pair_id", given.alias("given")), allowMissingColumns=True)
    whole = dealt(rows, "pair_id").groupBy("pair_id").agg(F.first("head", ignorenulls=True).alias("head"), F.sort_array(F.collect_list("given")).alias("g")).filter("head IS NOT NULL")
    parts = lambda side: joined(F.concat(F.array(f"head.{side}"), *([F.col("g.top")] if side == "new" else []), F.col(f"g.{side}"), F.col(f"g.{side}_link")))
    return whole.select("pair_id", parts("old").alias("old_md"), parts("new").alias("new_md"))


def ledger_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' titles, orders, items and paragraphs as trees, with the columns of ``tables.order_trees`` but for mark."""
    rows = ledger_lines(*(table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))).filter("a BETWEEN -3 AND 1000000000 AND md <> '' AND NOT (a = -3 AND b > 0)")
    md, a = F.col("md"), F.col("a")
    total, head, top = md.startswith("Total "), md.startswith("## "), a == -3
    order = F.regexp_extract("md", "of order ([0-9]+)$", 1)
    node = F.when(top, F.concat(F.lit("c"), "pair_id")).when(head, F.concat(F.lit("o"), a)).when(total, F.concat(F.lit("t"), order)).otherwise(F.concat(F.lit("l"), a, F.lit("."), "b"))
    depth = F.when(top, 0).when(head | (a == -2), 1).otherwise(2)
    rows = rows.select(
        "pair_id", "side", node.alias("node_id"), F.when(~top, F.when(depth == 1, F.concat(F.lit("c"), "pair_id")).otherwise(F.concat(F.lit("o"), a))).alias("parent_id"),
        F.when(top, "root").when(head, "heading").when(total, "paragraph").otherwise("listItem").alias("kind"), depth.alias("depth"), a.alias("sort_a"), F.col("b").alias("sort_b"),
        F.when(top | head, F.regexp_replace("md", "^#+ ", "")).otherwise("").alias("title"), F.when(top | head, "").when(total, md).otherwise(F.expr("substring(md, 7)")).alias("text"), F.when(~(top | head | total), md.startswith("- [x]")).alias("checked"),
    )
    return rows.withColumn("sibling_index", F.row_number().over(Window.partitionBy("pair_id", "side", "parent_id").orderBy("sort_a", "sort_b")) - 1)


# The same documents for the oracle. what: the part of the document that a line belongs to.
def _side(side: str) -> str:
    new = side == "new"
    on = lambda r, what="true": f"(pair_id % 5 = {r} AND ({what}))" if new else "false"
    add = lambda base, when, more: f"{base} || CASE WHEN {when} THEN '{more}' ELSE '' END"
    kept, moved = f"NOT {on(1, 'k % 3 = 0')}", on(4, "k % 2 = 0")
    head = [
        (-4, 0, "frontmatter", "'---'"), (-4, 1, "", add("'segment: ' || c_mktsegment", on(0), " LARGE")), (-4, 2, "", "'---'"), (-4, 3, "", "''"), (-3, 0, "title", "'# Customer ' || pair_id"), (-3, 1, "", "''"),
        (-3, 2, "code", "'```txt'"), (-3, 3, "", "'name ' || c_name"), (-3, 4, "", add("'balance ' || trunc(c_acctbal)::BIGINT", on(2), "1")), (-3, 5, "", "'```'"), (-3, 6, "", "''"),
        (-3, 7, "table", "'| nation | segment |'"), (-3, 8, "", "'| --- | --- |'"), (-3, 9, "", f"'| ' || c_nationkey || ' | ' || c_mktsegment || CASE WHEN {on(2)} THEN ' small |' ELSE ' |' END"), (-3, 10, "", "''"),
    ]
    text = f"'part ' || l_partkey || ' as number ' || k || ' ' || place || CASE WHEN {on(2, '(k + place) % 4 = 0')} OR {on(3, 'k % 2 = 1 AND (k + place) % 3 = 0 AND place % 2 = 1')} THEN ' changed' ELSE '' END"
    box = f"CASE WHEN ticked OR {on(3, 'k % 2 = 1 AND (k + place) % 3 = 0')} THEN '- [x] ' ELSE '- [ ] ' END"
    parts = [f"SELECT pair_id, {a} AS a, {b} AS b, '{what}' AS what, NULL AS k, NULL AS place, {md} AS md FROM people" for a, b, what, md in head]
    title = add("'## Order ' || k || ' ' || priority", f"{on(3, 'k % 2 = 0')} OR {on(4, 'k % 2 = 0')}", " revised")
    parts += [
        f"SELECT pair_id, k, 0, 'heading', k, NULL, {title} FROM sold WHERE {kept}", f"SELECT pair_id, k, 1, '', k, NULL, '' FROM sold WHERE {kept}", f"SELECT pair_id, k, {_TOTAL}, '', k, NULL, '' FROM sold WHERE {kept}",
        f"SELECT pair_id, CASE WHEN {moved} THEN -2 ELSE k END, CASE WHEN {moved} THEN 2 * k ELSE {_TOTAL + 1} END, 'total', k, NULL, 'Total ' || price || ' of order ' || k FROM sold WHERE {kept}",
        f"SELECT pair_id, CASE WHEN {moved} THEN -2 ELSE k END, CASE WHEN {moved} THEN 2 * k + 1 ELSE {_TOTAL + 2} END, '', k, NULL, '' FROM sold WHERE {kept}",
        f"SELECT pair_id, k, place + 2, 'item', k, place, {box} || {text} FROM tasks WHERE NOT {on(1, 'k % 3 = 0 OR (k + place) % 4 = 0')}",
        f"SELECT pair_id, {_LAST} + k, 0, 'definition', k, NULL, {add(chr(39) + '[o' + chr(39) + ' || k || ' + chr(39) + ']: /orders/' + chr(39) + ' || k', on(0, 'k % 3 = 0'), '/new')} FROM sold",
    ]
    if new:
        parts.append(f"SELECT pair_id, k, {_ADDED}, 'added', k, NULL, '- [ ] extra for ' || k FROM sold WHERE pair_id % 5 = 0 AND k % 2 = 0")
    whole = "\n  UNION ALL ".join(parts)
    return f"SELECT '{side}' AS side, *, row_number() OVER (PARTITION BY pair_id ORDER BY a, b)::INT AS line FROM (\n  {whole})"


LEDGER_SQL = f"""
people AS (SELECT c_custkey AS pair_id, * FROM customer),
sold AS (SELECT o_custkey AS pair_id, o_orderkey AS k, o_orderpriority AS priority, trunc(o_totalprice)::BIGINT AS price FROM orders JOIN people ON c_custkey = o_custkey),
tasks AS MATERIALIZED (SELECT s.pair_id, s.k, l_partkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1)::INT AS place, l_returnflag = 'R' AS ticked FROM lineitem JOIN sold s ON l_orderkey = s.k),
ledger AS MATERIALIZED ({_side('old')}
  UNION ALL {_side('new')}),
both_sides AS MATERIALIZED (SELECT coalesce(o.pair_id, n.pair_id) AS pair_id, coalesce(o.what, n.what) AS what, coalesce(o.k, n.k) AS k, coalesce(o.place, n.place) AS place, o.line AS old_line, n.line AS new_line, o.md AS old_text, n.md AS new_text
  FROM (SELECT * FROM ledger WHERE side = 'old' AND what <> '') o FULL JOIN (SELECT * FROM ledger WHERE side = 'new' AND what <> '') n
  ON n.pair_id = o.pair_id AND n.what = o.what AND coalesce(n.k, -1) = coalesce(o.k, -1) AND coalesce(n.place, -1) = coalesce(o.place, -1)),
told AS (
  SELECT pair_id, 'meta-update' AS op, 'frontmatter' AS kind, old_line, new_line FROM both_sides WHERE what = 'frontmatter' AND pair_id % 5 = 0
  UNION ALL SELECT pair_id, 'meta-update', 'definition', old_line, new_line FROM both_sides WHERE what = 'definition' AND old_text <> new_text
  UNION ALL SELECT pair_id, 'insert', unnest(['listItem', 'paragraph']), old_line, new_line FROM both_sides WHERE what = 'added'
  UNION ALL SELECT pair_id, 'delete', unnest(CASE what WHEN 'item' THEN ['listItem', 'paragraph'] WHEN 'heading' THEN ['heading'] ELSE ['paragraph'] END), old_line, new_line FROM both_sides WHERE new_line IS NULL
  UNION ALL SELECT pair_id, 'replace', what, old_line, new_line FROM both_sides WHERE what IN ('code', 'table') AND pair_id % 5 = 2
  UNION ALL SELECT pair_id, 'replace', 'paragraph', old_line, new_line FROM both_sides WHERE what = 'item' AND substr(old_text, 7) <> substr(new_text, 7)
  UNION ALL SELECT pair_id, 'replace', 'listItem', old_line, new_line FROM both_sides WHERE what = 'item' AND substr(old_text, 7) <> substr(new_text, 7) AND old_text[:6] <> new_text[:6]
  UNION ALL SELECT b.pair_id, CASE WHEN b.pair_id % 5 = 3 OR n > 1 THEN 'rename' ELSE 'replace' END, 'heading', old_line, new_line
    FROM both_sides b LEFT JOIN (SELECT k, count(*) AS n FROM tasks GROUP BY k) t ON t.k = b.k WHERE what = 'heading' AND old_text <> new_text
  UNION ALL SELECT pair_id, 'meta-update', 'listItem', old_line, new_line FROM both_sides WHERE what = 'item' AND substr(old_text, 7) = substr(new_text, 7) AND old_text <> new_text
  UNION ALL SELECT pair_id, 'move', 'paragraph', unnest([old_line, NULL]), unnest([NULL, new_line]) FROM both_sides WHERE what = 'total' AND pair_id % 5 = 4 AND k % 2 = 0
)"""

#: The trees, in the place of ``tables.TREES_SQL``.
LEDGER_TREES_SQL = f"""{LEDGER_SQL.strip()},
trees AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY pair_id, side, parent_id ORDER BY sort_a, sort_b) - 1)::INT AS sibling_index FROM (
  SELECT pair_id, side, CASE WHEN what = 'title' THEN 'c' || pair_id WHEN what = 'heading' THEN 'o' || k WHEN what = 'total' THEN 't' || k ELSE 'l' || a || '.' || b END AS node_id,
    CASE WHEN what = 'title' THEN NULL WHEN what = 'heading' OR a = -2 THEN 'c' || pair_id ELSE 'o' || k END AS parent_id, CASE what WHEN 'title' THEN 'root' WHEN 'heading' THEN 'heading' WHEN 'total' THEN 'paragraph' ELSE 'listItem' END AS kind,
    CASE WHEN what = 'title' THEN 0 WHEN what = 'heading' OR a = -2 THEN 1 ELSE 2 END AS depth, a AS sort_a, b AS sort_b, CASE WHEN what IN ('title', 'heading') THEN ltrim(md, '# ') ELSE '' END AS title,
    CASE WHEN what IN ('title', 'heading') THEN '' WHEN what = 'total' THEN md ELSE substr(md, 7) END AS text, CASE WHEN what IN ('item', 'added') THEN md LIKE '- [x]%' END AS checked
  FROM ledger WHERE what IN ('title', 'heading', 'total', 'item', 'added')))"""
