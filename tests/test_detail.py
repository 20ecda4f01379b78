"""What the detail view shows of small changes."""

import json

from treeloom.plans import detail, pairs
from treeloom.plans import engine as e


def change(old, new, kind):
    root, c = e.compare(old, new)
    return next(x for x in e.walk(root) if x.node.kind == kind), c


def test_previews():
    text = "---\na: 1\n---\n\n# Top\n\n3. [x] done\n4. open\n\n- [ ] todo\n\n> said so\n\n```py run\nx\n```\n\n| h | i |\n| - | - |\n| 1 | 2 |\n\n[ref]: /to \"Name\"\n\n[^n]: note\n\nsome **bold** words"
    shown = {detail.preview(n) for n in e.Document(text).nodes}
    assert shown >= {"---\na: 1\n---", "# Top", "1. [x] done", "2. open", "- [ ] todo", "> said so", "```py run\nx\n```", "| h | i |\n| 1 | 2 |", "[^n]", "some bold words"}
    assert any(x.startswith("[ref]: /to") for x in shown)


def test_metadata_lines():
    old, new = "---\nname: old\ntags:\n  - a\n  - b\nlast: 1\n---", "---\nname: new\ntags:\n  - a\n  - c\nlast: 1\n---"
    c, _ = change(old, new, "frontmatter")
    marked = {line: ranges for line, ranges in detail.highlighted(c, "new") if ranges}
    assert marked["name: new"] == [(0, 4), (6, 9)] and marked["tags:"] == [(0, 5)] and marked["  - c"] == [(0, 5)] and "last: 1" not in marked
    assert detail.path_parts("$.a.b[0].c") == ["a", "b", "0", "c"] and detail.block_lines(["x:", "  y", "", "z:"], "$.x[0]") == [0, 1, 2] and detail.block_lines(["x:"], "$.q") == []


def test_fields_of_definitions_and_code():
    c, _ = change("[id]: /old", "[id]: /new", "definition")
    assert detail.highlighted(c, "old") == [("[id]: /old", [(6, 10)])] and detail.changed_fields(c, "new") == ["/new"]
    c, _ = change("```js\ncode\n```", "```ts\ncode\n```", "code")
    assert detail.highlighted(c, "new")[0] == ("```ts", [(3, 5)])
    c, _ = change("same", "same", "paragraph")
    assert detail.highlighted(c, "old") == []


def test_code_and_table_views():
    c, _ = change("```\na\nbx\nd\n```", "```\na\nby\nd\ne\n```", "code")
    assert detail.code_lines(c, "old") == [("equal", "a", []), ("replace", "bx", [("equal", "b"), ("replace", "x")]), ("equal", "d", [])]
    assert [x[:2] for x in detail.code_lines(c, "new")][-1] == ("insert", "e")
    head = "| h | i |\n| - | - |\n"
    c, _ = change(head + "| 1 | 2 |\n| 3 | 4 |", head + "| 1 | 2 |\n| 3 | 5 |", "table")
    assert detail.table_rows(c, "new")[2] == ("equal", [("3", "equal", "equal"), ("5", "equal", "replace")])
    c, _ = change(head + "| 1 | 2 |\n| 3 | 4 |", head + "| 1 | 2 |\n| 8 | 9 |\n| 3 | 4 |", "table")
    assert [op for op, _ in detail.table_rows(c, "new")] == ["equal", "equal", "insert", "equal"] and [op for op, _ in detail.table_rows(c, "old")] == ["equal"] * 3
    assert ("table_row", 2, -1, "insert", "", "8\t9") in c.spans
    c, _ = change("| h |\n| - |\n| 1 |\n| 3 |", "| h | new |\n| - | - |\n| 1 | x |\n| 3 | y |", "table")
    assert ("table_column", -1, 1, "insert", "", "new") in c.spans and all(r[1][-1][1] == "insert" for r in detail.table_rows(c, "new"))


def test_cells_have_spans_and_formats_count():
    c, _ = change("| h |\n| - |\n| some old words |", "| h |\n| - |\n| some new words |", "table")
    assert ("cell", 1, 0, "replace", "some old words", "some new words") in c.spans and ("cell_word", 1, 0, "replace", "old", "new") in c.spans
    c, _ = change("| h |\n| - |\n| word |", "| h |\n| - |\n| **word** |", "table")
    assert ("cell", 1, 0, "replace", "word", "word") in c.spans


def test_lines_that_refer_to_a_definition():
    old = "See [a][one].\n\nand [b][one].\n\n[one]: /x"
    c, both = change(old, old.replace("/x", "/y"), "definition")
    assert detail.affected_lines(c, both.old, both.new) == [1, 3]


def test_table_of_details_and_index(spark):
    some = [(1, "# A\n\nold text", "# A\n\nnew text\n\nmore"), (2, "same", "same"), (3, None, "x")]
    df = spark.createDataFrame(some, "pair_id long, old_md string, new_md string")
    got = {(r["pair_id"], r["old_text"], r["new_text"]) for r in pairs.detailed(df).collect()}
    assert got == {(1, "old text", "new text"), (1, None, "more"), (3, None, "x")}
    table = "| a |\n| - |\n| 1 |"
    r = next(r for r in pairs.detailed(spark.createDataFrame([(1, table, table.replace("1", "2"))], df.schema)).collect() if r["new_table"])
    assert json.loads(r["new_table"])[1] == ["equal", [["2", "equal", "replace"]]]
    changes = pairs.compared(df).cache()
    index = {(r["pair_id"], r["kind"], r["key"]): r["change_id"] for r in pairs.change_index(changes).collect()}
    for c in changes.collect():
        for kind in ("old", "new"):
            if c[f"{kind}_id"]:
                assert index[c["pair_id"], kind, c[f"{kind}_id"]] == c["change_id"]
    assert pairs.detailed(df.limit(0)).count() == 0 and pairs.change_index(changes.limit(0)).count() == 0
