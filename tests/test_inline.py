"""Inline Markdown and definitions, by the rules of CommonMark and its usual additions."""

import random
import time

import pytest

from treeloom.plans import engine as e
from treeloom.sources.inline import inline, plain
from treeloom.sources.markdown import parse


def tree(nodes):
    """Nodes in short: a text as itself, else (type, what it has, children)."""
    said = lambda n: tuple(n[k] for k in ("value", "url", "title", "identifier", "alt", "name") if n.get(k) is not None)
    return [n["value"] if n["type"] == "text" else (n["type"], *said(n), *tree(n.get("children", []))) for n in nodes]


KNOWN = {"ship", "two words"}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (r"\*no\* \[x\] \q", [r"*no* [x] \q"]),
        ("&amp; &copy; &#960; &#x41; &none; &", ["& © π A &none; &"]),
        ("pre *one* post", ["pre ", ("emphasis", "one"), " post"]),
        ("snake_case_name and _it_", ["snake_case_name and ", ("emphasis", "it")]),
        ("**big *and* small**", [("strong", "big ", ("emphasis", "and"), " small")]),
        ("*open **and** not", ["*open ", ("strong", "and"), " not"]),
        ("4 * 5 * 6", ["4 * 5 * 6"]),
        ("*(*inner*)*", [("emphasis", "(", ("emphasis", "inner"), ")")]),
        ("~~gone~~ ~so~ ~~~stays~~~", [("delete", "gone"), " ", ("delete", "so"), " ~~~stays~~~"]),
        ("``a`b`` and ` `` `", [("inlineCode", "a`b"), " and ", ("inlineCode", "``")]),
        ("*a `*` b*", [("emphasis", "a ", ("inlineCode", "*"), " b")]),
        ("cost $x_1$ is", ["cost ", ("inlineMath", "x_1"), " is"]),
        ("<https://a.org/?q=1> <joe@b.org>", [("link", "https://a.org/?q=1", "https://a.org/?q=1"), " ", ("link", "mailto:joe@b.org", "joe@b.org")]),
        ("a <br/> b <3 c", ["a ", ("html", "<br/>"), " b <3 c"]),
        ("[go](/x(y)z 'to') [it](<a b>)", [("link", "/x(y)z", "to", "go"), " ", ("link", "a b", "it")]),
        ("![the *pic*](p.png \"t\")", [("image", "p.png", "t", "the pic")]),
        ("[a][ship] [Ship][] [ship] [none][] [Two\n words]", [("linkReference", "ship", "a"), " ", ("linkReference", "ship", "Ship"), " ", ("linkReference", "ship", "ship"), " [none][] ", ("linkReference", "two words", "Two\nwords")]),
        ("![a][ship]", [("imageReference", "ship", "a")]),
        ("[out [in](/i) side](/o)", ["[out ", ("link", "/i", "in"), " side](/o)"]),
        ("*[*](/s)", ["*", ("link", "/s", "*")]),
        ("said[^one] and[^no]", ["said", ("footnoteReference", "one"), " and[^no]"]),
        ("at http://q.org/a_b). or www.z.net, x.y@z.net.", ["at ", ("link", "http://q.org/a_b", "http://q.org/a_b"), "). or ", ("link", "http://www.z.net", "www.z.net"), ", ", ("link", "mailto:x.y@z.net", "x.y@z.net"), "."]),
        ("one  \ntwo\\\nthree\n four", ["one", ("break",), "two", ("break",), "three\nfour"]),
        (":tip[see *this*]{k=v} at 9:30", [("textDirective", "tip", "see ", ("emphasis", "this")), " at 9:30"]),
    ],
)
def test_inline(text, want):
    assert tree(inline(text, KNOWN, {"one"})) == want


def test_definitions_over_lines_and_before_use():
    b = parse("[ship] sails\n\n[Ship]:\n  <to sea>\n  \"a title\n  of two lines\"\n[next]: /n 'x' y\n[last]: /l\n'not a title' x\n")
    assert [x["type"] for x in b] == ["paragraph", "definition", "paragraph"]
    assert tree(b[0]["children"]) == [("linkReference", "ship", "ship"), " sails"] and (b[1]["url"], b[1]["title"], b[1]["line"], b[1]["end"]) == ("to sea", "a title\n  of two lines", 3, 6)
    assert [(x["identifier"], x["url"], x["title"]) for x in parse("[a]: /b\n[c]: /d\n'e'") if x["type"] == "definition"] == [("a", "/b", None), ("c", "/d", "e")]


def test_html_blocks_and_what_is_none():
    kinds = lambda md: [(x["type"], x["line"], x["end"]) for x in parse(md)]
    assert kinds("<https://a.b>") == [("paragraph", 1, 1)]
    assert kinds("text\n<div>\nx\n\ny") == [("paragraph", 1, 1), ("html", 2, 3), ("paragraph", 5, 5)]
    assert kinds("text\n<i>x</i>") == [("paragraph", 1, 2)] and kinds("<i>\n*x*\n\nz") == [("html", 1, 2), ("paragraph", 4, 4)]
    assert kinds("<!-- a\n\nb -->\nz") == [("html", 1, 3), ("paragraph", 4, 4)] and kinds("<i>x</i> y") == [("paragraph", 1, 1)]


def test_a_reference_is_a_change_of_its_definition_only():
    old, new = "See [the port][p].\n\n[p]: /a", "See [the port][p].\n\n[p]: /b"
    s = e.summary(e.compare(old, new)[0])
    assert (s["meta_updates"], s["replaces"]) == (1, 0)
    assert e.summary(e.compare(r"Five \* six", "Five * six")[0])["replaces"] == 0


def test_any_text_is_kept_and_nothing_is_slow():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(["*", "_", "`", "[", "]", "(", ")", "!", "<", ">", "&", "a", "b ", " ", "\n", "\\", "~", "$", ":x", "^"]) for _ in range(rng.randrange(40)))
        found = plain(inline(text, {"a"}, {"b"}))
        assert sum(c in "ab" for c in found) <= sum(c in "ab" for c in text)
        assert tree(inline("w " + text.replace("*", "").replace("_", "").replace("~", ""), {"a"}))[:1] != []
    for unit in ("[", "*a ", "*a _b ", "<!-- ", "<![CDATA[ ", "a@b ", "[a](", "a** b* ", "`a", "&a", "www.a.b) "):
        start = time.time()
        inline(unit * 10_000, {"a"})
        assert time.time() - start < 10, unit


def test_places_point_at_the_text():
    from treeloom.plans.document import Document

    text = "---\r\na: 1\r\n---\r\n# T\n\n  para one  \nmore\n\n- [ ] task text\n  - inner\n    lazy\n\n> quoted *x*\n> rest\n\n    code\n\n[^n]: note\n    goes on\n\n[d]: /u\n  'v'\n\nUnder\n---\n"
    d = Document(text)
    cut = {(n.kind, i): text[d.offset(n.line, n.column) : d.offset(n.end, n.end_column)] for i, n in enumerate(d.nodes) if n.line}
    said = {}
    for (kind, _), x in cut.items():
        said.setdefault(kind, []).append(x.replace("\r", ""))
    assert said["frontmatter"] == ["---\na: 1\n---"] and said["code"] == ["    code"] and said["definition"] == ["[d]: /u\n  'v'"]
    assert said["listItem"] == ["- [ ] task text\n  - inner\n    lazy", "- inner\n    lazy"] and said["blockquote"] == ["> quoted *x*\n> rest"] and said["footnote"] == ["[^n]: note\n    goes on"]
    assert said["paragraph"] == ["para one  \nmore", "task text", "inner\n    lazy", "quoted *x*\n> rest", "note\n    goes on"]
    assert [x.split("\n")[0] for x in said["heading"]] == ["# T", "Under"] and sorted(d.nodes, key=d.point_order)[-1] is d.root
    starts = [d.offset(n.line, n.column) for n in d.root.children]
    assert starts == sorted(starts)
