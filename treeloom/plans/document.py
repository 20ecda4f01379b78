"""A Markdown document as a tree of sections and blocks with hashes and tokens.

Headings open sections by depth; list items, quotes, footnotes and front matter are
sections too; everything else is a block. Definitions stand at their source line.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property
from json.encoder import encode_basestring

import numpy as np
import regex

from treeloom.functions.text import _PLAIN_WORD, CLUSTER, UNSPACED, WORD
from treeloom.sources.markdown import front_matter, normal_id, parse, plain

_WORD, _CLUSTER = regex.compile(f"(?P<run>{UNSPACED})|{WORD}"), regex.compile(CLUSTER)
_ASCII_WORD = re.compile(_PLAIN_WORD)
# Fixed value, as in ``functions.text``: the numbers before a heading that do not count.
_PREFIX = re.compile(r"^([ivxlcdm]+|\d+(?:\.\d+)*|\d{1,4})[.)、：:-]\s+")


def md5(x) -> str:
    return hashlib.md5(x.encode("utf-8", "surrogatepass")).hexdigest()


_ENCODER = json.JSONEncoder(sort_keys=True, ensure_ascii=False, default=str)


def canonical(x) -> str:
    return _ENCODER.encode(x)


def _leaf(x) -> str:
    """Canonical JSON of what is no list."""
    return "null" if x is None else encode_basestring(x) if isinstance(x, str) else str(x).lower() if isinstance(x, (bool, int)) else canonical(x)


def _inline(nodes) -> str:
    """Canonical JSON of inline nodes; most are one text."""
    if not nodes:
        return "[]"
    if len(nodes) == 1 and nodes[0]["type"] == "text":
        return f'[{{"type": "text", "value": {encode_basestring(nodes[0]["value"])}}}]'
    return canonical(nodes)


def normal_title(x: str) -> str:
    x = unicodedata.normalize("NFKC", x).strip().lower()
    m = _PREFIX.match(x)
    if m and not (re.fullmatch(r"\d{4}", m[1]) and 1900 <= int(m[1]) <= 2100):
        x = x[m.end() :]
    return " ".join(x.split())


def slug(x: str) -> str:
    # The classes of characters that a slug drops or joins.
    return re.sub(r"[\s_-]+", "-", re.sub(r"[^\w\s-]|_", " ", normal_title(x)).strip())


def words(x: str) -> list[str]:
    """The words of ``functions.text.tokenize_text``."""
    x = x.lower()
    if x.isascii():
        return _ASCII_WORD.findall(x)
    out = []
    for m in _WORD.finditer(x):
        run = _CLUSTER.findall(m[0]) if m["run"] else [m[0]]
        out += [a + b for a, b in zip(run, run[1:])] or run
    return out


def grams(x: str) -> Counter:
    x = x.lower()
    return Counter(x[i : i + 3] for i in range(len(x) - 2)) if len(x) >= 3 else Counter([x] if x else [])


def simhash(tokens: list[str]) -> int | None:
    """64 votes of each token's md5, a bit is 1 where its sum is not negative; None without a token."""
    if not tokens:
        return None
    digests = b"".join(hashlib.md5(t.encode("utf-8", "surrogatepass")).digest()[:8] for t in tokens)
    ones = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones >= len(tokens)).tobytes(), "big")


class Hashes(dict):
    """A node's hashes, each made when it is first asked for. Children's come first; ``Document.settle`` goes from the leaves up."""

    def __init__(self, node: Node):
        super().__init__()
        self.node = node

    def __missing__(self, name: str) -> str:
        self[name] = out = getattr(self, f"_{name}")()
        return out

    def _listed(self, name: str) -> str:
        """The children's hashes as canonical JSON."""
        kids = [c.hashes[name] for c in self.node.children]
        return '["' + '", "'.join(kids) + '"]' if kids else "[]"

    def _body(self) -> str:
        return md5(self._listed("subtree"))

    def _self(self) -> str:
        n = self.node
        own = (n.kind, n.normal if n.kind == "heading" else "", n.heading_depth, n.list_depth, n.quote_depth, n.checked, n.ordered, n.value, n.lang, n.meta, n.url, n.link_title)
        parts = [*map(_leaf, own), canonical(n.align) if n.align else "[]", canonical([[c for _, c in r] for r in n.rows]) if n.rows else "[]", _inline(n.inline)]
        parts.append(_leaf(n.identifier if n.entity == "block" or n.kind == "footnote" else None))
        # An item, quote or footnote holds its whole body in its own hash.
        parts.append(_leaf(self["body"] if n.kind in ("listItem", "blockquote", "footnote") else None))
        return md5(f"[{', '.join(parts)}]")

    def _direct(self) -> str:
        return md5(f'["{self["self"]}", {self._listed("self")}]')

    def _subtree(self) -> str:
        return md5(f'["{self["self"]}", {self._listed("subtree")}]')

    def _identity(self) -> str:
        n = self.node
        return md5(canonical([n.url, n.link_title])) if n.kind == "definition" else self["body"] if n.kind == "footnote" else self["self"]

    def _content(self) -> str:
        return md5(self.node.text)

    def _path(self) -> str:
        return md5(" / ".join(self.node.path))


class Keys(dict):
    """Of a node what ``Hashes`` has, as numbers that are equal where the hashes are; of documents that share a table only."""

    __slots__ = ("node", "table")

    def __init__(self, node: Node, table: dict):
        self.node, self.table = node, table

    def __missing__(self, name: str) -> int:
        n = self.node
        if name == "identity":
            x = (n.url, n.link_title) if n.kind == "definition" else None
            out = self.table.setdefault(x, len(self.table)) if x else self["body"] if n.kind == "footnote" else self["self"]
        else:
            x = n.text if name == "content" else tuple([c.keys["subtree"] for c in n.children]) if name == "body" else (self["self"], tuple([c.keys["self"] for c in n.children]))
            out = self.table.setdefault(x, len(self.table))
        self[name] = out
        return out


def _known(inline):
    """What a node's inline parts are told by: the text where they are one text, else canonical JSON."""
    return (inline[0]["value"],) if len(inline) == 1 and inline[0]["type"] == "text" else canonical(inline)


@dataclass(eq=False)
class Node:
    """kind: root, heading, listItem, blockquote, footnote, frontmatter for sections; a block's type else.

    Texts, tokens, signatures and hashes are made when they are first asked for, as
    a comparison looks at few nodes that closely.
    """

    id: str
    entity: str
    kind: str
    line: int = 0
    end: int = 0
    column: int = 0
    end_column: int = 0
    title: str = ""
    value: str | None = None
    heading_depth: int = 0
    list_depth: int = 0
    quote_depth: int = 0
    ordered: bool | None = None
    checked: bool | None = None
    identifier: str | None = None
    url: str | None = None
    link_title: str | None = None
    lang: str | None = None
    meta: str | None = None
    align: Sequence = ()
    rows: Sequence = ()
    inline: Sequence = ()
    raw: object = None
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    place: int = 0
    preorder: int = 0
    size: int = 1
    depth: int = 0
    level: int = 0
    path: tuple = ()

    @cached_property
    def shape(self) -> str:
        return f"{self.entity}:{self.kind}"

    @cached_property
    def hashes(self) -> Hashes:
        return Hashes(self)

    @cached_property
    def keys(self) -> dict:
        """``Keys`` in a comparison (``Document.number``), else the hashes."""
        return self.hashes

    @cached_property
    def text(self) -> str:
        if self.entity == "section":
            return " ".join(filter(None, [self.title if self.kind == "heading" else "", self.value or "", *(c.text for c in self.children)]))
        if self.kind == "code":
            return self.value or ""
        own = self.value if self.value is not None else plain(self.inline) if self.inline else " ".join(c for r in self.rows for c, _ in r) if self.rows else " ".join(filter(None, (self.identifier, self.url, self.link_title)))
        return " ".join(own.split())

    @cached_property
    def structure(self) -> list[str]:
        return [t for t, _ in _preorder(self.inline)] if self.entity == "block" else [c.shape for c in self.children]

    @cached_property
    def marks(self) -> list[str]:
        if self.entity == "section":
            return [*(words(self.title) if self.kind == "heading" else []), *(t for c in self.children for t in c.marks)]
        cells = ({"type": "tableRow", "children": [{"type": "tableCell", "children": c} for _, c in r]} for r in self.rows)
        return structured_tokens({"type": self.kind, "url": self.url, "title": self.link_title, "identifier": self.identifier, "children": [*self.inline, *cells]})

    @cached_property
    def tokens(self) -> list[str]:
        return words(self.text)

    @cached_property
    def sim(self) -> int | None:
        return simhash(self.tokens + self.marks)

    @cached_property
    def counts(self) -> Counter:
        return Counter(self.tokens)

    @cached_property
    def grams(self) -> Counter:
        return grams(self.text)

    @cached_property
    def normal(self) -> str:
        return normal_title(self.title)

    def below(self):
        for c in self.children:
            yield c
            yield from c.below()


HASHES = ("self", "direct", "subtree", "identity", "content", "body", "path")
#: What a node takes from its block beside its place.
_FIELDS = (("value", "value"), ("lang", "lang"), ("meta", "meta"), ("url", "url"), ("link_title", "title"), ("identifier", "identifier"), ("align", "align"), ("heading_depth", "depth"))
#: Nesting beyond which a document's texts and hashes are made at once, from the leaves up.
DEEP = 50


class Document:
    """root, nodes in document order, and the places that refer to an identifier."""

    def __init__(self, text: str):
        self.count, self.notes, self.backlinks = 0, [], {}
        self.lines = re.split(r"\r?\n", text)
        self.source = text
        self.root = self._node("section", "root")
        stack = [self.root]
        for b in parse(text):
            if b["type"] == "heading":
                while stack[-1].heading_depth >= b["depth"]:
                    stack.pop()
                s = self._section("heading", b, title=plain(b["children"]), heading_depth=b["depth"], inline=b["children"])
                stack[-1].children.append(s)
                stack.append(s)
            elif b["type"] in ("yaml", "toml"):
                self.root.children.append(self._section("frontmatter", b, value=b["value"], lang=b["type"], raw=front_matter(b["type"], b["value"])))
            elif b["type"] in ("definition", "footnoteDefinition"):
                self._place(b, self.root)
            else:
                self._place(b, stack[-1])
        self.nodes: list[Node] = []
        deepest = self._finish()
        for n in reversed(self.nodes):
            if not (kids := n.children):
                continue
            if len(kids) == 1:
                n.size = 1 + kids[0].size
            else:
                n.size = 1 + sum([c.size for c in kids])
            if n.kind != "root":
                last = max([c.end for c in kids])
                if last >= n.end:
                    n.end, n.end_column = max([(x.end, x.end_column) for x in (n, *kids) if x.end == last])
        for n in self.nodes:
            if not n.inline or (len(n.inline) == 1 and n.inline[0]["type"] == "text"):
                continue
            for kind, name in _references(n.inline):
                self.backlinks.setdefault((kind, name), []).append(n.id)
        if deepest > DEEP:
            self.settle()

    def settle(self, *hashes: str) -> None:
        """Makes all that nodes have, or the named hashes alone, from the leaves up."""
        for n in reversed(self.nodes):
            for name in hashes or HASHES:
                n.hashes[name]
            if not hashes:
                n.structure, n.sim  # noqa: B018

    def number(self, table: dict) -> None:
        """Keys of selves and subtrees, from the leaves up; table: the numbers of what was met before."""
        number = table.setdefault
        for n in reversed(self.nodes):
            n.keys = keys = Keys(n, table)
            kind = n.kind
            subtrees = tuple([c.keys["subtree"] for c in n.children])
            # An item, quote or footnote holds its whole body in its own key.
            held = kind in ("listItem", "blockquote", "footnote")
            if held:
                keys["body"] = number(subtrees, len(table))
            # What a paragraph or an item has at its default is left out.
            own = (kind, _known(n.inline) if n.inline else None) if kind == "paragraph" else (kind, n.list_depth, n.checked, n.ordered, keys["body"]) if kind == "listItem" else (
                kind, n.normal if kind == "heading" else "", n.heading_depth, n.list_depth, n.quote_depth, n.checked, n.ordered, n.value, n.lang, n.meta, n.url, n.link_title,
                canonical(n.align) if n.align else None, canonical([[c for _, c in r] for r in n.rows]) if n.rows else None, _known(n.inline) if n.inline else None,
                n.identifier if n.entity == "block" or kind == "footnote" else None, keys["body"] if held else None,
            )
            keys["self"] = mine = number(own, len(table))
            keys["subtree"] = number((mine, subtrees), len(table))

    @cached_property
    def starts(self) -> list[int]:
        """How many characters stand before each line."""
        return [0, *(m.end() for m in re.finditer(r"\r?\n", self.source))]

    def offset(self, line: int, column: int) -> int | None:
        """How many characters stand before a place; None of a node without one."""
        return self.starts[line - 1] + column - 1 if line else None

    def point_order(self, n: Node) -> tuple:
        """Nodes by where they start, those without a place last."""
        at = self.offset(n.line, n.column)
        return (at is None, at or 0, n.line, n.column)

    def _node(self, entity: str, kind: str, block: dict | None = None, **rest) -> Node:
        """A node with what is said of it; the rest are the defaults of its class, which cost no time."""
        self.count += 1
        n = object.__new__(Node)
        n.id, n.entity, n.kind, n.shape, n.children = f"{entity[0]}{self.count}", entity, kind, f"{entity}:{kind}", []
        if block:
            n.line, n.end, n.column, n.end_column = block["line"], block["end"], block["column"], block["end_column"]
        for name, x in rest.items():
            setattr(n, name, x)
        return n

    def _section(self, kind: str, block: dict, **rest) -> Node:
        return self._node("section", kind, block, **rest)

    def _place(self, b: dict, into: Node) -> None:
        """A block as a child of a section; lists, quotes and footnotes become sections."""
        kind = b["type"]
        if kind == "paragraph":
            n = self._node("block", kind, b)
            n.inline = b["children"]
            into.children.append(n)
        elif kind == "list":
            for item in b["children"]:
                lead = next((c for c in item["children"] if c["type"] == "paragraph"), None)
                title = plain(lead["children"]) if lead else {True: "[x]", False: "[ ]", None: ""}[item["checked"]]
                s = self._node("section", "listItem", item)
                s.title, s.list_depth, s.ordered, s.checked = title, into.list_depth + 1 if into.kind == "listItem" else 1, b["ordered"], item["checked"]
                into.children.append(s)
                for c in item["children"]:
                    self._place(c, s)
        elif kind == "blockquote":
            lead = next((plain(c["children"]) for c in b["children"] if c["type"] == "paragraph"), "")
            depth = into.quote_depth + 1 if into.kind == "blockquote" else 1
            self._container("blockquote", b, into, title=lead if len(lead) <= 50 else lead[:50] + "…", quote_depth=depth)
        elif kind == "footnoteDefinition":
            self._container("footnote", b, self.root, identifier=b["identifier"])
        else:
            into.children.append(self._block(b))

    def _container(self, kind: str, block: dict, into: Node, **rest) -> None:
        s = self._section(kind, block, **rest)
        into.children.append(s)
        for c in block["children"]:
            self._place(c, s)

    def _block(self, b: dict) -> Node:
        n = self._node("block", b["type"], b)
        if (inline := b.get("children")) is not None:
            n.inline = inline
        for name, key in _FIELDS:
            if (x := b.get(key)) is not None:
                setattr(n, name, x)
        n.rows = [[(plain(c), c) for c in row] for row in b.get("rows", [])]
        if n.kind == "heading":
            n.title = plain(n.inline)
        return n

    def _finish(self) -> int:
        """Nodes in document order, their parents, places and paths; how deep they are nested at most."""
        todo = [self.root]
        self.root.level, deepest = 0, 0
        nodes = self.nodes
        while todo:
            n = todo.pop()
            n.preorder = len(nodes)
            nodes.append(n)
            if n.kind == "heading" and n.entity == "section":
                n.path = (*n.path, n.normal)
            if path := n.path:
                n.depth = len(path)
            if kids := n.children:
                level = n.level + 1
                deepest = max(deepest, level)
                for i, c in enumerate(kids):
                    c.parent, c.place, c.level = n, i, level
                    if path:
                        c.path = path
                todo += kids[::-1]
        return deepest


#: The kind of a root, and its title, of a document that could not be read.
UNREADABLE, TOO_DEEP = "unreadable", "nesting-too-deep"


def readable(text: str, whole: bool = False) -> Document:
    """The document, or one of a root alone that says so (``UNREADABLE``) where it is nested too deep to be read; whole: with all that its nodes have."""
    # As in ``engine.compare``: what lives until the document is whole need not be looked at by collections between.
    collecting = gc.isenabled()
    gc.disable()
    try:
        document = Document(text)
        if whole:
            document.settle()
        return document
    except RecursionError:
        document = Document("")
        document.root.kind, document.root.shape, document.root.title = UNREADABLE, f"section:{UNREADABLE}", TOO_DEEP
        return document
    finally:
        if collecting:
            gc.enable()


def structured_tokens(node: dict) -> list[str]:
    """What a block and its inline nodes are and point to, beside their text."""
    own = [f"{name}:{node[key].lower()}" for name, key in (("url", "url"), ("title", "title"), ("alt", "alt")) if node.get(key)]
    if node.get("identifier"):
        own.append(f"id:{normal_id(node['identifier'])}")
    return [*own, f"type:{node['type']}", *(t for c in node.get("children", []) for t in structured_tokens(c))]


def _preorder(nodes: list[dict]):
    for x in nodes:
        yield x["type"], x
        yield from _preorder(x.get("children", []))


def _references(nodes: list[dict]):
    for kind, x in _preorder(nodes):
        if kind in ("footnoteReference", "linkReference", "imageReference"):
            yield ("footnote" if kind == "footnoteReference" else "definition"), x["identifier"]
