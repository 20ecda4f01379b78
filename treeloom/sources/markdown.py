"""Markdown to blocks: a line scanner; ``sources.inline`` reads what is within them.

It covers headings, paragraphs, lists and tasks, quotes, fences, tables, front
matter, definitions, footnotes, math, HTML and directives. Inline parts are read when
all definitions are known. A block is a dict with type, line, end, column and
end_column (from 1, the end column one past the last character) and what its type has.
"""

from __future__ import annotations

import re
import tomllib

from treeloom.sources import yaml
from treeloom.sources.inline import CLOSE_TAG, OPEN_TAG, _BLANKS, destination, inline, normal_id, plain, title, unescaped

__all__ = ["blocks", "cells", "front_matter", "inline", "normal_id", "parse", "plain"]

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^\s`]*)\s*(.*?)\s*$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_ITEM = re.compile(r"^( {0,3})([-*+]|\d{1,9}[.)])(?:([ \t]+)(.*)|$)")
_TASK = re.compile(r"^\[([ xX])\][ \t]+(.*)$")
_DEFINITION = re.compile(r" {0,3}\[(?!\^)((?:[^\[\]\\]|\\.){1,999})\]:", re.S)
_FOOTNOTE = re.compile(r"^ {0,3}\[\^([^\]]+)\]:\s?(.*)$")
_DIVIDER = re.compile(r"^ {0,3}\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_DIRECTIVE = re.compile(r"^ {0,3}(:{2,})([A-Za-z][\w-]*)?(.*)$")
# How HTML blocks start, and how they end; None: at an empty line.
_BLOCK_TAGS = "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
_HTML = (
    (re.compile(r" {0,3}<(?:pre|script|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:pre|script|style|textarea)>", re.I)), (re.compile(r" {0,3}<!--"), re.compile("-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")), (re.compile(r" {0,3}<![A-Za-z]"), re.compile(">")), (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf" {{0,3}}</?(?:{_BLOCK_TAGS.replace(' ', '|')})(?:\s|/?>|$)", re.I), None),
)
_HTML_TAG = re.compile(rf" {{0,3}}(?:{OPEN_TAG}|{CLOSE_TAG})\s*$")
_HEADING_ID = re.compile(r"\s*\{#[^}]*\}\s*$")

def cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


def parse(text: str) -> list[dict]:
    """Blocks of a document, definitions and footnotes among them."""
    lines = re.split(r"\r?\n", text)
    out: list[dict] = []
    first = 0
    for fence, kind in (("---", "yaml"), ("+++", "toml")):
        if lines[0].rstrip() == fence and (end := next((i for i in range(1, len(lines)) if lines[i].rstrip() == fence), 0)):
            out.append({"type": kind, "value": "\n".join(lines[1:end]), "line": 1, "end": end + 1, "column": 1, "end_column": len(lines[end].rstrip()) + 1})
            first = end + 1
            break
    out += blocks(lines[first:], first + 1)
    texts, tables, defined, notes = [], [], set(), set()
    todo = list(out)
    while todo:
        b = todo.pop()
        kind = b["type"]
        if kind == "paragraph" or kind == "heading":
            texts.append(b)
        elif kind == "table":
            tables.append(b)
        elif kind == "definition":
            defined.add(b["identifier"])
        elif "children" in b:
            if kind == "footnoteDefinition":
                notes.add(b["identifier"])
            todo += b["children"]
    for b in texts:
        b["children"] = inline(b["children"][0], defined, notes)
    for b in tables:
        b["rows"] = [[inline(c, defined, notes) for c in row] for row in b["rows"]]
    return out


def definition(text: str) -> tuple[dict, int] | None:
    """(label, url and title of the definition that a text starts with, how many of its lines it takes)."""
    m = _DEFINITION.match(text)
    if not m or not m[1].strip():
        return None
    found = destination(text, _BLANKS.match(text, m.end()).end())
    if not found or (not found[0] and text[found[1] - 1 : found[1]] != ">"):
        return None
    end, link_title = found[1], None
    after = _BLANKS.match(text, end).end()
    own = title(text, after) if after > end else None
    if own and re.compile(r"[ \t]*(?:\n|$)").match(text, own[1]):
        end, link_title = own[1], own[0]
    elif not re.compile(r"[ \t]*(?:\n|$)").match(text, end):
        return None
    return {"identifier": normal_id(m[1]), "label": m[1], "url": found[0], "title": link_title}, text.count("\n", 0, end) + 1


def html_end(lines: list[str], i: int, within: bool) -> int:
    """The line after the HTML block that starts at line i; 0 if none does. within: a paragraph is open, which lone tags don't end."""
    for start, stop in _HTML:
        if start.match(lines[i]):
            if stop:
                return next((j + 1 for j in range(i, len(lines)) if stop.search(lines[j], start.match(lines[i]).end() if j == i else 0)), len(lines))
            break
    else:
        if within or not _HTML_TAG.match(lines[i]):
            return 0
    return next((j for j in range(i + 1, len(lines)) if not lines[j].strip()), len(lines))


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _outdented(line: str) -> str:
    """A line without four columns of its indentation, in which tabs go to every fourth column."""
    rest = line.lstrip(" \t")
    return line[4:] if line.startswith("    ") or not line.strip() else line[: len(line) - len(rest)].expandtabs(4)[4:] + rest


def blocks(lines: list[str], start: int, cut: list[int] | None = None) -> list[dict]:
    """Blocks of lines, the first of which has number start; cut: how many characters each line has lost on its left."""
    out: list[dict] = []
    if len(lines) == 1 and lines[0][:1].isalpha():  # a line that starts with a letter is no other block
        lost, body = cut[0] if cut else 0, lines[0].rstrip()
        return [{"type": "paragraph", "children": [body.expandtabs(4)], "line": start, "end": start, "column": lost + 1, "end_column": lost + len(body) + 1}]
    cut = cut or [0] * len(lines)
    left = lambda j: cut[j] + len(lines[j]) - len(lines[j].lstrip()) + 1
    right = lambda j: cut[j] + len(lines[j].rstrip()) + 1
    i, n = 0, len(lines)
    paragraph: list[str] = []

    def close() -> None:
        if paragraph:
            body = "\n".join(x.strip() if not x.endswith("  ") else x.lstrip() for x in paragraph).rstrip()
            out.append({"type": "paragraph", "children": [body], "line": start + i - len(paragraph), "end": start + i - 1, "column": left(i - len(paragraph)), "end_column": right(i - 1)})
            paragraph.clear()

    def add(kind: str, last: int, **rest) -> None:
        out.append({"type": kind, "line": start + i, "end": start + last - 1, "column": left(i), "end_column": right(last - 1), **rest})

    while i < n:
        line = lines[i].expandtabs(4)
        if not line.strip():
            close()
            i += 1
        elif line[0].isalpha() and "|" not in line:  # no block starts with a letter
            paragraph.append(line)
            i += 1
        # A block of each kind starts with a mark of its own; what follows needs a look only where that mark stands.
        elif (mark := line.lstrip()[0]) in "`~" and (m := _FENCE.match(line)):
            close()
            end = next((j for j in range(i + 1, n) if lines[j].strip().startswith(m[1]) and not lines[j].strip().strip(m[1][0])), n)
            add("code", min(n, end + 1), lang=unescaped(m[2]) or None, meta=unescaped(m[3]) or None, value="\n".join(lines[i + 1 : end]))
            i = min(n, end + 1)
        elif mark == "$" and line.strip().startswith("$$"):
            close()
            rest = line.strip()[2:]
            if rest.endswith("$$") and rest[:-2].strip():
                add("math", i + 1, value=rest[:-2])
                i += 1
            else:
                end = next((j for j in range(i + 1, n) if lines[j].strip().endswith("$$")), n)
                add("math", min(n, end + 1), value="\n".join(lines[i + 1 : end]))
                i = min(n, end + 1)
        elif mark == ":" and (m := _DIRECTIVE.match(line)) and (m[2] or len(m[1]) >= 3):
            close()
            end = i + 1
            if len(m[1]) >= 3:
                end = min(n, next((j for j in range(i + 1, n) if lines[j].strip() == m[1]), n) + 1)
            add("unknown", end, original=("container" if len(m[1]) >= 3 else "leaf") + "Directive", value="\n".join(lines[i:end]))
            i = end
        elif mark == "#" and (m := _ATX.match(line)):
            close()
            add("heading", i + 1, depth=len(m[1]), children=[_HEADING_ID.sub("", m[2] or "")])
            i += 1
        elif paragraph and mark in "=-" and re.match(r"^ {0,3}(=+|-+)\s*$", line):
            depth = 1 if "=" in line else 2
            first, text = i - len(paragraph), "\n".join(x.strip() for x in paragraph)
            paragraph.clear()
            out.append({"type": "heading", "depth": depth, "children": [text], "line": start + first, "end": start + i, "column": left(first), "end_column": right(i)})
            i += 1
        elif mark in "-*_" and _RULE.match(line):
            close()
            add("thematicBreak", i + 1)
            i += 1
        elif mark == ">" and _indent(line) < 4:
            close()
            end, inner, lost = i, [], []
            while end < n and (lines[end].lstrip().startswith(">") or (lines[end].strip() and inner and inner[-1].strip() and not _ITEM.match(lines[end]) and not _ATX.match(lines[end]) and not _FENCE.match(lines[end]))):
                inner.append(re.sub(r"^ {0,3}> ?", "", lines[end]))
                lost.append(cut[end] + len(lines[end]) - len(inner[-1]))
                end += 1
            add("blockquote", end, children=blocks(inner, start + i, lost))
            i = end
        elif mark == "[" and not paragraph and (m := _FOOTNOTE.match(line)):
            end, inner, lost = i + 1, [m[2]], [cut[i] + len(lines[i]) - len(m[2])]
            while end < n and (lines[end].startswith("    ") or (not lines[end].strip() and end + 1 < n and lines[end + 1].startswith("    "))):
                inner.append(lines[end][4:])
                lost.append(cut[end] + len(lines[end]) - len(inner[-1]))
                end += 1
            add("footnoteDefinition", end, identifier=normal_id(m[1]), children=blocks(inner, start + i, lost))
            i = end
        elif mark == "[" and not paragraph and _indent(line) < 4 and (m := definition("\n".join(lines[i : next((j for j in range(i + 1, n) if not lines[j].strip()), n)]))):
            add("definition", i + m[1], **m[0])
            i += m[1]
        elif (mark in "-*+" or mark.isdecimal()) and (m := _ITEM.match(line)) and (not paragraph or (m[4] and (not m[2][0].isdigit() or m[2][:-1] == "1"))):
            close()
            i = _list(lines, i, start, out, cut)
        elif not paragraph and line.startswith("    "):
            end = i
            while end < n and (lines[end].expandtabs(4).startswith("    ") or not lines[end].strip()):
                end += 1
            while not lines[end - 1].strip():
                end -= 1
            add("code", end, lang=None, meta=None, value="\n".join(map(_outdented, lines[i:end])), column=cut[i] + 1)
            i = end
        elif "|" in line and i + 1 < n and "-" in lines[i + 1] and _DIVIDER.match(lines[i + 1]) and not paragraph and len(cells(line)) == len(cells(lines[i + 1])):
            end = i + 2
            while end < n and lines[end].strip() and "|" in lines[end]:
                end += 1
            marks = [("center" if c.startswith(":") and c.endswith(":") else "left" if c.startswith(":") else "right" if c.endswith(":") else None) for c in cells(lines[i + 1])]
            add("table", end, align=marks, rows=[cells(x) for x in [line, *lines[i + 2 : end]]])
            i = end
        elif mark == "<" and (end := html_end(lines, i, bool(paragraph))):
            close()
            add("html", end, value="\n".join(lines[i:end]))
            i = end
        else:
            paragraph.append(line)
            i += 1
    close()
    return out


def _list(lines: list[str], i: int, start: int, out: list[dict], cut: list[int]) -> int:
    """The list that starts at line i; returns the line after it."""
    m = _ITEM.match(lines[i].expandtabs(4))
    ordered = m[2][0].isdigit()
    kind = m[2][-1]
    items, first, spread = [], i, False
    count = len(lines)
    known = m  # of line i, if it was looked at before
    while i < count:
        m = known or _ITEM.match(lines[i].expandtabs(4))
        known = None
        if not m or m[2][-1] != kind or m[2][0].isdigit() != ordered or _RULE.match(lines[i]):
            break
        gap = len(m[3] or " ")
        width = len(m[1]) + len(m[2]) + (gap if gap <= 4 and m[4] else 1)
        inner, begin = [m[4] or ""], i
        lost, column = [cut[i] + len(lines[i]) - len(inner[0])], cut[i] + len(m[1]) + 1
        i += 1
        while i < count:
            line = lines[i].expandtabs(4)
            if not line.strip():
                if i + 1 < count and lines[i + 1].strip() and _indent(lines[i + 1].expandtabs(4)) >= width:
                    inner.append("")
                    lost.append(cut[i])
                    spread = True
                    i += 1
                    continue
                break
            if _indent(line) >= width:
                inner.append(line[width:])
            elif inner[-1].strip() and not (known := _ITEM.match(line)) and not _ATX.match(line) and not _FENCE.match(line) and not line.lstrip().startswith(">") and _indent(line) < 4 and not _RULE.match(line):
                inner.append(line.strip())
            else:
                break
            lost.append(cut[i] + len(lines[i]) - len(lines[i].lstrip()) if inner[-1] == line.strip() else cut[i] + len(lines[i]) - len(inner[-1]))
            i += 1
        task = _TASK.match(inner[0])
        if task:
            lost[0] += len(inner[0]) - len(task[2])
            inner[0] = task[2]
        items.append({"type": "listItem", "checked": None if not task else task[1] != " ", "children": blocks(inner, start + begin, lost), "line": start + begin, "end": start + i - 1, "column": column, "end_column": cut[i - 1] + len(lines[i - 1].rstrip()) + 1})
        skip = i
        while skip < count and not lines[skip].strip():
            skip += 1
        if skip > i and skip < count and (n := _ITEM.match(lines[skip])) and n[2][-1] == kind and n[2][0].isdigit() == ordered:
            spread, i = True, skip
    out.append({"type": "list", "ordered": ordered, "spread": spread, "children": items, "line": start + first, "end": start + i - 1})
    return i


def front_matter(kind: str, value: str):
    """The value of front matter, or None if it can't be read."""
    try:
        return tomllib.loads(value) if kind == "toml" else yaml.load(value)
    except (ValueError, TypeError, tomllib.TOMLDecodeError):
        return None
