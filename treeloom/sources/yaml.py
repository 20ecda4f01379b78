"""YAML as front matter has it: one document of the core schema, by lines and indentation.

Mappings and sequences in block and flow style, anchors and aliases, block scalars
with their indicators, scalars over several lines, quotes with escapes, comments.
Tags are read over but for ``!!str``; keys become strings. What it can't read, and a key that stands twice,
raises ValueError.
"""

from __future__ import annotations

import re

# The core schema.
_NULL, _TRUE, _FALSE = ("", "~", "null", "Null", "NULL"), ("true", "True", "TRUE"), ("false", "False", "FALSE")
_INT = re.compile(r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+")
_FLOAT = re.compile(r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?")
_ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}
_DOUBLE, _SINGLE = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S), re.compile(r"'((?:[^']|'')*)'", re.S)
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|(.))", re.S)
_PLAIN_KEY = re.compile(r"([^\s\[\]{}\"'#&*!|>%@`,?:-](?:(?!\s#)[^\n])*?|[-?:](?=[^\s])(?:(?!\s#)[^\n])*?)\s*:(?=\s|$)")
_PROPERTY = re.compile(r"(?:&([^\s\[\]{},]+)|(!\S*))(?=\s|$)\s*")
_BLOCK = re.compile(r"([|>])(?:([-+])([1-9])?|([1-9])([-+])?)?(?:\s+#.*|\s*)$")
_MOST_DEPTH = 200


class _More(Exception):
    """A quote or bracket is still open at the end of the text."""


def scalar(x: str):
    """A plain scalar's value."""
    if x in _NULL:
        return None
    if x in _TRUE or x in _FALSE:
        return x in _TRUE
    if _INT.fullmatch(x):
        return int(x, 0) if x[:2] in ("0o", "0x") else int(x)
    if re.fullmatch(r"[-+]?\.(?:inf|Inf|INF)", x):
        return float("-inf" if x[0] == "-" else "inf")
    if x in (".nan", ".NaN", ".NAN"):
        return float("nan")
    return float(x) if _FLOAT.fullmatch(x) else x


def _folded(x: str) -> str:
    """Lines of a flow scalar: a break is a blank, an empty line a break."""
    lines = x.split("\n")
    out = lines[0] if len(lines) == 1 else lines[0].rstrip(" \t")
    gap = 0
    for k, line in enumerate(lines[1:], 1):
        own = line.strip(" \t") if k < len(lines) - 1 else line.lstrip(" \t")
        if not own and k < len(lines) - 1:
            gap += 1
            continue
        out += ("\n" * gap if gap else " ") + own
        gap = 0
    return out


def _quoted(text: str, at: int) -> tuple[str, int]:
    """(value, end) of the quoted scalar at a place."""
    m = (_DOUBLE if text[at] == '"' else _SINGLE).match(text, at)
    if not m:
        raise _More
    if text[at] == "'":
        return _folded(m[1]).replace("''", "'"), m.end()
    body = re.sub(r"\\\n[ \t]*", "", m[1])

    def char(e) -> str:
        if code := e[1] or e[2] or e[3]:
            return chr(int(code, 16))
        if e[4] not in _ESCAPES:
            raise ValueError(f"escape {e[0]}")
        return _ESCAPES[e[4]]

    return _ESCAPE.sub(char, _folded(body)), m.end()


class _Reader:
    def __init__(self, text: str):
        self.lines, self.i, self.anchors = text.removesuffix("\n").split("\n"), 0, {}

    def skip(self) -> bool:
        """To the next line that is neither empty nor a comment; false at the end."""
        while self.i < len(self.lines) and re.match(r"[ \t]*(?:#|$)", self.lines[self.i]):
            self.i += 1
        return self.i < len(self.lines)

    def indent(self) -> int:
        line = self.lines[self.i]
        at = len(line) - len(line.lstrip(" "))
        if line[at : at + 1] == "\t":
            raise ValueError("tab in indentation")
        return at

    def node(self, depth: int):
        """The block that starts at the current line."""
        if depth > _MOST_DEPTH:
            raise ValueError("nested too deep")
        at = self.indent()
        text = self.lines[self.i][at:]
        if re.match(r"-(?:\s|$)", text):
            return self.sequence(at, depth)
        if self.key(text):
            return self.mapping(at, depth)
        self.i += 1
        return self.value(text, at - 1, depth)

    def key(self, text: str) -> tuple[str, int] | None:
        """(key, where its value's text starts)."""
        at, m = 0, _PROPERTY.match(text)
        while m:
            at = m.end()
            m = _PROPERTY.match(text, at)
        if text[at : at + 1] in ("'", '"') and at < len(text):
            try:
                own, end = _quoted(text, at)
            except _More:
                return None
            m = re.compile(r"\s*:(?=\s|$)").match(text, end)
            return (own, m.end()) if m else None
        if m := re.compile(r"\*(\S+)\s+:(?=\s|$)").match(text, at):
            return self.text_of(self.alias(m[1])), m.end()
        m = _PLAIN_KEY.match(text, at)
        return (self.text_of(scalar(m[1])), m.end()) if m else None

    @staticmethod
    def text_of(x) -> str:
        if isinstance(x, (dict, list)):
            raise ValueError("a key that is no scalar")
        return "" if x is None else str(x).lower() if isinstance(x, bool) else str(x)

    def alias(self, name: str):
        if name not in self.anchors:
            raise ValueError(f"no anchor {name}")
        return self.anchors[name]

    def mapping(self, at: int, depth: int) -> dict:
        found: dict = {}
        while self.skip() and self.indent() == at:
            text = self.lines[self.i][at:]
            own = self.key(text)
            if not own:
                raise ValueError(text)
            if own[0] in found:
                raise ValueError(f"key {own[0]} stands twice")
            found[own[0]] = None
            self.i += 1
            found[own[0]] = self.value(text[own[1] :], at, depth, of_key=True)
        if self.i < len(self.lines) and self.skip() and self.indent() > at:
            raise ValueError(self.lines[self.i])
        return found

    def sequence(self, at: int, depth: int) -> list:
        found = []
        while self.skip() and self.indent() == at and (m := re.match(r"-(\s+|$)", self.lines[self.i][at:])):
            rest = self.lines[self.i][at + m.end() :]
            if rest and "\t" not in m[0] and (re.match(r"-(?:\s|$)", rest) or (rest[0] not in "[{#" and self.key(rest) and not _PROPERTY.match(rest))):
                self.lines[self.i] = " " * (at + m.end()) + rest
                found.append(self.node(depth + 1))
            else:
                self.i += 1
                found.append(self.value(rest, at, depth))
        if self.i < len(self.lines) and self.skip() and self.indent() > at:
            raise ValueError(self.lines[self.i])
        return found

    def value(self, text: str, at: int, depth: int, of_key: bool = False):
        """What stands after a key, a dash or at a line's start; the parent is indented by at."""
        text, name, tag = text.strip(), None, None
        while m := _PROPERTY.match(text):
            name, tag = m[1] or name, m[2] or tag
            text = text[m.end() :]
        out = self.bare(text, at, depth, of_key, tag)
        if name:
            self.anchors[name] = out
        return out

    def bare(self, text: str, at: int, depth: int, of_key: bool, tag: str | None):
        if not text or text[0] == "#":
            if self.skip():
                inner = self.indent()
                if inner > at or (of_key and inner == at and re.match(r"-(?:\s|$)", self.lines[self.i][inner:])):
                    return self.node(depth + 1)
            return "" if tag == "!!str" else None
        if m := _BLOCK.match(text):
            return self.block(m[1], m[2] or m[5] or "", int(m[3] or m[4] or 0), at)
        if text[0] == "*":
            if not (m := re.match(r"\*(\S+)\s*(?:#.*)?$", text)):
                raise ValueError(text)
            return self.alias(m[1])
        if text[0] in "\"'[{":
            while True:
                try:
                    out, end = self.flow(text, 0, 0)
                    break
                except _More:
                    if self.i >= len(self.lines):
                        raise ValueError("not closed") from None
                    text += "\n" + self.lines[self.i]
                    self.i += 1
            if not re.fullmatch(r"\s*(?:\s#.*)?", text[end:]):
                raise ValueError(text[end:])
            return out
        if text[0] in "|>%@`&" or re.match(r"[-?:](?:\s|$)", text):
            raise ValueError(text)
        own = re.split(r"\s#", text)[0].rstrip()
        if re.search(r":(?:\s|$)", own):
            raise ValueError(text)
        parts = [own]
        while own == text and self.i < len(self.lines):
            line = self.lines[self.i]
            if line.strip() and (len(line) - len(line.lstrip(" ")) <= at or line.lstrip()[0] == "#"):
                break
            if not line.strip() and not self.continues(at):
                break
            more = re.split(r"\s#", line)[0].strip()
            if re.search(r":(?:\s|$)", more):
                raise ValueError(line)
            parts.append(more)
            self.i += 1
        whole = _folded("\n".join(parts)) if len(parts) > 1 else own
        return whole if tag == "!!str" or len(parts) > 1 else scalar(whole)

    def continues(self, at: int) -> bool:
        """Whether the next line with text belongs to the scalar above."""
        line = next((x for x in self.lines[self.i :] if x.strip()), "")
        return len(line) - len(line.lstrip(" ")) > at and line.lstrip()[:1] not in ("#", "")

    def block(self, style: str, chomp: str, more: int, at: int) -> str:
        """A literal or folded block; every line counts, also those that look like comments."""
        lines, base = [], max(at, 0) + more if more else 0
        while self.i < len(self.lines):
            line = self.lines[self.i]
            own = len(line) - len(line.lstrip(" "))
            if line.strip(" "):
                base = base or own
                if own < base or own <= at:
                    break
            lines.append(line[base:] if base else "")
            self.i += 1
        tail = 0
        while lines and not lines[-1]:
            lines.pop()
            tail += 1
        if style == "|":
            text = "\n".join(lines)
        else:
            text, gap = "", 0
            for k, line in enumerate(lines):
                if k and not line:
                    gap += 1
                    continue
                spaced = line[:1] in (" ", "\t") or (k > 0 and prior[:1] in (" ", "\t"))
                text += ("" if not k else "\n" * (gap + 1) if spaced else "\n" * gap if gap else " ") + line
                gap, prior = 0, line
        if chomp == "-" or (not lines and chomp != "+"):
            return text
        return text + ("\n" * (tail + 1 if lines else tail) if chomp == "+" else "\n")

    def flow(self, text: str, at: int, depth: int):
        """(value, end) of what stands at a place within flow style."""
        if depth > _MOST_DEPTH:
            raise ValueError("nested too deep")
        at = self.blank(text, at)
        name, tag = None, None
        while m := _PROPERTY.match(text, at):
            name, tag, at = m[1] or name, m[2] or tag, self.blank(text, m.end())
        c = text[at : at + 1]
        if not c:
            raise _More
        if c == "[":
            out, at = [], self.blank(text, at + 1)
            while text[at : at + 1] != "]":
                item, at = self.flow(text, at, depth + 1)
                at = self.blank(text, at)
                if text[at : at + 1] == ":":  # a single pair
                    held, at = self.flow(text, at + 1, depth + 1)
                    item, at = {self.text_of(item): held}, self.blank(text, at)
                out.append(item)
                at = self.comma(text, at, "]")
            at += 1
        elif c == "{":
            out, at = {}, self.blank(text, at + 1)
            while text[at : at + 1] != "}":
                item, at = self.flow(text, at, depth + 1)
                at, held = self.blank(text, at), None
                if text[at : at + 1] == ":":
                    at = self.blank(text, at + 1)
                    if text[at : at + 1] not in (",", "}"):
                        held, at = self.flow(text, at, depth + 1)
                    at = self.blank(text, at)
                item = self.text_of(item)
                if item in out:
                    raise ValueError(f"key {item} stands twice")
                out[item] = held
                at = self.comma(text, at, "}")
            at += 1
        elif c in "\"'":
            out, at = _quoted(text, at)
        elif c == "*":
            if not (m := re.compile(r"\*([^\s,\[\]{}]+)").match(text, at)):
                raise ValueError(text)
            out, at = self.alias(m[1]), m.end()
        elif c in ",]}":
            out = None
        else:
            m = re.compile(r"(?:(?!:(?:[\s,\[\]{}]|$)|\s#)[^,\[\]{}])+").match(text, at)
            if not m:
                raise ValueError(text[at:])
            own = _folded(m[0].strip()) if "\n" in m[0].strip() else m[0].strip()
            out, at = own if tag == "!!str" else scalar(own), m.end()
        if name:
            self.anchors[name] = out
        return out, at

    @staticmethod
    def blank(text: str, at: int) -> int:
        at = re.compile(r"(?:\s+#[^\n]*|\s)*").match(text, at).end()
        return at

    def comma(self, text: str, at: int, end: str) -> int:
        c = text[at : at + 1]
        if not c:
            raise _More
        if c == ",":
            at = self.blank(text, at + 1)
            if at >= len(text):
                raise _More
            return at
        if c != end:
            raise ValueError(text[at:])
        return at


def load(text: str):
    """The value of a YAML document."""
    r = _Reader(text)
    if not r.skip():
        return None
    try:
        out = r.node(0)
    except _More:
        raise ValueError("not closed") from None
    if r.skip():
        raise ValueError(r.lines[r.i])
    return out
