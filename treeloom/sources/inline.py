"""Inline parts of Markdown: a scan that fills a list of nodes and open marks, closed from the inside out.

Runs of ``*``, ``_`` and ``~`` open or close by what stands on their two sides;
brackets become links where a destination or a known definition follows. Text within
code, autolinks and HTML is never looked at again, so each character is scanned once.
A node is a dict with a type and what its type has.
"""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass

# What may start an inline part, and the forms of those that stand on their own.
_START = re.compile(r"[\\`$<&\[\]*_~\n:@]|!\[|(?<![A-Za-z0-9/])(?:https?://|www\.)", re.I)
_ESCAPED = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_ADDRESS = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>\x00-\x1f]*)>")
_MAIL = re.compile(r"<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*)>")
_ATTRIBUTE = r"(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)"
OPEN_TAG, CLOSE_TAG = rf"<[A-Za-z][A-Za-z0-9-]*{_ATTRIBUTE}*\s*/?>", r"</[A-Za-z][A-Za-z0-9-]*\s*>"
_TAG = re.compile(rf"{OPEN_TAG}|{CLOSE_TAG}|<!---?>|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
_WEB = re.compile(r"(?:https?://|www\.)[^\s<]+", re.I)
_MAIL_BEFORE, _MAIL_AFTER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._+-"), re.compile(r"@(?:[A-Za-z0-9_-]+\.)+[A-Za-z0-9_-]*[A-Za-z0-9]")
_DIRECTIVE = re.compile(r":([A-Za-z](?:[\w-]*[A-Za-z0-9])?)(?![\w:-])")
_ATTRIBUTES = re.compile(r"\{[^{}\n]*\}")
_DESTINATION = re.compile(r"<((?:[^<>\\\n]|\\.)*)>")
_TITLE = re.compile(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\)", re.S)
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]", re.S)
_BLANKS = re.compile(r"[ \t]*\n?[ \t]*")
_NAMES = {("*", 1): "emphasis", ("_", 1): "emphasis", ("*", 2): "strong", ("_", 2): "strong"}


def normal_id(x: str) -> str:
    return " ".join(x.split()).lower()


def unescaped(x: str) -> str:
    """Without backslashes before marks, and with entities as their characters."""
    return re.sub(r"\\([!-/:-@\[-`{-~])|(&[#A-Za-z][A-Za-z0-9]*;)", lambda m: m[1] if m[1] else entity(m[2]) or m[2], x)


def entity(x: str) -> str | None:
    """The characters that a whole entity stands for; None if it stands for none."""
    if not _ENTITY.fullmatch(x):
        return None
    found = html.unescape(x)
    return None if found == x else found if found else "\ufffd"


def destination(text: str, at: int) -> tuple[str, int] | None:
    """(a link's destination, where it ends) at a place."""
    if m := _DESTINATION.match(text, at):
        return unescaped(m[1]), m.end()
    if text[at : at + 1] == "<":
        return None
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "\\" and text[i + 1 : i + 2] in _ESCAPED and i + 1 < len(text):
            i += 2
            continue
        if c <= " " or c == "\x7f" or (c == ")" and not depth):
            break
        depth += (c == "(") - (c == ")")
        i += 1
        if depth > 32:
            return None
    return None if depth else (unescaped(text[at:i]), i)


def title(text: str, at: int) -> tuple[str, int] | None:
    """(a link's title, where it ends) at a place; a title holds no blank line."""
    m = _TITLE.match(text, at)
    if not m or re.search(r"\n[ \t]*\n", m[0]):
        return None
    return unescaped(next(g for g in m.groups() if g is not None)), m.end()


def _target(text: str, at: int) -> tuple[str, str | None, int] | None:
    """(destination, title, end) of what follows a link's text in round brackets."""
    at = _BLANKS.match(text, at + 1).end()
    found = ("", at) if text[at : at + 1] == ")" else destination(text, at)
    if found is None:
        return None
    url, end = found
    after = _BLANKS.match(text, end).end()
    own = title(text, after) if after > end else None
    if own:
        after = _BLANKS.match(text, own[1]).end()
    return (url, own[0] if own else None, after + 1) if text[after : after + 1] == ")" else None


@dataclass(eq=False)
class _Run:
    """A run of marks that is still open or may close."""

    mark: str
    count: int
    opens: bool
    closes: bool
    size: int = 0


@dataclass(eq=False)
class _Bracket:
    """An open bracket: its place among the parts and in the text."""

    at: int
    image: bool
    start: int
    active: bool = True


def _ends(text: str, at: int) -> str:
    """What ends the comment, instruction or section at a place; where it is missing, no later one ends."""
    return next((end for start, end in (("<!--", "-->"), ("<?", "?>"), ("<![CDATA[", "]]>"), ("<!", ">")) if text.startswith(start, at)), "")


def _blank(c: str) -> bool:
    return c == "" or c.isspace()


def _mark(c: str) -> bool:
    return c != "" and unicodedata.category(c)[0] in "PS"


def _run(text: str, at: int) -> _Run:
    mark, end = text[at], at
    while end < len(text) and text[end] == mark:
        end += 1
    before, after = text[at - 1 : at], text[end : end + 1]
    left = not _blank(after) and (not _mark(after) or _blank(before) or _mark(before))
    right = not _blank(before) and (not _mark(before) or _blank(after) or _mark(after))
    if mark == "_":
        opens, closes = left and (not right or _mark(before)), right and (not left or _mark(after))
    else:
        opens, closes = left, right
    if mark == "~" and end - at > 2:
        opens = closes = False
    return _Run(mark, end - at, opens, closes, end - at)


def _joined(parts: list) -> list[dict]:
    """Parts as nodes: marks that stayed open are text, and texts side by side are one."""
    out: list[dict] = []
    pieces: list[str] = []
    for p in [*parts, None]:
        if isinstance(p, _Run):
            pieces.append(p.mark * p.count)
        elif p is not None and p["type"] == "text":
            pieces.append(p["value"])
        else:
            if value := "".join(pieces):
                out.append({"type": "text", "value": value})
            pieces.clear()
            if p is not None:
                out.append(p)
    return out


def _fits(o: _Run, r: _Run) -> bool:
    if o.mark != r.mark:
        return False
    if o.mark == "~":
        return o.count == r.count
    # Where a run can both open and close, lengths that add up to a multiple of three don't pair, but for two such multiples.
    return not ((o.closes or r.opens) and (o.size + r.size) % 3 == 0 and (o.size % 3 or r.size % 3))


def _closed(parts: list) -> list[dict]:
    """Nodes of parts, with emphasis made of the runs that pair."""
    out: list = []
    opened: list[tuple[int, _Run]] = []
    bottom: dict[tuple, int] = {}
    for p in parts:
        if not isinstance(p, _Run):
            out.append(p)
            continue
        key = (p.mark, p.opens, p.size % 3 if p.mark != "~" else p.size)
        while p.closes and p.count:
            k = len(opened) - 1
            least = min(bottom.get(key, 0), len(opened))
            while k >= least and not _fits(opened[k][1], p):
                k -= 1
            if k < least:
                bottom[key] = len(opened)
                break
            at, o = opened[k]
            n = o.count if p.mark == "~" else 2 if o.count > 1 and p.count > 1 else 1
            node = {"type": "delete" if p.mark == "~" else _NAMES[p.mark, n], "children": _joined(out[at + 1 :])}
            del out[at + 1 :], opened[k + 1 :]
            o.count, p.count = o.count - n, p.count - n
            if not o.count:
                out.pop()
                opened.pop()
            out.append(node)
        if p.count:
            if p.opens:
                opened.append((len(out), p))
            out.append(p)
    return _joined(out)


def _unlinked(nodes: list[dict]) -> list[dict]:
    """Links may not hold links: addresses found in a link's text are text."""
    return _joined([c for n in nodes for c in (n["children"] if n.get("found") else [n])])


def inline(text: str, defined=frozenset(), notes=frozenset()) -> list[dict]:
    """Inline nodes of a text; defined and notes are the identifiers of definitions and of footnotes."""
    if not _START.search(text):
        return [{"type": "text", "value": text}] if text else []
    parts: list = []
    open_brackets: list[_Bracket] = []
    unclosed: set = set()
    i, n = 0, len(text)

    def say(x: str) -> None:
        parts.append({"type": "text", "value": x})

    put = parts.append

    def said() -> str:
        """The text right before, since the last mark."""
        return parts[-1]["value"] if parts and not isinstance(parts[-1], _Run) and parts[-1]["type"] == "text" else ""

    def cut(length: int) -> None:
        if length:
            parts[-1] = {"type": "text", "value": parts[-1]["value"][:-length]}

    while i < n:
        m = _START.search(text, i)
        if not m:
            say(text[i:])
            break
        say(text[i : m.start()])
        i, c = m.start(), m[0][0]
        if len(m[0]) > 2:
            own = _WEB.match(text, i)[0]
            surplus = own.count(")") - own.count("(")
            while True:
                short = own.rstrip("?!.,:*_~'\"")
                if short.endswith(";") and (e := short.rfind("&")) >= 0 and short[e + 1 : -1].isalnum():
                    short = short[:e]
                if short.endswith(")") and surplus > 0:
                    short, surplus = short[:-1], surplus - 1
                if short == own:
                    break
                own = short
            stop = own.find("]") if open_brackets else -1
            own = own if stop < 0 else own[:stop]
            if re.match(r"(?:https?://[^/?#]|www\.[^/?#.])", own, re.I):
                put({"type": "link", "url": own if own[:1] in "hH" else f"http://{own}", "title": None, "children": [{"type": "text", "value": own}], "found": True})
                i += len(own)
            else:
                say(text[i])
                i += 1
        elif c == "\\":
            if text[i + 1 : i + 2] == "\n":
                put({"type": "break"})
                i = _BLANKS.match(text, i + 1).end()
            elif i + 1 < n and text[i + 1] in _ESCAPED:
                say(text[i + 1])
                i += 2
            else:
                say(c)
                i += 1
        elif c == "\n":
            blanks = len(said()) - len(said().rstrip(" "))
            cut(blanks)
            if blanks > 1:
                put({"type": "break"})
            else:
                say("\n")
            i += 1
            while i < n and text[i] in " \t":
                i += 1
        elif c in "`$":
            end = i
            while end < n and text[end] == c:
                end += 1
            run = text[i:end]
            close = None if (c, len(run)) in unclosed else re.compile(rf"(?<!{re.escape(c)}){re.escape(run)}(?!{re.escape(c)})").search(text, end)
            if close:
                inner = text[end : close.start()].replace("\n", " ")
                if inner[:1] == inner[-1:] == " " and inner.strip(" "):
                    inner = inner[1:-1]
                put({"type": "inlineCode" if c == "`" else "inlineMath", "value": inner})
                i = close.end()
            else:
                unclosed.add((c, len(run)))
                say(run)
                i = end
        elif c == "<":
            if m := _ADDRESS.match(text, i) or _MAIL.match(text, i):
                url = m[1] if ":" in m[1] and m.re is _ADDRESS else f"mailto:{m[1]}"
                put({"type": "link", "url": url, "title": None, "children": [{"type": "text", "value": m[1]}]})
                i = m.end()
            elif (m := None if (stop := _ends(text, i)) in unclosed else _TAG.match(text, i)) or (unclosed.add(stop) if stop else None):
                put({"type": "html", "value": m[0]})
                i = m.end()
            else:
                say(c)
                i += 1
        elif c == "&":
            m = _ENTITY.match(text, i)
            own = entity(m[0]) if m else None
            say(own or c)
            i += len(m[0]) if own else 1
        elif c in "*_~":
            own = _run(text, i)
            put(own if own.opens or own.closes else {"type": "text", "value": own.mark * own.size})
            i += own.size
        elif c == "@":
            before, start = said(), 0
            while start < len(before) and before[-1 - start] in _MAIL_BEFORE:
                start += 1
            after = _MAIL_AFTER.match(text, i) if start else None
            if after and text[after.end() : after.end() + 1] not in ("-", "_"):
                own = before[len(before) - start :] + after[0]
                cut(start)
                put({"type": "link", "url": f"mailto:{own}", "title": None, "children": [{"type": "text", "value": own}], "found": True})
                i = after.end()
            else:
                say(c)
                i += 1
        elif c == ":":
            m = _DIRECTIVE.match(text, i) if text[i - 1 : i] != ":" or not i else None
            if m:
                i, inner = m.end(), []
                if label := _LABEL.match(text, i):
                    inner, i = inline(label[1], defined, notes), label.end()
                if more := _ATTRIBUTES.match(text, i):
                    i = more.end()
                put({"type": "textDirective", "name": m[1], "children": inner})
            else:
                say(c)
                i += 1
        elif c in "[!":
            note = _LABEL.match(text, i) if text.startswith("[^", i) else None
            if note and (own := normal_id(note[1][1:])) in notes:
                put({"type": "footnoteReference", "identifier": own})
                i = note.end()
            else:
                put({"type": "text", "value": m[0]})
                open_brackets.append(_Bracket(len(parts) - 1, c == "!", i + len(m[0])))
                i += len(m[0])
        else:  # a closing bracket
            if not open_brackets:
                say(c)
                i += 1
                continue
            b = open_brackets.pop()
            found, end = None, i + 1
            if b.active:
                if text[end : end + 1] == "(" and (to := _target(text, end)):
                    found, end = {"type": "image" if b.image else "link", "url": to[0], "title": to[1]}, to[2]
                else:
                    label = _LABEL.match(text, end)
                    own = label[1] if label and label[1].strip() else text[b.start : i] if i - b.start <= 999 and (label is None or not label[1]) else ""
                    name = normal_id(own)
                    if name in defined and _LABEL.fullmatch(f"[{own}]"):
                        found, end = {"type": "imageReference" if b.image else "linkReference", "identifier": name}, label.end() if label else end
            if found is None:
                say(c)
                i += 1
                continue
            inner = _closed(parts[b.at + 1 :])
            del parts[b.at :]
            if b.image:
                found["alt"] = plain(inner)
            else:
                found["children"] = _unlinked(inner)
                for other in open_brackets:
                    other.active = other.active and other.image
            parts.append(found)
            i = end
    out = _closed(parts)
    for node in out:
        _tidy(node)
    return out


def _tidy(node: dict) -> None:
    todo = [node]
    while todo:
        now = todo.pop()
        now.pop("found", None)
        todo += now.get("children", [])


def plain(nodes: list[dict]) -> str:
    """Text of inline nodes without separators; an image gives its alternative, a break a blank."""
    if len(nodes) == 1 and nodes[0]["type"] == "text":
        return nodes[0]["value"]
    out, todo = [], list(reversed(nodes))
    while todo:
        n = todo.pop()
        if n["type"] in ("image", "imageReference"):
            out.append(n.get("alt") or "")
        elif n["type"] == "break":
            out.append(" ")
        elif "children" in n:
            todo += reversed(n["children"])
        else:
            out.append(n.get("value", ""))
    return "".join(out)
