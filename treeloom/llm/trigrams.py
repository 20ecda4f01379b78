"""Boolean trigram queries that follow from a regular expression.

``query(pattern)`` is a disjunction of conjunctions of trigrams: a text that
matches the pattern holds, after lower-casing, every trigram of at least one
conjunction. None means that no trigram is mandatory, so the rule scans fully.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

#: Strings that a part of a pattern may stand for before it counts as open.
MOST_STRINGS = 64

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def _strings(items) -> set[str] | None:
    """All strings that a sequence of parsed items can match, or None if they are too many."""
    found = {""}
    for op, arg in items:
        if op is C.LITERAL:
            own = {chr(arg)}
        elif op is C.IN:
            own = set()
            for kind, value in arg:
                if kind is C.LITERAL:
                    own.add(chr(value))
                elif kind is C.RANGE and value[1] - value[0] < MOST_STRINGS:
                    own |= {chr(c) for c in range(value[0], value[1] + 1)}
                else:
                    return None
        elif op is C.SUBPATTERN:
            own = _strings(arg[3])
        elif op is C.BRANCH:
            parts = [_strings(x) for x in arg[1]]
            own = None if None in parts else set().union(*parts)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            base = _strings(inner)
            if base is None or high is C.MAXREPEAT or len(base) ** min(high, 8) > MOST_STRINGS or high > 64:
                return None
            own, run = set(), {""}
            for k in range(high + 1):
                if k >= low:
                    own |= run
                run = {a + b for a in run for b in base}
        elif op is C.AT:
            own = {""}
        else:
            return None
        if own is None or len(found) * len(own) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in own}
    return found


def _grams(strings: set[str]) -> Query:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in map(str.lower, strings)))


def _least(q: Query) -> Query:
    """Without conjunctions that another one implies."""
    return frozenset(x for x in q if not any(y < x for y in q))


def _and(a: Query, b: Query) -> Query:
    return _least(frozenset(x | y for x in a for y in b))


def _of(items) -> Query:
    """The query of a sequence: runs of items with few strings count together, others alone."""
    total, run = ANY, []

    def flush() -> Query:
        return _grams(_strings(run) or {""}) if run else ANY

    for item in items:
        if _strings([*run, item]) is not None:
            run.append(item)
            continue
        total, run = _and(total, flush()), []
        if _strings([item]) is not None:
            run = [item]
            continue
        op, arg = item
        if op is C.SUBPATTERN:
            total = _and(total, _of(arg[3]))
        elif op is C.BRANCH:
            total = _and(total, _least(frozenset().union(*(_of(x) for x in arg[1]))))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            total = _and(total, _of(arg[2]))
    return _and(total, flush())


def query(pattern: str) -> Query | None:
    found = _of(list(_parser.parse(pattern, re.ASCII)))
    return None if frozenset() in found else found
