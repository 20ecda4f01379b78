"""Comparison of two documents: matches, changes, moves, renames, spans, counts.

One pair is one unit of work. ``compare`` runs the steps that depend on each other
within a pair; ``plans.pairs`` spreads pairs over a table.
"""

from __future__ import annotations

import bisect
import gc
import math
import operator
import sys
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from treeloom.plans import kernels as k
from treeloom.plans.document import Document, Node, canonical, slug, words
from treeloom.plans.similarity import fallback_score, margin, multisets, recallable, relabel_score, sequence, sets, similarity


@dataclass(frozen=True)
class Options:
    """Fixed values, as the defaults of a comparison."""

    min_similarity: float = 0.55
    min_margin: float = 0.12
    most_local_cost: int = 12_000
    most_recursive_cost: int = 60_000
    most_inline_cost: int = 4_000
    most_tree_cost: int = 10_000
    tree_share: float = 0.35
    local_recovery: bool = True
    long_code: int = 200
    code_context: int = 20
    sibling_offset: int = 3
    sibling_window: int = 5
    size_low: float = 0.3
    size_high: float = 3.0
    depth_most: int = 2
    recall_distance: int = 24
    recall_most: int = 6
    child_bonus: float = 0.15


#: Without budgets: all candidates, pairs and parts are looked at, of documents of any size. What the registered queries compare by.
WHOLE = Options(most_local_cost=sys.maxsize, most_recursive_cost=sys.maxsize, most_inline_cost=sys.maxsize, most_tree_cost=sys.maxsize, recall_most=sys.maxsize)


#: Matches that bound where others may lie.
ANCHORS = frozenset(("forced-root", "exact-subtree", "exact-subtree-resolved", "exact-self"))


@dataclass(eq=False)
class Change:
    """op: equal, insert, delete, replace, move, meta-update."""

    op: str
    old: Node | None
    new: Node | None
    children: list[Change] = field(default_factory=list)
    pair_kind: str = "none"  # match, aligned or none
    match_kind: str = ""
    score: float | None = None
    move_id: str = ""
    role: str = ""
    renamed: bool = False
    reordered: bool = False
    self_changed: bool = False
    below_changed: bool = False
    meta_changed: bool = False
    inline_changed: bool = False
    degraded: bool = False
    warnings: list[str] = field(default_factory=list)
    meta: list[tuple] = field(default_factory=list)
    spans: list[tuple] = field(default_factory=list)

    @property
    def node(self) -> Node:
        return self.new or self.old


class Comparison:
    def __init__(self, old: Document, new: Document, options: Options):
        self.old, self.new, self.o = old, new, options
        self.by_old: dict[Node, Node] = {}
        self.by_new: dict[Node, Node] = {}
        self.kind: dict[Node, tuple[str, float]] = {}
        self.warnings: list[str] = []
        self.anchors: list[tuple[int, int]] = []
        table: dict = {}
        for document in (old, new):
            document.number(table)

    def release(self) -> None:
        """Takes both documents apart, whose nodes point at each other, so that they go without a collection."""
        for document in (self.old, self.new):
            for n in document.nodes:
                n.__dict__.clear()
            document.nodes.clear()

    # -- matches

    def match(self, a: Node, b: Node, kind: str, score: float = 1.0) -> bool:
        """One to one: false if either has another partner."""
        if a in self.by_old or b in self.by_new:
            return self.by_old.get(a) is b
        self.by_old[a], self.by_new[b], self.kind[a] = b, a, (kind, score)
        if kind in ANCHORS:
            bisect.insort(self.anchors, (a.preorder, b.preorder))
        return True

    def parents_matched(self, a: Node, b: Node) -> bool:
        return a.parent is not None and self.by_old.get(a.parent) is b.parent

    def context(self, a: Node, b: Node) -> float:
        return 1.0 if self.parents_matched(a, b) else 0.7

    def unique(self, olds, news, key) -> list[tuple[Node, Node]]:
        """Pairs whose key, if any, is unique on both sides; in the order of the old side."""
        if not olds or not news:
            return []
        a: dict[tuple, Node | None] = {}
        b: dict[tuple, Node | None] = {}
        for side, nodes in ((a, olds), (b, news)):
            for n in nodes:
                if (x := key(n)) is not None:
                    at = (n.shape, x)
                    side[at] = None if at in side else n
        return [(p, q) for at, p in a.items() if p is not None and (q := b.get(at)) is not None]

    def deterministic(self) -> None:
        self.match(self.old.root, self.new.root, "forced-root")
        covered: set[Node] = set()
        pairs = self.unique(self.old.nodes[1:], self.new.nodes[1:], lambda n: n.keys["subtree"])
        for a, b in sorted(pairs, key=lambda p: (-p[0].size, p[0].preorder)):
            if a not in covered and b not in covered and self.match(a, b, "exact-subtree"):
                covered.update(a.below(), b.below(), (a, b))
        self.resolve_repeated(covered)
        olds = [n for n in self.old.nodes[1:] if n not in covered]
        news = [n for n in self.new.nodes[1:] if n not in covered]
        is_kind = lambda kind, f: lambda n: f(n) if n.kind == kind else None
        found: list[tuple[int, str, Node, Node]] = []
        for a, b in self.unique(olds, news, lambda n: n.keys["self"]):
            if kind := self.guarded(a, b):
                found.append((5, kind, a, b))
        for a, b in self.unique([n for n in olds if n.entity == "section"], [n for n in news if n.entity == "section"], lambda n: n.keys["direct"]):
            if self.guarded(a, b):
                found.append((4, "exact-direct", a, b))
        rules = (
            (3, "footnote-identity", is_kind("footnote", lambda n: n.keys["identity"])), (2, "footnote-identifier", is_kind("footnote", lambda n: n.identifier)),
            (2, "definition-identity", is_kind("definition", lambda n: n.keys["identity"])), (1, "definition-identifier", is_kind("definition", lambda n: n.identifier)),
            (1, "frontmatter-anchor", is_kind("frontmatter", lambda n: "")),
        )
        few = [[n for n in side if n.kind in ("footnote", "definition", "frontmatter")] for side in (olds, news)]
        for rank, kind, key in rules:
            found += [(rank, kind, a, b) for a, b in self.unique(*few, key)]
        top: dict[Node, int] = {}
        for rank, _, a, b in found:
            top[a], top[b] = max(top.get(a, 0), rank), max(top.get(b, 0), rank)
        best = {(a, b): kind for rank, kind, a, b in found if rank == top[a] == top[b]}
        ends = Counter(x for p in best for x in p)
        for (a, b), kind in best.items():
            if ends[a] == ends[b] == 1:
                self.match(a, b, kind)

    def resolve_repeated(self, covered: set[Node]) -> None:
        """Subtrees that stand equally often, and more than once, on both sides, where their children tell which is which."""
        sides: list[dict] = [defaultdict(list), defaultdict(list)]
        for by, nodes in zip(sides, (self.old.nodes[1:], self.new.nodes[1:]), strict=True):
            for n in nodes:
                by[n.shape, n.keys["subtree"]].append(n)
        groups = [(v, sides[1][x]) for x, v in sides[0].items() if len(v) > 1 and len(v) == len(sides[1].get(x, ()))]
        for olds, news in sorted(groups, key=lambda g: -g[0][0].size):
            for a, b in told_apart(olds, news, lambda n: [c.keys["subtree"] for c in n.children]):
                if a not in covered and b not in covered and self.match(a, b, "exact-subtree-resolved"):
                    covered.update(a.below(), b.below(), (a, b))

    def bounds(self, a: Node, parent: Node | None) -> tuple[int, int] | None:
        """Between which places under parent the partner of a lies, by a's nearest siblings with a partner there; None without any."""
        if a.parent is None or parent is None:
            return None
        low, high = -1, len(parent.children)
        found = False
        for s in a.parent.children:
            p = self.by_old.get(s)
            if s is not a and p is not None and p.parent is parent:
                found = True
                if s.place < a.place:
                    low = p.place
                else:
                    high = p.place
                    break
        return (low, high) if found and low < high else None

    def interval(self, a: Node) -> tuple[int, int] | None:
        """First and last place in the new document's order between the partners of the nearest anchors; None if that is empty."""
        left = bisect.bisect_left(self.anchors, (a.preorder, -1)) - 1
        right = bisect.bisect_left(self.anchors, (a.preorder + 1, -1))
        low = self.anchors[left][1] + 1 if left >= 0 else 0
        high = self.anchors[right][1] - 1 if right < len(self.anchors) else len(self.new.nodes) - 1
        return (low, high) if low <= high else None

    def anchored(self, a: Node, b: Node) -> bool:
        """Whether b lies where a's anchors allow it: among siblings if some are matched, else in the whole document."""
        if (near := self.bounds(a, b.parent)) is not None:
            return near[0] < b.place < near[1]
        whole = self.interval(a)
        return whole is None or whole[0] <= b.preorder <= whole[1]

    def guarded(self, a: Node, b: Node) -> str:
        """exact-self under matched parents; near its place with a witness exact-self-with-context; else none."""
        if self.parents_matched(a, b):
            return "exact-self"
        if a.parent is None or b.parent is None or abs(a.place - b.place) > self.o.sibling_offset or not self.anchored(a, b):
            return ""
        near = lambda n: {s.keys["self"] for s in n.parent.children if 0 < abs(s.place - n.place) <= self.o.sibling_window}
        return "exact-self-with-context" if near(a) & near(b) else ""

    # -- alignment

    def changed(self, a: Node, b: Node, pair_kind: str) -> Change:
        kind, score = self.kind.get(a, ("", None)) if pair_kind == "match" else ("", similarity(a, b, self.context(a, b)))
        same = a.keys["self"] == b.keys["self"] or (a.entity == "section" and self.own(a) == self.own(b))
        c = Change("equal" if same else "replace", a, b, pair_kind=pair_kind, match_kind=kind, score=score, self_changed=not same)
        if kind == "exact-subtree":
            return c
        cost = len(a.children) * len(b.children) + len(a.children) + len(b.children)
        limit, why = (self.o.most_recursive_cost, "subtree-budget-exceeded") if pair_kind == "match" else (self.o.most_local_cost, "local-window-exceeded")
        if cost > limit:
            c.degraded = True
            c.warnings.append(why)
            c.below_changed = a.keys["body"] != b.keys["body"]
            return c
        self.seed(a, b)
        c.children = self.align(a, b)
        self.rejoin(c)
        self.fall_back(c)
        self.mark_reordered(c)
        c.below_changed = any(x.op != "equal" or x.renamed or x.below_changed for x in c.children)
        return c

    @staticmethod
    def own(n: Node) -> str:
        """What a section itself shows, without its body."""
        return canonical([n.kind, n.title if n.kind == "heading" else "", n.heading_depth, n.list_depth, n.quote_depth, n.checked, n.ordered, n.identifier, n.value, n.inline])

    def one_sided(self, n: Node, op: str) -> Change:
        """A deletion or insertion of a node and all below it, also of what has a partner elsewhere (``recover_moves`` finds that)."""
        return Change(op, n if op == "delete" else None, n if op == "insert" else None, [self.one_sided(c, op) for c in n.children])

    def align(self, a: Node, b: Node) -> list[Change]:
        olds, news = a.children, b.children
        # Partners have the old one's id for a token, others the number of their selves.
        x = [n.id if (p := self.by_old.get(n)) is not None and p.parent is b else n.keys["self"] for n in olds]
        y = [p.id if (p := self.by_new.get(n)) is not None and p.parent is a else n.keys["self"] for n in news]
        out: list[Change] = []
        gap_old: list[Node] = []
        gap_new: list[Node] = []

        def flush() -> None:
            out.extend(self.gap(gap_old, gap_new))
            gap_old.clear()
            gap_new.clear()

        for op, i, j in k.align(x, y) if x != y else [("equal", i, i) for i in range(len(x))]:
            if op == "equal":
                p, q = olds[i], news[j]
                if p not in self.by_old and q not in self.by_new and abs(p.place - q.place) <= self.o.sibling_offset:
                    self.match(p, q, "aligned-self")
                flush()
                out.append(self.changed(p, q, "match" if self.by_old.get(p) is q else "aligned") if (self.by_old.get(p) in (q, None) and self.by_new.get(q) in (p, None)) else Change("equal", p, q, pair_kind="aligned"))
            elif op == "delete":
                gap_old.append(olds[i])
            else:
                gap_new.append(news[j])
        flush()
        return out

    def rejoin(self, c: Change) -> None:
        """A deletion and an insertion of matched siblings become one change, at the new place."""
        gone = {x.old: x for x in c.children if x.op == "delete"}
        if not gone:
            return
        for x in list(c.children):
            p = self.by_new.get(x.new) if x.op == "insert" else None
            if p in gone:
                c.children[c.children.index(x)] = self.changed(p, x.new, "match")
                c.children.remove(gone.pop(p))

    @staticmethod
    def mark_reordered(c: Change) -> None:
        """Pairs that leave the longest run in common order."""
        kept = sorted([x for x in c.children if x.old is not None and x.new is not None], key=lambda x: x.old.place)
        places = [x.new.place for x in kept]
        if all(map(operator.lt, places, places[1:])):
            for x in kept:
                x.reordered = False
            return
        steady = set(k.longest_increasing(places))
        for i, x in enumerate(kept):
            x.reordered = i not in steady

    def gap(self, olds: list[Node], news: list[Node]) -> list[Change]:
        """Matched pairs, then the optimal pairing of the rest, then deletions and insertions."""
        if not olds and not news:
            return []
        pairs = {p: self.by_old[p] for p in olds if self.by_old.get(p) in news}
        left = [p for p in olds if p not in self.by_old]
        right = [q for q in news if q not in self.by_new]
        identifiers = Counter(n.identifier for side in (left, right) for n in {id(m): m for m in side}.values() if n.kind == "definition")
        costs = []
        for p in left:
            row: list[float | None] = []
            for q in right:
                score = similarity(p, q, self.context(p, q)) if p.shape == q.shape else 0.0
                allowed = score >= self.o.min_similarity or self.short_heading(p, q)
                if p.kind == "definition" and p.identifier == q.identifier and identifiers[p.identifier] > 2:
                    allowed = False
                row.append(1 - score + 1e-6 * abs(p.place - q.place) if allowed and p.shape == q.shape else None)
            costs.append(row)
        aligned = {left[i]: right[j] for i, j in k.optimal_assignment(costs)}
        out = []
        for p in olds:
            if p in pairs:
                out.append(self.changed(p, pairs[p], "match"))
            elif p in aligned:
                out.append(self.changed(p, aligned[p], "aligned"))
            else:
                out.append(self.one_sided(p, "delete"))
        taken = set(aligned.values()) | set(pairs.values())
        for q in news:
            if q not in taken:
                out.append(self.one_sided(q, "insert"))
        return out

    def short_heading(self, p: Node, q: Node) -> bool:
        """Headings that differ in name only, at one place, with names that no sibling has."""
        if not (p.kind == q.kind == "heading" and p.entity == "section" and p.heading_depth == q.heading_depth and abs(p.place - q.place) <= 1 and self.parents_matched(p, q)):
            return False
        if any(s is not p and s.normal == q.normal for s in p.parent.children) or any(s is not q and s.normal == p.normal for s in q.parent.children):
            return False
        return (p.keys["body"] == q.keys["body"] and bool(p.children)) or (not p.children and not q.children and bool(slug(p.title)) and bool(slug(q.title)))

    def seed(self, a: Node, b: Node) -> None:
        """Matches among unmatched children: equal selves, headings by slug and by body, identities, and clear likeness."""
        rest = lambda: ([n for n in a.children if n not in self.by_old], [n for n in b.children if n not in self.by_new])
        olds, news = rest()
        if not olds or not news:
            return
        head = lambda n: n.kind == "heading" and n.entity == "section"
        rules = (
            ("local-self", lambda n: n.keys["self"]), ("local-slug", lambda n: slug(n.title) or None if head(n) else None),
            ("local-body", lambda n: f"{n.heading_depth}:{n.list_depth}:{n.quote_depth}:{n.keys['body']}" if head(n) and n.children else None),
            ("local-identity", lambda n: n.keys["identity"] if n.kind in ("definition", "footnote") else None),
        )
        for kind, key in rules:
            for p, q in (found := self.unique(olds, news, key)):
                self.match(p, q, kind)
            if found:
                olds, news = rest()
        if len(olds) * len(news) > self.o.most_local_cost:
            return
        scores: dict[tuple[Node, Node], float] = {}
        for p in olds:
            for q in self.recalled(p, self.bounded(p, [q for q in news if q.shape == p.shape], b)):
                base = similarity(p, q, self.context(p, q))
                shared = multisets(Counter(c.keys["self"] for c in p.children), Counter(c.keys["self"] for c in q.children)) if p.children and q.children else 0.0
                scores[p, q] = base + self.o.child_bonus * shared
        lead = leads(scores)
        for (p, q), s in sorted(scores.items(), key=lambda x: (-x[1], x[0][0].preorder)):
            if s >= self.o.min_similarity and lead(p, q, s) >= self.o.min_margin:
                self.match(p, q, "local-similarity", s)

    def bounded(self, p: Node, qs: list[Node], parent: Node) -> list[Node]:
        """Those between the partners of p's nearest matched siblings; all if none is."""
        near = self.bounds(p, parent)
        return qs if near is None else [q for q in qs if near[0] < q.place < near[1]] or qs

    def recalled(self, p: Node, qs: list[Node]) -> list[Node]:
        if len(qs) <= self.o.recall_most or p.sim is None:
            return qs
        near = sorted((bin(p.sim ^ q.sim).count("1"), q.preorder, q) for q in qs if q.sim is not None)
        found = [q for d, _, q in near if d <= self.o.recall_distance][: self.o.recall_most]
        return found or qs

    def fall_back(self, c: Change) -> None:
        """Where much stays unpaired, a tree edit proposes pairs of deletions and insertions; clear and good ones are taken, the cheapest first."""
        if not self.o.local_recovery:
            return
        unpaired = sum(x.op != "equal" for x in c.children)
        if unpaired / max(1, len(c.old.children) + len(c.new.children)) <= self.o.tree_share:
            return
        gone, come = [x for x in c.children if x.op == "delete"], [x for x in c.children if x.op == "insert"]
        if len(gone) * len(come) > self.o.most_tree_cost:
            c.warnings.append("tree-budget-exceeded")
            return
        tops = {x.old: x for x in gone}, {x.new: x for x in come}
        may = lambda p, q: p.shape == q.shape and recallable(p, q)
        cost = lambda p, q: 1 - relabel_score(p, q)
        edit = lambda olds, news: k.tree_edit_matches(olds, news, lambda n: n.children, may, cost)
        found = [(p, q) for p, q in edit(list(tops[0]), list(tops[1]))[0] if p in tops[0] and q in tops[1]] if gone and come else []
        scores = {(p, q): fallback_score(p, q, self.context(p, q)) for p, q in found}
        of_old, of_new = defaultdict(list), defaultdict(list)
        for (p, q), s in scores.items():
            of_old[p].append(s)
            of_new[q].append(s)
        good = [x for x, s in scores.items() if s >= self.o.min_similarity and min(margin(of_old[x[0]]), margin(of_new[x[1]])) >= self.o.min_margin]
        if not good:
            c.warnings.append("tree-no-candidates")
            return
        used: set[Node] = set()
        for p, q in sorted(good, key=lambda x: (edit([x[0]], [x[1]])[1], -scores[x])):
            if p not in used and q not in used:
                used |= {p, q}
                c.children.remove(tops[0][p])
                c.children[c.children.index(tops[1][q])] = self.changed(p, q, "aligned")

    # -- after alignment

    def recover_moves(self, root: Change) -> None:
        """Deletions and insertions of one content at another place.

        A pair whose subtrees differ keeps what changed below it, under its target.
        """
        everything = list(walk(root))
        gone = [c for c in everything if c.op == "delete"]
        come = [c for c in everything if c.op == "insert"]
        covered: set[int] = set()
        count = lambda key: (Counter(key(c.old) for c in gone), Counter(key(c.new) for c in come))
        by = {h: count(lambda n, h=h: (n.shape, n.keys[h])) for h in ("subtree", "content")}
        pairs = defaultdict(list)
        for c in come:
            pairs[c.new.shape].append(c)
        slugs: tuple[dict, dict] = (defaultdict(list), defaultdict(list))
        for names, nodes in zip(slugs, ([c.old for c in gone], [c.new for c in come]), strict=True):
            for n in nodes:
                if n.kind == "heading":
                    names[slug(n.title)].append(n)
        for g in sorted(gone, key=lambda c: (-c.old.size, c.old.preorder)):
            for t in sorted(pairs[g.old.shape], key=lambda c: (-c.new.size, c.new.preorder)):
                if id(g) in covered or id(t) in covered:
                    continue
                kind = self.move_kind(g.old, t.new, by, slugs)
                if not kind:
                    continue
                if g.old in self.by_old or t.new in self.by_new:
                    if self.by_old.get(g.old) is not t.new:
                        continue
                self.match(g.old, t.new, kind)
                name = f"move:{g.old.id}:{t.new.id}"
                for c, role in ((g, "source"), (t, "target")):
                    covered.update(id(x) for x in walk(c))
                    c.op, c.role, c.move_id, c.match_kind, c.pair_kind, c.children = "move", role, name, kind, "match", []
                if g.old.keys["subtree"] != t.new.keys["subtree"]:
                    t.children = self.changed(g.old, t.new, "match").children
                break

    def move_kind(self, a: Node, b: Node, by: dict, slugs) -> str:
        suffix = min(len(a.path), len(b.path))
        compatible = suffix > 0 and a.path[len(a.path) - suffix :] == b.path[len(b.path) - suffix :]
        if abs(a.depth - b.depth) > self.o.depth_most and not compatible:
            return ""
        if a.entity == "section" and not self.o.size_low <= a.size / b.size <= self.o.size_high:
            return ""
        lone = lambda h: a.keys[h] == b.keys[h] and by[h][0][a.shape, a.keys[h]] == by[h][1][b.shape, b.keys[h]] == 1
        if (lone("subtree") or (self.by_old.get(a) is b and a.keys["subtree"] == b.keys["subtree"])) and bool(a.text or a.children):
            return "move-exact"
        if a.entity == "section" and a.keys["direct"] == b.keys["direct"] and (compatible or self.neighbours_matched(a, b)) and bool(a.text or a.children):
            return "move-direct"
        if a.kind == "heading" and slug(a.title) and slug(a.title) == slug(b.title):
            score = heading_score(a, b)
            if score >= self.o.min_similarity:
                own = [heading_score(a, q) for q in slugs[1][slug(a.title)]]
                theirs = [heading_score(p, b) for p in slugs[0][slug(a.title)]]
                if min(margin(own), margin(theirs)) >= self.o.min_margin:
                    return "move-heading"
        return "move-code" if a.kind == "code" and a.value and lone("content") else ""

    def neighbours_matched(self, a: Node, b: Node) -> bool:
        """Whether a node next to a has its partner next to b."""
        if a.parent is None or b.parent is None:
            return False
        beside = lambda n: [s for s in n.parent.children if abs(s.place - n.place) == 1]
        return any(self.by_old.get(s) in beside(b) for s in beside(a))

    def recover_definitions(self, root: Change) -> None:
        """Deleted and inserted definitions with one identifier that no other of them has become pairs."""
        left = lambda op, taken: [n for c in walk(root) if c.op == op and (n := c.node).kind == "definition" and n.identifier and n not in taken]
        for a, b in self.unique(left("delete", self.by_old), left("insert", self.by_new), lambda n: n.identifier):
            self.match(a, b, "definition-identifier")
        for c in walk(root):
            self.rejoin(c)

    def reclassify(self, everything: list[Change]) -> None:
        """Renames and changes of metadata among pairs."""
        identities = [Counter((n.shape, n.keys["identity"]) for n in d.nodes if n.kind in ("footnote", "definition")) for d in (self.old, self.new)]
        for c in everything:
            if c.old is None or c.new is None or c.op == "move":
                continue
            a, b = c.old, c.new
            self_same = c.op == "equal"
            meta: list[tuple] = []
            if a.kind == "heading" and a.entity == "section" and a.normal != b.normal:
                if unlike_leaves(a, b) or self.named_beside(a, b):
                    pass
                elif (a.heading_depth, a.list_depth, a.quote_depth) == (b.heading_depth, b.list_depth, b.quote_depth) and (a.keys["body"] == b.keys["body"] or self.children_matched(a, b)):
                    c.op, c.renamed, c.self_changed = "equal", True, False
                    if self.match(a, b, "heading-rename"):
                        c.pair_kind = "match"
                elif a.keys["content"] == b.keys["content"]:
                    c.renamed = True
            elif a.kind == "heading" and not self_same and a.heading_depth != b.heading_depth:
                meta.append(("depth", "replace", a.heading_depth, b.heading_depth))
            elif a.kind in ("footnote", "definition") and a.identifier != b.identifier:
                key = (a.shape, a.keys["identity"])
                if a.keys["identity"] == b.keys["identity"] and identities[0][key] == identities[1][key] == 1:
                    c.op, c.renamed, c.self_changed = "equal", True, False
                    if self.match(a, b, f"{a.kind}-rename"):
                        c.pair_kind = "match"
                elif a.kind == "definition":
                    c.renamed = c.meta_changed = True
            elif a.kind == "definition" and not self_same:
                meta += [(x, "replace", getattr(a, y), getattr(b, y)) for x, y in (("url", "url"), ("title", "link_title")) if getattr(a, y) != getattr(b, y)]
                self.match(a, b, "definition-meta")
                c.pair_kind = "match"
            elif a.kind == "code" and a.value == b.value and (a.lang, a.meta) != (b.lang, b.meta):
                meta += [(x, "replace", getattr(a, x), getattr(b, x)) for x in ("lang", "meta") if getattr(a, x) != getattr(b, x)]
            elif a.kind == "table" and a.align != b.align:
                # Beside changed cells the alignment is told too, but the table is replaced.
                if [[x for _, x in r] for r in a.rows] == [[x for _, x in r] for r in b.rows]:
                    meta.append(("align", "replace", a.align, b.align))
                else:
                    c.meta.append(("align", "replace", a.align, b.align))
            elif a.kind == "listItem" and a.checked != b.checked:
                # An item whose text changes as well is replaced.
                if a.keys["content"] == b.keys["content"]:
                    meta.append(("checked", "replace", a.checked, b.checked))
            elif a.kind == "frontmatter" and not self_same:
                meta += metadata_diff(a.raw, b.raw) if a.raw is not None and b.raw is not None else [("$", "replace", a.value, b.value)]
            if meta:
                c.op, c.meta_changed, c.self_changed, c.meta = "meta-update", True, False, meta

    @staticmethod
    def named_beside(a: Node, b: Node) -> bool:
        """Whether a heading next to one end has the name of the other end, so that neither is a new name."""
        heads = lambda n: (s.normal for s in (n.parent.children if n.parent else ()) if s is not n and s.kind == "heading" and s.entity == "section")
        return b.normal in heads(a) or a.normal in heads(b)

    def children_matched(self, a: Node, b: Node) -> bool:
        """Whether two children at least, and half of the fewer ones, are partners."""
        if not a.children or not b.children:
            return False
        shared = sum((p := self.by_old.get(x)) is not None and p.parent is b for x in a.children)
        return shared >= max(2, math.ceil(min(len(a.children), len(b.children)) / 2))

    def present(self, everything: list[Change]) -> None:
        """Spans of changed texts: words of paragraphs and titles, lines of code, cells of tables."""
        for c in everything:
            if c.old is None or c.new is None or (c.op == "equal" and not c.renamed):
                continue
            a, b = c.old, c.new
            if a.kind == "paragraph" or (a.kind == "heading" and c.renamed) or a.kind == "heading":
                c.spans = inline_spans(a.inline, b.inline, self.o.most_inline_cost)
                c.inline_changed = a.structure != b.structure
            elif a.kind == "code":
                c.spans = line_spans((a.value or "").split("\n"), (b.value or "").split("\n"))
                if len(c.spans) > self.o.long_code:
                    c.spans = folded(c.spans, self.o.code_context)
            elif a.kind == "table":
                c.spans = cell_spans(a, b, self.o.most_inline_cost)

    def run(self, look: bool = True) -> Change:
        self.deterministic()
        root = self.changed(self.old.root, self.new.root, "match")
        self.recover_moves(root)
        self.recover_definitions(root)
        everything = list(walk(root))
        self.reclassify(everything)
        for c in reversed(everything):
            c.below_changed = c.below_changed or any([x.op != "equal" or x.renamed or x.below_changed for x in c.children])
        if look:
            self.present(everything)
        self.warnings += invalid(root, everything)
        return root


def told_apart(olds: list[Node], news: list[Node], keys) -> list[tuple[Node, Node]]:
    """Pairs of equally many nodes on both sides, if each has a child that one partner only has; else none.

    keys: of a node, one for each child. A key counts where it stands once below a
    node, and it is evidence if one new node alone has it so. With hashes of the very
    subtrees that are alike no key tells nodes apart; keys that say more do.
    """
    once = lambda n: {x for x, m in Counter(keys(n)).items() if m == 1}
    holders = defaultdict(list)
    for b in news:
        for x in once(b):
            holders[x].append(b)
    found = []
    for a in olds:
        partners = {id(holders[x][0]): holders[x][0] for x in once(a) if len(holders.get(x, ())) == 1}
        if len(partners) == 1:
            found += [(a, b) for b in partners.values()]
    return found if len(olds) == len(news) == len(found) == len({id(b) for _, b in found}) else []


def leads(scores: dict[tuple[Node, Node], float]):
    """lead(p, q, s): by how much the pair's score s is above the best of all other pairs of p or of q; s itself if there is none."""
    best: dict[tuple[int, Node], list[float]] = defaultdict(list)
    for (p, q), s in scores.items():
        for end in ((0, p), (1, q)):
            best[end] = sorted([*best[end], s], reverse=True)[:2]

    def lead(p: Node, q: Node, s: float) -> float:
        rivals = [top[1] if top[0] == s else top[0] for top in (best[0, p], best[1, q]) if len(top) == 2]
        return s - max(rivals) if rivals else 1.0

    return lead


def heading_score(a: Node, b: Node) -> float:
    same = a.keys["body"] == b.keys["body"] and bool(a.children) or a.keys["content"] == b.keys["content"]
    return 1.0 if same else sets(a.tokens, b.tokens)


def unlike_leaves(a: Node, b: Node) -> bool:
    """Headings without a body whose names have nothing in common."""
    if a.children or b.children:
        return False
    x, y = words(a.normal), words(b.normal)
    return (max(sets(x, y), sequence(x, y)) if x or y else sequence(a.title, b.title)) <= 0


def walk(c: Change):
    """A change and all below it, in document order."""
    todo = [c]
    while todo:
        now = todo.pop()
        yield now
        if now.children:
            todo += now.children[::-1]


def metadata_diff(old, new, path: str = "$") -> list[tuple]:
    """(path, op, old, new) of the leaves that differ; lists are compared whole."""
    if isinstance(old, dict) and isinstance(new, dict):
        out = []
        for key in sorted(old.keys() | new.keys()):
            at = f"{path}.{key}"
            if key not in new:
                out.append((at, "delete", old[key], None))
            elif key not in old:
                out.append((at, "insert", None, new[key]))
            else:
                out += metadata_diff(old[key], new[key], at)
        return out
    return [] if canonical(old) == canonical(new) else [(path, "replace", old, new)]


def coalesced(edits: list, old: list, new: list, layer: str, glue: str) -> list[tuple]:
    """(layer, row, col, op, old text, new text): runs of one kind, a deletion next to an insertion as a replacement."""
    out: list[list] = []
    for op, i, j in edits:
        a, b = [old[i]] if i >= 0 else [], [new[j]] if j >= 0 else []
        if out and (op == "equal") == (out[-1][0] == "equal"):
            out[-1][1] += a
            out[-1][2] += b
        else:
            out.append([op, a, b])
    name = lambda op, a, b: "equal" if op == "equal" else "replace" if a and b else "delete" if a else "insert"
    return [(layer, 0, 0, name(op, a, b), glue.join(a), glue.join(b)) for op, a, b in out]


def word_spans(a: str, b: str) -> list[tuple]:
    x, y = words(a), words(b)
    if not x and not y:
        return coalesced(k.align(list(a), list(b)), list(a), list(b), "char", "")
    return coalesced(k.align(x, y), x, y, "word", " ")


def inline_spans(a: list[dict], b: list[dict], most: int) -> list[tuple]:
    from treeloom.sources.markdown import plain

    text = lambda nodes: [plain([n]) for n in nodes]
    if len(a) * len(b) > most:
        return [("inline", 0, 0, "replace", "".join(text(a)), "".join(text(b)))]
    out: list[tuple] = []
    for _, _, _, op, x, y in (spans := coalesced(k.align([canonical(n) for n in a], [canonical(n) for n in b]), text(a), text(b), "inline", "")):
        if op == "replace":
            out += word_spans(x, y)
    return spans + out


def line_spans(a: list[str], b: list[str]) -> list[tuple]:
    """Code lines; the k-th deleted line of a run stands against the k-th inserted one, with the characters that differ."""
    out: list[tuple] = []
    gone: list[str] = []
    come: list[str] = []

    def flush() -> None:
        for i in range(max(len(gone), len(come))):
            x, y = gone[i] if i < len(gone) else None, come[i] if i < len(come) else None
            out.append(("code_line", 0, 0, "replace" if x is not None and y is not None else "delete" if y is None else "insert", x or "", y or ""))
            if x is not None and y is not None:
                out.extend(coalesced(k.align(list(x), list(y)), list(x), list(y), "code_char", ""))
        gone.clear()
        come.clear()

    for op, i, j in k.align(a, b, "heckel"):
        if op == "equal":
            flush()
            out.append(("code_line", 0, 0, "equal", a[i], b[j]))
        elif op == "delete":
            gone.append(a[i])
        else:
            come.append(b[j])
    flush()
    return out


def folded(spans: list[tuple], around: int) -> list[tuple]:
    """Only lines near a change and at both ends."""
    hot = [i for i, s in enumerate(spans) if s[3] != "equal"]
    if not hot:
        return spans[: 2 * around]
    keep = set(range(around)) | set(range(len(spans) - around, len(spans)))
    for i in hot:
        keep.update(range(i - around, i + around + 1))
    return [s for i, s in enumerate(spans) if i in keep]


def table_edits(a: Node, b: Node) -> tuple[list, list] | None:
    """Edit scripts (op, i, j) of two tables' rows and columns; None if both have as many rows and as many columns."""
    x, y = cell_texts(a), cell_texts(b)
    if len(x) == len(y) and max(map(len, x), default=0) == max(map(len, y), default=0):
        return None
    key = lambda t: ["\t".join(r) for r in t]
    return k.align(key(x), key(y)), k.align(x[0] if x else [], y[0] if y else [])


def cell_texts(n: Node) -> list[list[str]]:
    return [[t for t, _ in r] for r in n.rows]


def cell_spans(a: Node, b: Node, most: int) -> list[tuple]:
    """Changed cells and the spans within them.

    Tables of one shape go cell by cell; else rows and columns are aligned, those that
    one side alone has are edits of the table, and the others are compared at their
    new places.
    """
    x, y = cell_texts(a), cell_texts(b)
    edits = table_edits(a, b)
    out = []
    if edits is None:
        rows, cols = [(i, i) for i in range(len(x))], [(j, j) for j in range(max(map(len, x), default=0))]
    else:
        rows, cols = ([(i, j) for op, i, j in own if op == "equal"] for own in edits)
        out += [("table_row", max(i, j), -1, op, "\t".join(x[i]) if i >= 0 else "", "\t".join(y[j]) if j >= 0 else "") for op, i, j in edits[0] if op != "equal"]
        out += [("table_column", -1, max(i, j), op, x[0][i] if i >= 0 else "", y[0][j] if j >= 0 else "") for op, i, j in edits[1] if op != "equal"]
    get = lambda n, i, j: n.rows[i][j] if j < len(n.rows[i]) else ("", [])
    for i, p in rows:
        for j, q in cols:
            (old, before), (new, after) = get(a, i, j), get(b, p, q)
            if canonical(before) != canonical(after):
                out.append(("cell", p, q, "replace", old, new))
                out += [(f"cell_{layer}", p, q, op, u, v) for layer, _, _, op, u, v in inline_spans(before, after, most)]
    return out


def invalid(root: Change, everything: list[Change] | None = None) -> list[str]:
    """Names of the rules that a change, or one below it, breaks; everything: these changes, if they are at hand."""
    out = []
    for c in everything or walk(root):
        both = c.old is not None and c.new is not None
        if c.op in ("equal", "replace", "meta-update") and not both:
            out.append("invalid-pair")
        if c.op == "insert" and (c.new is None or c.old is not None):
            out.append("invalid-insert")
        if c.op == "delete" and (c.old is None or c.new is not None):
            out.append("invalid-delete")
        if c.op == "move" and (not c.move_id or not c.role):
            out.append("invalid-move")
        if c.op == "meta-update" and not c.meta:
            out.append("invalid-meta")
        if c.renamed and not both:
            out.append("invalid-rename")
        if c.match_kind == "exact-subtree" and c.op != "move" and c.op != "equal":
            out.append("invalid-exact")
    return out


def summary(root: Change) -> dict[str, int]:
    all_of = list(walk(root))
    return {
        "inserts": sum(c.op == "insert" for c in all_of), "deletes": sum(c.op == "delete" for c in all_of), "replaces": sum(c.op == "replace" for c in all_of),
        "moves": len({c.move_id for c in all_of if c.move_id}), "renames": sum(c.renamed for c in all_of), "reorders": sum(c.reordered for c in all_of),
        "meta_updates": sum(c.op == "meta-update" for c in all_of), "matched": sum(c.pair_kind == "match" for c in all_of), "aligned": sum(c.pair_kind == "aligned" for c in all_of),
        "warnings": sum(len(c.warnings) for c in all_of),
    }


def compare(old: str, new: str, options: Options | None = None, look: bool = True) -> tuple[Change, Comparison]:
    """The changes from old to new. A pair nested too deep to be read gives one change, with a warning.

    look: also spans of changed texts, and whether their inline parts have changed.
    """
    options = options or Options()
    # A comparison makes many objects that live until its end, which collections between would look at again and again.
    collecting = gc.isenabled()
    gc.disable()
    try:
        c = Comparison(Document(old), Document(new), options)
        return c.run(look), c
    except RecursionError:
        c = Comparison(Document(""), Document(""), options)
        same = old == new
        return Change("equal" if same else "replace", c.old.root, c.new.root, pair_kind="match", match_kind="forced-root", self_changed=not same, degraded=True, warnings=["nesting-too-deep"]), c
    finally:
        if collecting:
            gc.enable()


def told(old: str, new: str, options: Options | None, look: bool, tell: Callable[[Change, Comparison], Iterable]) -> list:
    """What tell says of a comparison, as a list; nothing in it may point at the comparison, which is taken apart.

    Collections look at all that lives, so none runs until nothing of it does.
    """
    collecting = gc.isenabled()
    gc.disable()
    try:
        root, c = compare(old, new, options, look)
        out = list(tell(root, c))
        c.release()
        return out
    finally:
        if collecting:
            gc.enable()
