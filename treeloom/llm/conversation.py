"""Repair of conversations' structure, by dynamic programming over a trie.

``damaged`` is the fault injector of the query; ``repaired`` is the operator. A
conversation's rows, by turn, become a signature, a symbol for each row: its role's
initial and whether it is whole, truncated, or must go (blank or a copy of an
earlier row). The cheapest edits lead the signature to ``(s?(ua)+)?``: Keep costs 0,
Rerole to user or assistant 2, Delete 3, Insert of an empty user or assistant text
2, and a truncated row that stays 1.

The signatures of a run of conversations are sorted and inserted into a prefix
trie, which is walked depth first: a stack holds the layers of the current path,
and only symbols beyond the prefix shared with the last signature add layers. A
layer holds, for each of four states (nothing yet, after s, u, a), the least cost of
edits that end with a row's edit, and which of the states' audits comes first in
ASCII order. Two audits of equal cost that end in one state are never prefixes of
each other, as what one has more were inserts with a cost; so the order of two
states' audits, with the few letters added, decides all later ties, and no audit is
held in a layer. Layers, less their least cost, are few different ones and steps
between them are kept. A terminal node emits the answer by walking the path back.

Rows are dealt by conversation and sorted once by Spark; a task holds a few MB of
them at a time. A conversation with more than ``most_rows`` rows or ``most_bytes``
bytes goes another way: its rows are range-partitioned by turn and cut to blocks
there, in parallel, and only symbols (one byte a row) and then blocks, one by one,
meet in one task: an audit is one value, and a SHA-256 is sequential.

Defined cases: a null role or text is one space, as is a null conv_id or turn where
damage is dealt; rows without a turn come first; rows of one turn go by role and
text, so equal ones are adjacent; an empty role, or one whose initial is not s, u or
a, can't be kept; a null conv_id is a conversation of its own; one without rows has
zeros, an empty audit and the hash of an empty text. An empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import broadcast_if_small, checkpointed

MOST_ROWS = 20_000
MOST_BYTES = 8 << 20
#: Rows and bytes of a block of a large conversation, and bytes of conversations that share a trie.
BLOCK_ROWS = 4096
BLOCK_BYTES = 1 << 20

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = 2, 2, 3, 2  # what they cost, but for KEEP, which is free
#: Symbols: initial, in lower case if the row is whole and in upper case if it is truncated; o for other roles, x for rows that must go.
GONE = "x"
_TURN = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_BLANK = re.compile(r"[\x20\x09-\x0D]*")
_COLUMNS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of each row of conversations; a row that is dropped has no copies."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 0, "").otherwise(text).alias("text"), copies.alias("copies"))


@lru_cache(maxsize=None)
def moves(symbol: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, letters) of a row's edits, each with up to two inserts before it, the best for each pair of states."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for first in range(4):
        state = first
        for k in range(3):
            options = [(state, DELETE, "D")]
            if symbol != GONE:
                extra = symbol.isupper()
                options.append((_NEXT[state], REROLE + extra, "R"))
                if state in _TURN.get(symbol.lower(), {}):
                    options.append((_TURN[symbol.lower()][state], extra, "K"))
            for to, cost, letter in options:
                new = (cost + INSERT * k, "I" * k + letter)
                best[first, to] = min(new, best.get((first, to), new))
            state = _NEXT[state]
    return [(a, b, cost, letters) for (a, b), (cost, letters) in sorted(best.items())]


class Layer:
    """For each state: cost beyond the layer's least (None: can't be), its audit's place in the order, and the step that led there."""

    __slots__ = ("cost", "rank", "back", "steps")

    def __init__(self, cost, rank, back):
        self.cost, self.rank, self.back, self.steps = cost, rank, back, {}


_layers: dict[tuple, Layer] = {}
ROOT = Layer((0, None, None, None), (0, 0, 0, 0), ())


def step(layer: Layer, symbol: str) -> tuple[int, Layer]:
    """What the least cost rises by, and the next layer."""
    if symbol not in layer.steps:
        best: dict[int, tuple] = {}
        for a, b, cost, letters in moves(symbol):
            if layer.cost[a] is not None:
                new = (layer.cost[a] + cost, layer.rank[a], letters, a)
                best[b] = min(new, best.get(b, new))
        least = min(v[0] for v in best.values())
        order = sorted(best, key=lambda s: best[s][1:3])
        parts = (
            tuple(best[s][0] - least if s in best else None for s in range(4)),
            tuple(order.index(s) if s in best else 0 for s in range(4)),
            tuple((best[s][3], best[s][2]) if s in best else None for s in range(4)),
        )
        layer.steps[symbol] = (least, _layers.setdefault(parts, Layer(*parts)))
    return layer.steps[symbol]


def answer(path: list[tuple[int, Layer]]) -> tuple[int, str]:
    """Cost and audit of the signature whose path this is."""
    least, last = path[-1]
    ends = []
    for s in range(4):
        state, k = s, 0
        while last.cost[s] is not None and k < 3:
            if state in (START, ASSISTANT):
                ends.append((last.cost[s] + INSERT * k, last.rank[s], "I" * k, s))
                break
            state, k = _NEXT[state], k + 1
    cost, _, tail, state = min(ends)
    letters = [tail]
    for _, layer in reversed(path[1:]):
        state, own = layer.back[state]
        letters.append(own)
    return least + cost, "".join(reversed(letters))


def answers(signatures) -> dict[str, tuple[int, str]]:
    """Cost and audit of each signature, by a walk over the trie of the sorted ones."""
    found: dict[str, tuple[int, str]] = {}
    path, last = [(0, ROOT)], ""
    for own in sorted(set(signatures)):
        shared = 0
        for x, y in zip(own, last):  # the shorter one ends it
            if x != y:
                break
            shared += 1
        del path[shared + 1 :]
        for symbol in own[shared:]:
            rise, layer = step(path[-1][1], symbol)
            path.append((path[-1][0] + rise, layer))
        found[own], last = answer(path), own
    return found


def blank(text: str) -> bool:
    return _BLANK.fullmatch(text) is not None


def ends_whole(text: str) -> bool:
    at = len(text) - 1
    while at >= 0 and (text[at] == " " or "\t" <= text[at] <= "\r"):
        at -= 1
    return at >= 0 and text[at] in ".!?"


def symbol_of(role: str, text: str) -> str:
    """The symbol of a row that need not go."""
    own = role[:1] if role[:1] and role[:1] in "sua" else "o"
    return own if ends_whole(text) else own.upper()


class Writer:
    """The repaired rows of one conversation, row by row, into a hash."""

    def __init__(self):
        self.state, self.sha, self.first = START, hashlib.sha256(), True

    def put(self, letter: str, role: str = "", text: str = "") -> None:
        if letter == "D":
            return
        if letter == "K":
            self.state = _TURN[role[0]][self.state]
        else:
            self.state = _NEXT[self.state]
            role = "user" if self.state == USER else "assistant"
            text = "" if letter == "I" else text
        self.sha.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.first = False


class Tally:
    """Gaps, faults and illegal neighbours of rows in order."""

    def __init__(self):
        self.low = self.high = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = None

    def put(self, turn, initial: str, blanks: int, copies: int, truncated: int) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.last_turn
            self.high = self.last_turn = turn
        self.blank, self.duplicate, self.truncated = self.blank + blanks, self.duplicate + copies, self.truncated + truncated
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial

    def values(self) -> list[int]:
        return [0 if self.low is None else self.high - self.low + 1 - self.turns, self.blank, self.duplicate, self.truncated, self.illegal]


def _told(rows: list[tuple]) -> tuple[list[int], str, list[tuple[str, str]]]:
    """(counts, signature, rows) of one conversation's (turn, role, text, copies) in order."""
    tally, seen, signature, own = Tally(), set(), [], []
    for turn, role, text, copies in rows:
        for _ in range(copies):
            gone = blank(text)
            copy = not gone and (role, text) in seen
            seen.add((role, text))
            symbol = GONE if gone or copy else symbol_of(role, text)
            tally.put(turn, role[:1], gone, copy, symbol.isupper())
            signature.append(symbol)
            own.append((role, text))
    return tally.values(), "".join(signature), own


def _repaired(found: list[tuple]) -> list[list]:
    """Result rows of (conv, rows), which share a trie."""
    told = [(conv, *_told(rows)) for conv, rows in found]
    best = answers(t[2] for t in told)
    out = []
    for conv, counts, signature, own in told:
        cost, audit = best[signature]
        writer, at = Writer(), iter(own)
        for letter in audit:
            writer.put(letter, *(() if letter == "I" else next(at)))
        out.append([conv, *counts, cost, audit, writer.sha.hexdigest()])
    return out


def _batch(rows: list[list], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _small(rows: DataFrame, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size, kind = [], 0, None
        for batch in batches:
            kind = batch.column(0).type
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not found or found[-1][0] != conv:
                    if size > BLOCK_BYTES:
                        yield _batch(_repaired(found), names, kind)
                        found, size = [], 0
                    found.append((conv, []))
                found[-1][1].append(row)
                size += 200 + len(row[2])
        if found:
            yield _batch(_repaired(found), names, kind)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").mapInArrow(run, schema)


def _large(rows: DataFrame, schema: str) -> DataFrame:
    """The same for conversations of any size; see the module's text."""
    names = [x.split()[0] for x in schema.split(", ")]
    conv = schema.split(", ")[0]
    # A row is a copy if its role and text stand in an earlier turn; partial aggregates take the hot ones.
    rows = checkpointed(rows.withColumn("mark", F.md5(F.concat_ws("\x00", "role", "text"))))
    kept = rows.filter("copies > 0")
    first = kept.groupBy("conv_id", "mark").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = first.select(F.col("conv_id").alias("c"), F.col("mark").alias("m"), "first")
    rows = rows.join(broadcast_if_small(first, 200_000), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mark") == F.col("m")), "left")
    rows = rows.withColumn("later", F.coalesce(F.struct(F.col("turn").isNotNull().alias("known"), "turn") > F.col("first"), F.lit(False))).select("conv_id", "turn", "role", "text", "copies", "later", "mark")
    order = ["conv_id", F.asc_nulls_first("turn"), "role"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, block, size, before = TaskContext.get().partitionId(), 0, [], 0, None

        def done():
            head, signature = block[0][0], "".join(r[5] for r in block)
            return pa.RecordBatch.from_pylist([{"conv_id": head, "part": part, "number": number, "signature": signature, "rows": [{"turn": r[1], "role": r[2], "text": r[3], "fault": r[4]} for r in block]}], shape)

        for batch in batches:
            inner = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string())])
            shape = pa.schema([("conv_id", batch.column(0).type), ("part", pa.int32()), ("number", pa.int64()), ("signature", pa.string()), ("rows", pa.list_(inner))])
            for own, turn, role, text, copies, later, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block and (block[0][0] != own or len(block) >= BLOCK_ROWS or size > BLOCK_BYTES):
                    yield done()
                    number, block, size = number + 1, [], 0
                for _ in range(copies):
                    copy = later or before == (own, turn, mark)
                    before = (own, turn, mark)
                    fault = "blank" if blank(text) else "copy" if copy else ""
                    block.append((own, turn, role, text, fault, GONE if fault else symbol_of(role, text)))
                    size += len(text)
                if not copies and not block:
                    block.append((own, None, None, None, "none", ""))  # a conversation may have lost all of its rows
        if block:
            yield done()

    # Equal rows of one turn have equal keys, so they share a partition; only the keys' sample reaches the driver.
    ranged = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    blocks = checkpointed(ranged.mapInArrow(cut, f"{conv}, part int, number long, signature string, rows array<struct<turn:long,role:string,text:string,fault:string>>"))
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "number", "signature"))).alias("parts"))
    whole = whole.select("conv_id", F.transform("parts", lambda p: p["signature"]).alias("parts"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                parts = batch.column(1)[i].as_py()
                own = "".join(parts)
                cost, audit = answers([own])[own]
                ends = [m.end() for m in re.finditer("[KRD]", audit)]  # a row's edit, with the inserts before it
                pieces, at, row = [], 0, 0
                for p in parts:
                    row += len(p)
                    end = ends[row - 1] if p else at
                    pieces.append(audit[at:end])
                    at = end
                pieces[-1] += audit[at:]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([cost], pa.int64()), pa.array([audit], pa.string()), pa.array([pieces], pa.list_(pa.string()))], ["conv_id", "cost", "audit", "pieces"])

    solved = checkpointed(whole.mapInArrow(solve, f"{conv}, cost long, audit string, pieces array<string>"))
    place = F.row_number().over(_by_place())
    placed = blocks.select("conv_id", "part", "number").withColumn("at", place - 1)
    pieces = solved.select(F.col("conv_id").alias("c"), F.posexplode("pieces").alias("k", "piece"))
    pieces = placed.join(pieces, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("k"))).select(F.col("part").alias("p"), F.col("number").alias("q"), "piece")
    dealt = blocks.join(pieces, (F.col("part") == F.col("p")) & (F.col("number") == F.col("q"))).select("conv_id", "part", "number", "rows", "piece")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind = None, None

        def ended():
            return _batch([[now[0], *now[1].values(), 0, "", now[2].sha.hexdigest()]], names, kind)

        for batch in batches:
            kind = batch.column(0).type
            for i in range(len(batch)):
                own = batch.column(0)[i].as_py()
                if now is None or now[0] != own:
                    if now is not None:
                        yield ended()
                    now = (own, Tally(), Writer())
                rows = [r for r in batch.column(3)[i].as_py() if r["fault"] != "none"]
                for r in rows:
                    now[1].put(r["turn"], r["role"][:1], r["fault"] == "blank", r["fault"] == "copy", not r["fault"] and not ends_whole(r["text"]))
                at = iter(rows)
                for letter in batch.column(4)[i].as_py():
                    r = None if letter == "I" else next(at)
                    now[2].put(letter, *(() if r is None else (r["role"], r["text"])))
        if now is not None:
            yield ended()

    out = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").mapInArrow(write, schema).drop("cost", "audit")
    solved = solved.select(F.col("conv_id").alias("c"), "cost", "audit")
    return out.join(solved, F.col("conv_id").eqNullSafe(F.col("c"))).select(*names)


def _by_place():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy("part", "number")


def repaired(rows: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """A row for each conversation of rows (``damaged``, or any conv_id, turn, role, text, copies): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = rows.select("conv_id", "turn", "role", "text", "copies")
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_COLUMNS}"
    sizes = rows.groupBy("conv_id").agg(F.sum(F.greatest("copies", F.lit(1))).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    large = checkpointed(sizes.filter((F.col("n") > most_rows) | (F.col("size") > most_bytes)).select(F.col("conv_id").alias("large_id")))
    if large.isEmpty():
        return _small(rows, schema)
    large, same = broadcast_if_small(large, 200_000), F.col("conv_id").eqNullSafe(F.col("large_id"))
    return _small(rows.join(large, same, "left_anti"), schema).union(_large(rows.join(large, same, "left_semi"), schema))
