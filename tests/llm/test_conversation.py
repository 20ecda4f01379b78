import hashlib
import heapq
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from treeloom.llm import conversation

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = {"u": "user", "a": "assistant"}


def after_damage(rows):
    """Rows of each conversation after damage, in order; conversations without any, too."""
    found = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        found[conv] += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in found.items()}


def brute(rows):
    """All edits in order of (cost, audit), until one fits: a search without states' layers."""
    blank = duplicate = truncated = 0
    faults, seen = [], set()
    for _, role, text in rows:
        last = text.strip(" \t\n\x0b\f\r")
        fault = "x" if not last else "x" if (role, text) in seen else "t" if last[-1] not in ".!?" else ""
        blank += not last
        duplicate += bool(last) and (role, text) in seen
        truncated += fault == "t"
        seen.add((role, text))
        faults.append(fault)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, made, out = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", made):
            return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()
        if (at, made[-2:] if made else "") in done:
            continue
        done.add((at, made[-2:] if made else ""))

        def add(price, letter, to, initial="", line=None):
            now = made + initial
            if re.fullmatch("s?(ua)*u?", now):
                heapq.heappush(heap, (cost + price, audit + letter, to, now, out if line is None else (*out, line)))

        for k, name in NAMES.items():
            add(2, "I", at, k, f"{name}:")
        if at < len(rows):
            _, role, text = rows[at]
            add(3, "D", at + 1)
            if faults[at] != "x":
                if role:
                    add(0 + (faults[at] == "t"), "K", at + 1, role[0], f"{role}:{text}")
                for k, name in NAMES.items():
                    add(2 + (faults[at] == "t"), "R", at + 1, k, f"{name}:{text}")


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def hold(spark, rows, **limits):
    got = conversation.repaired(conversation.damaged(spark.createDataFrame(rows, SCHEMA)), **limits).collect()
    want = {c: brute(r) for c, r in after_damage(rows).items()}
    assert sorted((r["conv_id"] is not None, r["conv_id"] or 0) for r in got) == sorted((c is not None, c or 0) for c in want)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == want[r["conv_id"]], r["conv_id"]


ROWS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "umpire"]), st.sampled_from(["A.", "b", "", " \n", "Why? ", "x!\x0c"])), max_size=9)


@settings(max_examples=400, deadline=None)
@given(ROWS)
def test_layers_against_a_search(some):
    rows = [(i, role, text) for i, (role, text) in enumerate(some)]
    counts, signature, own = conversation._told([(*r, 1) for r in rows])
    assert tuple(conversation._repaired([(0, [(*r, 1) for r in rows])])[0][1:]) == brute(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("suaoSUAOx", max_size=12), max_size=12))
def test_shared_prefixes_change_nothing(some):
    found = conversation.answers(some)
    assert found == {s: conversation.answers([s])[s] for s in some}


def made(n, seed=0):
    rng, rows = random.Random(seed), []
    texts = ["Fine.", "so then", "Why?", "No!", "", None, "word " * 5, "é🎉.", "Fine. "]
    for c in range(n):
        for t in range(rng.randrange(1, 9)):
            rows.append((c if c else None, rng.choice([t, t, t, t + 1, None]), rng.choice(["user", "assistant", "system", "user", "assistant", None]), rng.choice(texts)))
    return rows


def test_query(spark):
    hold(spark, made(150))


def test_any_conversation_may_be_large(spark, monkeypatch):
    rows = made(40, 3)
    hold(spark, rows, most_rows=0)
    monkeypatch.setattr(conversation, "BLOCK_ROWS", 3)
    hold(spark, rows, most_rows=4)
    hold(spark, [(7, t, "user" if t % 2 == 0 else "assistant", f"Said {t % 50}.") for t in range(60)], most_rows=5)


def test_the_odd_cases(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    hold(spark, [(5, gone, "user", "Hello.")])
    hold(spark, [(5, gone, "user", "Hello.")], most_rows=0)
    hold(spark, [(1, 2, "user", "long " * 100_000 + "."), (1, 3, "assistant", "Yes.")])
    hold(spark, [(1, 2, "user", "Same.")] * 5)
    assert conversation.repaired(conversation.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    wide = spark.createDataFrame([(1, 0, "user", "Hi.", 3, "x", 4, "y")], SCHEMA + ", copies int, mark string, part int, signature string")
    assert conversation.repaired(conversation.damaged(wide)).count() == 1


def test_a_large_conversation_in_one_walk():
    rows = [(t, "user" if t % 2 == 0 else "assistant", "Yes." if t == 0 else f"No {t}.", 1) for t in range(100_000)]
    (out,) = conversation._repaired([(0, rows)])
    assert out[6] == 0 and out[7] == "K" * 100_000
