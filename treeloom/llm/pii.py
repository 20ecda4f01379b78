"""Personal data by weak supervision.

Patterns and lists propose candidate spans. Labelers vote on each: its form (regex),
lists of names, zones, ranges and country codes (gazetteer), and its surroundings
(context) speak for it, against it, or not at all. Counts of the different votes over
the whole corpus go into expectation-maximisation, which estimates how reliable each
labeler is and how likely a span with such votes is personal. A logistic classifier
learns those likelihoods from the text alone, never from the votes: the span's shape,
what stands next to it and the words around it. It decides about the spans that are
not fixed. Spans of the base kinds always stay.

The corpus is read once: candidates go to a checkpoint. The counted votes are a table
whose size has a bound that does not depend on the corpus (kinds x 3^labelers), so that
table alone reaches the driver, and with it TRAIN different candidates of each kind,
those with the smallest hashes, for the classifier. Candidates are different by
votes and features; each weighs as often as it stands in the corpus.

Defined cases: a null text counts as empty; texts of any length are scanned in
linear time; rows that repeat are judged each; a null doc_id passes through; ties
in start order go by the order of the kinds; without a candidate there is nothing
to learn and only zero counts; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import checkpointed, drawn, texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "national", "social", "masked", "titled", "name")
#: Candidates of each kind that the classifier learns from.
TRAIN = 1500
LABELERS = ("form", "known", "near", "unlike", "alone", "rare")

# The base patterns. Each is written so that a failing start costs no second look at its run.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# The other kinds of candidates.
_NATIONAL = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])")
_SOCIAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_MASKED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,5}", re.I)
_TITLED = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?")

# Lists and surroundings that the labelers know.
_GIVEN = frozenset("""
adam alan albert alex alice amanda amy andrea andrew angela anna anne anthony antonio barbara benjamin brian carlos carol catherine charles christine christopher
claire daniel david deborah dennis diana donald dorothy edward elena elizabeth emily emma eric eva frank gary george grace hannah hans heather helen henry
isabel jack jacob james jane janet jason jean jeffrey jennifer jessica joan john jonathan jose joseph joshua juan judith julia karen karl kate katherine kenneth
kevin laura lauren linda lisa louis lucas lucy luis manuel marco margaret maria marie mark martha martin mary matthew melissa michael michelle nancy nicholas
nicole olivia pamela patricia patrick paul peter philip pierre rachel raymond rebecca richard robert roger ronald rose ruth samuel sandra sarah scott sharon
sophie stephanie stephen steven susan teresa theresa thomas timothy victoria virginia walter william
""".split())
_FAMILY = frozenset("""
adams allen anderson bailey baker becker bell bennett brooks brown butler campbell carter clark collins cook cooper cox davis diaz edwards evans fischer flores
foster garcia gomez gonzalez gray green hall harris hernandez hill hoffman howard hughes jackson james jenkins johnson jones kelly king klein lee lewis long
lopez martin martinez miller mitchell moore morales morgan morris muller murphy myers nelson nguyen ortiz parker perez perry peterson phillips powell price
ramirez reed reyes richardson rivera roberts robinson rodriguez rogers ross russell sanchez sanders schmidt schneider scott simmons smith stewart sullivan
taylor thomas thompson torres turner walker ward watson weber white williams wilson wood wright young
""".split())
_COUNTRY = re.compile(r"1|7|2[07]|3[0123469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[013]|5[09][0-9]|6[789][0-9]|8[058][0-9]|9[679][0-9]")
_NAME = re.compile(r"\b[A-Z][a-z]{1,30} [A-Z][a-z]{1,30}\b")
_ZONES = frozenset("com org net edu gov info io co uk de fr es it eu us ca".split())
_BRANDS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38")
_NEAR = re.compile(r"\b(?:call|phone|tel|telephone|mobile|cell|fax|contact|e-?mail|mail|write|reach|card|visa|pay|address|ssn|social|name|dear|ip)\b", re.I)
_UNLIKE = re.compile(r"\b(?:version|release|isbn|issn|order|invoice|section|page|build|part|sample|localhost|chapter)\b", re.I)
AROUND = 40


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: the run of local characters before it, from the last match on, and a domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(rank of kind, start, end) of the base kinds; failing matches go without a retry."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def further_spans(text: str) -> list[tuple[int, int, int]]:
    """Candidates of the kinds that the classifier decides about."""
    out = []
    if _DIGIT.search(text):
        out += [(4, *m.span()) for m in _NATIONAL.finditer(text)]
        out += [(5, *m.span()) for m in _SOCIAL.finditer(text)]
    low = text.lower() if "(" in text or "[" in text else ""
    if "(at)" in low or "[at]" in low:
        out += [(6, *m.span()) for m in _MASKED.finditer(text)]
    titled = [m.span() for m in _TITLED.finditer(text)]
    out += [(7, *t) for t in titled]
    ends = {e for _, e in titled}
    for m in _NAME.finditer(text):
        if m.end() not in ends and m[0].split(" ")[0].lower() in _GIVEN:
            out.append((8, *m.span()))
    return out


def votes(text: str, kind: int, start: int, end: int, times: int) -> tuple[int, ...]:
    """1 for, -1 against, 0 not at all, of each labeler; times: how often the same span stands in the text."""
    span, name = text[start:end], KINDS[kind]
    digits = "".join(c for c in span if "0" <= c <= "9")
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    form = known = 0
    if name == "email":
        zone = span.rpartition(".")[2].lower()
        form = 1 if 2 <= len(zone) <= 12 and zone.isalpha() and ".." not in span else -1
        known = 1 if zone in _ZONES else 0
    elif name == "ip":
        parts = [int(p.lstrip("0") or 0) for p in span.split(".")]
        form = -1 if any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else 1
        known = -1 if parts[0] in (0, 10, 127) or parts[:2] == [192, 168] or (parts[0] == 172 and 16 <= parts[1] < 32) else 1
    elif name == "card":
        form = 1 if len(set(digits)) > 3 else -1
        known = 1 if _BRANDS.match(digits) else -1
    elif name == "phone":
        form = 1 if 10 <= len(digits) <= 13 else -1
        known = 1 if _COUNTRY.match(digits) else -1
    elif name == "national":
        form = 1 if digits[0] not in "01" else -1
        known = -1 if digits[0] in "01" or digits[3] in "01" else 1
    elif name == "social":
        form = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif name == "masked":
        form, known = 1, 1 if re.split(r"\W+", span.lower())[-1] in _ZONES else -1
    elif name == "titled":
        words = {w.lower() for w in span.split(" ")[1:]}
        form, known = 1, 1 if words & (_GIVEN | _FAMILY) else 0
    elif name == "name":
        form, known = 0, 1 if span.split(" ")[1].lower() in _FAMILY else -1
    near = 1 if _NEAR.search(before) or _NEAR.search(after) else 0
    unlike = -1 if _UNLIKE.search(before) or _UNLIKE.search(after) else 0
    beside = before[-1:] + after[:1]
    alone = -1 if any(c.isalnum() for c in beside) else 1 if all(c.isspace() for c in beside) else 0
    return form, known, near, unlike, alone, -1 if times > 3 else 0


def _sort(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4 if c in ",.;:!?" else 5


#: Where each group of features starts: kind, length, digits, different digits, signs in the span, its first and last sign, the signs beside it, and words around it.
WORDS = 128
_OFFSETS = np.cumsum([0, len(KINDS), 12, 20, 11, 8, 6, 6, 6, 6, 4 * WORDS]).tolist()
_WORD = re.compile(r"\w+")


def features(text: str, kind: int, start: int, end: int) -> list[int]:
    """The features that hold of a span: what it looks like and what is around it, as numbers below ``_OFFSETS[-1]``."""
    span = text[start:end]
    digits = [c for c in span if "0" <= c <= "9"]
    at = _OFFSETS
    out = [at[0] + kind, at[1] + min(11, len(span) // 3), at[2] + min(19, len(digits)), at[3] + min(10, len(set(digits)))]
    out += [at[4] + k for k, c in enumerate(".-( +@_[") if c in span]
    out += [at[5] + _sort(span[:1]), at[6] + _sort(span[-1:]), at[7] + _sort(text[start - 1 : start] if start else ""), at[8] + _sort(text[end : end + 1])]
    before, after = _WORD.findall(text[max(0, start - AROUND) : start])[-2:], _WORD.findall(text[end : end + AROUND])[:2]
    for k, w in [*enumerate(reversed(before)), *enumerate(after, 2)]:
        out.append(at[9] + k * WORDS + zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS)
    return out


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found) with found: (kind, start, end, votes, features) of each candidate. Spans that overlap one of a base kind are none."""

    def look(text: str) -> list[dict]:
        base = base_spans(text)
        more = further_spans(text)
        if more and base:
            taken = sorted((s, e) for _, s, e in base)
            starts, furthest = [s for s, _ in taken], np.maximum.accumulate([e for _, e in taken])
            at = np.searchsorted(starts, [e for _, _, e in more], "left") - 1
            more = [m for m, k in zip(more, at.tolist(), strict=True) if k < 0 or furthest[k] <= m[1]]
        spans = sorted(base + more, key=lambda x: (x[1], x[0]))
        times: dict[str, int] = {}
        for _, s, e in spans:
            times[text[s:e]] = times.get(text[s:e], 0) + 1
        return [
            {"kind": k, "start": s, "end": e, "votes": "".join("-0+"[v + 1] for v in votes(text, k, s, e, times[text[s:e]])), "features": features(text, k, s, e)}
            for k, s, e in spans
        ]

    inner = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [look(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, inner)], ["doc_id", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts_of(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, found array<struct<kind:int,start:int,end:int,votes:string,features:array<int>>>")


def reliabilities(vote: np.ndarray, kind: np.ndarray, count: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(how likely each row is personal; of each labeler the chance of each vote for not personal and for personal).

    vote: rows of -1, 0, 1; count: how often the row stands in the corpus. The
    labelers are taken as independent given the truth. It starts from the mean vote.
    """
    kinds = kind.max() + 1
    like = 1 / (1 + np.exp(-vote.sum(1) * 1.5))
    chance = np.zeros((vote.shape[1], 2, 3))
    for _ in range(rounds):
        weight = np.stack([(1 - like) * count, like * count])  # truth x rows
        for j in range(vote.shape[1]):
            for v in range(3):
                chance[j, :, v] = (weight * (vote[:, j] == v - 1)).sum(1) + np.where(v == 1, 1.0, 0.5)
            chance[j] /= chance[j].sum(1, keepdims=True)
            # A vote for a span never speaks against it, nor the other way: where the estimates say so, the vote says nothing.
            share = weight.sum(1) / max(weight.sum(), 1e-9)
            for v, sign in ((2, 1), (0, -1)):
                if sign * (chance[j, 1, v] - chance[j, 0, v]) < 0:
                    chance[j, :, v] = share @ chance[j, :, v]
        prior = (np.bincount(kind, weight[1], kinds) + 1) / (np.bincount(kind, count, kinds) + 2)
        log = np.stack([np.log(1 - prior[kind]), np.log(prior[kind])])
        for j in range(vote.shape[1]):
            log += np.log(chance[j][:, vote[:, j] + 1])
        like = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return like, chance


def design(rows: list[list[int]]) -> np.ndarray:
    """Rows of features as a matrix, with a last column of ones."""
    x = np.zeros((len(rows), _OFFSETS[-1] + 1), np.float32)
    x[:, -1] = 1
    for i, own in enumerate(rows):
        x[i, own] = 1
    return x


def classifier(x: np.ndarray, like: np.ndarray, count: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights of a logistic model of like, by Newton's method over the columns that occur; the others weigh nothing.

    count: how often each row stands for; by mean, a row weighs one, so that ridge means the same for any corpus.
    """
    used = np.flatnonzero(x.any(0))
    part, w = x[:, used], np.zeros(len(used))
    times = np.ones(len(x)) if count is None else count / max(count.mean(), 1e-9) if len(count) else count
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
        slope = part.T @ (times * (p - like)) + ridge * w
        step = np.linalg.solve((part * (times * p * (1 - p))[:, None]).T @ part + ridge * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max(initial=0) < 1e-6:
            break
    out = np.zeros(x.shape[1])
    out[used] = w
    return out


def learned(found: DataFrame, most: int = TRAIN) -> np.ndarray | None:
    """Weights of all features and, last, of the constant; None without a candidate."""
    rows = found.select(F.explode("found").alias("x")).select("x.kind", "x.votes", "x.features").groupBy("kind", "votes", "features").agg(F.count("*").alias("n"))
    counts = sorted(map(tuple, rows.groupBy("kind", "votes").agg(F.sum("n"), F.count("*")).collect()))
    if not counts:
        return None
    kind, said, count, _ = zip(*counts, strict=True)
    vote = np.array([["-0+".index(c) - 1 for c in v] for v in said])
    like = dict(zip(zip(kind, said, strict=True), reliabilities(vote, np.array(kind), np.array(count, float))[0], strict=True))
    different: dict[int, int] = {}
    for k, _, _, n in counts:
        different[k] = different.get(k, 0) + n
    chosen = drawn(rows.withColumn("h", F.xxhash64("kind", "votes", "features")), "kind", most, different).select("kind", "votes", "features", "n").collect()
    chosen.sort(key=lambda r: (r["kind"], r["votes"], r["features"]))
    return classifier(design([r["features"] for r in chosen]), np.array([like[r["kind"], r["votes"]] for r in chosen]), np.array([r["n"] for r in chosen], float))


def likelihood(weights: np.ndarray, own: list[int]) -> float:
    return float(1 / (1 + np.exp(-np.clip(weights[own].sum() + weights[-1], -30, 30))))


def spans(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) with spans: (start, rank, end, score), in order: all of the base kinds, others from a score of least on."""
    found = checkpointed(candidates(docs, id_col, text_col))
    weights = docs.sparkSession.sparkContext.broadcast(learned(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            out = []
            for own in batch.column("found").to_pylist():
                kept = [(x["start"], x["kind"], x["end"], likelihood(weights.value, x["features"])) for x in own]
                out.append([dict(zip(("start", "rank", "end", "score"), x, strict=True)) for x in sorted(kept) if x[1] < len(BASE) or x[3] >= least])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, inner)], ["doc_id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, spans array<struct<start:int,rank:int,end:int,score:double>>")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    names = F.array(*(F.lit(k) for k in KINDS))
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))

    def counted(rank: int, kind: str):
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{kind}")

    return spans(docs).select("doc_id", *(counted(k, kind) for k, kind in enumerate(BASE)), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
