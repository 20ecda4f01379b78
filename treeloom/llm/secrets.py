"""Secret scans over a trigram inverted index, with DataFrame operations only.

Each rule's regular expression yields a Boolean trigram query (``trigrams``).
Postings (trigram, key) are made for the trigrams of those queries, the postings of
a conjunction are intersected by key, and the rule's expression runs on the
candidates alone. A rule without a mandatory trigram scans all texts.

A row's key is a hash of its id and text. Two texts that share a key share their
candidate rules, which the expressions then verify, so a collision changes nothing.
A posting is a row, and an intersection is a count over one key's rows, so no list
of documents meets in one task. Keys with very many rows are salted.

A text with n matches takes time in proportion to its length and n * sqrt(n):
places are running sums, made block by block.

Defined cases: a null text counts as empty and gives zero counts and empty
spans; rows that repeat an id are each judged by their own text, and so are rows
without one; an empty table gives an empty result; ties in start order go by the
order of the rules; further columns are ignored by ``report`` and kept by ``redact``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import trigrams
from treeloom.llm.common import hot_keys, salted_join


@dataclass(frozen=True)
class Rule:
    """least: shortest text of the group that counts; a shorter match is dropped without a retry."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True


#: Fixed values. Runs of one class hold their least length in the pattern, as no retry can bring forth a longer one.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", base=False),
)


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (gram, key) of the trigrams that the rules ask for; docs: key, text."""
    grams = sorted({g for r in rules for q in (trigrams.query(r.pattern) or ()) for g in q})
    held = F.array_compact(F.array(*(F.when(F.col("low").contains(g), F.lit(g)) for g in grams)))
    return docs.select("key", F.lower("text").alias("low")).select("key", F.explode(held).alias("gram"))


def candidates(spark: SparkSession, postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules): the indexed rules whose query the postings of a key fulfil."""
    terms, sizes = [], {}
    for r, rule in enumerate(rules):
        for k, q in enumerate(sorted(map(sorted, trigrams.query(rule.pattern) or ()))):
            sizes[r, k] = len(q)
            terms += [(r, k, g) for g in q]
    # Both tables have a row for each trigram of the rules.
    asked = F.broadcast(spark.createDataFrame(terms, "rule int, part int, gram string"))
    need = F.broadcast(spark.createDataFrame([(r, k, n) for (r, k), n in sizes.items()], "rule int, part int, need int"))
    met = (
        postings.join(asked, "gram")
        .groupBy("key", "rule", "part").agg(F.countDistinct("gram").alias("held"))
        .join(need, ["rule", "part"]).filter("held = need")
    )
    return met.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _with(value: Column, make: Callable[[Column], Column]) -> Column:
    """make of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each of an array's numbers what step makes of 0 and all numbers before it; step is associative.

    A block has about as many numbers as there are blocks, and only a block's results grow one by one.
    """

    def grown(own: Column, first: Column) -> Column:
        return F.aggregate(own, F.array(first), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))

    def whole(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda k: F.slice(v, k * width + 1, width))
        return _with(blocks, lambda cut: _with(
            grown(F.transform(cut, lambda own: F.aggregate(own, F.lit(0), step)), F.lit(0)),
            lambda firsts: F.flatten(F.transform(cut, lambda own, k: F.slice(grown(own, F.get(firsts, k)), 1, F.size(own)))),
        ))

    return _with(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(v))


def _found(rule: Rule, text: Column, length: Callable[[Column], Column]) -> Column:
    """Spans (start, end) of the rule's matches in text, in the unit of length."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    gaps = F.split(text, rule.pattern, -1)
    sizes = F.arrays_zip(
        F.transform(hits, length).alias("hit"), F.transform(kept, F.length).alias("kept"), F.slice(F.transform(gaps, length), 1, F.size(hits)).alias("gap")
    )

    def spans(parts: Column) -> Column:
        before = _running(F.transform(parts, lambda p: p["gap"] + p["hit"]), lambda a, b: a + b)
        placed = F.zip_with(parts, before, lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["hit"]).alias("end"), p["kept"].alias("kept")))
        return F.transform(F.filter(placed, lambda s: s["kept"] >= rule.least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    return _with(sizes, spans)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", length: Callable[[Column], Column] = F.length) -> DataFrame:
    """docs' rows as (row, text, found): all columns as a struct, the text, and an array of spans (start, end) for each rule."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("row").getField(text_col), F.lit("")).alias("text")
    base = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(id_col, text_col).alias("key"))
    asked = candidates(spark, index(base.select("key", text), rules), rules)
    hot = hot_keys(base.groupBy("key").agg(F.count("*").alias("n")), "key", docs.count())
    rows = salted_join(base.withColumn("place", F.monotonically_increasing_id()), asked, "key", hot, "place").select("row", text, "rules")
    none = F.array().cast("array<struct<start:int,end:int>>")
    spans = []
    for r, rule in enumerate(rules):
        found = F.when(F.col("text").rlike(rule.pattern), _found(rule, F.col("text"), length)).otherwise(none)
        spans.append((found if trigrams.query(rule.pattern) is None else F.when(F.array_contains("rules", r), found).otherwise(none)).alias(rule.kind))
    return rows.select("row", "text", F.struct(*spans).alias("found"))


def ordered(rules: tuple[Rule, ...], only_base: bool = False) -> Column:
    """The spans of all rules as one array of (start, rank, end), in order."""

    def ranked(rank: int, kind: str) -> Column:
        return F.transform(f"found.{kind}", lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))

    return F.array_sort(F.concat(*(ranked(k, rule.kind) for k, rule in enumerate(rules) if rule.base or not only_base)))


def _joined(rules: tuple[Rule, ...], only_base: bool) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(ordered(rules, only_base), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    counts = [F.size(f"found.{r.kind}").cast("long").alias(f"n_{r.kind}") for r in rules if r.base]
    return scan(docs.select("doc_id", "text"), rules).select("row.doc_id", *counts, F.sha2(_joined(rules, True), 256).alias("base_sha256"), _joined(rules, False).alias("spans"))


def _redacted(text: Column, spans: Column, mark: str) -> Column:
    """text without spans (in bytes, in order); those that overlap are covered by one mark."""

    def told(raw: Column, own: Column) -> Column:
        ends = F.transform(own, lambda s: s["end"])
        cut = lambda s, at: F.when(s["start"] >= at, F.concat(F.substring(raw, at + 1, s["start"] - at).cast("string"), F.lit(mark))).otherwise("")
        tail = F.substring(raw, F.array_max(ends) + 1, F.octet_length(raw)).cast("string")
        return F.concat(F.array_join(F.zip_with(own, _running(ends, lambda a, b: F.greatest(a, b)), cut), ""), tail)

    return _with(text.cast("binary"), lambda raw: _with(spans, lambda own: told(raw, own)))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """docs with every secret replaced by mark and n_chars, if there, set anew; all rows stay."""
    hit = " OR ".join(f"size(found.{r.kind}) > 0" for r in rules)
    rows = scan(docs, rules, length=F.octet_length).withColumn("new", F.when(F.expr(hit), _redacted(F.col("text"), ordered(rules), mark)))
    columns = []
    for c in docs.columns:
        old = F.col("row").getField(c)
        if c == "text":
            columns.append(F.coalesce("new", old).alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col("new").isNotNull(), F.length("new").cast(docs.schema[c].dataType)).otherwise(old).alias(c))
        else:
            columns.append(old.alias(c))
    return rows.select(*columns)
