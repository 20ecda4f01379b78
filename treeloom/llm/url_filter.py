"""URL filters: rules first, then link-graph propagation over host edges.

Rules decide what they fit, the longest rule first. For the rest, trust spreads
along links from hosts with allowed pages (personalised PageRank), and distrust
spreads against links from hosts with blocked pages (the same on the reversed
graph). Seeds are the shares of a host's pages that rules allow or block, so both
scores are on one scale. A host is blocked where its distrust passes a threshold
and a multiple of its trust; else allowed.

Edges are counted by pairs of hosts before they are shuffled, links within a host
say nothing. Scores stay distributed; each few rounds go to a checkpoint, and the
query goes on until no more score moves. A host
with a large part of all pages is cut into salts before scores are joined to pages.

Defined cases: null urls and urls without ``://`` have empty host and path; null
html has no links; rows that repeat are judged each; ties between rules of one
length go to the first in the list; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import string
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import checkpointed, hot_keys, salted_join

#: Fixed values: (verdict, rule).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
DAMPING, ROUNDS, KEEP_EVERY = 0.85, 10, 5
#: Scores are settled where KEEP_EVERY rounds change less than this, summed over all hosts.
SETTLED = 1e-6
#: Blocked: distrust over LEAST, and over RATIO times trust, as shares of a seed's own score.
LEAST, RATIO = 0.05, 2.0

_LINK = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*([^"'\s>]+)"""


def _lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise("")
    return _lowered(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for say, name in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        own, _, rest = name.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, links) between different hosts; pages: host, html."""
    links = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("link"))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))
    absolute = full.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    edges = links.filter(absolute).select(F.col("host").alias("source"), host_and_path(full)[0].alias("target"))
    return edges.filter("source <> '' AND target <> '' AND source <> target").groupBy("source", "target").agg(F.count("*").alias("links"))


def _moves(kind: str, edges: DataFrame, host: str, to: str) -> DataFrame:
    """(kind, node, to, share): what each host passes on to each of its neighbours. A host with very many of them is dealt to several tasks."""
    degree = edges.groupBy(host).agg(F.sum("links").alias("all"), F.count("*").alias("n"))
    hot = hot_keys(degree.select(host, "n"), host, edges.count())
    rows = salted_join(edges, degree.select(host, "all"), host, hot, to, "inner")
    return rows.select(F.lit(kind).alias("kind"), F.concat_ws("/", F.lit(kind), host).alias("node"), F.col(to).alias("to"), (F.col("links") / F.col("all")).alias("share"))


def scores(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = ROUNDS) -> DataFrame:
    """(host, trust, distrust) of hosts with either, as multiples of 1 - damping.

    seeds: host, allowed, blocked (shares from 0 to 1); edges: source, target, links.
    Without a number of rounds, scores spread until they are settled: a round passes on
    at most damping of what the last one moved, so what is missing from a host then is
    below SETTLED too.
    """
    edges = checkpointed(edges)
    moves = checkpointed(_moves("trust", edges, "source", "target").unionByName(_moves("distrust", edges, "target", "source")))
    hot = checkpointed(hot_keys(moves.groupBy("node").agg(F.count("*").alias("n")), "node", moves.count()))
    start = checkpointed(
        seeds.select(F.lit("trust").alias("kind"), "host", F.col("allowed").alias("score"))
        .unionByName(seeds.select(F.lit("distrust").alias("kind"), "host", F.col("blocked").alias("score"))).filter("score > 0")
    )
    now = start
    if not moves.isEmpty():
        last = start
        for k in count(1) if rounds is None else range(1, rounds + 1):
            own = now.select(F.concat_ws("/", "kind", "host").alias("node"), "score")
            sent = salted_join(moves, own, "node", hot, "to", "inner").select("kind", F.col("to").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
            now = start.unionByName(sent).groupBy("kind", "host").agg(F.sum("score").alias("score"))
            if k % KEEP_EVERY == 0 or k == rounds:
                now = checkpointed(now)
                if rounds is None and _moved(last, now) < SETTLED:
                    break
                last = now
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return now.groupBy("host").agg(of("trust"), of("distrust"))


def _moved(last: DataFrame, now: DataFrame) -> float:
    """The sum of all hosts' changes of score."""
    both = last.withColumn("score", -F.col("score")).unionByName(now).groupBy("kind", "host").agg(F.sum("score").alias("moved"))
    return both.agg(F.sum(F.abs("moved"))).first()[0] or 0.0


def judged(pages: DataFrame, rules=RULES, damping: float = DAMPING, rounds: int | None = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of each row of pages (page_id, url, html); rounds as in scores."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    hosts = ruled.groupBy("host").agg(
        F.count("*").alias("pages"), F.avg((F.coalesce("ruled", F.lit("")) == "allow").cast("double")).alias("allowed"),
        F.avg((F.coalesce("ruled", F.lit("")) == "block").cast("double")).alias("blocked"),
    )
    hosts = checkpointed(hosts)
    found = scores(hosts.filter("host <> ''"), host_edges(parsed.select("host", "html")), damping, rounds)

    # At most 8 x partitions hosts have that many pages; only those are broadcast.
    total = hosts.agg(F.sum("pages")).first()[0] or 0
    most = max(1000, -(-total // (8 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    hot = hosts.filter(F.col("pages") >= most).select("host", F.ceil(F.col("pages") / most).cast("int").alias("salts"))
    left = ruled.join(F.broadcast(hot), "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    right = found.join(F.broadcast(hot), "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    rows = left.join(right, ["host", "salt"], "left")
    trust, distrust = F.round(F.coalesce("trust", F.lit(0.0)), 9), F.round(F.coalesce("distrust", F.lit(0.0)), 9)
    blocked = (distrust > LEAST) & (distrust > RATIO * trust)
    return rows.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"),
    )
