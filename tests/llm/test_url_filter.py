import random
import re

import pytest

from treeloom.llm import url_filter as u

LINK = re.compile(u._LINK)


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute(pages):
    parsed = [(p, *parse(url), html) for p, url, html in pages]

    def rule(host, path):
        fits = [(len(n), s, n) for s, n in u.RULES for h, _, r in [n.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + r)]
        return max(fits)[1:] if fits else (None, None)

    ruled = [rule(h, p) for _, h, p, _ in parsed]
    hosts = sorted({h for _, h, _, _ in parsed if h})
    seeds = {}
    for h in hosts:
        own = [s for (s, _), (_, x, _, _) in zip(ruled, parsed) if x == h]
        seeds[h] = (own.count("allow") / len(own), own.count("block") / len(own))
    links = {}
    for _, h, _, html in parsed:
        for x in LINK.findall(html or ""):
            x = "x:" + x if x.startswith("//") else x
            if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", x) and h and (t := parse(x)[0]) and t != h:
                links[h, t] = links.get((h, t), 0) + 1

    def rank(seed, edges):
        nodes = set(seed) | {x for e in edges for x in e}
        total = {n: sum(w for (a, _), w in edges.items() if a == n) for n in nodes}
        now = {n: seed.get(n, 0) for n in nodes}
        for _ in range(u.ROUNDS):
            now = {n: seed.get(n, 0) + u.DAMPING * sum(now[a] * w / total[a] for (a, b), w in edges.items() if b == n) for n in nodes}
        return now

    trust = rank({h: s[0] for h, s in seeds.items()}, links)
    distrust = rank({h: s[1] for h, s in seeds.items()}, {(b, a): w for (a, b), w in links.items()})
    out = []
    for (p, h, path, _), (say, name) in zip(parsed, ruled):
        t, d = round(trust.get(h, 0), 9), round(distrust.get(h, 0), 9)
        out.append((p, h, path, name, say or ("block" if d > u.LEAST and d > u.RATIO * t else "allow"), t, d))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    hosts = ["a.org", "example.org", "x.example.org", "b.com", "c.com", "spam.net", "farm.net", "clean.net", "ORG", "notorg", "hub.net"]
    pages = []
    for i in range(400):
        h = "hub.net" if i % 3 == 0 else rng.choice(hosts)
        path = rng.choice(["/fr/1", "/de/2", "/es/3", "/en/1", "/en/2", "", "?q=/fr/", "/"])
        to = [f'<a class="x" href="http://{rng.choice(hosts)}/{rng.choice("abc")}">' for _ in range(rng.randrange(4))]
        pages.append((i, f"http://{h}{path}", " ".join([*to, "<A HREF=//c.com/de/9>", "<a href='/own'>"])))
    pages += [(900, None, None), (901, "no scheme", "<a href='http://a.org/'>"), (902, "x://H.COM/de/?a#b", None), (903, "http://", ""), (1, "http://b.com/de/2", None), (None, "ftp://u:p@spam.net:21/x", "")]
    pages += [(800, "http://bad.com/de/1", None), *((801 + i, "http://lure.net/x", "<a href=http://bad.com/>") for i in range(3))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted((tuple(r) for r in u.judged(df).collect()), key=repr)
    want = brute(pages)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5:] for g in got] == [pytest.approx(w[5:], abs=1e-6) for w in want]
    assert {"allow", "block"} == {g[4] for g in got if g[3] is None}
    assert u.judged(df.limit(0)).count() == 0


def test_without_links(spark):
    df = spark.createDataFrame([(1, "http://a.com/de/1", "x"), (2, "http://a.com/en/1", None), (3, "http://b.net/", None)], "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in u.judged(df).collect()} == {1: "block", 2: "block", 3: "allow"}
