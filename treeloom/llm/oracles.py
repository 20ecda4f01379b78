"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

import string

from treeloom.llm import ngram_join, secrets, url_filter


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _lowered(x: str) -> str:
    return f"translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def secret_scan() -> str:
    """Each rule's matches with the texts between them; places are sums of lengths."""
    ranks, names = range(len(secrets.RULES)), [r.kind for r in secrets.RULES]
    parts = []
    for k, rule in zip(ranks, secrets.RULES, strict=True):
        p = _quoted(rule.pattern)
        parts.append(f"""SELECT row_id, {k} AS rank, {str(rule.base).lower()} AS base, unnest(range(len(hits))) AS i, hits, kept, gaps, {rule.least} AS least
  FROM (SELECT row_id, regexp_extract_all(body, {p}) AS hits, regexp_extract_all(body, {p}, {rule.group}) AS kept, string_split_regex(body, {p}) AS gaps FROM docs)""")
    union = "\n  UNION ALL ".join(parts)
    counts = ", ".join(f"count(*) FILTER (WHERE rank = {k}) AS n_{r.kind}" for k, r in zip(ranks, secrets.RULES, strict=True) if r.base)
    zero = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.RULES if r.base)
    said = f"string_agg([{', '.join(map(_quoted, names))}][rank + 1] || ':' || first || ':' || past, ',' ORDER BY first, rank)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS body FROM documents), found AS (
  {union}
), placed AS (
  SELECT *, list_sum(list_transform(gaps[1:i + 1], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i], lambda h: length(h))), 0) AS first FROM found
), spans AS (
  SELECT row_id, rank, base, first::BIGINT AS first, (first + length(hits[i + 1]))::BIGINT AS past FROM placed WHERE length(kept[i + 1]) >= least
), told AS (
  SELECT row_id, {counts}, {said.replace('ORDER BY', 'ORDER BY')} FILTER (WHERE base) AS base_spans, {said} AS spans FROM spans GROUP BY row_id
)
SELECT doc_id, {zero}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN told USING (row_id)"""


def url_verdicts() -> str:
    """Rules, host edges and the rounds of both propagations, written out one after the other."""
    rest = lambda x: f"CASE WHEN strpos({x}, '://') > 0 THEN substr({x}, strpos({x}, '://') + 3) ELSE '' END"
    host = lambda x: _lowered(f"regexp_extract({rest(x)}, '^[^/?#]*')")
    whens = {"rule": "", "verdict": ""}
    for say, name in sorted(url_filter.RULES, key=lambda r: -len(r[1])):
        own, _, path = name.partition("/")
        fits = f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{path}')"
        whens["rule"] += f" WHEN {fits} THEN '{name}'"
        whens["verdict"] += f" WHEN {fits} THEN '{say}'"
    link = _quoted(url_filter._LINK)
    rounds = []
    for kind, a, b, seed in (("t", "source", "target", "allowed"), ("d", "target", "source", "blocked")):
        rounds.append(f"{kind}0 AS (SELECT host, {seed} AS score FROM hosts WHERE {seed} > 0 AND host <> '')")
        moves = f"(SELECT {a} AS f, {b} AS g, links / sum(links) OVER (PARTITION BY {a}) AS share FROM edges)"
        rounds += [
            f"{kind}{k} AS (SELECT host, sum(score) AS score FROM (SELECT * FROM {kind}0 UNION ALL SELECT m.g, r.score * m.share * {url_filter.DAMPING} FROM {kind}{k - 1} r JOIN {moves} m ON m.f = r.host) GROUP BY host)"
            for k in range(1, url_filter.ROUNDS + 1)
        ]
    last = url_filter.ROUNDS
    return f"""
WITH parsed AS (
  SELECT page_id, {host('url')} AS host, regexp_extract({rest('url')}, '(?s)^[^/?#]*([^?#]*)', 1) AS path, html FROM (SELECT page_id, coalesce(url, '') AS url, html FROM pages)
), ruled AS (SELECT *, CASE{whens['rule']} END AS rule, CASE{whens['verdict']} END AS ruled FROM parsed), hosts AS (
  SELECT host, avg((coalesce(ruled, '') = 'allow')::INT) AS allowed, avg((coalesce(ruled, '') = 'block')::INT) AS blocked FROM ruled GROUP BY host
), links AS (
  SELECT host, CASE WHEN starts_with(l, '//') THEN 'x:' || l ELSE l END AS l FROM (SELECT host, unnest(regexp_extract_all(html, {link}, 1)) AS l FROM parsed)
), edges AS (
  SELECT host AS source, {host('l')} AS target, count(*) AS links FROM links WHERE regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') AND host <> '' GROUP BY ALL HAVING target <> '' AND target <> source
), {', '.join(rounds)}, scored AS (
  SELECT r.*, round(coalesce(t.score, 0.0), 9) AS trust, round(coalesce(d.score, 0.0), 9) AS distrust FROM ruled r LEFT JOIN t{last} t ON t.host = r.host LEFT JOIN d{last} d ON d.host = r.host
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN distrust > {url_filter.LEAST} AND distrust > {url_filter.RATIO} * trust THEN 'block' ELSE 'allow' END) AS verdict, trust, distrust FROM scored"""


def ngram_components() -> str:
    """All pairs by their common shingles, and what can be reached from each document."""
    n, share = ngram_join.N, ngram_join.SHARE
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_lowered("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {n} THEN list_transform(range(len(w) - {n - 1}), lambda i: array_to_string(w[i + 1:i + {n}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {share} * (x.n + y.n - c)
), reach AS (
  SELECT doc_id, doc_id AS root FROM words UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id
)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""


def conversation_repair() -> str:
    """One row of four cheapest (cost, audit) per row of a conversation, in order; texts of equal cost compare as they are."""
    insert = lambda x: f"{{'c': ({x}).c + 2, 'a': ({x}).a || 'I'}}"
    put = lambda x, cost, letter: f"{{'c': ({x}).c + {cost}, 'a': ({x}).a || '{letter}'}}"
    never = "{'c': 1000000000, 'a': 'Z'}"
    # After up to two inserts.
    closure = lambda rows: f"""SELECT *, b0 AS l0, b1 AS l1, least(x2, {insert("x3")}) AS l2, least(x3, {insert("x2")}) AS l3
        FROM (SELECT *, least(b2, {insert("b0")}, {insert("b1")}, {insert("b3")}) AS x2, least(b3, {insert("b2")}) AS x3 FROM {rows})"""  # noqa: E731
    keep = lambda symbol, x: f"CASE WHEN s.initial = '{symbol}' THEN {put(x, 's.late', 'K')} ELSE {never} END"
    rerole = lambda x: f"CASE WHEN s.fault = '' OR s.fault = 't' THEN {put(x, '2 + s.late', 'R')} ELSE {never} END"
    steps = f"""{put("l0", 3, "D")},
        least({put("l1", 3, "D")}, {keep("s", "l0")}),
        least({put("l2", 3, "D")}, {rerole("l0")}, {rerole("l1")}, {rerole("l3")}, {keep("u", "l0")}, {keep("u", "l1")}, {keep("u", "l3")}),
        least({put("l3", 3, "D")}, {rerole("l2")}, {keep("a", "l2")})"""
    return rf"""
    WITH RECURSIVE bytes AS (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)),
    crc AS (SELECT list(v ORDER BY i) AS t FROM bytes),
    dealt AS (
        SELECT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
                lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS kind
        FROM conversations, crc),
    damaged AS (
        SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM dealt),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
    judged AS (
        SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'd'
            WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
            left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) AS before
        FROM ordered),
    symbols AS (SELECT k, i, role, text, fault, CASE WHEN fault IN ('b', 'd') THEN 'x' ELSE initial END AS initial, (fault = 't')::INT AS late FROM judged),
    layers AS (
        SELECT DISTINCT k, 0::BIGINT AS i, {{'c': 0, 'a': ''}} AS b0, {never} AS b1, {never} AS b2, {never} AS b3 FROM symbols
        UNION ALL
        SELECT l.k, s.i, {steps}
        FROM ({closure("layers")}) l JOIN symbols s ON s.k = l.k AND s.i = l.i + 1),
    best AS (SELECT k, least(l0, l3).c AS cost, least(l0, l3).a AS audit
        FROM ({closure("(SELECT * FROM layers QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1)")})),
    letters AS (SELECT k, unnest(string_split(audit, '')) AS letter, unnest(range(1, length(audit) + 1)) AS p FROM best WHERE audit <> ''),
    matched AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY k ORDER BY p) AS i, row_number() OVER (PARTITION BY k, letter <> 'D' ORDER BY p) AS made FROM letters),
    lines AS (
        SELECT m.k, p, made, letter, s.role, s.text, max(CASE WHEN made = 1 AND letter = 'K' AND s.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.k) AS system
        FROM matched m LEFT JOIN symbols s ON s.k = m.k AND s.i = m.i AND m.letter <> 'I' WHERE letter <> 'D'),
    written AS (SELECT k, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (made - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS sha FROM lines GROUP BY k),
    counted AS (
        SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
            count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
        FROM judged GROUP BY k)
    SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT k, conv_id FROM dealt) LEFT JOIN counted USING (k) LEFT JOIN best USING (k) LEFT JOIN written USING (k)
    """
