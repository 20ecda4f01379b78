"""Queries of the text and similarity functions over whole tables, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeloom.functions import similarity as sim
from treeloom.functions import text as t
from treeloom.plans.stages import materialized
from treeloom.sources.tables import LINES_SQL, line_pairs, lines, table

SPACE, CJK = t.SPACE, t.CJK
_trim = lambda x: f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"
_collapse = lambda x: f"regexp_replace({_trim(x)}, '{SPACE}+', ' ', 'g')"
_number = lambda x: f"regexp_extract({x}, '{t.PREFIX}', 1)"


def _strip(x: str) -> str:
    year = f"regexp_matches({_number(x)}, '^\\d{{4}}$') AND try_cast({_number(x)} AS INT) BETWEEN 1900 AND 2100"
    return f"CASE WHEN {year} THEN {x} ELSE regexp_replace({x}, '{t.PREFIX}', '') END"


_title = lambda x: _collapse(f"({_strip(f'lower({_trim(x)})')})")
_slug = lambda x: f"""regexp_replace({_trim(f"regexp_replace({_title(x)}, '[^\\p{{L}}\\p{{N}}\\s-]', ' ', 'g')")}, '[\\s_-]+', '-', 'g')"""
_word = t.re2(t.WORD).replace("'", "''")
_tokens = lambda x: f"regexp_extract_all(lower({x}), '{_word}')"
_grams = lambda x: f"CASE WHEN length({x}) >= 3 THEN list_transform(range(length({x}) - 2), lambda i: substr(lower({x}), i::INT + 1, 3)) WHEN length({x}) > 0 THEN [lower({x})] ELSE [] END"
_bigrams = lambda x: f"CASE WHEN length({x}) > 1 THEN list_transform(range(length({x}) - 1), lambda i: substr({x}, i::INT + 1, 2)) WHEN length({x}) = 1 THEN [{x}] ELSE [] END"
_runs = lambda x: f"regexp_extract_all({x}, '{CJK}|[^\\s]+')"
_md5 = lambda x: f"md5(array_to_string({x}, '|'))"


def _md5_of(tokens):
    return F.md5(t.joined(tokens).cast("binary"))


#: name: (columns of a line, the same for the oracle).
LINE_FUNCTIONS = {
    "collapse_whitespace": ({"value": t.collapse_whitespace}, {"value": _collapse("line")}),
    "normalize_identifier": ({"value": t.normalize_identifier}, {"value": f"lower({_collapse('line')})"}),
    "strip_heading_prefix": ({"value": lambda x: t.strip_heading_prefix(F.lower(x))}, {"value": _strip("lower(line)")}),
    "normalize_heading_title": ({"value": t.normalize_heading_title}, {"value": _title("line")}),
    "slugify_heading": ({"value": t.slugify_heading}, {"value": _slug("line")}),
    "extract_attribution": ({"value": t.extract_attribution}, {"value": _trim("regexp_extract(line, '^(.+?)[：:]', 1)")}),
    "blockquote_excerpt": ({"value": t.excerpt}, {"value": "CASE WHEN length(line) > 50 THEN substr(line, 1, 50) || '…' ELSE line END"}),
    "leading_spaces": ({"value": lambda x: t.leading_spaces(x).cast("long")}, {"value": "length(regexp_extract(line, '^( *)', 1))"}),
    "tokenize_text": ({"n": lambda x: F.size(t.tokenize_text(x)).cast("long"), "tokens": lambda x: t.joined(t.tokenize_text(x))}, {"n": f"len({_tokens('line')})", "tokens": f"array_to_string({_tokens('line')}, '|')"}),
    "tokenize_for_similarity": ({"tokens": lambda x: t.joined(t.tokenize_for_similarity(x))}, {"tokens": f"array_to_string({_runs('line')}, '|')"}),
    "cjk_bigrams": ({"n": lambda x: F.size(t.cjk_bigrams(x)).cast("long"), "hash": lambda x: _md5_of(t.cjk_bigrams(x))}, {"n": f"len({_bigrams('line')})", "hash": _md5(_bigrams("line"))}),
    "character_ngrams": ({"n": lambda x: F.size(t.character_ngrams(x)).cast("long"), "hash": lambda x: _md5_of(t.character_ngrams(x))}, {"n": f"len({_grams('line')})", "hash": _md5(_grams("line"))}),
    "content_hash": ({"hash": lambda x: t.content_hash(F.lit("paragraph"), F.lit(None), x)}, {"hash": "md5('=paragraph' || chr(31) || '~' || chr(31) || '=' || line)"}),
}


def _line_query(columns):
    def run(spark, sf_dir):
        return lines(table(spark, sf_dir, "documents")).select("doc_id", "ln", *(f(F.col("line")).alias(c) for c, f in columns.items()))

    return run


QUERIES = {k: _line_query(spark) for k, (spark, _) in LINE_FUNCTIONS.items()}
SQL = {k: f"WITH {LINES_SQL} SELECT doc_id, ln, {', '.join(f'{x} AS {c}' for c, x in sql.items())} FROM lines" for k, (_, sql) in LINE_FUNCTIONS.items()}


# -- pairs of lines

_set_jaccard = lambda a, b: f"CASE WHEN len(list_distinct({a} || {b})) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b}))) / len(list_distinct({a} || {b})) END"
_chars = lambda x: f"string_split({x}, '')"


def _numbered(a: str) -> str:
    """Elements with their number among equals, by sorting: the place less the first place of the same."""
    return f"list_transform(list_sort({a}), lambda x, i: x || '#' || (i + 1 - list_position(list_sort({a}), x)))"


def _edit(a: str, b: str) -> str:
    """Edit distance of lists with fewer than 94 different elements, each as one ASCII character."""
    code = lambda x: f"array_to_string(list_transform({x}, lambda c: chr((33 + list_position(list_distinct({a} || {b}), c))::INT)), '')"
    return f"levenshtein({code(a)}, {code(b)})"


def _seq(a: str, b: str) -> str:
    return f"CASE WHEN greatest(len({a}), len({b})) = 0 THEN 1.0 ELSE 1 - {_edit(a, b)} / greatest(len({a}), len({b})) END"


_multi = lambda a, b: _set_jaccard(_numbered(a), _numbered(b))
_align = lambda a, b: f"CASE WHEN greatest(len({a}), len({b})) = 0 THEN 1.0 WHEN least(len({a}), len({b})) = 0 THEN 0.0 ELSE len(list_filter(range(least(len({a}), len({b}))), lambda i: {a}[i + 1] = {b}[i + 1])) / least(len({a}), len({b})) END"


#: name: (of the old and the new text; the oracle's, over columns that are made before).
PAIR_FUNCTIONS = {
    "jaccard_similarity": (lambda a, b: sim.jaccard(t.tokenize_text(a), t.tokenize_text(b)), _set_jaccard("ta", "tb")),
    "multiset_jaccard_similarity": (lambda a, b: sim.multiset_jaccard(t.tokenize_text(a), t.tokenize_text(b)), _multi("ta", "tb")),
    "character_ngram_similarity": (sim.ngram_similarity, None),
    "plain_block_similarity": (sim.plain_block_similarity, _set_jaccard("ra", "rb")),
    "exact_alignment_ratio": (lambda a, b: sim.exact_alignment_ratio(t.tokenize_text(a), t.tokenize_text(b)), _align("ta", "tb")),
    "length_ratio": (lambda a, b: sim.ratio(F.length(a), F.length(b)), "CASE WHEN length(a) = 0 AND length(b) = 0 THEN 1.0 ELSE least(length(a), length(b)) / greatest(length(a), length(b), 1) END"),
}


def _rounded(x):
    return F.round(x.cast("double"), sim.NINE).alias("score")


def _scored(f):
    a, b = F.col("old_text"), F.col("new_text")
    return _rounded(sim.unless_equal(a, b, f(a, b)))


def _pair_query(f):
    def run(spark, sf_dir):
        return line_pairs(table(spark, sf_dir, "documents")).select("doc_id", "pos", _scored(f))

    return run


_MADE = "{0}, made AS (SELECT *, {1} FROM (SELECT {2}, {3} AS a, {4} AS b FROM {5}))"
_made_columns = ", ".join(f"{f(x)} AS {p}{x}" for x in "ab" for p, f in (("t", _tokens), ("g", _grams), ("r", _runs)))
_pairs_sql = _MADE.format(LINES_SQL, _made_columns, "doc_id, pos", "old_text", "new_text", "pairs")
QUERIES |= {k: _pair_query(f) for k, (f, _) in PAIR_FUNCTIONS.items()}
SQL |= {k: f"WITH {_pairs_sql} SELECT doc_id, pos, round(({sql})::DOUBLE, 9) AS score FROM made" for k, (_, sql) in PAIR_FUNCTIONS.items() if sql}
SQL["character_ngram_similarity"] = f"""
WITH {LINES_SQL}, sides AS (
  SELECT doc_id, pos, 0 AS side, unnest({_grams('old_text')}) AS gram FROM pairs UNION ALL SELECT doc_id, pos, 1, unnest({_grams('new_text')}) FROM pairs
), counted AS (
  SELECT doc_id, pos, gram, count(*) FILTER (WHERE side = 0) AS m, count(*) FILTER (WHERE side = 1) AS n FROM sides GROUP BY ALL
), summed AS (SELECT doc_id, pos, sum(least(m, n)) / sum(greatest(m, n)) AS score FROM counted GROUP BY ALL)
SELECT p.doc_id, p.pos, round(coalesce(score, 1.0)::DOUBLE, 9) AS score FROM pairs p LEFT JOIN summed s ON p.doc_id = s.doc_id AND p.pos = s.pos"""


def _text_sequence(spark, sf_dir):
    pairs = line_pairs(table(spark, sf_dir, "documents"))
    return pairs.select("doc_id", "pos", _scored(lambda a, b: sim.text_sequence_similarity(a, b, None)))


QUERIES["text_sequence_similarity"] = _text_sequence
SQL["text_sequence_similarity"] = f"""
WITH {LINES_SQL}, letters AS (
  SELECT doc_id, pos, old_text AS a, new_text AS b, list_distinct(string_split(old_text || new_text, '')) AS v FROM pairs
), shown AS (
  SELECT *, array_to_string(v, '') AS alphabet, array_to_string(list_transform(range(len(v)), lambda i: chr((33 + i)::INT)), '') AS ascii FROM letters
)
SELECT doc_id, pos, round((CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1 - levenshtein(translate(a, alphabet, ascii), translate(b, alphabet, ascii)) / greatest(length(a), length(b)) END)::DOUBLE, 9) AS score FROM shown"""


# -- pairs of part names: few different words in each, as the oracle's token distance needs


def part_pairs(part):
    """(id, a, b, a_size, b_size, a_brand, b_brand, a_type, b_type) of each part and the next."""
    full = lambda p: F.concat_ws(" ", f"{p}p_name", f"{p}p_type")
    cols = ("p_partkey", "p_name", "p_type", "p_size", "p_brand")
    a, b = part.select(*(F.col(c).alias(f"a_{c}") for c in cols)), part.select(*(F.col(c).alias(f"b_{c}") for c in cols))
    return a.join(b, F.col("b_p_partkey") == F.col("a_p_partkey") + 1).select(
        F.col("a_p_partkey").alias("id"), full("a_").alias("a"), full("b_").alias("b"), F.col("a_p_size").alias("a_size"), F.col("b_p_size").alias("b_size"),
        F.col("a_p_brand").alias("a_brand"), F.col("b_p_brand").alias("b_brand"), F.col("a_p_type").alias("a_type"), F.col("b_p_type").alias("b_type"),
    )


_PARTS = f"""
base AS (
  SELECT x.p_partkey AS id, concat_ws(' ', x.p_name, x.p_type) AS a, concat_ws(' ', y.p_name, y.p_type) AS b, x.p_size AS a_size, y.p_size AS b_size,
         x.p_brand AS a_brand, y.p_brand AS b_brand, x.p_type AS a_type, y.p_type AS b_type
  FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1
), made AS (SELECT *, {_made_columns} FROM base), scored AS (
  SELECT *, {_set_jaccard('ta', 'tb')} AS sj, {_seq('ta', 'tb')} AS ss, {_multi('ga', 'gb')} AS sg FROM made
), texts AS (
  SELECT *, greatest(sj, ss, sg) AS tc, CASE WHEN a_brand = b_brand THEN 1.0 ELSE 0.7 END AS context, CASE WHEN a_type = b_type THEN 1.0 ELSE 0.4 END AS structure FROM scored
)"""
_fallback = lambda w: f"CASE WHEN structure < 0.5 OR len(ta) + len(tb) = 0 THEN 0.0 ELSE {w[0]} + {w[1]} * structure + {w[2]} * (CASE WHEN len(ta) = 0 AND len(tb) = 0 THEN 1.0 ELSE least(len(ta), len(tb)) / greatest(len(ta), len(tb), 1) END) + {w[3]} * context END"
_weighted = lambda w: f"greatest({w[0]} * tc + {w[1]} * structure, {_fallback(w[2])})"



def _ab():
    return F.col("a"), F.col("b")


def _context():
    return F.when(F.col("a_brand") == F.col("b_brand"), 1.0).otherwise(0.7)


def _structure():
    return F.when(F.col("a_type") == F.col("b_type"), 1.0).otherwise(0.4)


def _units():
    return tuple(F.size(t.tokenize_text(x)) for x in _ab())


def _tokens_of():
    return tuple(t.tokenize_text(x) for x in _ab())


_heading_sql = "CASE WHEN a_size % 2 = 0 AND b_size % 2 = 0 THEN 0.4 * sj + 0.3 * {0} + 0.15 * {1} + 0.15 * context ELSE 0.6 * sj + 0.0 * {0} + 0.2 * {1} + 0.2 * context END".format("CASE WHEN a_type = b_type THEN 1.0 ELSE 0.5 END", "CASE WHEN a_size = b_size THEN 1.0 ELSE 0.6 END")
_code_lines = lambda x: f"list_filter(list_transform(string_split(replace({x}, ' ', chr(10)), chr(10)), lambda l: trim(l)), lambda l: l <> '')"

#: name: (Column over ``part_pairs``, the oracle's over ``texts``).
PART_FUNCTIONS = {
    "token_sequence_similarity": (lambda: sim.sequence_similarity(*_tokens_of()), "ss"),
    "text_content_similarity": (lambda: sim.text_content_similarity(*_ab()), "tc"),
    "paragraph_similarity": (lambda: sim.weighted_text(sim.text_content_similarity(*_ab()), _structure(), *_units(), _context(), sim.PARAGRAPH), _weighted(sim.PARAGRAPH)),
    "container_similarity": (lambda: sim.weighted_text(sim.text_content_similarity(*_ab()), _structure(), *_units(), _context(), sim.CONTAINER), _weighted(sim.CONTAINER)),
    "heading_similarity": (
        lambda: sim.heading_similarity(sim.jaccard(*_tokens_of()), F.col("a_type") == F.col("b_type"), F.col("a_size") == F.col("b_size"), _context(), (F.col("a_size") % 2 == 0) & (F.col("b_size") % 2 == 0)),
        _heading_sql,
    ),
    "code_similarity": (
        lambda: sim.code_similarity(F.replace(F.col("a"), F.lit(" "), F.lit("\n")), F.replace(F.col("b"), F.lit(" "), F.lit("\n")), F.col("a_brand"), F.col("b_brand")),
        f"least(1.0, greatest({_set_jaccard(_code_lines('a'), _code_lines('b'))}, {_seq(_code_lines('a'), _code_lines('b'))}, {_seq(_chars('a'), _chars('b'))}) + CASE WHEN a_brand IS NOT DISTINCT FROM b_brand THEN 0.1 ELSE 0 END)",
    ),
    "definition_similarity": (
        lambda: sim.definition_similarity(F.col("a_brand") == F.col("b_brand"), F.col("a_type") == F.col("b_type"), F.col("a_size") == F.col("b_size")),
        "0.5 * (a_brand = b_brand)::INT + 0.25 * (a_type = b_type)::INT + 0.25 * (a_size = b_size)::INT",
    ),
    "structure_fallback_score": (lambda: sim.structure_fallback(_structure(), *_units(), _context(), *sim.PARAGRAPH[2]), _fallback(sim.PARAGRAPH[2])),
    "source_range_closeness": (lambda: sim.range_closeness(F.col("a_size"), F.col("b_size")), "greatest(0.0, 1 - abs(a_size - b_size) / 10)"),
    "path_suffix_compatible": (
        lambda: F.when(sim.is_path_suffix(F.split("a", " "), F.split("b", " ")), 1.0).otherwise(0.0),
        "CASE WHEN list_reverse(string_split(a, ' '))[:least(len(string_split(a, ' ')), len(string_split(b, ' ')))] = list_reverse(string_split(b, ' '))[:least(len(string_split(a, ' ')), len(string_split(b, ' ')))] THEN 1.0 ELSE 0.0 END",
    ),
}


def _part_query(make):
    return lambda spark, sf_dir: part_pairs(table(spark, sf_dir, "part")).select("id", _rounded(make()))


QUERIES |= {k: _part_query(f) for k, (f, _) in PART_FUNCTIONS.items()}
SQL |= {k: f"WITH {_PARTS} SELECT id, round(({sql})::DOUBLE, 9) AS score FROM texts" for k, (_, sql) in PART_FUNCTIONS.items()}


# -- signatures of whole documents


def _words(docs):
    return docs.filter("text IS NOT NULL").select("doc_id", F.explode(t.tokenize_text(F.col("text"))).alias("token"))


def simhashes(docs):
    """(doc_id, simhash) of texts with a token: 64 sums in one aggregate."""
    return _words(docs).groupBy("doc_id").agg(*t.simhash_votes(F.col("token"))).select("doc_id", t.simhash_of_votes().alias("simhash"))


def minhashes(docs):
    """(doc_id, m0 ... m63, n): least permuted hashes and the number of different tokens.

    A document's texts are shuffled once, as they are, and its different tokens found within its row; a distinct count
    beside the minima would shuffle all 64 of them with each token.
    """
    texts = docs.filter("text IS NOT NULL").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    tokens = texts.select("doc_id", F.array_distinct(F.flatten(F.transform("texts", t.tokenize_text))).alias("tokens"))
    words = tokens.select("doc_id", F.size("tokens").cast("long").alias("n"), F.explode("tokens").alias("token"))
    return words.groupBy("doc_id").agg(*t.minhash_minima(F.col("token")), F.max("n").alias("n"))


_words_sql = f"words AS (SELECT doc_id, unnest({_tokens('text')}) AS token FROM documents WHERE text IS NOT NULL)"
_bit = lambda i: f"(h{i // 32} >> {31 - i % 32}) & 1"
_votes_sql = ", ".join(f"CASE WHEN sum(CASE WHEN {_bit(i)} = 1 THEN 1 ELSE -1 END) >= 0 THEN 1 ELSE 0 END AS v{i}" for i in range(64))
_hex_sql = " || ".join("substr('0123456789abcdef', 1 + " + " + ".join(f"{8 >> b} * v{4 * d + b}" for b in range(4)) + ", 1)" for d in range(16))
_SIM = f"""{_words_sql}, halves AS (SELECT doc_id, ('0x' || substr(md5(token), 1, 8))::BIGINT AS h0, ('0x' || substr(md5(token), 9, 8))::BIGINT AS h1 FROM words),
votes AS (SELECT doc_id, {_votes_sql} FROM halves GROUP BY doc_id), signed AS (SELECT doc_id, {_hex_sql} AS simhash FROM votes)"""
_MIN = f"""{_words_sql}, hashed AS (SELECT doc_id, token, ('0x' || substr(md5(token), 1, 8))::BIGINT % {t._PRIME} AS h FROM words),
minima AS (SELECT doc_id, {', '.join(f'min((h * {a} + {b}) % {t._PRIME}) AS m{i}' for i, (a, b) in enumerate(t.minhash_seeds()))}, count(DISTINCT token) AS n FROM hashed GROUP BY doc_id)"""


def _simhash_signature(spark, sf_dir):
    return simhashes(table(spark, sf_dir, "documents"))


def _simhash_hamming(spark, sf_dir):
    s = simhashes(table(spark, sf_dir, "documents"))
    other = s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("simhash").alias("next"))
    return s.join(other, "doc_id").select("doc_id", t.hamming(F.col("simhash"), F.col("next")).cast("long").alias("distance"))


def _minhash_similarity(spark, sf_dir):
    """Estimated for a pair with over 256 tokens on a side, of each document and the next."""
    m = materialized(minhashes(table(spark, sf_dir, "documents")))
    other = m.select((F.col("doc_id") - 1).alias("doc_id"), F.col("n").alias("n_next"), *(F.col(f"m{i}").alias(f"o{i}") for i in range(t.MINHASHES)))
    equal = sum((F.when(F.col(f"m{i}") == F.col(f"o{i}"), 1).otherwise(0) for i in range(t.MINHASHES)), F.lit(0))
    return m.join(other, "doc_id").filter(F.greatest("n", "n_next") > 256).select("doc_id", (equal / t.MINHASHES).alias("score"))


QUERIES |= {"simhash_signature": _simhash_signature, "simhash_hamming": _simhash_hamming, "minhash_similarity": _minhash_similarity}
SQL |= {
    "simhash_signature": f"WITH {_SIM} SELECT doc_id, simhash FROM signed",
    "simhash_hamming": f"""WITH {_SIM} SELECT a.doc_id, (bit_count(xor(('0x' || substr(a.simhash, 1, 8))::BIGINT, ('0x' || substr(b.simhash, 1, 8))::BIGINT))
  + bit_count(xor(('0x' || substr(a.simhash, 9, 8))::BIGINT, ('0x' || substr(b.simhash, 9, 8))::BIGINT)))::BIGINT AS distance FROM signed a JOIN signed b ON b.doc_id = a.doc_id + 1""",
    "minhash_similarity": f"""WITH {_MIN} SELECT a.doc_id, ({' + '.join(f'(a.m{i} = b.m{i})::INT' for i in range(t.MINHASHES))}) / {t.MINHASHES} AS score
  FROM minima a JOIN minima b ON b.doc_id = a.doc_id + 1 WHERE greatest(a.n, b.n) > 256""",
}
