"""Similarities and distances as Column expressions; all lie between 0 and 1 unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeloom.functions.text import character_ngrams, let, tokenize_for_similarity, tokenize_text

NINE = 9  # digits that scores are rounded to before they meet a threshold


def ratio(a: Column, b: Column) -> Column:
    """The smaller over the larger; 1 for two zeros."""
    return F.when((a == 0) & (b == 0), 1.0).otherwise(F.least(a, b) / F.greatest(a, b, F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def common_elements(a: Column, b: Column) -> Column:
    """How many elements two arrays share, each as often as in both: a merge of the sorted arrays, in one pass."""

    def step(x, y):
        def move(at, _):
            p, q = F.get(x, at["i"]), F.get(y, at["j"])
            state = lambda i, j, n: F.struct((at["i"] + i).alias("i"), (at["j"] + j).alias("j"), (at["n"] + n).alias("n"))
            return F.when(p == q, state(1, 1, 1)).when(q.isNull() | (p < q), state(1, 0, 0)).otherwise(state(0, 1, 0))

        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("n"))
        return F.aggregate(F.sequence(F.lit(1), F.size(x) + F.size(y)), start, move, lambda at: at["n"])

    found = let(F.struct(F.array_sort(a).alias("x"), F.array_sort(b).alias("y")), lambda s: step(s["x"], s["y"]))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), found).otherwise(0)


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Sum of the smaller over sum of the larger counts: as a + b is their sum, the larger ones are a + b less the smaller."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(let(common_elements(a, b), lambda both: both / (total - both)))


def coded(tokens: Column, alphabet: Column) -> Column:
    """Tokens as one character each, by their place in the alphabet, past the surrogates (below a million different ones)."""
    code = lambda at: F.when(at < 0xD800, at).otherwise(at + 0x800)
    places = F.transform(tokens, lambda t: F.array_position(alphabet, t) + 19968)
    return F.array_join(F.transform(places, lambda at: F.decode(F.unhex(F.lpad(F.hex(code(at)), 8, "0")), "UTF-32")), "")


def edit_distance(a: Column, b: Column) -> Column:
    """Insertions, deletions and replacements between two arrays of tokens."""
    return let(F.array_distinct(F.concat(a, b)), lambda v: F.levenshtein(coded(a, v), coded(b, v)))


def sequence_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, 1.0).otherwise(1 - edit_distance(a, b) / longest)


def text_sequence_similarity(a: Column, b: Column, most: int | None = 2000) -> Column:
    """By characters, of the first most of each; None: of whole texts. Where one text starts with the other, the distance is what their lengths differ by."""
    if most is not None:
        a, b = F.substring(a, 1, most), F.substring(b, 1, most)
    longest = F.greatest(F.length(a), F.length(b))
    distance = F.when(a.startswith(b) | b.startswith(a), F.abs(F.length(a) - F.length(b))).otherwise(F.levenshtein(a, b))
    return F.when(longest == 0, 1.0).otherwise(1 - distance / longest)


def unless_equal(a: Column, b: Column, score: Column) -> Column:
    """score where two texts differ; equal ones are alike by every measure here, and nothing of them is looked at."""
    return F.when(a == b, 1.0).otherwise(score)


def ngram_similarity(a: Column, b: Column, n: int = 3) -> Column:
    return multiset_jaccard(character_ngrams(a, n), character_ngrams(b, n))


def plain_block_similarity(a: Column, b: Column) -> Column:
    return jaccard(tokenize_for_similarity(a), tokenize_for_similarity(b))


def text_content_similarity(a: Column, b: Column) -> Column:
    """The best of token sets, token sequences and 3-grams; of characters if neither has a token."""
    x, y = tokenize_text(a), tokenize_text(b)
    none = (F.size(x) == 0) & (F.size(y) == 0)
    return F.when(none, text_sequence_similarity(a, b, None)).otherwise(F.greatest(jaccard(x, y), sequence_similarity(x, y), ngram_similarity(a, b)))


def exact_alignment_ratio(a: Column, b: Column) -> Column:
    """Equal elements at equal places, over the shorter length."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda s: F.coalesce(s, F.lit(False))))
    least = F.least(F.size(a), F.size(b))
    return F.when(F.greatest(F.size(a), F.size(b)) == 0, 1.0).when(least == 0, 0.0).otherwise(same / least)


def range_closeness(a_line: Column, b_line: Column, a_offset: Column | None = None, b_offset: Column | None = None) -> Column:
    """By lines (0 from 10 on), else by offsets (0 from 400 on), else 0.7."""
    by_line = F.greatest(F.lit(0.0), 1 - F.abs(a_line - b_line) / 10)
    by_offset = F.lit(None).cast("double") if a_offset is None else F.greatest(F.lit(0.0), 1 - F.abs(a_offset - b_offset) / 400)
    return F.when(a_line.isNull() | b_line.isNull(), F.when(by_offset.isNull(), 0.7).otherwise(by_offset)).otherwise(by_line)


def structure_fallback(structure: Column, a_units: Column, b_units: Column, context: Column, base: float, w_structure: float, w_length: float, w_context: float) -> Column:
    """From a structure of at least 0.5 and any text: base and the weighted parts."""
    score = base + w_structure * structure + w_length * ratio(a_units, b_units) + w_context * context
    return F.when((structure < 0.5) | (a_units + b_units == 0), 0.0).otherwise(score)


# The weights of the kinds' similarities.
PARAGRAPH = (0.7, 0.3, (0.5, 0.15, 0.1, 0.05))
CONTAINER = (0.55, 0.45, (0.48, 0.15, 0.05, 0.1))
HEADING_FULL, HEADING_LEAF = (0.4, 0.3, 0.15, 0.15), (0.6, 0.0, 0.2, 0.2)


def weighted_text(text: Column, structure: Column, a_units: Column, b_units: Column, context: Column, weights) -> Column:
    """Paragraphs, quotes and list items: text and structure, or the structure fallback where that is more."""
    w_text, w_structure, fallback = weights
    return F.greatest(w_text * text + w_structure * structure, structure_fallback(structure, a_units, b_units, context, *fallback))


def heading_similarity(title: Column, same_body: Column, same_depth: Column, context: Column, both_full: Column) -> Column:
    """title: similarity; same_body, same_depth: booleans; another body counts half, another depth 0.6."""
    body, depth = F.when(same_body, 1.0).otherwise(0.5), F.when(same_depth, 1.0).otherwise(0.6)
    of = lambda w: w[0] * title + w[1] * body + w[2] * depth + w[3] * context
    return F.when(both_full, of(HEADING_FULL)).otherwise(of(HEADING_LEAF))


def code_similarity(a: Column, b: Column, a_lang: Column, b_lang: Column) -> Column:
    """Of lines as sets and as sequences, or of at most 5000 characters; a common language (or none) adds 0.1."""
    split = lambda x: F.filter(F.transform(F.split(x, "\r?\n", -1), F.trim), lambda l: l != "")
    x, y = split(a), split(b)
    chars = F.when(F.greatest(F.length(a), F.length(b)) <= 5000, text_sequence_similarity(a, b, None)).otherwise(0.0)
    best = F.greatest(jaccard(x, y), sequence_similarity(x, y), chars)
    return F.least(F.lit(1.0), best + F.when(a_lang.eqNullSafe(b_lang), 0.1).otherwise(0.0))


def definition_similarity(same_url: Column, same_title: Column, same_label: Column) -> Column:
    one = lambda x: F.when(x, 1.0).otherwise(0.0)
    return 0.5 * one(same_url) + 0.25 * one(same_title) + 0.25 * one(same_label)


def simhash_bonus(distance: Column, weight: float = 0.05, most: int = 24) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), (most - distance) / most) * weight, F.lit(0.0))


def is_path_suffix(a: Column, b: Column) -> Column:
    """Whether the shorter of two paths ends the longer one."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(F.reverse(a), F.lit(1), F.greatest(n, F.lit(1))) == F.slice(F.reverse(b), F.lit(1), F.greatest(n, F.lit(1)))
