"""Text, token and hash functions as Column expressions.

Lengths and positions count code points. White space means Unicode white space.
Hashes are md5, which other engines have too.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters that count as white space, and as CJK.
SPACE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"

# Unicode's classes of word breaks. Scripts without spaces between words, and the last character below
# them all; characters that extend the one before; those that join letters, or digits, on both sides (a colon does
# not); connectors. Plain characters instead of escapes, as Java, RE2 and Python's regex all read these patterns.
_NO_SPACES = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}" + "\u30fc\uff70"
_LAST_SPACED = "\u0dff"
_EXTEND = r"[\p{M}" + "\u00ad\u061c\u200c\u200d\u200e\u200f\u2060]"
_MID_BOTH = "'.\u2018\u2019\u2024\ufe52\uff07\uff0e"
_MID_LETTER = f"[{_MID_BOTH}\u00b7\u0387\u055f\u05f4\u2027\ufe13]"
_MID_DIGIT = f"[{_MID_BOTH},;\u037e\u0589\u060c\u060d\u066c\u07f8\u2044\ufe10\ufe14\ufe50\ufe54\uff0c\uff1b]"
_CONNECTOR = r"\p{Pc}"
_LETTER = rf"[^\P{{L}}{_NO_SPACES}]"
_DIGIT = r"[\p{Nd}" + "\u066b]"


def _run(unit: str, mid: str) -> str:
    return f"{unit}++(?:{_EXTEND}++{unit}*+|{mid}{_EXTEND}*+{unit}++)*+"


def _word(letters: str, digits: str, connector: str) -> str:
    return f"{connector}*+(?:(?:{letters}|{digits})++{connector}*+)++|{connector}{{2,}}+"


#: A word by Unicode's rules, outside the scripts that take a dictionary. Possessive, so that a text of any length needs no stack.
WORD = _word(_run(f"(?:[a-zß-öø-ÿ]++|{_LETTER}++)", _MID_LETTER), _run(_DIGIT, _MID_DIGIT), _CONNECTOR)
#: The same for lower-case texts of ASCII alone, where it is faster.
_PLAIN_WORD = _word("[a-z]++(?:['.][a-z]++)*+", "[0-9]++(?:['.,;][0-9]++)*+", "_")
#: A character of a script without spaces, with what extends it; and a run of such.
CLUSTER = f"[{_NO_SPACES}]{_EXTEND}*+"
UNSPACED = f"(?:{CLUSTER})++"


def re2(pattern: str) -> str:
    """One of these patterns for engines without possessive quantifiers, which name scripts without a prefix."""
    return re.sub(r"([*+}])\+", r"\1", pattern).replace(r"\p{Is", r"\p{")


# The numbers before a heading that do not count.
PREFIX = r"^([ivxlcdm]+|\d+(?:\.\d+)*|\d{1,4})[.)、：:-]" + SPACE + "+"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def collapse_whitespace(x: Column) -> Column:
    return F.regexp_replace(trimmed(x), f"{SPACE}+", " ")


def normalize_identifier(x: Column) -> Column:
    return F.lower(collapse_whitespace(x))


def strip_heading_prefix(x: Column) -> Column:
    """Without a leading number or roman numeral with its mark; a year from 1900 to 2100 stays. x is lower-case."""
    number = F.regexp_extract(x, PREFIX, 1)
    year = number.rlike(r"^\d{4}$") & number.try_cast("int").between(1900, 2100)
    return F.when(year, x).otherwise(F.regexp_replace(x, PREFIX, ""))


@F.pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def normalize_heading_title(x: Column, nfkc: bool = False) -> Column:
    """nfkc: Spark has no such function, so it takes an Arrow UDF; without it texts must come in NFKC."""
    x = _nfkc(x) if nfkc else x
    # Words of ASCII with single spaces between them have no white space to trim, collapse or lose, and most titles have no number.
    low = F.lower(x)
    plain = F.when(low.rlike(PREFIX), strip_heading_prefix(low)).otherwise(low)
    return F.when(x.rlike("\\A[!-~]++(?: [!-~]++)*+\\z"), plain).otherwise(collapse_whitespace(strip_heading_prefix(F.lower(trimmed(x)))))


def slugify_heading(x: Column, nfkc: bool = False) -> Column:
    # The classes of characters that a slug drops or joins.
    plain = F.regexp_replace(normalize_heading_title(x, nfkc), r"[^\p{L}\p{N}\s-]", " ")
    return F.regexp_replace(trimmed(plain), r"[\s_-]+", "-")


def extract_attribution(x: Column) -> Column:
    return trimmed(F.regexp_extract(x, "^(.+?)[：:]", 1))


def excerpt(x: Column, most: int = 50) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("…"))).otherwise(x)


def leading_spaces(x: Column) -> Column:
    return F.length(F.regexp_extract(x, "^( *)", 1))


def ngrams(x: Column, n: int) -> Column:
    """Runs of n characters; a shorter text that isn't empty is one itself. The text is split once, so it takes linear time."""

    def made(chars):
        runs = F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(*(F.get(chars, i + k) for k in range(n))))
        return F.when(F.size(chars) >= n, runs).otherwise(F.array(F.array_join(chars, "")))

    return F.when(F.length(x) > 0, let(F.split(x, ""), made)).otherwise(F.array().cast("array<string>"))


def cjk_bigrams(x: Column) -> Column:
    """Neighbouring pairs of a text's characters, a single one as it is."""
    return ngrams(x, 2)


def tokenize_text(x: Column) -> Column:
    """Words by Unicode's rules, lower-case; of scripts without spaces, for which there is no dictionary, pairs of neighbours.

    Apostrophes and full stops join letters, those and commas digits, connectors anything;
    marks and joiners stay with what they extend. Emoji and other symbols are no words.
    Quotes after or between Hebrew letters part them unless they are gershayim. No word: an empty array; null: null.
    """
    low = F.lower(x)
    mixed = F.regexp_extract_all(low, F.lit(f"{UNSPACED}|{WORD}"), F.lit(0))

    def paired(w):
        return let(F.regexp_extract_all(w, F.lit(CLUSTER), F.lit(0)), lambda c: F.when(F.size(c) < 2, c).otherwise(F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c)), lambda a, b: F.concat(a, b))))

    pairs = F.flatten(F.transform(mixed, lambda w: F.when(w.rlike(f"^{CLUSTER}"), paired(w)).otherwise(F.array(w))))
    found = lambda pattern: F.regexp_extract_all(low, F.lit(pattern), F.lit(0))
    return F.when(~low.rlike(r"[^\x00-\x7F]"), found(_PLAIN_WORD)).when(low.rlike(rf"[^\x00-{_LAST_SPACED}]") & low.rlike(CLUSTER), pairs).otherwise(found(WORD))


def tokenize_for_similarity(x: Column) -> Column:
    """Each CJK character, or a run of others without white space."""
    return F.regexp_extract_all(x, F.lit(rf"{CJK}|(?:(?!{CJK})[^\s])+"), F.lit(0))


def character_ngrams(x: Column, n: int = 3) -> Column:
    """Lower-case n-grams; a shorter text that isn't empty is one itself."""
    return ngrams(F.lower(x), n)


def content_hash(*parts: Column) -> Column:
    """md5 of the parts' canonical form; a missing part differs from an empty one."""
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("~")) for p in parts)).cast("binary"))


def joined(x: Column) -> Column:
    return F.array_join(x, "|")


# -- signatures


def simhash_votes(token: Column) -> list[Column]:
    """64 sums of +1 or -1 over a group's tokens, by the bits of the token's md5, the highest first."""
    half = [F.conv(F.substring(F.md5(token.cast("binary")), 1 + 8 * k, 8), 16, 10).cast("long") for k in range(2)]
    return [F.sum(F.when(F.shiftright(half[i // 32], 31 - i % 32).bitwiseAND(1) == 1, 1).otherwise(-1)).alias(f"v{i}") for i in range(64)]


def simhash_of_votes() -> Column:
    """16 hex digits from the columns of ``simhash_votes``: a bit is 1 where its sum is not negative."""
    digits = [sum((F.when(F.col(f"v{4 * d + b}") >= 0, 8 >> b).otherwise(0) for b in range(4)), F.lit(0)) for d in range(16)]
    return F.concat(*(F.substring(F.lit("0123456789abcdef"), x + 1, F.lit(1)) for x in digits))


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two signatures; null if either is missing."""
    parts = [F.conv(F.substring(x, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(2) for x in (a, b)]
    return F.bit_count(parts[0].bitwiseXOR(parts[1])) + F.bit_count(parts[2].bitwiseXOR(parts[3]))


MINHASHES = 64
_PRIME = 4294967291


def minhash_seeds() -> list[tuple[int, int]]:
    """(factor, addend) of each permutation."""
    return [((2654435761 * (s + 1)) % 2147483647, (40503 * (s + 1) ** 2) % _PRIME) for s in range(MINHASHES)]


def minhash_minima(token: Column) -> list[Column]:
    """The least permuted hash of a group's tokens, for each permutation."""
    h = F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long")
    return [F.min((h % _PRIME * a + b) % _PRIME).alias(f"m{i}") for i, (a, b) in enumerate(minhash_seeds())]
