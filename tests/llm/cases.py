"""Small documents with the awkward cases that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA + ", norm string, salt int, h long, rules string, class long, n int, size int, rank string, a int, b int"


def rows(texts, langs=None):
    langs = langs or ["en"] * len(texts)
    return [(i, t, lang, f"src{i % 3}", None if t is None else len(t)) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]


def widened(some):
    return [(*r, "x", 1, 2, "y", 3, 4, 5, "z", 6, 7) for r in some]


AWKWARD = [
    None, "", " ", "\n\t\x0b\f\r", "a", "é", "𝔘𝔫𝔦 🎉", "x" * 5000, "word " * 3000, "same text here", "same  text\nhere", "same text here",
    "aaaa bbbb cccc dddd eeee ffff", "AAAA bbbb cccc dddd eeee ffff", "  ", "1234", "<|endoftext|> hi <|startoftext|>", "İstanbul ΣΑΣ ſ K",
]
