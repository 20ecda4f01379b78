import hashlib
import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cases import AWKWARD, EXTRA, SCHEMA, rows, widened
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from treeloom.llm import bpe

PATH = bpe.default_path()
LIB = Tokenizer.from_file(PATH)
OWN = bpe.loaded(PATH)


def ids(text):
    return LIB.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("aehinorst' 's.1é\x1c\x85 ß", max_size=60) | st.text("ILMSVaeiou'TD-_!?\t\n", max_size=80))
def test_any_text(text):
    assert OWN.encode(text) == ids(text)
    assert OWN.decode(ids(text)) == LIB.decode(ids(text), skip_special_tokens=False)


def test_words_of_many_kinds():
    rng = random.Random(1)
    syllables = "the ing er an tion ou on ha re is ea nd st eux ment ç è au 2 ! ... 'll #$% ß ö".split()
    for _ in range(2000):
        text = "".join(rng.choice([*syllables, " "]) for _ in range(rng.randrange(1, 40)))
        assert OWN.encode(text) == ids(text), text
    for text in ("a" * 3000, "ab" * 2000, "!" * 999, "x1" * 100, "the" * 500, "\0a", "Á é", "İΣ ſ K ǅ ﬁ ²½ Ⅳ"):
        assert OWN.encode(text) == ids(text), text


def test_proposals_do_fail_and_are_mended():
    words = [w.encode() for w in ("thinshsh", "edonth", "anerthe", "hethwhwh", "ingeser", "thatble", "ountion", "haanner", "a", "x" * 70)] * 3
    letters, ends = OWN.letters_of(words)
    each = [x.tolist() for x in np.split(letters, ends[:-1])]
    token, owner = OWN.propose(letters, ends)
    proposed = [token[owner == i].tolist() for i in range(len(words))]
    assert proposed == [OWN.longest_of(x) for x in each]
    wrong = [i for i, x in enumerate(each) if proposed[i] != OWN.merged(x)]
    assert wrong and len(wrong) < len(words)
    pairs = [OWN.compatible(np.array(x[:-1], np.int64), np.array(x[1:], np.int64)).all() for x in proposed]
    assert [i for i, good in enumerate(pairs) if not good] == wrong
    token, owner = OWN.merged_together(letters, np.repeat(np.arange(len(words)), np.diff(ends, prepend=0)))
    assert [token[owner == i].tolist() for i in range(len(words))] == [OWN.merged(x) for x in each]
    ids, ends = OWN.encode_words(words)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [OWN.merged(x) for x in each]


def test_query(spark):
    some = rows([*AWKWARD, "it's the ÉTÉ’s end—of 12 days"])
    for df in (spark.createDataFrame(some, SCHEMA), spark.createDataFrame(widened(some), EXTRA)):
        got = {r["doc_id"]: r for r in bpe.digests(df, PATH).collect()}
        assert len(got) == len(some)
        for doc_id, text, *_ in some:
            want = ids(text or "")
            r = got[doc_id]
            assert r["n_tokens"] == len(want)
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(LIB.decode(want, skip_special_tokens=False).encode()).hexdigest()
    both = bpe.encoded(df, PATH)
    assert {r["doc_id"]: r["ids"] for r in both.collect()} == {d: ids(t or "") for d, t, *_ in some}
    assert {r["doc_id"]: r["text"] for r in bpe.decoded(both, PATH).collect()} == {d: LIB.decode(ids(t or ""), skip_special_tokens=False) for d, t, *_ in some}
    assert bpe.digests(df.limit(0), PATH).count() == 0
