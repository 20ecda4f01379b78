"""BPE encoding and decoding by speculation and verification.

A word's greedy longest-match segmentation is only a proposal. It is the BPE
result exactly if each two neighbouring tokens are compatible, that is if BPE
would leave them apart; the pairs of all new words are tested together, as
arrays. Words with an incompatible pair are merged exactly, by rank.

Words are found as the vocabulary's own normaliser and pre-tokeniser do: texts
of ASCII and Latin-1 letters by one expression, others by the tokenizers
library's normaliser and pre-tokeniser. What comes of a word is kept in a bounded
table for the length of a task; a word that the table has lost is encoded again,
with the same result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from treeloom.llm.common import slices, texts_of

#: Words that a task remembers before it starts anew.
MOST_WORDS = 120_000
#: New words that are encoded together, and letters up to which a word takes part in that.
CHUNK, LONG_WORD = 50_000, 64

# The expression of the vocabulary's pre-tokeniser, for texts of ASCII and Latin-1 letters.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x20\x09-\x0Da-zß-öø-ÿ0-9]+")
_UNSAFE = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next from 256 on."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class Pairs:
    """A hash table from pairs of small integers to two integers, looked up by arrays."""

    def __init__(self, first: np.ndarray, second: np.ndarray, *values: np.ndarray):
        self.bits = max(4, int(4 * len(first)).bit_length())
        key = (first.astype(np.int64) << 32) | second
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = [np.full(1 << self.bits, -1, np.int64) for _ in values]
        left, slot = np.arange(len(key)), self._slot(key)
        while len(left):
            free = self.keys[slot] < 0
            own, at = np.unique(slot[free], return_index=True)  # one key for each free slot
            put = left[free][at]
            self.keys[own] = key[put]
            for table, v in zip(self.values, values, strict=True):
                table[own] = v[put]
            stay = np.ones(len(left), bool)
            stay[np.flatnonzero(free)[at]] = False
            left, slot = left[stay], (slot[stay] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def at(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Slots of the pairs, to index a table of values with; -1 for a pair that isn't there."""
        key = (first << 32) | second
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, slot, -1)
        more = np.flatnonzero((held != key) & (held >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[more]]
            hit = held == key[more]
            out[more[hit]] = slot[more[hit]]
            more = more[~hit & (held >= 0)]
        return out


class WordBpe:
    """A byte-level BPE vocabulary whose words end in a suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        suffix = model["end_of_word_suffix"]
        ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*ids.items(), *self.special.items()]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([ids[c] for c in letters], np.int64)  # of each byte within a word, and at its end
        self.final = np.array([ids[c + suffix] for c in letters], np.int64)
        n = max(self.tokens) + 1
        self.rank = np.full(n, -1, np.int64)  # of the merge that makes a token; -1: a letter
        self.left, self.right = np.arange(n), np.arange(n)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        parts = {int(i): (int(i),) for i in [*self.inner, *self.final]}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j, k = ids[a], ids[b], ids[a + b]
            self.merges[i, j] = (r, k)
            self.rank[k], self.left[k], self.right[k] = r, i, j
            parts[k] = parts[i] + parts[j]
        a, b = np.array(list(self.merges), np.int64).T
        r, k = np.array(list(self.merges.values()), np.int64).T
        self.pairs = Pairs(a, b, r, k)
        # All tokens as a tree of letters, for the longest match: node 0 is the root, token -1 is none.
        step: dict[tuple[int, int], int] = {}
        token = [-1]
        for k, path_of in sorted(parts.items()):
            node = 0
            for letter in path_of:
                if (node, letter) not in step:
                    step[node, letter] = len(token)
                    token.append(-1)
                node = step[node, letter]
            token[node] = k
        self.step, self.node_token = step, np.array(token, np.int64)
        a, b = np.array(list(step), np.int64).T
        self.tree = Pairs(a, b, np.array(list(step.values()), np.int64))

    # -- words -> ids

    def letters_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(letters of all words, where each word ends); no word is empty."""
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        out = self.inner[data]
        out[ends - 1] = self.final[data[ends - 1]]
        return out, ends

    def propose(self, letters: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, owning word): the longest tokens from left to right, of all words at once."""
        starts = np.concatenate([[0], ends[:-1]])
        word = np.arange(len(ends))
        at, node = starts.copy(), np.zeros(len(ends), np.int64)
        best, past = np.full(len(ends), -1), starts.copy()
        places, found, owners = [], [], []
        moves, step = self.tree, self.tree.values[0]
        padded = np.append(letters, -1)
        while len(word):
            slot = moves.at(node, padded[at])
            go = (slot >= 0) & (at < ends[word])
            node = np.where(go, step[slot], 0)
            at = at + go
            token = np.where(go, self.node_token[node], -1)
            best, past = np.where(token >= 0, token, best), np.where(token >= 0, at, past)
            stop = ~go
            if stop.any():
                places.append(past[stop])
                found.append(best[stop])
                owners.append(word[stop])
                at = np.where(stop, past, at)
                best = np.where(stop, -1, best)
                keep = ~stop | (at < ends[word])
                word, at, node, best, past = word[keep], at[keep], node[keep], best[keep], past[keep]
        place, token, owner = np.concatenate(places), np.concatenate(found), np.concatenate(owners)
        order = np.argsort(place, kind="stable")
        return token[order], owner[order]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs (a[i], b[i]) BPE leaves apart.

        Both tokens are taken apart again, the later merge first, down to the
        letters at their common border. If two parts that touch there would merge
        sooner than the merge that took one of them up, the border does not last.
        Equal ranks: BPE goes from left to right, so the left one comes first.
        """
        good = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        x, y, live = a, b, np.arange(len(a))
        ranks = self.pairs.values[0]
        while len(live):
            slot = self.pairs.at(x, y)
            early = (slot >= 0) & (ranks[slot] * 2 < limit)
            good[live[early]] = False
            rx, ry = self.rank[x], self.rank[y]
            left = rx > ry
            go = ~early & (left | (ry >= 0))
            limit = np.where(left, rx * 2, ry * 2 + 1)[go]
            x, y, live = np.where(left, self.right[x], x)[go], np.where(left, y, self.left[y])[go], live[go]
        return good

    def merged(self, letters: list[int]) -> list[int]:
        """Exact BPE of one word: the pair of lowest rank first, the leftmost of equals."""
        ids = list(letters)
        n = len(ids)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        queue = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, new, a, b = heapq.heappop(queue)
            j = after[i]
            if gone[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], after[i] = new, True, after[j]
            if after[i] < n:
                before[after[i]] = i
            for p in (before[i], i):
                if p >= 0 and (q := after[p]) < n and (m := self.merges.get((ids[p], ids[q]))):
                    heapq.heappush(queue, (m[0], p, m[1], ids[p], ids[q]))
        return [x for x, dead in zip(ids, gone, strict=True) if not dead]

    def merged_together(self, letters: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, owner): exact BPE of many short words, one merge of each word in a round."""
        done, whose = [], []
        ranks, into = self.pairs.values
        while len(letters):
            slot = self.pairs.at(letters[:-1], letters[1:])
            rank = np.where((slot >= 0) & (owner[:-1] == owner[1:]), ranks[slot], np.iinfo(np.int64).max)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(np.append(rank, np.iinfo(np.int64).max), first)
            size = np.diff(np.append(first, len(letters)))
            whole = np.repeat(least == np.iinfo(np.int64).max, size)
            done.append(letters[whole])
            whose.append(owner[whole])
            hits = np.flatnonzero((rank == np.repeat(least, size)[:-1]) & ~whole[:-1])
            hits = hits[np.concatenate([[True], owner[hits][1:] != owner[hits][:-1]])] if len(hits) else hits
            letters = letters.copy()
            letters[hits] = into[slot[hits]]
            stay = ~whole
            stay[hits + 1] = False
            letters, owner = letters[stay], owner[stay]
        token, own = np.concatenate(done), np.concatenate(whose)
        order = np.argsort(own, kind="stable")
        return token[order], own[order]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, where each word ends among them)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        short = np.flatnonzero(sizes <= LONG_WORD)
        token, owner = [], []
        if len(short):
            letters, ends = self.letters_of([words[i] for i in short])
            got, own = self.propose(letters, ends)
            inner = own[:-1] == own[1:]
            bad = np.zeros(len(short), bool)
            bad[own[:-1][inner][~self.compatible(got[:-1][inner], got[1:][inner])]] = True
            keep = ~bad[own]
            token.append(got[keep])
            owner.append(short[own[keep]])
            if bad.any():
                of = np.repeat(np.arange(len(short)), np.diff(ends, prepend=0))
                again = bad[of]
                got, own = self.merged_together(letters[again], of[again])
                token.append(got)
                owner.append(short[own])
        for i in np.flatnonzero(sizes > LONG_WORD):
            letters, _ = self.letters_of([words[i]])
            got = self.longest_of(letters.tolist())
            pair = np.array(got, np.int64)
            if not self.compatible(pair[:-1], pair[1:]).all():
                got = self.merged(letters.tolist())
            token.append(np.array(got, np.int64))
            owner.append(np.full(len(got), i))
        if not token:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = np.concatenate(owner)
        order = np.argsort(own, kind="stable")
        return np.concatenate(token)[order], np.cumsum(np.bincount(own, minlength=len(words)))

    def longest_of(self, letters: list[int]) -> list[int]:
        """``propose`` for one long word."""
        out, at, n = [], 0, len(letters)
        while at < n:
            node, best, i = 0, (-1, at), at
            while i < n and (node := self.step.get((node, letters[i]), -1)) >= 0:
                i += 1
                if self.node_token[node] >= 0:
                    best = (int(self.node_token[node]), i)
            out.append(best[0])
            at = best[1]
        return out

    # -- texts -> words

    def split(self, text: str) -> list[str]:
        """Words of text, either plain, or after a NUL a special token or a word in the letters of ``byte_letters``."""
        if "<|" in text and self.cut.search(text):
            parts = self.cut.split(text)
        else:
            parts = [text]
        out: list[str] = []
        for part in parts:
            if part in self.special:
                out.append("\0" + part)
            elif part.isascii() or not _UNSAFE.search(part):
                out += _WORDS.findall(part.lower()) if "\0" not in part else self._split_slowly(part)
            else:
                out += self._split_slowly(part)
        return out

    def _split_slowly(self, part: str) -> list[str]:
        normal = self.library.normalizer.normalize_str(part)
        return ["\0" + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def bytes_of(self, word: str) -> bytes:
        """The bytes whose letters a word of ``split`` is made of."""
        return bytes([self.byte_of[c] for c in word[1:]]) if word[0] == "\0" else word.encode()

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, where each word ends among them); words as ``split`` gives them."""
        special = [i for i, w in enumerate(words) if w[0] == "\0" and w[1:] in self.special]
        if not special:
            return self.encode_words([self.bytes_of(w) for w in words])
        apart = set(special)
        flat, ends = self.encode_words([self.bytes_of(w) for i, w in enumerate(words) if i not in apart])
        parts = iter(np.split(flat, ends[:-1]) if len(ends) else [])
        each = [np.array([self.special[w[1:]]]) if i in apart else next(parts) for i, w in enumerate(words)]
        return np.concatenate(each), np.cumsum([len(x) for x in each])

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        return self.ids_of(words)[0].tolist() if words else []

    def decode(self, ids: list[int]) -> str:
        """The tokens with single spaces between them, as a vocabulary without a decoder has it."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


_loaded: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


class WordTable:
    """What is made of each word's ids, found again by the word. It holds a bounded number of words."""

    def __init__(self, bpe: WordBpe, make):
        """make: from (all ids, where each word ends) to a list with something for each word."""
        self.bpe, self.make, self.found = bpe, make, {}

    def of(self, docs: list[list[str]]) -> dict:
        """The table, with all words of docs in it."""
        if len(self.found) > MOST_WORDS:
            self.found.clear()
        found = self.found
        new = list({w for words in docs for w in words if w not in found})
        for i in range(0, len(new), CHUNK):
            part = new[i : i + CHUNK]
            found.update(zip(part, self.make(*self.bpe.ids_of(part)), strict=True))
        return found


def cut_lists(flat: list, ends: np.ndarray) -> list[list]:
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(ends) else []


def id_bytes(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Each word's ids as little-endian unsigned 32-bit numbers."""
    return cut_lists(ids.astype("<u4").tobytes(), ends * 4)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row.

    A null or empty text gives an empty array; rows that repeat and a null doc_id
    pass through; an empty table gives an empty result; other columns go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, words_of = loaded(path), WordTable(loaded(path), lambda ids, ends: cut_lists(ids.tolist(), ends))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in slices(texts):
                docs = [bpe.split(t) for t in texts[i:j]]
                known = words_of.of(docs)
                ids = [[x for w in words for x in known[w]] for words in docs]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encoding and decoding give, as digests.

    The same words, tables and decoding as ``encoded`` and ``decoded``, without the
    arrays between them: each word's decimal ids and decoded tokens are joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        both = WordTable(bpe, lambda ids, ends: [(" ".join(map(str, x)), bpe.decode(x)) for x in cut_lists(ids.tolist(), ends)])
        sha = hashlib.sha256
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in slices(texts):
                docs = [bpe.split(t) for t in texts[i:j]]
                known = both.of(docs)
                pairs = [[known[w] for w in words] for words in docs]
                ids = [" ".join([p[0] for p in x]) for x in pairs]
                back = [" ".join([p[1] for p in x]) for x in pairs]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[i:j], pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64()),
                        pa.array([sha(x.encode()).hexdigest() for x in ids]), pa.array([sha(x.encode()).hexdigest() for x in back]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return texts_of(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
