"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word is a row of symbols. Leaf i of its tree holds rank * size + i for the pair of the symbols at i and right of i;
each inner node is the smaller of its children, so the root is the leftmost pair of lowest rank. A merge rewrites
three leaves and their ancestors. Words of the same padded length are merged together in numpy, one merge per word and
step; long words are merged one by one with the same tree. Words already met in the task come from a bounded cache.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame

from launchlens.llm.common import map_texts

#: Words kept per task; the cache is emptied beyond it, which changes no result.
CACHE_WORDS = 200_000
#: Words with more symbols than this are merged one by one.
WIDE = 64
_NONE = 1 << 30


# Letters and numbers that the `regex` module knows and Unicode 16, the tokenizer library's for words, does not.
_NEWER = """
    558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959
    10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3
    16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6
    1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4
    1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
# Capital letters that the library lowers and older interpreters do not.
_NEW_CAPITALS = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 32 for c in range(0x10D50, 0x10D66)}, **{c: c + 27 for c in range(0x16EA0, 0x16EB9)},
}
_NEW_CAPITAL = re.compile("[" + "".join(map(chr, _NEW_CAPITALS)) + "]")


def _newer() -> set[int]:
    spans = [[int(x, 16) for x in span.split("-")] for span in _NEWER.split()]
    return {c for span in spans for c in range(span[0], span[-1] + 1)}


def _class_of(prop: str, limit: int) -> str:
    """Code points below limit of a general category, as ranges for a character class."""
    newer = _newer()
    known = "".join(" " if c in newer or chr(c).isspace() else chr(c) for c in range(limit))
    runs = regex.finditer(rf"\p{{{prop}}}+", known)
    return "".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in runs)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary: itself, or the next one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tables of a word-level BPE file: symbol ids, pair ranks, special tokens, and the word pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        self.pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        codes = np.array([(a << 16) | b for a, b in self.pairs], np.int64)
        order = np.argsort(codes)
        self.codes = codes[order]
        self.rank_of = np.array([r for r, _ in self.pairs.values()], np.int32)[order]
        self.merged = np.empty(len(merges), np.int32)
        self.merged[[r for r, _ in self.pairs.values()]] = [i for _, i in self.pairs.values()]
        # white space as the tokenizer file's regular expressions understand it
        space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
        # tried in an order that suits running text: no letter or number can begin another branch
        self.word, self.wide_word = (
            f"[{letter}]+|[{number}]|'(?:s|t|re|ve|m|ll|d)|[^{space}{letter}{number}]+"
            for letter, number in ((_class_of("L", top), _class_of("N", top)) for top in (1 << 16, sys.maxunicode + 1))
        )
        self.split = "(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")"

    def ranks(self, a: np.ndarray, b: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
        """Leaf keys of the pairs (a, b) at positions at; _NONE where they do not merge."""
        code = (a.astype(np.int64) << 16) | b
        k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[k] == code) & (a >= 0) & (b >= 0), self.rank_of[k] * size + at, _NONE).astype(np.int32)


def merge_rows(v: Vocabulary, sym: np.ndarray) -> np.ndarray:
    """Merge each row of symbols (padded with -1 to a power of two) until no pair is left; removed symbols become -1."""
    n, size = sym.shape
    sym = np.concatenate([sym, np.full((n, 1), -1, np.int32)], axis=1)  # column size: no neighbour
    right = np.tile(np.arange(1, size + 2, dtype=np.int32), (n, 1))
    left = np.tile(np.arange(-1, size, dtype=np.int32), (n, 1))
    left[:, 0] = size
    tree = np.full((n, 2 * size), _NONE, np.int32)
    if size > 1:
        at = np.arange(size, dtype=np.int32)
        tree[:, size:] = v.ranks(sym[:, :size], sym[:, 1:], size, at[None, :])
    level = size >> 1
    while level:
        tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
        level >>= 1
    rows = np.flatnonzero(tree[:, 1] < _NONE) if size > 1 else np.empty(0, np.int64)
    flat, sym_f, left_f, right_f, wide = tree.reshape(-1), sym.reshape(-1), left.reshape(-1), right.reshape(-1), size + 1
    while len(rows):
        root = flat[rows * (2 * size) + 1]
        pos, base = root % size, rows * wide
        gone = right_f[base + pos]
        after, before = right_f[base + gone], left_f[base + pos]
        sym_f[base + pos] = v.merged[root // size]
        sym_f[base + gone] = -1
        right_f[base + pos] = after
        left_f[base + after] = pos
        mine = sym_f[base + pos]
        first = np.where(before == size, pos, before)  # without a left neighbour, the pair of pos twice
        low = v.ranks(sym_f[base + first], np.where(before == size, sym_f[base + after], mine), size, first)
        here = v.ranks(mine, sym_f[base + after], size, pos)
        top = rows * (2 * size)
        flat[top + size + gone] = _NONE
        flat[top + size + first] = low
        flat[top + size + pos] = here
        for leaf in (gone, first, pos):
            node = (leaf + size) >> 1
            for _ in range(size.bit_length() - 1):
                k = top + 2 * node
                flat[top + node] = np.minimum(flat[k], flat[k + 1])
                node = node >> 1
        rows = rows[flat[rows * (2 * size) + 1] < _NONE]
    return sym[:, :size]


def merge_word(v: Vocabulary, symbols: list[int]) -> list[int]:
    """The same for one word of any length, in steps logarithmic in its length."""
    n = len(symbols)
    size = 1 << max(1, (n - 1).bit_length())
    right, left, pairs, none = list(range(1, n + 1)), list(range(-1, n - 1)), v.pairs, (_NONE, 0)
    tree = [none] * (2 * size)
    tree[size:size + n - 1] = [(pairs[p][0], i) if p in pairs else none for i, p in enumerate(zip(symbols, symbols[1:], strict=False))]
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(i: int, key: tuple[int, int]) -> None:
        node = i + size
        tree[node] = key
        node >>= 1
        while node:
            best = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node >>= 1

    while tree[1][0] < _NONE:
        pos = tree[1][1]
        gone = right[pos]
        symbols[pos] = pairs[symbols[pos], symbols[gone]][1]
        symbols[gone] = -1
        right[pos] = after = right[gone]
        put(gone, none)
        put(pos, none)
        if after < n:
            left[after] = pos
            if (p := (symbols[pos], symbols[after])) in pairs:
                put(pos, (pairs[p][0], pos))
        if (b := left[pos]) >= 0:
            put(b, (pairs[p][0], b) if (p := (symbols[b], symbols[pos])) in pairs else none)
    return [s for s in symbols if s >= 0]


class Encoder:
    """Ids and decoded text of whole texts; one per task."""

    def __init__(self, v: Vocabulary):
        self.v, self.cut = v, re.compile(v.split).split
        self.find, self.find_wide = re.compile(v.word).findall, re.compile(v.wide_word).findall
        self.ids: dict[str, str] = {}
        self.text: dict[str, str] = {}
        self.name = [str(i) for i in range(max(v.token) + 1)]
        self.shown = [v.token.get(i, "") for i in range(max(v.token) + 1)]

    def words(self, text: str) -> list[str]:
        """Normalised words; special tokens stand as one-item tuples."""
        out = []
        for k, part in enumerate(self.cut(text)):
            if k % 2:
                out.append((part,))
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # no final sigma: letters are lowered one by one
                    if _NEW_CAPITAL.search(part):
                        part = part.translate(_NEW_CAPITALS)
                part = part.lower()
                astral = not part.isascii() and len(part.encode("utf-16-le", "surrogatepass")) > 2 * len(part)
                out += (self.find_wide if astral else self.find)(part)
        return out

    def learn(self, new: list) -> None:
        """Put words into the cache: merged together by padded length."""
        v, groups = self.v, {}
        for w in new:
            if isinstance(w, tuple):
                self.ids[w], self.text[w] = str(v.special[w[0]]), w[0]
                continue
            raw = w.encode("utf-8", "surrogatepass")
            if len(raw) > WIDE:
                symbols = v.inner[np.frombuffer(raw, np.uint8)]
                symbols[-1] = v.last[raw[-1]]
                self.keep(w, merge_word(v, symbols.tolist()))
            else:
                groups.setdefault(1 << (len(raw) - 1).bit_length(), []).append((w, raw))
        for size, group in groups.items():
            lengths = np.array([len(raw) for _, raw in group])
            bytes_ = np.frombuffer(b"".join(raw for _, raw in group), np.uint8)
            grid = np.full((len(group), size), -1, np.int32)
            grid[np.arange(size)[None, :] < lengths[:, None]] = v.inner[bytes_]
            grid[np.arange(len(group)), lengths - 1] = v.last[bytes_[np.cumsum(lengths) - 1]]
            for (w, _), row in zip(group, merge_rows(v, grid).tolist(), strict=True):
                self.keep(w, [s for s in row if s >= 0])

    def keep(self, word: str, symbols: list[int]) -> None:
        self.ids[word] = " ".join([self.name[s] for s in symbols])
        self.text[word] = " ".join([self.shown[s] for s in symbols])

    def __call__(self, texts: list[str]) -> list[tuple[str, str]]:
        """(ids in decimal joined by a space, decoded text) of each text."""
        split = [self.words(t) for t in texts]
        if len(self.ids) > CACHE_WORDS:
            self.ids.clear()
            self.text.clear()
        seen = set()
        for words in split:
            seen.update(words)
        self.learn(list(seen.difference(self.ids)))
        ids, text = self.ids.__getitem__, self.text.__getitem__
        return [(" ".join(map(ids, words)), " ".join(map(text, words))) for words in split]


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string, one row per row of docs; a null or empty text has no ids.

    Special tokens written out in a text take their own id, as by default in the tokenizers library. The vocabulary
    file is read on the driver and broadcast: its size does not depend on the data. Repeated rows are all encoded."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))

    def worker():
        enc = Encoder(shared.value)

        def step(texts):
            out = enc(texts)
            return [[list(map(int, i.split())) for i, _ in out], [t for _, t in out]]
        return step

    return map_texts(docs, id_col, text_col, worker, "ids array<int>, decoded string", rows_at_once=128, chars_at_once=1 << 19, tidy=True)


def encoding_digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what `encode` yields, digested in the task instead of returned."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))

    def worker():
        enc = Encoder(shared.value)

        def step(texts):
            out = enc(texts)
            return [
                [i.count(" ") + 1 if i else 0 for i, _ in out],
                [hashlib.sha256(i.encode()).hexdigest() for i, _ in out],
                [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for _, t in out],
            ]
        return step

    return map_texts(docs, id_col, text_col, worker, "n_tokens long, ids_sha256 string, decoded_sha256 string", rows_at_once=256,
                     chars_at_once=1 << 19, tidy=True)
