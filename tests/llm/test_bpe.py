import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from launchlens.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n\t", "<|endoftext|>a<|startoftext|>", "ΑΣ ΟΔΟΣ İ ǅ", "it's we'll I'M '", "12345 ½² ٣", "é Å ﬁ 가",
       "😀😀 a😀b 𝔘𝔫", "a​b c\x1cd", "x" * 3000, "ab" * 700 + "\n" + "!?" * 90, "Reon*** haeand$$$ | |"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_rows_match_the_library(spark, library):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("abcdeéß 'S\n12.,-ing the") for _ in range(rng.randint(1, 400))) for _ in range(150)]
    df = spark.createDataFrame([(i % 160, t, 1, "x") for i, t in enumerate(texts)] + [(None, None, 1, "x")],
                               "doc_id long, text string, n_tokens int, ids string")
    want = {}
    for i, t in enumerate([*texts, ""]):
        r = library.encode(t, add_special_tokens=False)
        want[hashlib.sha256(t.encode()).hexdigest()] = (r.ids, library.decode(r.ids, skip_special_tokens=False))
    got = bpe.encode(df, PATH).collect()
    assert sorted((r.ids, r.decoded) for r in got) == sorted(
        want[hashlib.sha256(t.encode()).hexdigest()] for t in [*texts, ""])
    digests = bpe.encoding_digests(df, PATH).collect()
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests) == sorted(
        (len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest())
        for i, d in ((r.ids, r.decoded) for r in got))
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_cache_limit_changes_nothing(library, monkeypatch):
    v = bpe.Vocabulary(PATH)
    texts = ["one two three", "three four", "one five", "two"] * 3
    monkeypatch.setattr(bpe, "CACHE_WORDS", 1)
    small = bpe.Encoder(v)
    assert [small([t])[0] for t in texts] == bpe.Encoder(v)(texts)


def test_tree_takes_leftmost_lowest(library):
    v = bpe.Vocabulary(PATH)
    for word in ("aaaaaaaaa", "inthinthereinth", "hello", "z", "ĳ" * 20):
        raw = word.encode()
        symbols = v.inner[list(raw)].tolist()
        symbols[-1] = int(v.last[raw[-1]])
        plain = list(symbols)
        while found := [(v.pairs[p][0], i) for i, p in enumerate(zip(plain, plain[1:])) if p in v.pairs]:
            _, i = min(found)
            plain[i:i + 2] = [v.pairs[plain[i], plain[i + 1]][1]]
        assert bpe.merge_word(v, symbols) == plain
        assert library.encode(word, add_special_tokens=False).ids == plain


def test_every_code_point_against_the_library():
    """All code points of the lower planes and all that newer Unicode versions added; every sixteenth of the uniform rest."""
    import sys

    from tokenizers import Tokenizer

    from launchlens.llm.queries import vocabulary_path

    library = Tokenizer.from_file(vocabulary_path())
    library.no_padding()
    library.no_truncation()
    own = bpe.Encoder(bpe.Vocabulary(vocabulary_path()))
    points = sorted({*range(0x20000), *bpe._newer(), *range(0x20000, sys.maxunicode + 1, 16)} - set(range(0xD800, 0xE000)))
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}" for c in points]
    for at in range(0, len(texts), 5000):
        part = texts[at:at + 5000]
        want = [" ".join(map(str, e.ids)) for e in library.encode_batch(part, add_special_tokens=False)]
        assert [ids for ids, _ in own(part)] == want
