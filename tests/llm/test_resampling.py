import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from launchlens.llm import resampling as rs

SCHEMA = "doc_id long, text string, score string, rank int, position int"


def features(text, longest):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def plain(docs, target, longest=1, buckets=rs.BUCKETS, percent=10, least=20):
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(crc(f) for _, t in docs for f in features(t, longest)[0])
    t_ = Counter(crc(f) for t in target for f in features(t, longest)[0])
    S, T = sum(s.values()), sum(t_.values())
    gain = lambda b: math.floor(1000 * math.log((t_[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, text in docs:
        fs, words = features(text, longest)
        weight = sum(gain(crc(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("longest,percent", [(1, 10), (2, 60)])
def test_against_brute_force(spark, longest, percent):
    rng = random.Random(longest)
    vocab = ["alpha", "Beta", "gamma9", "ümlaut", "x", "中文", "é-é", "k2"]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 60)))) for i in range(300)]
    docs += [(None, "a " * 30), (400, None), (401, ""), (402, "word " * 30_000), (403, "z" * 100_000), (5, "again " * 25), (-7, "Ä,b " * 40)]
    target = ["gamma9 x x", None, "ümlaut alpha gamma9"]
    df = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in docs], SCHEMA)
    got = rs.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, target, longest, percent=percent)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a " * 20, "s", 1, 2)] * 10, SCHEMA)
    none = df.limit(0)
    assert rs.resample(none, none).count() == 0
    assert sorted(r["rank"] or 0 for r in rs.resample(df, none).collect()) == [0] * 9 + [1]


def test_radix_order_over_blocks_and_extremes(spark):
    rng = random.Random(9)
    rows = [(rng.choice([-(2**40), -5, 0, 3, 2**40]), rng.choice([None, -9, 0, 1, 2**33])) for _ in range(500)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(3)
    got = rs.radix_order(df, [("a", True), ("b", False)], block=64, bits=7).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(500))
    assert [(r["a"], r["b"]) for r in got] == sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    same = spark.range(100).select(F.lit(None).cast("long").alias("a"))
    assert sorted(r["position"] for r in rs.radix_order(same, [("a", False)], block=16).collect()) == list(range(100))
    one = spark.range(100).select(F.lit(4).alias("a"))
    assert sorted(r["position"] for r in rs.radix_order(one, [("a", False)], block=16).collect()) == list(range(100))
    far = [(x,) for x in (-(2**63), 2**63 - 1, 0, None, -1, 1, 5)]
    df = spark.createDataFrame(far, "a long")
    for down in (False, True):
        got = [r["a"] for r in rs.radix_order(df, [("a", down)], block=4).orderBy("position").collect()]
        assert got == [*sorted((x for x, in far if x is not None), reverse=down), None]
