import hashlib
import random

import numpy as np

from launchlens.llm import centroids as cc

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int"


def plain(rows, k=16, rounds=3, width=64):
    kept = [(i, [int(np.floor(float(np.float32(x)) * 64)) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        got = [near(v)[1] for _, v in kept]
        for c in range(len(cents)):
            own = [v for (_, v), g in zip(kept, got) if g == c]
            if own:
                cents[c] = [sum(col) // len(own) for col in zip(*own)]
    out = [(i, *near(v)) for i, v in kept]
    per = {c: sum(d for _, d, g in out if g == c) for c in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((str(i), g, d, per[g], sum(per.values()), sha[g]) for i, d, g in out)


def clustered(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    return sorted((str(r[0]), *r[1:]) for r in cc.cluster(df, **kw).collect())


def test_against_brute_force_with_nulls_ties_and_repeats(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.3, -0.02, 0.0, 0.015, 0.4]) * (1 + i % 3) for _ in range(64)]) for i in range(150)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (200, None), (201, []), (202, [0.0] * 63), (203, [0.0] * 65),
             (204, [float("nan")] + [0.0] * 63), (205, [float("inf")] + [0.0] * 63), (206, [None] + [0.0] * 63), (207, [0.0] * 64), (208, [0.0] * 64)]
    assert clustered(spark, rows) == plain(rows)


def test_few_vectors_and_empty_tables(spark):
    rows = [(i, [i / 10] * 64) for i in range(5)]
    assert clustered(spark, rows) == plain(rows)
    assert clustered(spark, [(1, [0.5] * 64)]) == plain([(1, [0.5] * 64)])
    assert clustered(spark, []) == [] and clustered(spark, [(1, None)]) == []
    assert clustered(spark, [(1, [3e30] * 64), (2, [0.5] * 64)]) == plain([(2, [0.5] * 64)])


def test_search_is_exact_prunes_and_breaks_ties():
    rng = np.random.default_rng(1)
    spots = rng.integers(-3, 4, (200, 2)).astype(np.int64)  # many equal centroids and equal distances
    x = rng.integers(-4, 5, (500, 2)).astype(np.int64)
    number, best, _ = cc.nearest(cc.build_tree(spots), x)
    d = ((x[:, None] - spots[None]) ** 2).sum(axis=2)
    assert (best == d.min(axis=1)).all() and (number == d.argmin(axis=1)).all()
    spread = rng.integers(-10_000, 10_000, (256, 3)).astype(np.int64)
    near = spread[rng.integers(0, 256, 300)] + rng.integers(-5, 6, (300, 3))
    number, best, measured = cc.nearest(cc.build_tree(spread), near)
    assert (best == ((near[:, None] - spread[None]) ** 2).sum(axis=2).min(axis=1)).all()
    assert measured < 300 * 256 / 4
