"""A small labelled table for training tests: two columns that matter, one that does not."""

import random


def snapshots(spark, n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        signal, hint, noise = rnd.random(), rnd.randrange(5), rnd.random()
        rows.append((i, 1_700_000_000_000 + i * 60_000, signal, float(hint), noise, int(signal + hint / 10 + rnd.gauss(0, 0.2) > 0.9)))
    return spark.createDataFrame(rows, "row_key long, snapshot_ts long, unique_buyers double, kol_buyers double, sandwich_risk double, peaked_30 int")
