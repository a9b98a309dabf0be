"""Streams with state of their own, against the batch operators and plain loops."""

import random

import pandas as pd
from pyspark.sql import functions as F

from launchlens.models import training
from launchlens.operators import features
from launchlens.streaming import scoring, snapshots

BASE = 1_700_000_000_000


def replay(spark, rows, schema, path, cuts):
    """Rows in the order given as a file stream, `cuts` files, one per micro-batch."""
    for i in range(cuts):
        spark.createDataFrame(rows[i * len(rows) // cuts:(i + 1) * len(rows) // cuts], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(spark, stream, out):
    with snapshots.timers(spark):
        q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{out}-checkpoint").option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out)


def test_accumulators_merge_to_the_whole():
    rnd = random.Random(1)
    rows = pd.DataFrame([(i, rnd.randrange(50), int(rnd.random() < 0.5), rnd.random() * 9, rnd.random(), rnd.random() < 0.2) for i in range(40)],
                        columns=["trade_id", "ts_ms", "is_buy", "sol_amount", "price_sol", "own"])
    rows["units"] = (rows["sol_amount"] * 1e9).round().astype("int64")
    whole = snapshots.accumulated(rows)
    for cut in (0, 1, 17, 40):
        a, b = rows[:cut], rows[cut:]
        parts = [snapshots.accumulated(x) if len(x) else None for x in (a, b)]
        assert snapshots.merged(*parts) == whole == snapshots.merged(*parts[::-1])
    assert snapshots.merged(None, None) is None


def test_snapshots_do_not_depend_on_how_the_stream_is_cut(spark, tmp_path):
    rnd, ages = random.Random(2), [5, 15, 30]
    rows = []
    for i in range(300):
        token = 1 if rnd.random() < 0.6 else rnd.randrange(2, 5)
        at = BASE + token * 3000 + rnd.choice([0, 5000, 15_000, rnd.randrange(40_000)])
        rows.append((i, token, rnd.randrange(6), rnd.randrange(2), rnd.randrange(1, 900) / 100, rnd.random() + 0.1, at))
    rows.append((900, 9, 1, 1, 1.0, 1.0, BASE + 5000))  # a token the table does not know
    rows.sort(key=lambda r: r[6] + rnd.randrange(2000))  # out of order by less than the bound
    end = [(1000 + k, 8, 1, 1, 1.0, 1.0, BASE + 10**7 * (k + 1)) for k in range(2)]
    schema = "trade_id long, mint_address int, wallet long, is_buy int, sol_amount double, price_sol double, ts_ms long"
    mints = spark.createDataFrame([(t, BASE + t * 3000, 2) for t in (1, 2, 3, 4, 8)], "mint_address int, created_ms long, creator_wallet long")
    batch = features.core_features(features.trades_as_of(spark.createDataFrame(rows, schema), mints, ages), ages)
    want = sorted(map(str, batch.filter("mint_address < 8").collect()))
    for cuts in (1, 3):
        stream = replay(spark, rows, schema, str(tmp_path / f"in{cuts}"), cuts)
        for r in end:
            spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{cuts}"))
        got = drained(spark, snapshots.stream_snapshots(stream, mints, ages, "10 seconds", parts=2), str(tmp_path / f"out{cuts}"))
        assert sorted(map(str, got.drop("cutoff_ts").filter("mint_address < 8").collect())) == want
    assert len(want) > 9


def test_scoring_keeps_one_in_a_while_and_agrees_with_the_batch_scores(spark, tmp_path):
    rnd = random.Random(4)
    schema = "row_key long, mint_address int, snapshot_ts long, creator_wallet long, trade_count long, rugged int, a double, peaked_30 int"
    rows = [(i, i % 7, BASE + i * 9000, i % 3, 9 if i % 11 else 2, int(i % 7 == 6), rnd.random(), 0) for i in range(400)]
    rows = [(*r[:-1], int(r[6] + rnd.random() / 5 > 0.6)) for r in rows]
    df = spark.createDataFrame(rows, schema)
    model = training.train_target(df, "peaked_30", ["a"], gap_ms=0, iters=3, depth=2)
    stats = spark.createDataFrame([(0, 1.5, 0.5, 8), (1, 2.5, 0.25, 9)], "wallet long, skill_score double, win_rate double, mints_completed long")
    kept, last = [], {}
    for r in rows:
        if r[4] >= 5 and not r[5] and r[2] - last.get(r[1], 0) >= 100_000:
            last[r[1]] = r[2]
            kept.append(r)
    stream = replay(spark, rows, schema, str(tmp_path / "in"), 3)
    out = drained(spark, scoring.stream_scoring(scoring.worth_scoring(stream, stats, 5, 100_000, "1 minute"), [model]), str(tmp_path / "out"))
    scores = {(r["mint_address"], r["snapshot_ts"]): r["p"] for r in model.score(df, "p").collect()}
    got = {(r["mint_address"], r["ts_ms"]): (r["prob"], r["creator_skill"]) for r in out.collect()}
    assert got == {(r[1], r[2]): (scores[r[1], r[2]], {0: 1.5, 1: 2.5}.get(r[3])) for r in kept}
