from pyspark.sql import functions as F

from launchlens.models import metrics, prepare, training
from snapshots import snapshots


def test_training_beats_chance_and_calibration_is_monotone(spark):
    df = snapshots(spark, 3000, 42).persist()
    cols = ["unique_buyers", "kol_buyers", "sandwich_risk"]
    m = training.train_target(df, "peaked_30", cols, gap_ms=60_000, iters=5, depth=3)
    assert m.metrics["auc_roc"] > 0.6 and m.metrics["n_train"] > 2000
    knots = [r["p"] for r in m.score(df, "p").groupBy("p").agg(F.count(F.lit(1))).collect()]
    assert all(0 <= p <= 1 for p in knots)
    drop = {r["feature"]: r["importance"] for r in training.permutation_importance(m, df, "peaked_30", ["unique_buyers", "sandwich_risk"], repeats=1, gap_ms=60_000).collect()}
    assert drop["unique_buyers"] > drop["sandwich_risk"] - 0.05


def test_few_positives_are_not_trained(spark):
    df = snapshots(spark, 200, 1).withColumn("migrated", (F.col("row_key") < 3).cast("int"))
    assert training.train_target(df, "migrated", ["unique_buyers"], iters=2) is None


def test_split_is_exact_with_ties(spark):
    df = spark.range(100).select(F.col("id").alias("row_key"), F.lit(5).alias("snapshot_ts"))
    got = {r["split"]: r["n"] for r in prepare.time_split(df, 0.8, 0).groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"train": 80, "val": 20}


def test_feature_lists():
    assert [len(prepare.FEATURES[m]) for m in ("pre", "lean", "post")] == [len(set(prepare.FEATURES[m])) for m in ("pre", "lean", "post")]
    assert len(prepare.ACTIVE_TARGETS) == 14


def test_perfect_ranking(spark):
    df = spark.createDataFrame([(i / 100, int(i >= 50)) for i in range(100)], "prob double, label int")
    got = metrics.binary_metrics(df).first()
    assert got["auc_roc"] == 1.0 and got["auc_pr"] == 1.0 and got["tp"] == 50


def duck_auc(rows):
    import duckdb
    import pandas as pd

    x = pd.DataFrame(rows, columns=["y", "p"])  # noqa: F841
    return duckdb.query("""WITH g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM x GROUP BY p)
      SELECT sum(neg * (coalesce((SELECT sum(pos) FROM g h WHERE h.p > g.p), 0) + pos / 2)) / (sum(pos) * sum(neg)) FROM g""").fetchall()[0][0]


def test_missing_values_carry_the_label_and_the_registry_keeps_models(spark, tmp_path):
    import random

    rnd = random.Random(3)
    rows = []
    for i in range(1200):
        y = int(rnd.random() < 0.4)
        # present values are the same for both labels; only their absence tells them apart
        rows.append((i, 1_700_000_000_000 + i * 1000, None if (y and rnd.random() < 0.9) else rnd.uniform(-5, 5), rnd.random(), y, float(y) * 3 - 1, None, y if i < 4 else 0))
    df = spark.createDataFrame(rows, "row_key long, snapshot_ts long, a double, b double, peaked_30 int, pnl_pct_60s double, peaked_100 int, will_rug int")
    targets = {"peaked_30": 5, "pnl_pct_60s": 10, "peaked_100": 5, "will_rug": 0, "absent": 1, "alive_at_1h": 10**9}
    df = df.withColumn("alive_at_1h", F.col("peaked_30"))
    root = str(tmp_path / "models")
    found = {o.target: o for o in training.retrain(df, targets, ["a", "b", "not_there"], root, 1, gap_ms=0, settings=training.Settings(iters=8, depth=2))}
    assert [found[t].reason is None for t in targets] == [True, True, False, False, False, False]
    assert found["absent"].reason == "no such column" and "class" in found["will_rug"].reason
    m = found["peaked_30"].model
    assert m.metrics["auc_roc"] > 0.85 and m.importances()["a"] > 0.9 and m.booster.trees[0].feature[0] == 0
    assert found["pnl_pct_60s"].model.metrics["r2_log"] > 0.6
    val = prepare.time_split(df, 0.8, 0).filter("split = 'val'")
    pairs = [(r["peaked_30"], r["p"]) for r in m.score(val, "p").collect()]
    assert abs(duck_auc(pairs) - m.metrics["auc_roc"]) < 1e-9
    loaded = training.load_models(spark, f"{root}/models")
    assert [x.target for x in loaded] == ["peaked_30", "pnl_pct_60s"]
    both = training.score_columns(training.score_columns(val, loaded, ["p1", "q1"]), [m, found["pnl_pct_60s"].model], ["p2", "q2"])
    assert both.filter("p1 <> p2 or q1 <> q2 or p1 is null").count() == 0
    assert training.score_columns(df.limit(0), loaded, ["p", "q"]).count() == 0
    # a second run appends: two history rows a target, the registry serves the newest or the newest up to a time
    again = training.retrain(df, targets, ["a", "b"], root, 2, force=True, gap_ms=0, settings=training.Settings(iters=2, depth=2))
    history = spark.read.parquet(f"{root}/history").orderBy("target", "trained_at").collect()
    assert [(r["target"], r["trained_at"]) for r in history] == [("peaked_30", 1), ("peaked_30", 2), ("pnl_pct_60s", 1), ("pnl_pct_60s", 2)]
    assert history[0]["model_path"].endswith("peaked_30_v1") and '"a"' in history[0]["feature_importances_json"]
    assert len(training.load_models(spark, f"{root}/models", ["peaked_30"])[0].booster.trees) <= 2
    assert training.load_models(spark, f"{root}/models", as_of_ms=1)[0].to_json() == loaded[0].to_json()
    report = {r["target"]: r for r in training.training_report(spark, again).collect()}
    assert len(report) == 6 and report["peaked_100"]["n_usable"] == 0 and not report["peaked_100"]["trained"]


def test_poisson_trees_beat_a_linear_model_on_an_interaction(spark):
    import numpy as np
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rng = np.random.default_rng(5)
    a, b = rng.random(2000), rng.random(2000)
    y = rng.poisson(np.where((a > 0.5) ^ (b > 0.5), 6.0, 0.5))
    rows = [(i, 1_700_000_000_000 + i, float(a[i]), float(b[i]), float(y[i])) for i in range(2000)]
    df = spark.createDataFrame(rows, "row_key long, snapshot_ts long, a double, b double, unique_buyers_next_60s double").persist()
    m = training.train_target(df, "unique_buyers_next_60s", ["a", "b"], gap_ms=0, iters=25, depth=3)
    assert m.booster.loss == "poisson"
    val = m.score(prepare.time_split(df, 0.8, 0).filter("split = 'val'"), "p")
    asm = VectorAssembler(inputCols=["a", "b"], outputCol="f")
    glm = GeneralizedLinearRegression(family="poisson", featuresCol="f", labelCol="unique_buyers_next_60s", predictionCol="q").fit(asm.transform(df.limit(1600)))
    got = glm.transform(asm.transform(val)).select("p", "q", F.col("unique_buyers_next_60s").alias("y")).toPandas()

    def deviance(p):
        t = np.where(got.y > 0, got.y * np.log(np.maximum(got.y, 1e-9) / p), 0)
        return 2 * np.mean(t - (got.y - p))

    assert deviance(got.p) < 0.6 * deviance(got.q)


def test_isotonic_against_plain_pooling():
    from launchlens.models.boosting import isotonic

    xs, ys = isotonic([(0.1, 1, 0.5), (0.2, 1, 0.1), (0.3, 2, 0.6), (0.4, 1, 0.6), (0.5, 1, 0.2)])
    assert xs == [0.1, 0.2, 0.3, 0.5] and [round(v, 6) for v in ys] == [0.3, 0.3, 0.5, 0.5]


def test_prefix_sums_share_out_crowded_values(spark):
    from launchlens.functions import prefix_sums

    rows = [(k, 7 if k else i % 3, i, None if i % 50 == 9 else i) for k in (0, 1) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, day int, id int, v int")
    for keys in ([], ["k"]):
        got = prefix_sums(df, keys, ["day", "id"] if keys else ["k", "day", "id"], {"v": "s"}, parts=8)
        total, want = {}, {}
        for k, day, i, v in sorted(rows):
            at = k if keys else 0
            total[at] = total.get(at, 0) + (v or 0)
            want[k, i] = total[at]
        assert {(r["k"], r["id"]): r["s"] for r in got.collect()} == want
    held = prefix_sums(df, [], ["day", "id", "k"], {"v": "s"}, parts=8).groupBy(F.spark_partition_id()).count().collect()
    assert len(held) >= 2 and max(r["count"] for r in held) < 800
