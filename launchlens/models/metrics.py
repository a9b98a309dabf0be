"""Validation metrics as distributed aggregates, for one model or for many at once (`by`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from launchlens.functions import nz, order_statistics, prefix_sums
from launchlens.functions.ranks import MEDIAN_HIGH, MEDIAN_LOW


def _keyed(scored: DataFrame, by: list[str], label: str, value: str) -> tuple[DataFrame, list[str]]:
    """Columns (keys, y, p); without keys one constant stands in."""
    keys = by or ["_k"]
    cols = by or [F.lit(1).alias("_k")]
    return scored.select(*cols, F.col(label).cast("double").alias("y"), F.col(value).cast("double").alias("p")), keys


def curve_areas(scored: DataFrame, label: str = "label", prob: str = "prob", by: list[str] = ()) -> DataFrame:
    """Per key (auc_roc, auc_pr): exact areas with ties counted half, average precision over distinct scores.

    Scores are counted per distinct value; the counts are accumulated over ranges of equally many values, highest first.
    """
    x, keys = _keyed(scored, list(by), label, prob)
    g = x.groupBy(*keys, "p").agg(F.count(F.when(F.col("y") == 1, 1)).alias("pos"), F.count(F.when(F.col("y") == 1, None).otherwise(1)).alias("neg"))
    c = prefix_sums(g, keys, [-F.col("p")], {"pos": "cum_pos", "neg": "cum_neg"})
    s = c.groupBy(*keys).agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0)).alias("u"),
        F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("ap"),
    )
    return s.select(
        *by,
        F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("u") / (F.col("P") * F.col("N"))).otherwise(0.0).alias("auc_roc"),
        F.when(F.col("P") > 0, F.col("ap") / F.col("P")).otherwise(0.0).alias("auc_pr"),
    )


def binary_metrics(scored: DataFrame, label: str = "label", prob: str = "prob", by: list[str] = ()) -> DataFrame:
    """Per key: areas, precision at the top decile, baseline, lift, Brier score, confusion at 0.5 (M6)."""
    x, keys = _keyed(scored, list(by), label, prob)
    pos = lambda n: (n - 1) * F.lit(0.9)
    size = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    q = order_statistics(x, keys, "p", {"lo": lambda n: F.floor(pos(n)), "hi": lambda n: F.ceil(pos(n))}, refine=2).join(size, keys)
    part = pos(F.col("_size")) - F.floor(pos(F.col("_size")))
    cut = q.select(*keys, F.when(F.col("_size") > 10, F.col("lo") + (F.col("hi") - F.col("lo")) * part).otherwise(0.5).alias("cut"))
    x = x.join(F.broadcast(cut), keys)  # one row per model
    hit, top, y = F.col("p") >= 0.5, F.col("p") >= F.col("cut"), F.col("y") == 1
    flag = lambda c: F.count(F.when(c, 1))
    m = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), nz(F.avg(F.when(top, F.col("y")))).alias("precision_top10"), F.avg("y").alias("baseline_rate"),
        F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"),
        flag(~y & ~hit).alias("tn"), flag(~y & hit).alias("fp"), flag(y & ~hit).alias("fn"), flag(y & hit).alias("tp"),
    )
    return m.join(curve_areas(x, "y", "p", keys), keys).select(
        *by, "n", "auc_roc", "auc_pr", "precision_top10", "baseline_rate",
        F.when(F.col("baseline_rate") > 0, F.col("precision_top10") / F.col("baseline_rate")).otherwise(0.0).alias("lift"), "brier", "tn", "fp", "fn", "tp",
    )


def regression_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] = ()) -> DataFrame:
    """Per key: mean and median absolute error and R2 (M7)."""
    x, keys = _keyed(scored, list(by), label, prediction)
    x = x.withColumn("e", F.abs(F.col("y") - F.col("p")))
    med = order_statistics(x, keys, "e", {"lo": MEDIAN_LOW, "hi": MEDIAN_HIGH}, refine=2).select(*keys, ((F.col("lo") + F.col("hi")) / 2).alias("median_ae"))
    s = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("e").alias("mae"), F.sum(F.col("e") * F.col("e")).alias("_res"), (F.var_pop("y") * F.count(F.lit(1))).alias("_tot")
    )
    return s.join(med, keys).select(
        *by, "n", "mae", "median_ae", F.when((F.col("n") > 1) & (F.col("_tot") > 0), 1 - F.col("_res") / F.col("_tot")).otherwise(0.0).alias("r2")
    )
