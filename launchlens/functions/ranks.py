"""Exact order statistics per group without holding a group in one task.

A group is first counted in value buckets (map-side combined, a few hundred to a few thousand
buckets whatever the group size). The running count over the buckets shows which bucket holds the
wanted rank; only rows of that bucket are read again, counted by value and ranked. A bucket with a
single distinct value needs no second look.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_PER_OCTAVE = 64
_OCTAVES_BELOW_ONE = 80
REFINE_PARTS = 1024


def value_bucket(v: Column) -> Column:
    """Monotone bucket number of a double: 64 logarithmic buckets per octave, mirrored for negatives. Infinities come beyond
    all numbers, NaN last."""
    step = F.floor((F.log2(F.abs(v)) + F.lit(_OCTAVES_BELOW_ONE)) * F.lit(_PER_OCTAVE)) + F.lit(1)
    size = F.when(F.abs(v) > F.pow(F.lit(2.0), F.lit(-_OCTAVES_BELOW_ONE)), step).otherwise(F.lit(0))
    finite = (F.signum(v) * size).cast("long")
    beyond = F.lit(_PER_OCTAVE * 4096).cast("long")
    return F.when(F.isnan(v), beyond + 1).when(v == float("inf"), beyond).when(v == float("-inf"), -beyond).otherwise(finite)


def floor_quantile_rank(q: float) -> Callable[[Column], Column]:
    """0-based rank floor(q*n), kept inside the group."""
    return lambda n: F.greatest(F.lit(0), F.least(n - 1, F.floor(F.lit(q) * n))).cast("long")


MEDIAN_LOW: Callable[[Column], Column] = lambda n: F.floor((n - 1) / 2).cast("long")
MEDIAN_HIGH: Callable[[Column], Column] = lambda n: F.floor(n / 2).cast("long")


def median_from(low, high) -> Column:
    return (F.col(low) + F.col(high)) / 2.0


def order_statistics(
    df: DataFrame,
    keys: list[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    grow: tuple[str, str, list[int]] | None = None,
    refine: int = 0,
) -> DataFrame:
    """One row per key with the values at the requested 0-based ranks (NULL values are ignored).

    `grow=(bin, out, steps)` treats rows as cumulative over time: a row with bin index b counts for
    steps[b], steps[b+1], ...; `out` then becomes an extra key. Rows are not copied for this, only
    their bucket counts are. `refine` rounds cut the bucket that holds a rank into REFINE_PARTS equal parts each before
    its values are ranked: for values that crowd far from zero, as times do.
    """
    rows = df.filter(F.col(value).isNotNull()).select(
        *keys, *([grow[0]] if grow else []), F.col(value).cast("double").alias("_v")
    )
    rows = rows.withColumn("_b", value_bucket(F.col("_v")))
    bins = [grow[0]] if grow else []
    hist = rows.groupBy(*keys, *bins, "_b").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    out_keys = list(keys)
    if grow:
        bin_col, out, steps = grow
        out_keys = [*keys, out]
        hist = (
            hist.withColumn(out, F.explode(F.slice(F.array(*[F.lit(s) for s in steps]), F.col(bin_col) + 1, len(steps))))
            .groupBy(*keys, out, "_b")
            .agg(F.sum("_n").alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        )
    by_bucket = W.partitionBy(*out_keys).orderBy("_b")
    hist = hist.withColumn("_upto", F.sum("_n").over(by_bucket)).withColumn(
        "_total", F.sum("_n").over(W.partitionBy(*out_keys))
    )
    wanted = F.array(
        *[F.struct(F.lit(name).alias("name"), fn(F.col("_total")).cast("long").alias("rank")) for name, fn in ranks.items()]
    )
    cells = (
        hist.withColumn("_w", F.explode(wanted))
        .filter((F.col("_w.rank") < F.col("_upto")) & (F.col("_w.rank") >= F.col("_upto") - F.col("_n")))
        .select(
            *out_keys, "_b", "_lo", "_hi", F.col("_w.name").alias("_name"),
            (F.col("_w.rank") - (F.col("_upto") - F.col("_n"))).alias("_r"),
        )
    )
    settled = cells.filter(F.col("_lo") == F.col("_hi")).select(*out_keys, "_name", F.col("_lo").alias("_v"))
    open_cells = cells.filter(F.col("_lo") != F.col("_hi")).select(*out_keys, "_b", "_name", "_r", "_lo", "_hi")
    counted = rows.groupBy(*keys, *bins, "_b", "_v").agg(F.count(F.lit(1)).alias("_n"))

    def inside(wanted_cells: DataFrame) -> DataFrame:
        found = counted.join(wanted_cells, [*keys, "_b"]).filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        if grow:
            order = F.array_position(F.array(*[F.lit(s) for s in grow[2]]), F.col(grow[1])) - 1
            found = found.filter(F.col(grow[0]) <= order)
        return found

    for _ in range(refine):
        part = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * REFINE_PARTS).cast("long")
        by_part = W.partitionBy(*out_keys, "_name").orderBy("_part")
        narrowed = (
            inside(open_cells).withColumn("_part", part).groupBy(*out_keys, "_name", "_b", "_r", "_part")
            .agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
            .withColumn("_upto", F.sum("_n").over(by_part))
            .filter((F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_n")))
            .withColumn("_r", F.col("_r") - (F.col("_upto") - F.col("_n")))
        )
        settled = settled.unionByName(narrowed.filter("_lo = _hi").select(*out_keys, "_name", F.col("_lo").alias("_v")))
        open_cells = narrowed.filter("_lo <> _hi").select(*out_keys, "_b", "_name", "_r", "_lo", "_hi")
    hit = inside(open_cells)
    by_value = W.partitionBy(*out_keys, "_name").orderBy("_v")
    picked = (
        hit.groupBy(*out_keys, "_name", "_r", "_v")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(by_value))
        .filter((F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_n")))
        .select(*out_keys, "_name", "_v")
    )
    return (
        settled.unionByName(picked)
        .groupBy(*out_keys)
        .agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])
    )
