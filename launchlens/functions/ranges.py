"""Aggregates over arbitrary time ranges per key, without joining a range to every row inside it.

Points are rolled up into blocks of 1, b, b^2, ... time units. A range is cut into fewer than 2b blocks
per level, and ranges meet blocks by an equi-join on (key, level, block). A key with a
large share of the points is spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F



def _blocks(lo: Column, hi: Column, levels: int, base: int) -> Column:
    """Array of struct(level, block) that exactly covers the integer range [lo, hi].

    At each level the blocks that lie inside the range but whose parent does not; every level is
    computed from the range itself, so the expression stays small.
    """
    kind = "array<struct<level:int,block:bigint>>"
    empty = F.array().cast(kind)

    def inside(level: int) -> tuple[Column, Column]:
        if level == 0:
            return lo, hi
        size = F.lit(base**level)
        return F.ceil(lo / size).cast("long"), (F.floor((hi + 1) / size) - 1).cast("long")

    def run(level: int, a: Column, b: Column) -> Column:
        seq = F.transform(F.sequence(a, b), lambda x: F.struct(F.lit(level).cast("int").alias("level"), x.alias("block")))
        return F.when(a <= b, seq.cast(kind)).otherwise(empty)

    parts = []
    for level in range(levels):
        a, b = inside(level)
        if level == levels - 1:
            parts.append(run(level, a, b))
            break
        pa, pb = inside(level + 1)
        has_parent = pa <= pb
        parts.append(run(level, a, F.when(has_parent, F.least(b, pa * base - 1)).otherwise(b)))
        parts.append(F.when(has_parent, run(level, F.greatest(a, (pb + 1) * base), b)).otherwise(empty))
    return F.concat(*parts)


def range_aggregate(
    ranges: DataFrame,
    points: DataFrame,
    keys: list[str],
    range_id: list[str],
    start: str,
    end: str,
    ts: str,
    aggs: dict[str, tuple[Column, str]],
    max_span_ms: int,
    unit_ms: int = 1,
    base: int = 8,
) -> DataFrame:
    """For every range: aggregates of the points with start < ts <= end.

    `aggs` maps an output name to (expression over points, kind); kind is one of max, min, sum and
    last (newest value; the expression is then struct(ts, tie, value) and the result is that
    struct). Ranges without points are kept with NULLs. `unit_ms` may be raised to 1000 when all
    point times are whole seconds; range limits need not be. A smaller `base` cuts ranges into fewer blocks
    and copies points to more levels: choose it small when ranges outnumber the distinct point times.
    """
    merge = {"max": F.max, "min": F.min, "sum": F.sum, "last": F.max}
    levels = 1
    while base ** levels < max(1, max_span_ms // unit_ms) and levels < 24:
        levels += 1
    rows = points.select(
        *keys, F.floor(F.col(ts) / F.lit(unit_ms)).cast("long").alias("_u"), *[e.alias(n) for n, (e, _) in aggs.items()]
    )
    lo = (F.floor(F.col(start) / F.lit(unit_ms)) + 1).cast("long")
    hi = F.floor(F.col(end) / F.lit(unit_ms)).cast("long")
    # points outside the largest blocks that any range of their key touches are never copied to the levels
    largest = F.lit(base ** (levels - 1))
    whole = lambda u: F.floor(u / largest).cast("long")
    touched = ranges.select(*dict.fromkeys(keys), F.explode(F.sequence(whole(lo), F.greatest(whole(lo), whole(hi)))).alias("_top")).distinct()
    rows = rows.withColumn("_top", whole(F.col("_u"))).join(touched, [*keys, "_top"], "left_semi").drop("_top")
    first = rows.groupBy(*keys, "_u").agg(*[merge[k](n).alias(n) for n, (_, k) in aggs.items()])
    tree = (
        first.withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(levels)])))
        .withColumn("block", F.floor(F.col("_u") / F.pow(F.lit(float(base)), F.col("level"))).cast("long"))
        .groupBy(*keys, "level", "block")
        .agg(*[merge[k](n).alias(n) for n, (_, k) in aggs.items()])
    )
    cut = (
        ranges.select(*dict.fromkeys([*keys, *range_id]), lo.alias("_lo"), hi.alias("_hi"))
        .withColumn("_blk", F.explode(_blocks(F.col("_lo"), F.col("_hi"), levels, base)))
        .select(*dict.fromkeys([*keys, *range_id]), F.col("_blk.level").alias("level"), F.col("_blk.block").alias("block"))
    )
    got = cut.join(tree, [*keys, "level", "block"]).groupBy(*range_id).agg(
        *[merge[k](n).alias(n) for n, (_, k) in aggs.items()]
    )
    return ranges.join(got, range_id, "left")
