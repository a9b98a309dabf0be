"""Ordered operations per key that stay splittable when one key holds a large share of the rows.

Every window here is partitioned by (key, time chunk). What a chunk needs from earlier chunks is
carried by one summary row per chunk, so no task ever sees more than one chunk of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

HOUR_MS = 3_600_000


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    take: list[str],
    tie: str | None = None,
    chunk_ms: int = HOUR_MS,
    strict: bool = False,
) -> DataFrame:
    """Left rows with the columns `take` of the newest right row at or before `left_ts`.

    Ties on the right go to the largest `tie`. With `strict` a right row at exactly `left_ts` does
    not count. Left rows without a match get NULLs. The right side is reduced to one carry row per
    (key, chunk), so rows of both sides meet only inside one chunk and no pairs are formed.
    """
    lcols = left.columns
    val = F.struct(
        F.col(right_ts).cast("long").alias("_t"),
        (F.col(tie).cast("long") if tie else F.lit(0).cast("long")).alias("_tie"),
        *[F.col(c).alias(f"_v_{c}") for c in take],
    )
    order = F.struct(F.col(right_ts).cast("long"), F.col(tie).cast("long") if tie else F.lit(0).cast("long"))
    chunk_l = F.floor(F.col(left_ts) / F.lit(chunk_ms)).cast("long")
    chunk_r = F.floor(F.col(right_ts) / F.lit(chunk_ms)).cast("long")
    # side: 0 = carry from earlier chunks, then right rows, then left rows (the other way round if strict)
    right_side, left_side = (2, 1) if strict else (1, 2)
    r = right.filter(F.col(right_ts).isNotNull()).select(
        *keys, chunk_r.alias("_chunk"), F.col(right_ts).cast("long").alias("_ts"), F.lit(right_side).alias("_side"),
        val.alias("_r"),
    )
    l_rows = left.select(
        *keys, chunk_l.alias("_chunk"), F.col(left_ts).cast("long").alias("_ts"), F.lit(left_side).alias("_side"),
        F.struct(*[F.col(c) for c in lcols]).alias("_l"),
    )
    tails = right.filter(F.col(right_ts).isNotNull()).groupBy(*keys, chunk_r.alias("_chunk")).agg(
        F.max_by(val, order).alias("_r")
    )
    heads = left.groupBy(*keys, chunk_l.alias("_chunk")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        tails.unionByName(heads.drop("_n"), allowMissingColumns=True)
        .groupBy(*keys, "_chunk")
        .agg(F.max("_r").alias("_own"))
        .withColumn("_r", F.last("_own", ignorenulls=True).over(before))
        .filter(F.col("_r").isNotNull())
        .select(*keys, "_chunk", F.lit(None).cast("long").alias("_ts"), F.lit(0).alias("_side"), "_r")
    )
    w = (
        W.partitionBy(*keys, "_chunk")
        .orderBy(F.col("_ts").asc_nulls_first(), "_side", F.col("_r._tie"))
        .rowsBetween(W.unboundedPreceding, 0)
    )
    joined = (
        l_rows.unionByName(r, allowMissingColumns=True)
        .unionByName(carry, allowMissingColumns=True)
        .withColumn("_hit", F.last("_r", ignorenulls=True).over(w))
        .filter(F.col("_side") == left_side)
    )
    return joined.select(*[F.col(f"_l.{c}").alias(c) for c in lcols], *[F.col(f"_hit._v_{c}").alias(c) for c in take])


def running_total(
    df: DataFrame, keys: list[str], ts: str, order: list[str], value: Column | str, out: str, chunk_ms: int = 24 * HOUR_MS
) -> DataFrame:
    """Running sum of `value` per key in the given order, the row itself included.

    `order` must start with the time column. Works without keys: rows are then split by time chunk only.
    """
    value = F.col(value) if isinstance(value, str) else value
    rows = df.withColumn("_chunk", F.floor(F.col(ts) / F.lit(chunk_ms)).cast("long")).withColumn("_val", value)
    sums = rows.groupBy(*keys, "_chunk").agg(F.sum("_val").alias("_s"))
    # one row per chunk: the only part that is ordered across chunks
    before = W.partitionBy(*keys, F.lit(0)).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = sums.select(*keys, "_chunk", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_carry"))
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.join(carry, [*keys, "_chunk"])
        .withColumn(out, F.col("_carry") + F.sum("_val").over(inside))
        .drop("_chunk", "_val", "_carry")
    )


def prefix_sums(df: DataFrame, keys: list[str], order: list[Column | str], sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """Running sums {column: output} per key in the given order, the row itself included; keys may be empty.

    Rows are cut into ranges of (keys, order) that hold about equally many rows each, whatever the values are; one total per
    range carries over. The ranges are written once, so that a lost task finds the same rows in them. Nulls count as 0."""
    from launchlens.sources.files import replace_table, work_dir

    spark = df.sparkSession
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"_o{i}" for i in range(len(order))]
    rows = df.select("*", *[c.alias(n) for n, c in zip(names, order, strict=True)])
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *[F.col(c) for c in (*keys, *names)]).withColumn("_part", F.spark_partition_id())
    rows = replace_table(rows, work_dir(spark, "prefix"))
    totals = rows.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = W.partitionBy(*keys, F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per key and range
    carry = totals.select(*keys, "_part", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_c_{c}") for c in sums])
    inside = W.partitionBy(*keys, "_part").orderBy(*names).rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(carry, [*keys, "_part"]).select("*", *[
        (F.col(f"_c_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(o) for c, o in sums.items()])
    return out.drop("_part", *names, *[f"_c_{c}" for c in sums])


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First k rows per key. Spark keeps only k rows per key and task before it shuffles."""
    name = rank or "_rn"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def totals_before(
    queries: DataFrame, facts: DataFrame, keys: list[str], at: str, ts: str, measures: list[str], chunk_ms: int = 24 * HOUR_MS
) -> DataFrame:
    """Query rows with, per measure, the sum over facts of the same key with ts strictly before `at`."""
    qcols = queries.columns
    zero = [F.lit(0).cast("long").alias(m) for m in measures]
    q = queries.select(*keys, F.col(at).cast("long").alias("_ts"), F.struct(*qcols).alias("_q"), *zero)
    f = facts.select(*keys, F.col(ts).cast("long").alias("_ts"), *[F.col(m).cast("long").alias(m) for m in measures])
    rows = q.unionByName(f, allowMissingColumns=True).withColumn("_chunk", F.floor(F.col("_ts") / chunk_ms).cast("long"))
    sums = rows.groupBy(*keys, "_chunk").agg(*[F.sum(m).alias(m) for m in measures])
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = sums.select(*keys, "_chunk", *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_c_{m}") for m in measures])
    inside = W.partitionBy(*keys, "_chunk").orderBy("_ts").rangeBetween(W.unboundedPreceding, -1)
    return (
        rows.select("*", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_i_{m}") for m in measures])
        .filter(F.col("_q").isNotNull())
        .join(carry, [*keys, "_chunk"])
        .select(*[F.col(f"_q.{c}").alias(c) for c in qcols], *[(F.col(f"_c_{m}") + F.col(f"_i_{m}")).alias(m) for m in measures])
    )
