"""Candidate selection and preparation filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from launchlens.functions import nz, top_rows
from launchlens.operators.features import SNAPSHOT_AGES

MINUTE_MS = 60_000


def snapshot_candidates(
    mints: DataFrame, as_of_ms: int, ages: list[int] = SNAPSHOT_AGES, grace_sec: int = 90, min_trades: int = 20
) -> DataFrame:
    """Tokens young enough that an age can still be captured (F1)."""
    lo, hi = as_of_ms - (max(ages) + grace_sec) * 1000, as_of_ms - min(ages) * 1000
    return mints.filter(
        (F.col("created_ms") > lo) & (F.col("created_ms") < hi) & (F.col("rugged") == 0) & F.col("name").isNotNull()
        & (F.col("trade_count") >= min_trades)
    )


def due_snapshots(
    candidates: DataFrame, existing: DataFrame, as_of_ms: int, ages: list[int] = SNAPSHOT_AGES, grace_sec: int = 90
) -> DataFrame:
    """(token, age) pairs whose age was crossed within the grace period and is not captured yet (F2)."""
    now = (F.lit(as_of_ms) - F.col("created_ms")) / 1000
    due = candidates.select(
        "mint_address",
        F.explode(F.filter(F.array(*[F.lit(a) for a in ages]), lambda a: (now >= a) & (now <= a + grace_sec))).alias("snapshot_age_sec"),
    )
    return due.join(existing.select("mint_address", "snapshot_age_sec"), ["mint_address", "snapshot_age_sec"], "left_anti")


def entry_candidates(
    mints: DataFrame, positions: DataFrame, snapshots: DataFrame, as_of_ms: int, cooldown_ms: int = 10 * MINUTE_MS,
    limit: int = 16, age_ms: tuple[int, int] = (3 * MINUTE_MS, 30 * MINUTE_MS), max_price: float = 1e-5, min_mcap: float = 15.0,
) -> DataFrame:
    """Newest tokens that may be entered: alive, priced, with a snapshot, not held and not just closed."""
    held = positions.filter("status = 'open'")
    recent = positions.filter((F.col("status") == "closed") & (F.col("exited_ms") > as_of_ms - cooldown_ms))
    blocked = held.select("mint_address").union(recent.select("mint_address")).distinct()
    ok = mints.filter(
        (F.col("created_ms") > as_of_ms - age_ms[1]) & (F.col("created_ms") < as_of_ms - age_ms[0]) & (F.col("rugged") == 0)
        & (F.col("migrated") == 0) & (F.col("last_price_sol") > 0) & (F.col("last_price_sol") < max_price)
        & (F.col("current_market_cap_sol") >= min_mcap) & F.col("name").isNotNull()
    )
    return (
        ok.join(blocked, "mint_address", "left_anti").join(snapshots.select("mint_address"), "mint_address", "left_semi")
        .orderBy(F.col("created_ms").desc(), "mint_address").limit(limit)
    )


def needs_scoring(
    snapshots: DataFrame, mints: DataFrame, predictions: DataFrame, as_of_ms: int, fresh_ms: int = 5 * MINUTE_MS,
    max_age_ms: int = 30 * MINUTE_MS, min_trades: int = 20, limit: int = 24,
) -> DataFrame:
    """Tokens with a snapshot but no fresh prediction, newest snapshot first."""
    m = mints.filter((F.col("created_ms") > as_of_ms - max_age_ms) & (F.col("rugged") == 0) & (F.col("trade_count") >= min_trades))
    fresh = predictions.filter((F.col("ts_ms") > as_of_ms - fresh_ms) & (F.col("ts_ms") <= as_of_ms)).select("mint_address").distinct()
    return (
        snapshots.groupBy("mint_address").agg(F.max("snapshot_ts").alias("snapshot_ts"))
        .join(m.select("mint_address"), "mint_address", "left_semi").join(fresh, "mint_address", "left_anti")
        .orderBy(F.col("snapshot_ts").desc(), "mint_address").limit(limit)
    )


def recent_mints(mints: DataFrame, as_of_ms: int, window_ms: int, limit: int) -> DataFrame:
    return mints.filter(F.col("created_ms") > as_of_ms - window_ms).orderBy(F.col("created_ms").desc(), "mint_address").limit(limit)


def clean_target(df: DataFrame, target: str, regression: bool) -> DataFrame:
    """Rows with a usable target: not NULL, and finite for regression."""
    c = F.col(target)
    ok = c.isNotNull() & ~F.isnan(c.cast("double"))
    return df.filter(ok & (F.abs(c) != float("inf"))) if regression else df.filter(ok)


def cap_outliers(df: DataFrame, col: str, cap: float = 1000.0) -> DataFrame:
    """Upper winsorising; the flag column says which rows were capped (F8)."""
    return df.withColumn("was_capped", nz((F.col(col) > cap).cast("int"), 0)).withColumn(
        col, F.when(F.col(col).isNotNull(), F.least(F.col(col), F.lit(cap)))
    )


def impute_missing(df: DataFrame, cols: list[str], value: float = -1.0) -> DataFrame:
    return df.fillna(value, cols)


def to_usd(df: DataFrame, rate: float | Column, cols: list[str]) -> DataFrame:
    """Adds *_usd columns from SOL columns."""
    rate = F.lit(rate) if isinstance(rate, (int, float)) else rate
    return df.select("*", *[(F.col(c) * rate).alias(f"{c.removesuffix('_sol')}_usd") for c in cols])


def best_in_tick(df: DataFrame, tick: str, score: str, k: int) -> DataFrame:
    """k best rows per tick."""
    return top_rows(df, [tick], [F.col(score).desc(), F.col("mint_address")], k)


