"""Lookups and as-of joins between trades, wallets, tokens, predictions and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from launchlens.functions import asof_join, nz
from launchlens.operators.wallets import unflagged


def tag_wallets(trades: DataFrame, wallets: DataFrame) -> DataFrame:
    """Wallet labels per trade, 0 and '' where the wallet is unknown."""
    w = wallets.select(F.col("address").alias("wallet"), "tracked", "is_kol", "bundle_cluster_id")
    return trades.join(w, "wallet", "left").fillna({"tracked": 0, "is_kol": 0, "bundle_cluster_id": ""})


def join_wallet_skill(trades: DataFrame, wallet_stats: DataFrame) -> DataFrame:
    """Skill of each distinct (token, wallet, side), flagged wallets dropped."""
    sides = trades.select("mint_address", "wallet", "is_buy").distinct()
    return sides.join(unflagged(wallet_stats).select("wallet", "skill_score", "median_hold_sec"), "wallet")


def trade_returns(trades: DataFrame, chunk_ms: int = 60_000) -> DataFrame:
    """Relative price change to the token's previous trade, where both prices are positive."""
    t = trades.select("trade_id", "mint_address", "ts_ms", "price_sol")
    return _previous(t, chunk_ms).filter((F.col("price_sol") > 0) & (F.col("prev") > 0)).select(
        "trade_id", "mint_address", ((F.col("price_sol") - F.col("prev")) / F.col("prev")).alias("ret")
    )


def _previous(t: DataFrame, chunk_ms: int) -> DataFrame:
    rows = t.withColumn("_chunk", F.floor(F.col("ts_ms") / chunk_ms).cast("long"))
    order = F.struct("ts_ms", "trade_id")
    tails = rows.groupBy("mint_address", "_chunk").agg(F.max_by("price_sol", order).alias("_p"))
    along = W.partitionBy("mint_address").orderBy("_chunk")
    carry = tails.select("mint_address", "_chunk", F.lag("_p").over(along).alias("_carry"))
    inside = W.partitionBy("mint_address", "_chunk").orderBy("ts_ms", "trade_id")
    first = F.row_number().over(inside) == 1
    return (
        rows.join(carry, ["mint_address", "_chunk"])
        .withColumn("prev", F.when(first, F.col("_carry")).otherwise(F.lag("price_sol").over(inside)))
    )


POSTMORTEM_TARGETS = [
    "will_rug", "will_die_fast", "hits_2x_within_1h", "peaked_100", "peaked_300", "buy_pressure_continues_60s", "peak_within_5min",
]
STACKED_TARGETS = [
    "will_migrate", "peak_pct_max", "will_rug", "hits_2x_within_1h", "buy_pressure_continues_60s", "peaked_100", "peaked_300",
    "local_top_60s", "drawdown_20pct_300s",
]


def positions_with_mint(positions: DataFrame, mints: DataFrame, status: str, limit: int | None = None) -> DataFrame:
    """Positions with the current token state; open ones by entry, closed ones by exit, newest first."""
    m = mints.select(
        "mint_address", "name", "symbol", "migrated", "current_market_cap_sol", F.col("last_price_sol").alias("now_price"),
        F.col("peak_market_cap_sol"),
    )
    by = "entered_ms" if status == "open" else "exited_ms"
    out = positions.filter(F.col("status") == status).join(m, "mint_address", "left").orderBy(F.col(by).desc(), "id")
    return out.limit(limit) if limit else out


def predictions_as_of(
    rows: DataFrame, row_id: str, at: str, predictions: DataFrame, targets: list[str], prefix: str = "pred_", chunk_ms: int = 3_600_000,
) -> DataFrame:
    """Per row the newest prediction of each target for its token at or before `at`, one column per target."""
    wanted = rows.select(row_id, "mint_address", at, F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"))
    p = predictions.filter(F.col("prob").isNotNull() & F.col("target").isin(targets)).select(
        "mint_address", "target", F.col("ts_ms").alias("_pts"), F.col("prediction_id").alias("_pid"), "prob"
    )
    hit = asof_join(wanted, p, ["mint_address", "target"], at, "_pts", ["prob"], tie="_pid", chunk_ms=chunk_ms)
    return hit.groupBy(row_id).agg(*[F.max(F.when(F.col("target") == t, F.col("prob"))).alias(prefix + t) for t in targets])


def latest_prediction(predictions: DataFrame, as_of_ms: int, fresh_ms: int = 60_000) -> DataFrame:
    """Newest non-null probability per (token, target) inside the freshness window."""
    live = predictions.filter(
        F.col("prob").isNotNull() & (F.col("ts_ms") > as_of_ms - fresh_ms) & (F.col("ts_ms") <= as_of_ms)
    )
    return live.groupBy("mint_address", "target").agg(F.max_by("prob", F.struct("ts_ms", "prediction_id")).alias("prob"))


def prediction_row(latest: DataFrame, targets: list[str]) -> DataFrame:
    """One row per token with a column per target."""
    return latest.groupBy("mint_address").agg(*[F.max(F.when(F.col("target") == t, F.col("prob"))).alias(t) for t in targets])


def with_fresh_prediction(mints: DataFrame, predictions: DataFrame, as_of_ms: int, fresh_ms: int = 60_000) -> DataFrame:
    live = predictions.filter((F.col("ts_ms") > as_of_ms - fresh_ms) & (F.col("ts_ms") <= as_of_ms))
    return mints.join(live.select("mint_address"), "mint_address", "left_semi")


def forward_fill_anchor(snapshots: DataFrame, cols: list[str], age: str = "snapshot_age_min") -> DataFrame:
    """Columns of the token's age-0 row on every row of the token, own value where the anchor has none."""
    anchor = snapshots.filter(F.col(age) == 0).groupBy("mint_address").agg(*[F.first(c).alias(f"_a_{c}") for c in cols])
    filled = snapshots.join(anchor, "mint_address", "left")
    return filled.select(*[F.coalesce(f"_a_{c}", c).alias(c) if c in cols else F.col(c) for c in snapshots.columns])


def targets_for_backfill(mints: DataFrame, positions: DataFrame, as_of_ms: int, recent_ms: int = 3_600_000) -> DataFrame:
    """Tokens held open or created recently."""
    held = positions.filter("status = 'open'").select("mint_address").distinct().withColumn("held", F.lit(1))
    return mints.join(held, "mint_address", "left").filter(
        F.col("held").isNotNull() | (F.col("created_ms") > as_of_ms - recent_ms)
    ).drop("held")


def incomplete_post_exit(
    positions: DataFrame, checks: DataFrame, as_of_ms: int, first_mark_min: int = 5, n_marks: int = 7, limit: int = 120
) -> DataFrame:
    """Closed positions whose first mark is due and that have fewer than all marks recorded."""
    done = checks.groupBy("position_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("position_id", "id")
    return (
        positions.filter(
            (F.col("status") == "closed") & (F.col("exit_price") > 0) & (F.col("exited_ms") + first_mark_min * 60_000 <= as_of_ms)
        )
        .join(done, "id", "left").filter(nz("n", 0) < n_marks).select("id", "mint_address", "exit_price", "exited_ms")
        .orderBy(F.col("exited_ms").desc(), "id").limit(limit)
    )


def latest_snapshot(snapshots: DataFrame, order: str = "snapshot_ts", newest: bool = True) -> DataFrame:
    """One row per token: the newest (or, with newest=False, the youngest) snapshot."""
    pick = F.max_by if newest else F.min_by
    cols = snapshots.columns
    return snapshots.groupBy("mint_address").agg(pick(F.struct(*cols), F.col(order)).alias("s")).select("s.*")


def price_drift(
    positions: DataFrame, mints: DataFrame, reference_prices: DataFrame, as_of_ms: int, threshold_pct: float = 10.0,
    stale_ms: int = 180_000,
) -> DataFrame:
    """Stored against reference price of open positions.

    Tokens that migrated are only checked for silence. Others get a correction when the stored price
    is off by more than the threshold.
    """
    held = positions.filter("status = 'open'").select("id", "mint_address")
    x = held.join(
        mints.filter(F.col("bonding_curve_key").isNotNull()).select("mint_address", "migrated", "last_trade_ms", "last_price_sol"),
        "mint_address",
    ).join(reference_prices.select("mint_address", "ref_price"), "mint_address", "left")
    pct = F.abs(F.col("ref_price") - F.col("last_price_sol")) / F.col("ref_price") * 100
    usable = (F.col("migrated") == 0) & (nz("last_price_sol") > 0) & (nz("ref_price") > 0)
    stale = (F.col("migrated") == 1) & (as_of_ms - nz("last_trade_ms", 0) > stale_ms)
    drift = F.when(usable, pct)
    return x.select(
        "id", "mint_address", drift.alias("drift_pct"), stale.cast("int").alias("is_stale"),
        nz((drift > threshold_pct).cast("int"), 0).alias("is_drift"),
        F.when(drift > threshold_pct, F.col("ref_price")).alias("corrected_price"),
    )


def post_exit_trades(closes: DataFrame, trades: DataFrame, horizon_ms: int = 480 * 60_000, slot_ms: int = 60_000) -> DataFrame:
    """Priced trades in (exit, exit + horizon] per close.

    The result is the listing itself and as long as it needs to be; W7 computes the path without it.
    Both sides meet on (token, time slot): a close covers a fixed number of slots.
    """
    c = closes.select(
        F.col("id").alias("position_id"), "mint_address", "exited_ms",
        F.explode(
            F.sequence(F.floor(F.col("exited_ms") / slot_ms), F.floor((F.col("exited_ms") + horizon_ms) / slot_ms))
        ).alias("_slot"),
    )
    t = trades.filter("price_sol > 0").select("trade_id", "mint_address", "ts_ms", "price_sol", F.floor(F.col("ts_ms") / slot_ms).alias("_slot"))
    return (
        c.join(t, ["mint_address", "_slot"])
        .filter((F.col("ts_ms") > F.col("exited_ms")) & (F.col("ts_ms") <= F.col("exited_ms") + horizon_ms))
        .select("position_id", "mint_address", "trade_id", "ts_ms", "price_sol")
    )
