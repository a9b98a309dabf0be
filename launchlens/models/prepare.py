"""Training sets: feature lists, exports, time splits, target transforms, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from launchlens.functions import nz, order_statistics
from launchlens.operators.filters import cap_outliers
from launchlens.operators.joins import STACKED_TARGETS, forward_fill_anchor

# Feature names by model family.
_PRE_FEATURES = [
    "snapshot_age_sec", "initial_buy_sol", "creator_launch_count", "creator_migrated_count", "has_twitter", "has_telegram", "has_website", "name_length",
    "symbol_length", "created_hour_utc", "created_dow", "last_price_sol", "last_mcap_sol", "peak_mcap_sol_so_far", "v_sol_in_curve", "sol_inflow",
    "sol_outflow", "buy_count", "sell_count", "buy_sell_ratio", "unique_buyers", "tracked_buyers", "kol_buyers", "bundle_buyers", "top10_buyers",
    "top50_buyers", "weighted_buyer_quality", "avg_buy_sol", "median_buy_sol", "p90_buy_sol", "max_buy_sol", "std_buy_sol", "avg_sell_sol",
    "median_sell_sol", "p90_sell_sol", "max_sell_sol", "std_sell_sol", "top1_buyer_sol_pct", "top3_buyer_sol_pct", "top5_buyer_sol_pct", "buyer_hhi",
    "top1_seller_sol_pct", "top3_seller_sol_pct", "top5_seller_sol_pct", "seller_hhi", "sniper_buyer_count", "pct_sniper_buys", "first_block_buyer_count",
    "pct_first_block_buys", "avg_buyer_rank", "median_buyer_rank", "pct_buyers_in_first_10", "tracked_first_seen_sec", "kol_first_seen_sec",
    "seconds_to_5_unique_buyers", "seconds_to_10_unique_buyers", "n_reversals_in_window", "longest_up_run_pct", "longest_down_run_pct", "max_30s_buy_sol",
    "max_30s_buy_count", "max_30s_buy_sell_ratio", "creator_buys_post_launch", "creator_sells_post_launch", "creator_sol_to_sidewallets",
    "creator_sidewallet_buyer_count", "inflow_accel_pct", "buy_count_accel_pct", "top10_buy_timing_std_sec", "max_30s_sell_sol", "max_30s_sell_count",
    "max_30s_unique_sellers", "creator_recent_launch_siblings", "trend_signal_match", "narrative_match_count", "pressure_60_buy_pct", "pressure_60_net",
    "telegram_member_count", "buyer_hhi_delta", "seller_hhi_delta", "bot_sniper_buyer_count", "fast_human_sniper_count",
    "seconds_since_prev_creator_death", "trade_count", "trades_per_min", "volatility_pct", "sandwich_risk", "reaction_speed_ms", "rpc_latency_p90_ms",
    "priority_fee_p90",
]
_LEAN_FEATURES = [
    "snapshot_age_sec", "initial_buy_sol", "creator_launch_count", "creator_migrated_count", "has_twitter", "has_telegram", "has_website", "name_length",
    "symbol_length", "created_hour_utc", "created_dow", "last_price_sol", "last_mcap_sol", "peak_mcap_sol_so_far", "v_sol_in_curve", "sol_inflow",
    "sol_outflow", "buy_count", "sell_count", "buy_sell_ratio", "unique_buyers", "top10_buyers", "top50_buyers", "avg_buy_sol", "median_buy_sol",
    "p90_buy_sol", "max_buy_sol", "std_buy_sol", "avg_sell_sol", "median_sell_sol", "p90_sell_sol", "max_sell_sol", "std_sell_sol", "top1_buyer_sol_pct",
    "top3_buyer_sol_pct", "top5_buyer_sol_pct", "buyer_hhi", "top1_seller_sol_pct", "top3_seller_sol_pct", "top5_seller_sol_pct", "seller_hhi",
    "sniper_buyer_count", "pct_sniper_buys", "first_block_buyer_count", "pct_first_block_buys", "avg_buyer_rank", "median_buyer_rank",
    "pct_buyers_in_first_10", "seconds_to_5_unique_buyers", "seconds_to_10_unique_buyers", "n_reversals_in_window", "longest_up_run_pct",
    "longest_down_run_pct", "max_30s_buy_sol", "max_30s_buy_count", "max_30s_buy_sell_ratio", "creator_buys_post_launch", "creator_sells_post_launch",
    "inflow_accel_pct", "buy_count_accel_pct", "top10_buy_timing_std_sec", "max_30s_sell_sol", "max_30s_sell_count", "max_30s_unique_sellers",
    "creator_recent_launch_siblings", "pressure_60_buy_pct", "pressure_60_net", "seconds_since_prev_creator_death", "trade_count", "trades_per_min",
    "volatility_pct", "migrated", "top_buyer_skill_p90", "smart_buyer_count", "whale_buyer_count", "avg_buyer_hold_sec", "top_seller_skill_p90",
    "smart_seller_count",
]
_POST_FEATURES = [
    "snapshot_age_min", "current_mcap_sol", "current_price_sol", "liquidity_usd", "amm_volume_h1_usd", "amm_volume_h24_usd", "amm_buys_h24",
    "amm_sells_h24", "amm_price_change_h1", "amm_price_change_h24", "window_buys", "window_sells", "window_unique_buyers", "window_tracked_buyers",
    "window_kol_buyers", "pct_from_migration", "peak_pct_so_far", "pre_mig_age_min", "pre_mig_peak_mcap_sol", "pre_mig_unique_buyers",
    "pre_mig_trade_count", "pre_mig_buy_count", "pre_mig_sell_count", "pre_mig_buy_sell_ratio", "pre_mig_tracked_buyers", "pre_mig_kol_buyers",
    "pre_mig_bundle_buyers", "pre_mig_volatility_pct", "pre_mig_sandwich_risk", "pre_mig_creator_launches", "pre_mig_creator_migrations", "has_twitter",
    "has_telegram", "has_website", "name_length", "symbol_length", "migration_hour_utc", "migration_dow", "amm_initial_liquidity_usd",
    *[f"pre_pred_{t}" for t in STACKED_TARGETS],
]
# What stays as it was at migration, besides the pre_mig_ columns.
STATIC_AFTER_MIGRATION = [
    "has_twitter", "has_telegram", "has_website", "name_length", "symbol_length", "migration_hour_utc", "migration_dow", "amm_initial_liquidity_usd",
]
FEATURES = {"pre": _PRE_FEATURES, "lean": _LEAN_FEATURES, "post": _POST_FEATURES}
SIGNED_LOG_TARGETS = {"hold_1h_pct", "hold_4h_pct", "hold_24h_pct", "pnl_pct_60s", "pnl_pct_300s", "post_mig_ev_with_ladder_sol"}
#: Falls given as negative numbers.
NEGATIVE_TARGETS = {"max_drawdown_within_24h_pct"}
POISSON_TARGETS = {"unique_buyers_next_60s", "unique_sellers_next_60s"}
REGRESSION_TARGETS = SIGNED_LOG_TARGETS | POISSON_TARGETS | {
    "drawdown_from_peak_pct", "peak_pct_within_24h", "max_drawdown_within_24h_pct", "pump_durability_5min", "peak_pct_max", "time_to_peak_sec",
    "time_to_peak_5x_sec", "post_mig_peak_pct", "post_mig_peak_pct_4h", "post_mig_peak_pct_24h", "post_mig_time_to_peak_min",
}
ACTIVE_TARGETS = {
    "post_mig_hits_2x": 50, "post_mig_peak_pct": 100, "post_mig_rugs_1h": 50, "post_mig_hits_130pct_4h": 50, "post_mig_hits_186pct_4h": 50,
    "post_mig_hits_50pct_30m": 50, "post_mig_hits_100pct_1h": 50, "post_mig_hits_30x_24h": 30, "post_mig_drawdown_50_5min": 50,
    "post_mig_drawdown_30_5min": 50, "post_mig_alive_4h": 30, "post_mig_peak_pct_4h": 100, "post_mig_peak_pct_24h": 100,
    "post_mig_ev_with_ladder_sol": 100,
}
NEVER_FORCE = {"hits_5x_within_24h"}


def select_features(df: DataFrame, mode: str, keep: list[str] = ()) -> DataFrame:
    """Columns of a feature family that are present, after the key columns `keep`."""
    return df.select(*keep, *[c for c in FEATURES[mode] if c in df.columns and c not in keep])


def export_training_set(
    labelled: DataFrame, resolved_only: bool = True, ages: list[int] | None = None, target: str | None = None,
    include_zero_price: bool = False,
) -> DataFrame:
    """Labelled snapshots fit for training, oldest first."""
    out = labelled
    if resolved_only:
        out = out.filter(F.col("labels_resolved_at").isNotNull())
    if not include_zero_price:
        out = out.filter(F.col("last_price_sol") > 1e-9)
    if ages:
        out = out.filter(F.col("snapshot_age_sec").isin(ages))
    if target:
        out = out.filter(F.col(target).isNotNull())
    return out.orderBy("snapshot_ts", "mint_address", "snapshot_age_sec")


def anchor_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c.startswith("pre_mig_") or c in STATIC_AFTER_MIGRATION]


def export_postmig_training_set(
    snapshots: DataFrame, labels: DataFrame, ages_min: list[int] | None = None, target: str | None = None, resolved_col: str | None = None,
    cap: float = 1000.0,
) -> DataFrame:
    """Migration snapshots with the anchor's context on every age, labels, filters and a cap on the peak."""
    x = forward_fill_anchor(snapshots, anchor_columns(snapshots.columns)).join(labels.drop("migrated_ms"), "mint_address", "left")
    if resolved_col:
        x = x.filter(F.col(resolved_col).isNotNull())
    if ages_min:
        x = x.filter(F.col("snapshot_age_min").isin(ages_min))
    x = cap_outliers(x, "post_mig_peak_pct", cap).drop("was_capped")
    if target:
        x = x.filter(F.col(target).isNotNull())
    return x.orderBy("snapshot_ts", "mint_address", "snapshot_age_min")


def dataset_summary(df: DataFrame, labels: list[str], features: list[str], age: str = "snapshot_age_sec") -> DataFrame:
    """Long table of (section, name, statistic, value) over a training set."""
    whole = df.agg(
        F.count(F.lit(1)).cast("double").alias("rows"), F.count_distinct("mint_address").cast("double").alias("tokens"),
        F.min("snapshot_ts").cast("double").alias("first_ts"), F.max("snapshot_ts").cast("double").alias("last_ts"),
    ).unpivot([], ["rows", "tokens", "first_ts", "last_ts"], "stat", "value").select(F.lit("all").alias("section"), F.lit("").alias("name"), "stat", "value")
    per_age = df.groupBy(age).agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("age").alias("section"), F.col(age).cast("string").alias("name"), F.lit("rows").alias("stat"), "value"
    )

    def long(cols: list[str], section: str, stats: dict) -> DataFrame:
        tall = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "name", "v").filter(F.col("v").isNotNull())
        g = tall.groupBy("name").agg(*[fn("v").cast("double").alias(s) for s, fn in stats.items()])
        return g.unpivot(["name"], list(stats), "stat", "value").select(F.lit(section).alias("section"), "name", "stat", "value")

    return whole.unionByName(per_age).unionByName(long(labels, "label", {"mean": F.avg, "sum": F.sum, "n": F.count, "max": F.max})).unionByName(
        long(features, "feature", {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max})
    )


def take_by_time(df: DataFrame, n: int, oldest: bool = False, ts: str = "snapshot_ts", tie: str = "row_key") -> DataFrame:
    """The newest, or the oldest, n rows in order of time."""
    order = [F.col(ts), F.col(tie)] if oldest else [F.col(ts).desc(), F.col(tie).desc()]
    return df.orderBy(*order).limit(n)


def time_split(
    df: DataFrame, frac: float = 0.8, gap_ms: int = 24 * 3_600_000, ts: str = "snapshot_ts", tie: str = "row_key", least_val: int = 50
) -> DataFrame:
    """Adds split = train or val: the oldest share trains, validation starts after a gap (M1, M2).

    Exact by row count. The cut is found by rank selection on the time and, inside the one time value
    at the cut, on the numeric `tie`; rows are never sorted globally. With fewer than `least_val`
    validation rows after the gap, no gap is left.
    """
    one = df.select(F.lit(1).alias("_k"), ts, F.col(tie).cast("double").alias("_tie"))
    # the wanted rank is the first validation row
    head = order_statistics(one, ["_k"], ts, {"at": lambda n: F.floor(n * F.lit(frac))}, refine=2).first()
    if head is None:
        return df.withColumn("split", F.lit(None).cast("string"))
    at = head["at"]
    counts = one.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(ts) < at, 1)).alias("below"), F.count(F.when(F.col(ts) == at, 1)).alias("same"),
        F.max(F.when(F.col(ts) < at, F.col(ts))).alias("last_below"),
    ).first()
    take = int(counts["n"] * frac) - counts["below"]
    last_train = at if take > 0 else counts["last_below"]
    is_train = F.col(ts) < at
    if 0 < take < counts["same"]:
        edge = order_statistics(one.filter(F.col(ts) == at), ["_k"], "_tie", {"at": lambda n: F.lit(take)}, refine=2).first()["at"]
        is_train = is_train | ((F.col(ts) == at) & (F.col(tie).cast("double") < edge))
    elif take >= counts["same"]:
        is_train = F.col(ts) <= at
    out = df.withColumn("split", F.when(is_train, "train").otherwise("val"))
    if gap_ms > 0 and last_train is not None:
        late = F.col(ts) >= F.lit(last_train) + gap_ms
        if out.filter((F.col("split") == "val") & late).limit(least_val).count() >= least_val:
            out = out.filter((F.col("split") == "train") | late)
    return out


def transform_target(col: Column, target: str) -> Column:
    """Training scale of a regression target: signed log, clipped count or unchanged (M3)."""
    if target in SIGNED_LOG_TARGETS:
        return F.signum(col) * F.log1p(F.abs(col))
    return F.greatest(col, F.lit(0.0)) if target in POISSON_TARGETS else col


def inverse_target(col: Column, target: str) -> Column:
    """Back to the original scale; targets that cannot be negative are clipped at 0."""
    if target in SIGNED_LOG_TARGETS:
        return F.signum(col) * F.expm1(F.abs(col))
    if target in NEGATIVE_TARGETS:
        return F.least(col, F.lit(0.0))
    return F.greatest(col, F.lit(0.0))


def train_gate(df: DataFrame, targets: dict[str, int], last_rows: int = 0, have_models: set[str] = frozenset(), force: bool = False) -> DataFrame:
    """Which targets to train: new rows or missing models, and enough positives or values."""
    cols = [t for t in targets if t in df.columns]
    n_of = lambda t: F.count(t) if t in REGRESSION_TARGETS else nz(F.sum(nz(F.col(t).cast("long"), 0)), 0)
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), *[n_of(t).cast("long").alias(t) for t in cols])
    missing = {t for t in targets if t not in have_models and t not in NEVER_FORCE}
    least = F.create_map(*[x for t in cols for x in (F.lit(t), F.lit(targets[t]))])
    return counts.unpivot(["n_rows"], cols, "target", "n_usable").withColumn(
        "stale", F.lit(force or bool(missing)) | (F.col("n_rows") > last_rows + 100)
    ).withColumn("train", F.col("stale") & (F.col("n_usable") >= least[F.col("target")]))
