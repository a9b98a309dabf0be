"""Wallet behaviour: round trips per token, skill scores, activity and hit rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from launchlens.functions import nz, order_statistics, ratio, top_rows
from launchlens.functions.ranks import MEDIAN_HIGH, MEDIAN_LOW, median_from

DAY_MS = 86_400_000

# Fixed values of the scoring rule.
MIN_TOKENS = 5
SAMPLE_CAP = 200
HIGH_FREQ_PER_DAY = 100
FLIPPER_HOLD_SEC = 60
SMART_SKILL = 2.0
WHALE_SKILL = 5.0


def wallet_token_pnl(trades: DataFrame, as_of_ms: int, window_ms: int = 30 * DAY_MS, fresh_ms: int = 6 * 3_600_000) -> DataFrame:
    """Completed round trips per (wallet, token): both sides traded and last touched before as_of - fresh."""
    buy, sell = F.col("is_buy") == 1, F.col("is_buy") == 0
    return (
        trades.filter((F.col("is_junk") == 0) & (F.col("ts_ms") > as_of_ms - window_ms))
        .groupBy("wallet", "mint_address")
        .agg(
            F.sum(F.when(buy, F.col("sol_amount")).otherwise(0.0)).alias("sol_in"),
            F.sum(F.when(sell, F.col("sol_amount")).otherwise(0.0)).alias("sol_out"),
            F.min(F.when(buy, F.col("ts_ms"))).alias("first_buy_ms"),
            F.max(F.when(sell, F.col("ts_ms"))).alias("last_sell_ms"),
            F.max("ts_ms").alias("last_ms"),
        )
        .filter((F.col("sol_in") > 0) & (F.col("sol_out") > 0) & (F.col("last_ms") < as_of_ms - fresh_ms))
        .withColumn("pnl_pct", (F.col("sol_out") - F.col("sol_in")) / F.col("sol_in") * 100)
        .withColumn("hold_sec", (F.col("last_sell_ms") - F.col("first_buy_ms")) / 1000.0)
        .withColumn("profitable", (F.col("sol_out") > F.col("sol_in")).cast("int"))
    )


def wallet_skill(
    pairs: DataFrame, as_of_ms: int, window_days: int = 30, min_tokens: int = MIN_TOKENS, cap: int = SAMPLE_CAP,
    variant: str = "capped",
) -> DataFrame:
    """Skill table per wallet.

    capped: win rate * sqrt(min(n, cap)) with exact interpolated medians and the three behaviour
    flags. uncapped: win rate * sqrt(n) with the mean profit percentage and no flags.
    """
    agg = (
        pairs.groupBy("wallet")
        .agg(
            F.count(F.lit(1)).alias("mints_completed"),
            F.sum("profitable").alias("mints_profitable"),
            F.sum("sol_in").alias("total_sol_in"),
            F.sum("sol_out").alias("total_sol_out"),
            F.avg("pnl_pct").alias("avg_pnl_pct"),
            # keeps the pair aggregate identical in every branch, so its shuffle is reused
            F.max("hold_sec").alias("_max_hold"),
        )
        .filter(F.col("mints_completed") >= min_tokens)
        .withColumn("win_rate", F.col("mints_profitable") / F.col("mints_completed"))
        .withColumn("total_pnl_sol", F.col("total_sol_out") - F.col("total_sol_in"))
        .withColumn("window_days", F.lit(window_days))
        .withColumn("computed_ms", F.lit(as_of_ms).cast("long"))
        .drop("_max_hold")
    )
    if variant == "uncapped":
        return agg.withColumn("skill_score", F.col("win_rate") * F.sqrt("mints_completed"))
    long = pairs.select(
        "wallet",
        F.explode(
            F.array(
                F.struct(F.lit("pnl").alias("metric"), F.col("pnl_pct").alias("v")),
                F.struct(F.lit("hold").alias("metric"), F.col("hold_sec").alias("v")),
            )
        ).alias("m"),
    ).select("wallet", "m.metric", "m.v")
    med = (
        order_statistics(long, ["wallet", "metric"], "v", {"lo": MEDIAN_LOW, "hi": MEDIAN_HIGH})
        .withColumn("median", median_from("lo", "hi"))
        .groupBy("wallet")
        .agg(
            F.max(F.when(F.col("metric") == "pnl", F.col("median"))).alias("median_pnl_pct"),
            F.max(F.when(F.col("metric") == "hold", F.col("median"))).alias("median_hold_sec"),
        )
    )
    return (
        agg.drop("avg_pnl_pct")
        .join(med, "wallet")
        .withColumn("skill_score", F.col("win_rate") * F.sqrt(F.least(F.col("mints_completed"), F.lit(cap))))
        .withColumn("trades_per_day", F.col("mints_completed") / F.lit(float(window_days)))
        .withColumn("is_high_freq", (F.col("trades_per_day") > HIGH_FREQ_PER_DAY).cast("int"))
        .withColumn("is_flipper", (F.col("median_hold_sec") < FLIPPER_HOLD_SEC).cast("int"))
        .withColumn("is_unprofitable", (F.col("total_pnl_sol") <= 0).cast("int"))
    )


def unflagged(stats: DataFrame) -> DataFrame:
    return stats.filter("is_high_freq = 0 AND is_flipper = 0 AND is_unprofitable = 0")


def smart_money_pool(stats: DataFrame, min_skill: float = SMART_SKILL) -> DataFrame:
    return unflagged(stats).filter(F.col("skill_score") >= min_skill)


def pool_medians(pool: DataFrame) -> DataFrame:
    """One row: size of the pool and the exact medians of its four headline columns."""
    cols = ["trades_per_day", "median_hold_sec", "win_rate", "total_pnl_sol"]
    long = pool.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in cols])).alias("m")
    ).select("m.metric", "m.v")
    med = order_statistics(long, ["metric"], "v", {"lo": MEDIAN_LOW, "hi": MEDIAN_HIGH}, refine=2).withColumn(
        "median", median_from("lo", "hi")
    )
    one = med.agg(*[F.max(F.when(F.col("metric") == c, F.col("median"))).alias(f"median_{c}") for c in cols])
    return one.withColumn("wallets", pool.agg(F.count(F.lit(1))).scalar())


def top_wallets(stats: DataFrame, by: str, k: int) -> DataFrame:
    return stats.orderBy(F.col(by).desc(), "wallet").limit(k)


def wallet_activity(trades: DataFrame, wallet: int | None = None) -> DataFrame:
    """Buys, sells and distinct tokens bought for every wallet, or for one."""
    rows = trades if wallet is None else trades.filter(F.col("wallet") == wallet)
    buy = F.col("is_buy") == 1
    per_pair = rows.groupBy("wallet", "mint_address").agg(
        F.sum(F.when(buy, 1).otherwise(0)).alias("b"),
        F.sum(F.when(buy, 0).otherwise(1)).alias("s"),
        F.sum(F.when(buy, F.col("sol_amount")).otherwise(0.0)).alias("bs"),
        F.sum(F.when(buy, 0.0).otherwise(F.col("sol_amount"))).alias("ss"),
    )
    return per_pair.groupBy("wallet").agg(
        F.sum("b").alias("buys"), F.sum("s").alias("sells"), F.sum("bs").alias("sol_bought"), F.sum("ss").alias("sol_sold"),
        (F.sum("ss") - F.sum("bs")).alias("net_sol"),
        F.sum((F.col("b") > 0).cast("int")).alias("unique_mints"),
    )


def recent_wallet_trades(trades: DataFrame, k: int = 50) -> DataFrame:
    return top_rows(trades, ["wallet"], [F.col("ts_ms").desc(), F.col("trade_id").desc()], k, rank="rank")


def with_later_peak(trades: DataFrame, chunk_ms: int = 60_000) -> DataFrame:
    """Adds the highest price of the token strictly after each trade's time."""
    rows = trades.withColumn("_chunk", F.floor(F.col("ts_ms") / chunk_ms).cast("long"))
    peaks = rows.groupBy("mint_address", "_chunk").agg(F.max("price_sol").alias("_p"))
    later = W.partitionBy("mint_address").orderBy(F.col("_chunk").desc()).rowsBetween(W.unboundedPreceding, -1)
    carry = peaks.select("mint_address", "_chunk", F.max("_p").over(later).alias("_carry"))
    inside = W.partitionBy("mint_address", "_chunk").orderBy(F.col("ts_ms").desc()).rangeBetween(W.unboundedPreceding, -1)
    return (
        rows.join(carry, ["mint_address", "_chunk"], "left")
        .withColumn("later_peak_price", F.greatest(F.max("price_sol").over(inside), F.col("_carry")))
        .drop("_chunk", "_carry")
    )


def wallet_hit_rate(
    trades: DataFrame, multiple: float = 5.0, min_tokens: int = MIN_TOKENS,
    tiers: tuple[tuple[str, float], ...] = (("mega_elite", 0.45), ("super_elite", 0.35), ("elite", 0.25)),
) -> DataFrame:
    """Per wallet: share of bought tokens that later reached `multiple` times its first buy price."""
    buy, sell = F.col("is_buy") == 1, F.col("is_buy") == 0
    order = F.when(buy, F.struct("ts_ms", "trade_id"))
    pair = (
        with_later_peak(trades)
        .groupBy("wallet", "mint_address")
        .agg(
            F.min_by(F.struct("ts_ms", "price_sol", "market_cap_sol", "later_peak_price"), order).alias("first"),
            F.max(F.when(sell, F.col("ts_ms"))).alias("last_sell_ms"),
            F.avg(F.when(sell, F.col("market_cap_sol"))).alias("avg_sell_mcap"),
            F.sum(buy.cast("int")).alias("n_buys"),
        )
        .filter("n_buys > 0")
    )
    hit = (F.col("first.price_sol") > 0) & (F.col("first.later_peak_price") >= multiple * F.col("first.price_sol"))
    sold = F.col("last_sell_ms") >= F.col("first.ts_ms")
    mult = F.when(sold & (F.col("first.market_cap_sol") > 0), F.col("avg_sell_mcap") / F.col("first.market_cap_sol"))
    out = pair.groupBy("wallet").agg(
        F.count(F.lit(1)).alias("tokens_bought"),
        F.sum(F.when(hit, 1).otherwise(0)).alias("tokens_hit"),
        F.avg("first.market_cap_sol").alias("avg_entry_mcap"),
        F.avg(F.when(sold, (F.col("last_sell_ms") - F.col("first.ts_ms")) / 1000.0)).alias("avg_hold_sec"),
        F.sum(F.when(sold, 0).otherwise(1)).alias("tokens_never_sold"),
        F.avg(mult).alias("avg_mcap_multiple"),
    ).withColumn("hit_rate", ratio("tokens_hit", "tokens_bought"))
    tier = F.lit("none")
    for name, least in reversed(tiers):
        tier = F.when(F.col("hit_rate") >= least, name).otherwise(tier)
    return out.withColumn("tier", F.when(F.col("tokens_bought") >= min_tokens, tier).otherwise("none"))
