"""Market-wide and dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from launchlens.functions import nz, token_join, top_rows

DAY_MS = 86_400_000


def _in_day(ts: str, start_ms: int) -> Column:
    return (F.col(ts) >= start_ms) & (F.col(ts) < start_ms + DAY_MS)


def beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """Columns of two one-row frames in one row; the second is read as a scalar subquery."""
    return one.select("*", other.select(F.struct(*other.columns)).scalar().alias("_o")).select(*one.columns, "_o.*")


def day_stats(mints: DataFrame, trades: DataFrame, start_ms: int, peaks: tuple[float, float, float] = (140.0, 280.0, 1400.0)) -> DataFrame:
    """One row of token and buy totals of the day."""
    flag = lambda c: F.count(F.when(c, 1))
    names = ("mints_5x_plus", "mints_10x_plus", "mints_50x_plus")
    m = mints.filter(_in_day("created_ms", start_ms)).agg(
        F.count(F.lit(1)).alias("mints_created"), flag(F.col("migrated") == 1).alias("mints_migrated"),
        flag(F.col("rugged") == 1).alias("mints_rugged"),
        *[flag(F.col("peak_market_cap_sol") >= p).alias(n) for n, p in zip(names, peaks)],
        F.count_distinct("creator_wallet").alias("unique_creators"),
    )
    t = trades.filter(_in_day("ts_ms", start_ms) & (F.col("is_buy") == 1)).agg(
        F.count(F.lit(1)).alias("total_trades"), F.count_distinct("wallet").alias("unique_buyers"),
        F.round(F.sum("sol_amount"), 2).alias("total_sol_volume"),
    )
    return beside(m, t)


def top_creators(mints: DataFrame, start_ms: int, k: int = 20) -> DataFrame:
    g = mints.filter(_in_day("created_ms", start_ms) & F.col("creator_wallet").isNotNull()).groupBy(
        F.col("creator_wallet").alias("wallet")
    ).agg(
        F.count(F.lit(1)).alias("launches"), F.count(F.when(F.col("migrated") == 1, 1)).alias("migrations"),
        F.round(F.max("peak_market_cap_sol"), 2).alias("best_peak_mcap"),
    )
    return g.orderBy(F.col("launches").desc(), F.col("best_peak_mcap").desc(), "wallet").limit(k)


def top_buyers(trades: DataFrame, start_ms: int, k: int = 25) -> DataFrame:
    g = trades.filter(_in_day("ts_ms", start_ms) & (F.col("is_buy") == 1)).groupBy("wallet").agg(
        F.count(F.lit(1)).alias("buys"), F.round(F.sum("sol_amount") + 1e-9, 3).alias("sol_in")
    )
    return g.orderBy(F.col("sol_in").desc(), "wallet").limit(k)


def strategy_performance(positions: DataFrame, start_ms: int) -> DataFrame:
    """Per strategy: entries and closes of the day, and a map from exit reason to count."""
    entered, exited = nz(_in_day("entered_ms", start_ms), False), nz(_in_day("exited_ms", start_ms), False)
    rows = positions.filter(entered | exited).withColumn("_in", entered).withColumn("_out", exited)
    pnl = F.col("realized_pnl_sol")
    # first per (strategy, reason): the lists below hold one entry per reason
    part = rows.groupBy("strategy", F.when(F.col("_out"), F.col("exit_reason")).alias("reason")).agg(
        F.count(F.when(F.col("_in"), 1)).alias("entries"), F.count(F.when(F.col("_out"), 1)).alias("closes"),
        F.count(F.when(F.col("_out") & (pnl > 0), 1)).alias("wins"), F.count(F.when(F.col("_out") & (pnl < 0), 1)).alias("losses"),
        nz(F.sum(F.when(F.col("_out"), nz(pnl)))).alias("pnl"),
    )
    reason = F.when(F.col("reason").isNotNull(), F.struct("reason", "closes"))
    return part.groupBy("strategy").agg(
        *[F.sum(c).alias(c) for c in ("entries", "closes", "wins", "losses")],
        F.round(F.sum("pnl") + 1e-9, 4).alias("realized_pnl_sol"),
        F.map_from_entries(F.collect_list(reason)).alias("exit_reasons"),
    )


def regime_as_of(log: DataFrame, end_ms: int) -> DataFrame:
    """Latest regime note strictly before a time, cut to 240 characters."""
    notes = log.filter((F.col("category") == "market-regime") & (F.col("level") == "thought") & (F.col("ts_ms") < end_ms))
    row = F.struct("ts_ms", F.substring(nz("message", ""), 1, 240).alias("message"))
    return notes.agg(F.max_by(row, F.struct("ts_ms", "log_id")).alias("r")).filter(F.col("r").isNotNull()).select("r.*")


def lifecycle_outcome(end_ms: int, dead_below: float = 28.0) -> Column:
    """Outcome of a token as of day end."""
    last, peak = F.col("last_trade_ms"), nz("peak_market_cap_sol")
    return (
        F.when(F.col("rugged") == 1, "rugged")
        .when((F.col("migrated") == 1) & (last >= end_ms), "migrated_active")
        .when(F.col("migrated") == 1, "migrated_dormant")
        .when(peak < dead_below, "dead_on_arrival")
        .when(last >= end_ms - 3_600_000, "alive_post_pump")
        .otherwise("pump_died")
    )


def first_peak_time(mints: DataFrame, trades: DataFrame) -> DataFrame:
    """First time the market cap reached the token's peak, in whole seconds from creation."""
    m = mints.select("mint_address", "created_ms", nz("peak_market_cap_sol").alias("_peak"))
    hit = token_join(trades.select("mint_address", "ts_ms", "market_cap_sol"), m).filter(
        F.col("market_cap_sol") >= F.col("_peak")
    )
    return hit.groupBy("mint_address").agg(F.min("ts_ms").alias("peak_ms"), F.min("created_ms").alias("_c")).select(
        "mint_address", "peak_ms", F.expr("cast((peak_ms - _c) / 1000 as int)").alias("time_to_peak_sec")
    )


def mint_lifecycle(mints: DataFrame, trades: DataFrame, start_ms: int, dead_below: float = 28.0, top: int = 5) -> DataFrame:
    """One row per token created on the day, most valuable first.

    n_unique_buyers counts the wallets of buys and sells, not only of buys.
    """
    m = mints.filter(_in_day("created_ms", start_ms))
    buy = F.col("is_buy") == 1
    per_wallet = (
        token_join(trades, m.select("mint_address"), "left_semi").groupBy("mint_address", "wallet")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(buy, F.col("sol_amount"))).alias("bought"))
    )
    agg = per_wallet.groupBy("mint_address").agg(
        F.sum("n").alias("n_trades"), F.count(F.lit(1)).alias("n_unique_buyers"),
        F.round(nz(F.sum("bought")) + 1e-9, 2).alias("buy_volume_sol"),
    )
    best = (
        top_rows(per_wallet.filter(F.col("bought").isNotNull()), ["mint_address"], [F.col("bought").desc(), F.col("wallet")], top, rank="rk")
        .groupBy("mint_address").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "wallet"))), lambda x: x["wallet"]).alias("top_buyers"))
    )
    has = lambda c: (F.length(nz(F.col(c), "")) > 0).cast("int").alias(f"has_{c}")
    return (
        m.join(agg, "mint_address", "left").join(best, "mint_address", "left")
        .join(first_peak_time(m, trades), "mint_address", "left")
        .select(
            "mint_address", "symbol", "name", "creator_wallet", "created_ms", "peak_market_cap_sol", "time_to_peak_sec", "migrated",
            "migrated_ms", "rugged", "rugged_ms", lifecycle_outcome(start_ms + DAY_MS, dead_below).alias("outcome"),
            nz("n_trades", 0).alias("n_trades"), nz("n_unique_buyers", 0).alias("n_unique_buyers"),
            nz("buy_volume_sol").alias("buy_volume_sol"), 
            F.coalesce("top_buyers", F.array().cast("array<bigint>")).alias("top_buyers"),
            has("twitter"), has("telegram"), has("website"),
        )
        .orderBy(F.col("peak_market_cap_sol").desc_nulls_last(), "mint_address")
    )


def mint_counts(mints: DataFrame, as_of_ms: int, window_ms: int = DAY_MS, fresh_ms: int = 300_000, caps: tuple[float, float] = (50.0, 200.0)) -> DataFrame:
    """One row of token counts of the last 24 hours."""
    alive = (F.col("migrated") == 0) & (F.col("rugged") == 0)
    flag = lambda c: F.count(F.when(c, 1))
    return mints.filter(F.col("created_ms") > as_of_ms - window_ms).agg(
        F.count(F.lit(1)).alias("total"), flag(F.col("created_ms") > as_of_ms - fresh_ms).alias("fresh"),
        flag(alive & (F.col("current_market_cap_sol") > caps[0])).alias("runners"),
        flag(alive & (F.col("current_market_cap_sol") > caps[1])).alias("near_grad"),
        flag(F.col("migrated") == 1).alias("migrated"), flag(F.col("rugged") == 1).alias("rugged"),
    )


def portfolio_summary(positions: DataFrame, mints: DataFrame, starting: float, started_ms: int, peak_value: float, clamp: bool = False) -> DataFrame:
    """One row of cash, exposure, mark-to-market and win rate (A27). `clamp` limits each position's at-risk part at 0."""
    p = positions.filter(F.col("entered_ms") >= started_ms).join(
        mints.select("mint_address", F.col("last_price_sol").alias("_now")), "mint_address", "left"
    )
    is_open, closed = F.col("status") == "open", F.col("status") == "closed"
    risk = F.col("entry_sol") - nz("sol_realized_so_far")
    risk = F.greatest(F.lit(0.0), risk) if clamp else risk
    pnl = F.col("realized_pnl_sol")
    total = lambda c, v: nz(F.sum(F.when(c, v)))
    flag = lambda c: F.count(F.when(c, 1))
    a = p.agg(
        total(closed, pnl).alias("realized_pnl_sol"), flag(closed).alias("total_closed"), flag(closed & (pnl > 0)).alias("wins"),
        flag(closed & (pnl < 0)).alias("losses"), flag(is_open).alias("open_positions"),
        total(is_open, F.col("entry_sol")).alias("open_cost"), total(is_open, risk).alias("at_risk"),
        total(is_open, nz("tokens_remaining") * nz("_now")).alias("open_mtm"),
        flag(is_open & (nz("sol_realized_so_far") >= F.col("entry_sol"))).alias("house_money_count"),
        total(is_open, nz("sol_realized_so_far")).alias("realized_locked"),
    )
    a = a.withColumn("cash", F.lit(starting) + F.col("realized_pnl_sol") - F.col("at_risk"))
    a = a.withColumn("total_value", F.col("cash") + F.col("open_mtm"))
    a = a.withColumn("peak_total_value", F.greatest(F.lit(peak_value), F.col("total_value")))
    share = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    return (
        a.withColumn("drawdown", share(F.col("total_value") - F.col("peak_total_value"), F.col("peak_total_value")))
        .withColumn("pct_change", share(F.col("total_value") - F.lit(starting), F.lit(starting)))
        .withColumn("win_rate", share(F.col("wins"), F.col("total_closed")))
    )


def top_picks(predictions: DataFrame, mints: DataFrame, as_of_ms: int, k: int = 30, fresh_ms: int = 300_000) -> DataFrame:
    """Tokens with the highest recent doubling probability and low death and rug risk."""
    best = lambda t: F.max(F.when(F.col("target") == t, F.col("prob")))
    a = predictions.filter((F.col("ts_ms") > as_of_ms - fresh_ms) & (F.col("ts_ms") <= as_of_ms)).groupBy("mint_address").agg(
        best("hits_2x_within_1h").alias("h2x"), best("peaked_100").alias("p100"), best("will_die_fast").alias("die"),
        best("will_rug").alias("rug"), F.max("ts_ms").alias("ts_ms"),
    )
    m = mints.select("mint_address", "name", "symbol", "last_price_sol", "current_market_cap_sol")
    return (
        a.filter((F.col("die") < 0.5) & (F.col("rug") < 0.15)).join(m, "mint_address", "left")
        .orderBy(F.col("h2x").desc_nulls_last(), "mint_address").limit(k)
    )


def snapshot_coverage(snapshots: DataFrame, as_of_ms: int) -> DataFrame:
    """Snapshots per true age, with the overall total, first time and collection days."""
    per_age = snapshots.groupBy("snapshot_age_sec").agg(F.count(F.lit(1)).alias("n"))
    whole = snapshots.agg(F.count(F.lit(1)).alias("total"), F.min("snapshot_ts").alias("earliest_ms"))
    o = whole.select(F.struct("*")).scalar()
    return per_age.withColumn("_o", o).select(
        "snapshot_age_sec", "n", "_o.*", ((F.lit(as_of_ms) - F.col("_o.earliest_ms")) / DAY_MS).alias("collection_days")
    )


def feed_health(trades: DataFrame, predictions: DataFrame, positions: DataFrame, as_of_ms: int) -> DataFrame:
    """One row: silence of the trade feed, recent predictions, table counts."""
    live = F.col("ts_ms").between(as_of_ms - 300_000 + 1, as_of_ms + 60_000)
    t = trades.agg(
        F.floor((F.lit(as_of_ms) - F.max(F.when(live, F.col("ts_ms")))) / 1000).alias("last_trade_ago_sec"),
        F.count(F.lit(1)).alias("trades"),
    )
    p = predictions.agg(
        F.count(F.when(F.col("ts_ms") > as_of_ms - 180_000, 1)).alias("predictions_3m"),
        F.count(F.when(F.col("ts_ms") > as_of_ms - 3_600_000, 1)).alias("predictions_1h"), F.count(F.lit(1)).alias("predictions"),
    )
    q = positions.agg(F.count_distinct("mint_address").alias("tokens_traded"), F.count(F.lit(1)).alias("positions"))
    return beside(beside(t, p), q)


def strategy_summary(positions: DataFrame) -> DataFrame:
    c = positions.filter("status = 'closed'")
    return c.groupBy("strategy").agg(
        F.count(F.when(F.col("realized_pnl_sol") > 0, 1)).alias("wins"), F.count(F.when(F.col("realized_pnl_sol") < 0, 1)).alias("losses"),
        nz(F.sum("realized_pnl_sol")).alias("total_pnl_sol"),
    )


def write_day_summary(
    mints: DataFrame, trades: DataFrame, positions: DataFrame, log: DataFrame, day: str, start_ms: int, out: str,
) -> dict[str, str]:
    """Daily summary as gzipped JSON: one document, and the token rows as JSON lines beside it.

    The document holds only lists of fixed length; the tokens of a day are never gathered in one row.
    """
    one = day_stats(mints, trades, start_ms)
    arr = lambda d: d.agg(F.collect_list(F.struct(*d.columns))).scalar()
    strategies = strategy_performance(positions, start_ms)
    regime = regime_as_of(log, start_ms + DAY_MS)
    doc = one.select(
        F.lit(day).alias("day"), F.lit(1).alias("version"), F.struct(*one.columns).alias("stats"),
        arr(top_creators(mints, start_ms)).alias("top_creators"), arr(top_buyers(trades, start_ms)).alias("top_buyers"),
        arr(strategies).alias("strategy_perf"), regime.select(F.struct(*regime.columns)).scalar().alias("regime"),
    )
    paths = {"summary": f"{out}/summary", "mints": f"{out}/mints"}
    doc.select(F.to_json(F.struct(*doc.columns)).alias("value")).write.mode("overwrite").option("compression", "gzip").text(paths["summary"])
    mint_lifecycle(mints, trades, start_ms).write.mode("overwrite").option("compression", "gzip").json(paths["mints"])
    return paths
