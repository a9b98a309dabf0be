"""Wallet queries."""

from pyspark.sql import functions as F

from launchlens.functions import rounded
from launchlens.operators import wallets as ops
from launchlens.plans import query
from launchlens.sources import tables as t

NOW = t.AS_OF_MS

PAIRS = f"""pairs AS (
  SELECT *, (sol_out - sol_in) / sol_in * 100 AS pnl_pct, (last_sell_ms - first_buy_ms) / 1000.0::double AS hold_sec,
    CASE WHEN sol_out > sol_in THEN 1 ELSE 0 END AS profitable
  FROM (SELECT wallet, mint_address, sum(CASE WHEN is_buy = 1 THEN sol_amount ELSE 0.0 END) AS sol_in,
      sum(CASE WHEN is_buy = 0 THEN sol_amount ELSE 0.0 END) AS sol_out,
      min(CASE WHEN is_buy = 1 THEN ts_ms END) AS first_buy_ms, max(CASE WHEN is_buy = 0 THEN ts_ms END) AS last_sell_ms,
      max(ts_ms) AS last_ms
    FROM trades WHERE is_junk = 0 GROUP BY 1, 2)
  WHERE sol_in > 0 AND sol_out > 0 AND last_ms < {NOW})"""
STATS = f"""wallet_stats AS (
  SELECT *, mints_profitable / mints_completed AS win_rate, total_sol_out - total_sol_in AS total_pnl_sol,
    mints_profitable / mints_completed * sqrt(least(mints_completed, 200)) AS skill_score,
    mints_completed / 30.0::double AS trades_per_day,
    CASE WHEN mints_completed / 30.0::double > 100 THEN 1 ELSE 0 END AS is_high_freq,
    CASE WHEN median_hold_sec < 60 THEN 1 ELSE 0 END AS is_flipper,
    CASE WHEN total_sol_out - total_sol_in <= 0 THEN 1 ELSE 0 END AS is_unprofitable,
    cast({NOW} AS bigint) AS computed_ms, 30 AS window_days
  FROM (SELECT wallet, count(*) AS mints_completed, cast(sum(profitable) AS bigint) AS mints_profitable,
      sum(sol_in) AS total_sol_in, sum(sol_out) AS total_sol_out, median(pnl_pct) AS median_pnl_pct,
      median(hold_sec) AS median_hold_sec
    FROM pairs GROUP BY 1 HAVING count(*) >= 5))"""


def pairs(spark, sf):
    return ops.wallet_token_pnl(t.trades(spark, sf), NOW, fresh_ms=0)


def stats(spark, sf):
    """The skill table as other jobs read it."""
    return t.stored(spark, sf, "wallet_stats", lambda: ops.wallet_skill(pairs(spark, sf), NOW))


def r(*cols):
    return ", ".join(f"round({c}, 6) + 0.0::double AS {c}" for c in cols)


@query("a16_wallet_token_pnl", t.oracle(
    f"SELECT wallet, mint_address, {r('sol_in','sol_out','pnl_pct','hold_sec')}, first_buy_ms, last_sell_ms, last_ms, profitable FROM pairs", PAIRS))
def _(spark, sf):
    return rounded(pairs(spark, sf))


@query("a17_wallet_skill", t.oracle(
    f"SELECT wallet, mints_completed, mints_profitable, {r('win_rate','skill_score','total_sol_in','total_sol_out','total_pnl_sol','median_pnl_pct','median_hold_sec','trades_per_day')}, "
    "is_high_freq, is_flipper, is_unprofitable, computed_ms, window_days FROM wallet_stats", PAIRS, STATS))
def _(spark, sf):
    return rounded(ops.wallet_skill(pairs(spark, sf), NOW))


@query("a17_wallet_skill_uncapped", t.oracle(f"""
SELECT wallet, count(*) AS mints_completed, cast(sum(profitable) AS bigint) AS mints_profitable,
  round(sum(profitable) / count(*), 6) AS win_rate, round(sum(profitable) / count(*) * sqrt(count(*)), 6) AS skill_score,
  round(sum(sol_in), 6) AS total_sol_in, round(sum(sol_out), 6) AS total_sol_out,
  round(sum(sol_out) - sum(sol_in), 6) + 0.0::double AS total_pnl_sol, round(avg(pnl_pct), 6) + 0.0::double AS avg_pnl_pct,
  cast({NOW} AS bigint) AS computed_ms, 30 AS window_days
FROM pairs GROUP BY wallet HAVING count(*) >= 5""", PAIRS))
def _(spark, sf):
    return rounded(ops.wallet_skill(pairs(spark, sf), NOW, variant="uncapped"))


@query("a18_smart_money_pool", t.oracle(
    f"SELECT wallet, mints_completed, {r('win_rate','skill_score','total_pnl_sol')} FROM wallet_stats "
    "WHERE is_high_freq = 0 AND is_flipper = 0 AND is_unprofitable = 0 AND skill_score >= 1.0", PAIRS, STATS))
def _(spark, sf):
    cols = ["wallet", "mints_completed", "win_rate", "skill_score", "total_pnl_sol"]
    return rounded(ops.smart_money_pool(stats(spark, sf), 1.0).select(*cols))


@query("a18_pool_medians", t.oracle("""
SELECT count(*) AS wallets, round(median(trades_per_day), 6) AS median_trades_per_day,
  round(median(median_hold_sec), 6) AS median_median_hold_sec, round(median(win_rate), 6) AS median_win_rate,
  round(median(total_pnl_sol), 6) AS median_total_pnl_sol
FROM wallet_stats WHERE is_high_freq = 0 AND is_flipper = 0 AND is_unprofitable = 0 AND skill_score >= 1.0""", PAIRS, STATS))
def _(spark, sf):
    return rounded(ops.pool_medians(ops.smart_money_pool(stats(spark, sf), 1.0)))


@query("a18_top_wallets", t.oracle("""
(SELECT 'skill' AS board, wallet, round(skill_score, 6) AS score FROM wallet_stats
 WHERE is_high_freq = 0 AND is_flipper = 0 AND is_unprofitable = 0 AND skill_score >= 1.0 ORDER BY skill_score DESC, wallet LIMIT 10)
UNION ALL
(SELECT 'profit', wallet, round(total_pnl_sol, 6) FROM wallet_stats ORDER BY total_pnl_sol DESC, wallet LIMIT 5)""", PAIRS, STATS))
def _(spark, sf):
    s = stats(spark, sf)
    a = ops.top_wallets(ops.smart_money_pool(s, 1.0), "skill_score", 10)
    b = ops.top_wallets(s, "total_pnl_sol", 5)
    return rounded(
        a.select(F.lit("skill").alias("board"), "wallet", F.col("skill_score").alias("score")).unionByName(
            b.select(F.lit("profit").alias("board"), "wallet", F.col("total_pnl_sol").alias("score"))
        )
    )


@query("a28_wallet_activity", t.oracle("""
SELECT wallet, cast(sum(is_buy) AS bigint) AS buys, cast(sum(1 - is_buy) AS bigint) AS sells,
  round(sum(CASE WHEN is_buy = 1 THEN sol_amount ELSE 0.0 END), 6) AS sol_bought,
  round(sum(CASE WHEN is_buy = 0 THEN sol_amount ELSE 0.0 END), 6) AS sol_sold,
  round(sum(CASE WHEN is_buy = 0 THEN sol_amount ELSE -sol_amount END), 6) + 0.0::double AS net_sol,
  count(DISTINCT CASE WHEN is_buy = 1 THEN mint_address END) AS unique_mints
FROM trades GROUP BY wallet"""))
def _(spark, sf):
    return rounded(ops.wallet_activity(t.trades(spark, sf)))


@query("a28_recent_wallet_trades", t.oracle("""
SELECT wallet, rank, trade_id, mint_address, is_buy, round(sol_amount, 6) AS sol_amount, ts_ms
FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY ts_ms DESC, trade_id DESC) AS rank FROM trades) WHERE rank <= 50"""))
def _(spark, sf):
    cols = ["wallet", "rank", "trade_id", "mint_address", "is_buy", "sol_amount", "ts_ms"]
    return rounded(ops.recent_wallet_trades(t.trades(spark, sf)).select(*cols))


@query("a42_wallet_hit_rate", t.oracle("""
SELECT wallet, tokens_bought, tokens_hit, round(avg_entry_mcap, 2) AS avg_entry_mcap, round(avg_hold_sec, 6) AS avg_hold_sec,
  tokens_never_sold, round(avg_mcap_multiple, 6) AS avg_mcap_multiple, round(tokens_hit / tokens_bought, 6) AS hit_rate,
  CASE WHEN tokens_bought < 5 THEN 'none' WHEN tokens_hit / tokens_bought >= 0.45 THEN 'mega_elite'
       WHEN tokens_hit / tokens_bought >= 0.35 THEN 'super_elite' WHEN tokens_hit / tokens_bought >= 0.25 THEN 'elite' ELSE 'none' END AS tier
FROM (SELECT wallet, count(*) AS tokens_bought, cast(sum(CASE WHEN p0 > 0 AND later_peak >= 5 * p0 THEN 1 ELSE 0 END) AS bigint) AS tokens_hit,
  avg(m0) AS avg_entry_mcap, avg(CASE WHEN last_sell >= t0 THEN (last_sell - t0) / 1000.0::double END) AS avg_hold_sec,
  cast(sum(CASE WHEN last_sell >= t0 THEN 0 ELSE 1 END) AS bigint) AS tokens_never_sold,
  avg(CASE WHEN last_sell >= t0 AND m0 > 0 THEN sell_mcap / m0 END) AS avg_mcap_multiple
 FROM (SELECT f.*, s.last_sell, s.sell_mcap, (SELECT max(price_sol) FROM trades x WHERE x.mint_address = f.mint_address AND x.ts_ms > f.t0) AS later_peak
   FROM (SELECT wallet, mint_address, min(ts_ms) AS t0, arg_min(price_sol, ts_ms * 1000000000 + trade_id) AS p0,
           arg_min(market_cap_sol, ts_ms * 1000000000 + trade_id) AS m0 FROM trades WHERE is_buy = 1 GROUP BY 1, 2) f
   LEFT JOIN (SELECT wallet, mint_address, max(ts_ms) AS last_sell, avg(market_cap_sol) AS sell_mcap FROM trades WHERE is_buy = 0 GROUP BY 1, 2) s
     USING (wallet, mint_address)) GROUP BY wallet)"""))
def _(spark, sf):
    out = ops.wallet_hit_rate(t.trades(spark, sf))
    return rounded(out.withColumn("avg_entry_mcap", F.round("avg_entry_mcap", 2)))
