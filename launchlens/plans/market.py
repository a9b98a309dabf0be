"""Day, dashboard and token life-cycle queries."""

from pyspark.sql import functions as F

from launchlens.functions import rounded
from launchlens.functions.columns import round_off_tie
from launchlens.operators import market as ops
from launchlens.plans import query
from launchlens.sources import files, tables as t

START, END = t.DAY_START_MS, t.DAY_START_MS + t.DAY_MS
# The test prices are far above real ones: market-cap limits are scaled to match.
PEAKS = (140e9, 280e9, 300e9)
DEAD = 400e9


def real_clock(spark, sf):
    """Tables with the wall clock in the usual time columns; launches are spread over the month."""
    tr = t.trades(spark, sf).withColumn("ts_ms", F.col("ts_real_ms"))
    m = t.mints(spark, sf)
    shift = F.floor(F.col("mint_address") / 5) % 20 * t.DAY_MS
    m = m.select(
        *[c for c in m.columns if not c.endswith("_ms")], (F.col("created_real_ms") + shift).alias("created_ms"),
        F.col("migrated_real_ms").alias("migrated_ms"), F.col("rugged_real_ms").alias("rugged_ms"), F.col("last_trade_real_ms").alias("last_trade_ms"),
    )
    p = t.positions(spark, sf)
    real = lambda c: (F.lit(1_704_067_200_000) + F.col(c) * 3600).cast("long").alias(c)
    p = p.select(*[c for c in p.columns if c not in ("entered_ms", "exited_ms")], real("entered_ms"), real("exited_ms"))
    return tr, m, p


REAL = f"""real_mints AS (SELECT * EXCLUDE (created_ms, migrated_ms, rugged_ms, last_trade_ms), created_real_ms + (mint_address // 5) % 20 * {t.DAY_MS} AS created_ms,
  migrated_real_ms AS migrated_ms, rugged_real_ms AS rugged_ms, last_trade_real_ms AS last_trade_ms FROM mints),
real_positions AS (SELECT * EXCLUDE (entered_ms, exited_ms), 1704067200000 + entered_ms * 3600 AS entered_ms, 1704067200000 + exited_ms * 3600 AS exited_ms FROM positions),
day_mints AS (SELECT * FROM real_mints WHERE created_ms >= {START} AND created_ms < {END}),
day_buys AS (SELECT * FROM trades WHERE is_buy = 1 AND ts_real_ms >= {START} AND ts_real_ms < {END})"""

DAY_STATS = f"""SELECT count(*) AS mints_created, count(*) FILTER (migrated = 1) AS mints_migrated, count(*) FILTER (rugged = 1) AS mints_rugged,
  count(*) FILTER (peak_market_cap_sol >= {PEAKS[0]}) AS mints_5x_plus, count(*) FILTER (peak_market_cap_sol >= {PEAKS[1]}) AS mints_10x_plus,
  count(*) FILTER (peak_market_cap_sol >= {PEAKS[2]}) AS mints_50x_plus, count(DISTINCT creator_wallet) AS unique_creators,
  (SELECT count(*) FROM day_buys) AS total_trades, (SELECT count(DISTINCT wallet) FROM day_buys) AS unique_buyers,
  (SELECT round(sum(sol_amount), 2) FROM day_buys) AS total_sol_volume FROM day_mints"""


@query("a19_day_stats", t.oracle(DAY_STATS, REAL))
def _(spark, sf):
    tr, m, _ = real_clock(spark, sf)
    return ops.day_stats(m, tr, START, PEAKS)


@query("a20_top_creators", t.oracle("""SELECT creator_wallet AS wallet, count(*) AS launches, count(*) FILTER (migrated = 1) AS migrations, round(max(peak_market_cap_sol), 2) AS best_peak_mcap
FROM day_mints GROUP BY 1 ORDER BY 2 DESC, 4 DESC, 1 LIMIT 20""", REAL))
def _(spark, sf):
    return ops.top_creators(real_clock(spark, sf)[1], START)


@query("a21_top_buyers", t.oracle("SELECT wallet, count(*) AS buys, round(sum(sol_amount) + 1e-9, 3) AS sol_in FROM day_buys GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 25", REAL))
def _(spark, sf):
    return ops.top_buyers(real_clock(spark, sf)[0], START)


def as_text(df, col):
    """Map of counts as sorted text, so that both engines print it alike."""
    items = F.array_sort(F.transform(F.map_entries(col), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))))
    return df.withColumn(col, F.array_join(items, ","))


@query("a22_strategy_performance", t.oracle(f"""
SELECT strategy, count(*) FILTER (i) AS entries, count(*) FILTER (o) AS closes, count(*) FILTER (o AND realized_pnl_sol > 0) AS wins, count(*) FILTER (o AND realized_pnl_sol < 0) AS losses,
  round(coalesce(sum(realized_pnl_sol) FILTER (o), 0.0) + 1e-9, 4) AS realized_pnl_sol,
  (SELECT string_agg(r || ':' || n, ',' ORDER BY r || ':' || n) FROM (SELECT exit_reason AS r, count(*) AS n FROM real_positions x WHERE x.strategy = y.strategy AND x.exited_ms >= {START} AND x.exited_ms < {END} GROUP BY 1)) AS exit_reasons
FROM (SELECT *, entered_ms >= {START} AND entered_ms < {END} AS i, coalesce(exited_ms >= {START} AND exited_ms < {END}, false) AS o FROM real_positions) y WHERE i OR o GROUP BY strategy""", REAL))
def _(spark, sf):
    return as_text(ops.strategy_performance(real_clock(spark, sf)[2], START), "exit_reasons")


LOG = """agent_log AS (SELECT trade_id AS log_id, ts_real_ms AS ts_ms, CASE WHEN is_junk = 1 THEN 'market-regime' ELSE 'trade' END AS category,
  CASE WHEN wallet % 2 = 0 THEN 'thought' ELSE 'info' END AS level, repeat('regime ' || mint_address || ' ', 40) AS message FROM trades)"""


def agent_log(spark, sf):
    return t.trades(spark, sf).select(
        F.col("trade_id").alias("log_id"), F.col("ts_real_ms").alias("ts_ms"), F.when(F.col("is_junk") == 1, "market-regime").otherwise("trade").alias("category"),
        F.when(F.col("wallet") % 2 == 0, "thought").otherwise("info").alias("level"),
        F.repeat(F.concat(F.lit("regime "), F.col("mint_address").cast("string"), F.lit(" ")), 40).alias("message"),
    )


@query("a23_regime_as_of", t.oracle(f"SELECT ts_ms, substr(message, 1, 240) AS message FROM agent_log WHERE category = 'market-regime' AND level = 'thought' AND ts_ms < {END} ORDER BY ts_ms DESC, log_id DESC LIMIT 1", LOG))
def _(spark, sf):
    return ops.regime_as_of(agent_log(spark, sf), END)


OUTCOME = f"""CASE WHEN rugged = 1 THEN 'rugged' WHEN migrated = 1 THEN CASE WHEN last_trade_ms >= {END} THEN 'migrated_active' ELSE 'migrated_dormant' END
  WHEN peak_market_cap_sol < {DEAD} * 0.2 THEN 'dead_on_arrival' WHEN last_trade_ms >= {END} - 3600000 THEN 'alive_post_pump' ELSE 'pump_died' END"""


@query("a24_mint_lifecycle", t.oracle(f"""
SELECT m.mint_address, symbol, name, creator_wallet, created_ms, round(peak_market_cap_sol, 2) AS peak_market_cap_sol,
  (SELECT cast(trunc((min(x.ts_real_ms) - m.created_ms) / 1000) AS int) FROM trades x WHERE x.mint_address = m.mint_address AND x.market_cap_sol >= m.peak_market_cap_sol) AS time_to_peak_sec,
  migrated, migrated_ms, rugged, rugged_ms, {OUTCOME} AS outcome, n_trades, n_unique_buyers, round(buy_volume + 1e-9, 2) AS buy_volume_sol,
  (SELECT string_agg(wallet, ',' ORDER BY v DESC, wallet) FROM (SELECT wallet, sum(sol_amount) AS v FROM trades x WHERE x.mint_address = m.mint_address AND is_buy = 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)) AS top_buyers,
  (twitter <> '')::int AS has_twitter, (telegram <> '')::int AS has_telegram, (website <> '')::int AS has_website
FROM day_mints m JOIN (SELECT mint_address, count(*) AS n_trades, count(DISTINCT wallet) AS n_unique_buyers, sum(CASE WHEN is_buy = 1 THEN sol_amount ELSE 0.0 END) AS buy_volume FROM trades GROUP BY 1) a USING (mint_address)""", REAL))
def _(spark, sf):
    tr, m, _ = real_clock(spark, sf)
    out = ops.mint_lifecycle(m, tr, START, DEAD * 0.2)
    return out.withColumn("peak_market_cap_sol", F.round("peak_market_cap_sol", 2)).withColumn("top_buyers", F.array_join(F.col("top_buyers").cast("array<string>"), ","))


@query("a25_lifecycle_outcome", t.oracle(f"SELECT mint_address, {OUTCOME} AS outcome FROM real_mints", REAL))
def _(spark, sf):
    return real_clock(spark, sf)[1].select("mint_address", ops.lifecycle_outcome(END, DEAD * 0.2).alias("outcome"))


@query("w6_first_peak_time", t.oracle("""SELECT m.mint_address, min(x.ts_ms) AS peak_ms, cast(trunc((min(x.ts_ms) - min(m.created_ms)) / 1000) AS int) AS time_to_peak_sec
FROM mints m JOIN trades x ON x.mint_address = m.mint_address AND x.market_cap_sol >= m.peak_market_cap_sol GROUP BY 1"""))
def _(spark, sf):
    return ops.first_peak_time(t.mints(spark, sf), t.trades(spark, sf))


CAPS = (20e9, 50e9)


@query("a26_mint_counts", t.oracle(f"""SELECT count(*) AS total, count(*) FILTER (created_ms > 8000 - 4000) AS fresh,
  count(*) FILTER (current_market_cap_sol > {CAPS[0]} AND migrated = 0 AND rugged = 0) AS runners, count(*) FILTER (current_market_cap_sol > {CAPS[1]} AND migrated = 0 AND rugged = 0) AS near_grad,
  count(*) FILTER (migrated = 1) AS migrated, count(*) FILTER (rugged = 1) AS rugged FROM mints WHERE created_ms > 8000 - 7000"""))
def _(spark, sf):
    return ops.mint_counts(t.mints(spark, sf), 8000, window_ms=7000, fresh_ms=4000, caps=CAPS)


NOW = t.AS_OF_MS


@query("a29_top_picks", t.oracle(f"""
SELECT a.mint_address, h2x, p100, die, rug, ts_ms, symbol, round(last_price_sol, 6) AS last_price_sol FROM (
  SELECT mint_address, max(prob) FILTER (target = 'hits_2x_within_1h') AS h2x, max(prob) FILTER (target = 'peaked_100') AS p100,
    max(prob) FILTER (target = 'will_die_fast') AS die, max(prob) FILTER (target = 'will_rug') AS rug, max(ts_ms) AS ts_ms
  FROM (SELECT * REPLACE (CASE WHEN target = 'peaked_30' THEN 'will_die_fast' ELSE target END AS target, prob * CASE WHEN target = 'will_rug' THEN 0.1::double ELSE 0.5::double END AS prob) FROM predictions)
  WHERE ts_ms > {NOW} - 300000 AND ts_ms <= {NOW} GROUP BY 1) a LEFT JOIN mints m USING (mint_address)
WHERE die < 0.5 AND rug < 0.15 ORDER BY h2x DESC NULLS LAST, a.mint_address LIMIT 30"""))
def _(spark, sf):
    p = t.predictions(spark, sf).withColumn("prob", F.col("prob") * F.when(F.col("target") == "will_rug", 0.1).otherwise(0.5))
    p = p.withColumn("target", F.when(F.col("target") == "peaked_30", "will_die_fast").otherwise(F.col("target")))
    out = ops.top_picks(p, t.mints(spark, sf), NOW)
    return out.select("mint_address", "h2x", "p100", "die", "rug", "ts_ms", "symbol", round_off_tie(F.col("last_price_sol")).alias("last_price_sol"))


@query("a30_snapshot_coverage", t.oracle(f"""SELECT age AS snapshot_age_sec, count(*) AS n, sum(count(*)) OVER ()::bigint AS total, min(min(cutoff)) OVER () AS earliest_ms,
  round(({NOW} - min(min(cutoff)) OVER ()) / 86400000, 6) AS collection_days FROM grid GROUP BY 1""".replace("sum(count(*)) OVER ()::bigint", "cast(sum(count(*)) OVER () AS bigint)")))
def _(spark, sf):
    from launchlens.operators.features import snapshot_grid

    return rounded(ops.snapshot_coverage(snapshot_grid(t.mints(spark, sf), t.AGES).withColumnRenamed("cutoff_ms", "snapshot_ts"), NOW))


@query("a31_feed_health", t.oracle(f"""SELECT cast(floor(({NOW} - max(ts_ms) FILTER (ts_ms > {NOW} - 300000 AND ts_ms <= {NOW} + 60000)) / 1000) AS bigint) AS last_trade_ago_sec, count(*) AS trades,
  (SELECT count(*) FROM predictions WHERE ts_ms > {NOW} - 180000) AS predictions_3m, (SELECT count(*) FROM predictions WHERE ts_ms > {NOW} - 3600000) AS predictions_1h,
  (SELECT count(*) FROM predictions) AS predictions, (SELECT count(DISTINCT mint_address) FROM positions) AS tokens_traded, (SELECT count(*) FROM positions) AS positions FROM trades"""))
def _(spark, sf):
    return ops.feed_health(t.trades(spark, sf), t.predictions(spark, sf), t.positions(spark, sf), NOW)


@query("s18_write_day_summary", t.oracle(f"""SELECT '{t.DAY}' AS day, (SELECT mints_created FROM ({DAY_STATS})) AS mints_created, (SELECT total_trades FROM ({DAY_STATS})) AS total_trades,
  least(20, (SELECT count(DISTINCT creator_wallet) FROM day_mints)) AS n_creators, least(25, (SELECT count(DISTINCT wallet) FROM day_buys)) AS n_buyers,
  (SELECT count(DISTINCT strategy) FROM real_positions WHERE (entered_ms >= {START} AND entered_ms < {END}) OR (exited_ms >= {START} AND exited_ms < {END})) AS n_strategies,
  (SELECT ts_ms FROM agent_log WHERE category = 'market-regime' AND level = 'thought' AND ts_ms < {END} ORDER BY ts_ms DESC, log_id DESC LIMIT 1) AS regime_ms,
  (SELECT count(*) FROM day_mints) AS mint_rows""", REAL, LOG))
def _(spark, sf):
    tr, m, p = real_clock(spark, sf)
    paths = ops.write_day_summary(m, tr, p, agent_log(spark, sf), t.DAY, START, files.work_dir(spark, "summary"))
    doc = spark.read.schema(
        "day string, stats struct<mints_created:bigint,total_trades:bigint>, top_creators array<struct<wallet:bigint>>, "
        "top_buyers array<struct<wallet:bigint>>, strategy_perf array<struct<strategy:string>>, regime struct<ts_ms:bigint>"
    ).json(paths["summary"])
    rows = spark.read.schema("mint_address int").json(paths["mints"]).agg(F.count(F.lit(1)).alias("n"))
    size = lambda c: F.size(c).cast("long")
    return doc.select(
        "day", "stats.mints_created", "stats.total_trades", size("top_creators").alias("n_creators"), size("top_buyers").alias("n_buyers"),
        size("strategy_perf").alias("n_strategies"), F.col("regime.ts_ms").alias("regime_ms"), rows.scalar().alias("mint_rows"),
    )
