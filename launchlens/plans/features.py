"""Snapshot feature queries. Every family has its own oracle; the wide row is checked against all of them joined."""

from pyspark.sql import functions as F

from launchlens.functions import rounded
from launchlens.functions.columns import round_off_tie
from launchlens.operators import creators, features as ops
from launchlens.plans import query
from launchlens.plans.wallets import PAIRS, STATS, stats
from launchlens.sources import tables as t

AGES = t.AGES
KEY = ops.KEY
# All windows and time chunks are the library defaults; the compressed clock makes them apply.
GRID = "g(mint_address, snapshot_age_sec) AS (SELECT mint_address, age FROM grid)"
SEEN = """seen AS (
  SELECT g.age, g.cutoff, g.created_ms, g.creator_wallet, t.*,
    greatest(0, cast(floor((t.ts_ms - g.created_ms) / 1000) AS bigint)) AS secs,
    row_number() OVER (PARTITION BY g.mint_address, g.age ORDER BY t.ts_ms, t.trade_id) AS seq
  FROM grid g JOIN trades t ON t.mint_address = g.mint_address AND t.ts_ms <= g.cutoff)"""

# family -> (supporting expressions, {column: (type, SQL)}, FROM clause grouped by (mint_address, age))
FAMILIES = {
    "a1_flow_features": ([], {
        "sol_inflow": ("d", "sum(CASE WHEN is_buy = 1 THEN sol_amount ELSE 0.0 END)"),
        "sol_outflow": ("d", "sum(CASE WHEN is_buy = 0 THEN sol_amount ELSE 0.0 END)"),
        "buy_count": ("i", "count(*) FILTER (is_buy = 1)"), "sell_count": ("i", "count(*) FILTER (is_buy = 0)"),
        "buy_sell_ratio": ("d", "CASE WHEN count(*) FILTER (is_buy = 0) > 0 THEN count(*) FILTER (is_buy = 1) / count(*) FILTER (is_buy = 0) WHEN count(*) FILTER (is_buy = 1) > 0 THEN 99.0::double ELSE 0.0 END"),
        "trade_count": ("i", "count(*)"), "trades_per_min": ("d", "count(*) / age * 60"),
    }, "seen"),
    "a2_amount_distribution": ([], {
        f"{f}_{s}_sol": ("d", e.format(c=f"is_buy = {b}", l=f"list_sort(list(sol_amount) FILTER (is_buy = {b}))"))
        for s, b in (("buy", 1), ("sell", 0))
        for f, e in {
            "avg": "avg(sol_amount) FILTER ({c})", "max": "max(sol_amount) FILTER ({c})", "std": "stddev_pop(sol_amount) FILTER ({c})",
            "median": "({l})[cast(floor(0.5::double * count(*) FILTER ({c})) AS int) + 1]",
            "p90": "({l})[least(cast(floor(0.9::double * count(*) FILTER ({c})) AS int), count(*) FILTER ({c}) - 1) + 1]",
        }.items()
    }, "seen"),
    "a3_concentration": (["""vols AS (
      SELECT *, row_number() OVER (PARTITION BY mint_address, age, is_buy ORDER BY v DESC) AS rk,
        sum(v) OVER (PARTITION BY mint_address, age, is_buy) AS tot
      FROM (SELECT mint_address, age, is_buy, wallet, sum(sol_amount) AS v FROM seen GROUP BY ALL))"""], {
        **{f"top{k}_{s}_sol_pct": ("d", f"CASE WHEN max(tot) FILTER (is_buy = {b}) > 0 THEN sum(v) FILTER (is_buy = {b} AND rk <= {k}) / max(tot) FILTER (is_buy = {b}) END")
           for s, b in (("buyer", 1), ("seller", 0)) for k in (1, 3, 5)},
        **{f"{s}_hhi": ("d", f"sum((v / tot) * (v / tot)) FILTER (is_buy = {b} AND tot > 0)") for s, b in (("buyer", 1), ("seller", 0))},
    }, "vols"),
    "a4_sniper_features": ([], {
        "sniper_buyer_count": ("i", "count(DISTINCT wallet) FILTER (is_buy = 1 AND secs <= 30)"),
        "pct_sniper_buys": ("d", "count(DISTINCT wallet) FILTER (is_buy = 1 AND secs <= 30) / nullif(count(*) FILTER (is_buy = 1), 0)"),
        "first_block_buyer_count": ("i", "count(DISTINCT wallet) FILTER (is_buy = 1 AND secs <= 1)"),
        "pct_first_block_buys": ("d", "count(DISTINCT wallet) FILTER (is_buy = 1 AND secs <= 1) / nullif(count(*) FILTER (is_buy = 1), 0)"),
        "fast_human_sniper_count": ("i", "count(DISTINCT wallet) FILTER (is_buy = 1 AND secs <= 30)"),
    }, "seen"),
    "a5_buyer_rank_features": (["""buyer_ranks AS (
      SELECT *, row_number() OVER (PARTITION BY mint_address, age ORDER BY f) AS rk FROM (
        SELECT mint_address, age, wallet, min(seq) AS f FROM seen WHERE is_buy = 1 GROUP BY ALL))"""], {
        "unique_buyers": ("i", "count(*)"), "avg_buyer_rank": ("d", "avg(rk)"),
        "median_buyer_rank": ("i", "list_sort(list(rk))[cast(floor(0.5::double * count(*)) AS int) + 1]"),
        "pct_buyers_in_first_10": ("d", "count(*) FILTER (rk <= 10) / count(*)"),
        "top10_buyers": ("i", "count(*) FILTER (rk <= 10)"), "top50_buyers": ("i", "count(*) FILTER (rk <= 50)"),
    }, "buyer_ranks"),
    "a6_seconds_to_n_buyers": (["""firsts AS (
      SELECT *, row_number() OVER (PARTITION BY mint_address, age ORDER BY f) AS rk FROM (
        SELECT mint_address, age, wallet, min(seq) AS f, arg_min(secs, seq) AS s FROM seen WHERE is_buy = 1 GROUP BY ALL))"""], {
        f"seconds_to_{n}_unique_buyers": ("i-1", f"max(s) FILTER (rk = {n})") for n in (5, 10)
    }, "firsts"),
    "a7_pressure_window": ([], {
        "pressure_60_buy_pct": ("d", "count(*) FILTER (is_buy = 1 AND ts_ms >= cutoff - 60000) / nullif(count(*) FILTER (ts_ms >= cutoff - 60000), 0)"),
        "pressure_60_net": ("d", "sum(CASE WHEN is_buy = 1 THEN sol_amount ELSE -sol_amount END) FILTER (ts_ms >= cutoff - 60000)"),
    }, "seen"),
    "a8_acceleration": (["""halves AS (
      SELECT mint_address, age, coalesce(sum(sol_amount) FILTER (ts_ms >= cutoff - 30000), 0.0) AS ls, count(*) FILTER (ts_ms >= cutoff - 30000) AS ln,
        coalesce(sum(sol_amount) FILTER (ts_ms < cutoff - 30000 AND ts_ms >= cutoff - 60000), 0.0) AS es,
        count(*) FILTER (ts_ms < cutoff - 30000 AND ts_ms >= cutoff - 60000) AS en
      FROM seen WHERE is_buy = 1 GROUP BY ALL)"""], {
        "inflow_accel_pct": ("d", "max(CASE WHEN es > 0 THEN (ls - es) / es ELSE 0.0 END)"),
        "buy_count_accel_pct": ("d", "max(CASE WHEN en > 0 THEN (ln - en) / en ELSE 0.0 END)"),
    }, "halves"),
    "a9_top10_buy_timing": (["""big AS (
      SELECT *, row_number() OVER (PARTITION BY mint_address, age ORDER BY v DESC, f) AS rk FROM (
        SELECT mint_address, age, wallet, sum(sol_amount) AS v, min(seq) AS f FROM seen WHERE is_buy = 1 GROUP BY ALL))""",
        """big_buys AS (SELECT s.mint_address, s.age, s.secs FROM seen s JOIN big b USING (mint_address, age, wallet) WHERE rk <= 10 AND is_buy = 1)"""], {
        "top10_buy_timing_std_sec": ("d", "stddev_pop(secs)"),
    }, "big_buys"),
    "a10_creator_activity": ([], {
        "creator_buys_post_launch": ("i", "count(*) FILTER (wallet = creator_wallet AND is_buy = 1)"),
        "creator_sells_post_launch": ("i", "count(*) FILTER (wallet = creator_wallet AND is_buy = 0)"),
    }, "seen"),
    "a11_volatility": (["""rets AS (
      SELECT mint_address, age, (price_sol - prev) / prev AS ret FROM (
        SELECT *, lag(price_sol) OVER (PARTITION BY mint_address, age ORDER BY seq) AS prev FROM seen) WHERE price_sol > 0 AND prev > 0)"""], {
        "volatility_pct": ("d", "CASE WHEN count(*) >= 2 THEN stddev_pop(ret) END"),
    }, "rets"),
    "a12_wallet_skill_features": ([PAIRS, STATS, """skilled AS (
      SELECT DISTINCT s.mint_address, s.age, s.is_buy, s.wallet, w.skill_score AS k, w.median_hold_sec AS h
      FROM seen s JOIN wallet_stats w USING (wallet) WHERE is_high_freq = 0 AND is_flipper = 0 AND is_unprofitable = 0)"""], {
        **{f"top_{s}_skill_p90": ("d", f"(list_sort(list(k) FILTER (is_buy = {b})))[least(cast(floor(0.9::double * count(*) FILTER (is_buy = {b})) AS int), count(*) FILTER (is_buy = {b}) - 1) + 1]")
           for s, b in (("buyer", 1), ("seller", 0))},
        "smart_buyer_count": ("i", "count(*) FILTER (is_buy = 1 AND k >= 2)"), "whale_buyer_count": ("i", "count(*) FILTER (is_buy = 1 AND k >= 5)"),
        "avg_buyer_hold_sec": ("d", "avg(h) FILTER (is_buy = 1)"), "smart_seller_count": ("i", "count(*) FILTER (is_buy = 0 AND k >= 2)"),
    }, "skilled"),
    "a13_price_state": (["""priced AS (
      SELECT s.mint_address, s.age, CASE WHEN arg_max(s.price_sol, seq) <> 0 THEN arg_max(s.price_sol, seq) ELSE max(m.last_price_sol) END AS p,
        max(s.price_sol) AS top FROM seen s JOIN mints m USING (mint_address) GROUP BY ALL)"""], {
        "last_price_sol": ("d", "max(p)"), "last_mcap_sol": ("d3", "max(p) * 1e9"), "peak_mcap_sol_so_far": ("d3", "greatest(max(top) * 1e9, max(p) * 1e9)"),
    }, "priced"),
    "w1_price_runs": (["""moves AS (
      SELECT * FROM (SELECT mint_address, age, seq, price_sol AS p, lag(price_sol) OVER q AS prev,
          first_value(price_sol) OVER q AS p0 FROM seen WINDOW q AS (PARTITION BY mint_address, age ORDER BY seq))
      WHERE p <> 0 AND prev <> 0 AND p <> prev)""", """turns AS (
      SELECT *, lag(sign(p - prev)) OVER (PARTITION BY mint_address, age ORDER BY seq) AS before FROM moves)""", """runs AS (
      SELECT mint_address, age, before, prev, coalesce(lag(prev) OVER (PARTITION BY mint_address, age ORDER BY seq), p0) AS start
      FROM turns WHERE before IS NOT NULL AND before <> sign(p - prev))"""], {
        "n_reversals_in_window": ("i", "count(*)"),
        "longest_up_run_pct": ("d", "greatest(0.0, max(CASE WHEN before > 0 AND start > 0 THEN (prev - start) / start END))"),
        "longest_down_run_pct": ("d", "least(0.0, min(CASE WHEN before < 0 AND start > 0 THEN (prev - start) / start END))"),
    }, "runs"),
    "w2_max_rolling": (["""rolls AS (
      SELECT i.mint_address, i.age, i.seq, coalesce(sum(j.sol_amount) FILTER (j.is_buy = 1), 0.0) AS b, coalesce(sum(j.sol_amount) FILTER (j.is_buy = 0), 0.0) AS s,
        count(*) FILTER (j.is_buy = 1) AS nb, count(*) FILTER (j.is_buy = 0) AS ns, count(DISTINCT j.wallet) FILTER (j.is_buy = 0) AS us
      FROM seen i JOIN seen j ON j.mint_address = i.mint_address AND j.age = i.age AND j.seq >= i.seq AND j.ts_ms <= i.ts_ms + 30000 GROUP BY ALL)"""], {
        "max_30s_buy_sol": ("d", "max(b)"), "max_30s_buy_count": ("i", "max(nb)"),
        "max_30s_buy_sell_ratio": ("d", "max(CASE WHEN s > 0 THEN b / s WHEN b > 0 THEN 99.0::double ELSE 0.0 END)"),
        "max_30s_sell_sol": ("d", "max(s)"), "max_30s_sell_count": ("i", "max(ns)"), "max_30s_unique_sellers": ("i", "max(us)"),
    }, "rolls"),
}


def shown(col: str, kind: str) -> str:
    if kind.startswith("i"):
        return f"cast(coalesce({col}, {kind[1:] or 0}) AS bigint) AS {col}"
    return f"round(coalesce({col}, 0.0), {kind[1:] or 6}) + 0.0::double AS {col}"


def family_cte(name: str) -> str:
    _, cols, src = FAMILIES[name]
    return f"f_{name} AS (SELECT mint_address, age AS snapshot_age_sec, {', '.join(f'{e} AS {c}' for c, (_, e) in cols.items())} FROM {src} GROUP BY mint_address, age)"


def family_sql(name: str) -> str:
    extra, cols, _ = FAMILIES[name]
    return t.oracle(
        f"SELECT mint_address, snapshot_age_sec, {', '.join(shown(c, k) for c, (k, _) in cols.items())} FROM g LEFT JOIN f_{name} USING (mint_address, snapshot_age_sec)",
        GRID, SEEN, *extra, family_cte(name),
    )


def base(spark, sf):
    return ops.trades_as_of(t.trades(spark, sf), t.mints(spark, sf), AGES)


def on_grid(spark, sf, fam, name):
    """Fill the (token, age) grid, order columns and types like the oracle."""
    cols = FAMILIES[name][1]
    g = ops.snapshot_grid(t.mints(spark, sf), AGES).select(*KEY)
    out = g.join(fam, KEY, "left")
    return out.select(*KEY, *[typed(c, k) for c, (k, _) in cols.items()])


def typed(c, kind):
    if kind.startswith("i"):
        return F.coalesce(F.col(c), F.lit(int(kind[1:] or 0))).cast("long").alias(c)
    return round_off_tie(F.coalesce(F.col(c), F.lit(0.0)), int(kind[1:] or 6)).alias(c)


def _register(name, build):
    @query(name, family_sql(name))
    def run(spark, sf):
        return on_grid(spark, sf, build(spark, sf), name)


_core = lambda s, sf: ops.core_features(base(s, sf), AGES)
_register("a1_flow_features", _core)
_register("a2_amount_distribution", lambda s, sf: _core(s, sf).join(ops.amount_quantiles(base(s, sf), AGES), KEY, "left"))
_register("a3_concentration", lambda s, sf: ops.wallet_features(base(s, sf), AGES))


def _snipers(s, sf):
    x = ops.wallet_features(base(s, sf), AGES).join(_core(s, sf).select(*KEY, "buy_count"), KEY)
    return x.withColumn("pct_sniper_buys", F.col("sniper_buyer_count") / F.col("buy_count")).withColumn(
        "pct_first_block_buys", F.col("first_block_buyer_count") / F.col("buy_count")
    )


_register("a4_sniper_features", _snipers)
_register("a5_buyer_rank_features", lambda s, sf: ops.wallet_features(base(s, sf), AGES))
_register("a6_seconds_to_n_buyers", lambda s, sf: ops.seconds_to_buyers(base(s, sf), ops.snapshot_grid(t.mints(s, sf), AGES)))
_register("a7_pressure_window", lambda s, sf: ops.recent_window_features(base(s, sf), AGES))
_register("a8_acceleration", lambda s, sf: ops.recent_window_features(base(s, sf), AGES))
_register("a9_top10_buy_timing", lambda s, sf: ops.wallet_features(base(s, sf), AGES))
_register("a10_creator_activity", _core)
_register("a11_volatility", lambda s, sf: ops.path_features(base(s, sf), AGES))
_register("a12_wallet_skill_features", lambda s, sf: ops.wallet_skill_features(base(s, sf), stats(s, sf), AGES))
_register("a13_price_state", lambda s, sf: ops.price_state(_core(s, sf), t.mints(s, sf)))
_register("w1_price_runs", lambda s, sf: ops.path_features(base(s, sf), AGES))
_register("w2_max_rolling", lambda s, sf: ops.rolling_features(base(s, sf), AGES))

RETURNS_SQL = t.oracle("""SELECT trade_id, mint_address, round((price_sol - prev) / prev, 6) + 0.0::double AS ret FROM (
  SELECT *, lag(price_sol) OVER (PARTITION BY mint_address ORDER BY ts_ms, trade_id) AS prev FROM trades) WHERE price_sol > 0 AND prev > 0""")

CREATOR = {
    "creator_launch_count": "(SELECT count(*) FROM mints c WHERE c.creator_wallet = m.creator_wallet AND c.created_ms < m.created_ms)",
    "creator_migrated_count": "(SELECT count(*) FROM mints c WHERE c.creator_wallet = m.creator_wallet AND c.migrated = 1 AND coalesce(c.migrated_ms, c.created_ms) < m.created_ms)",
    "seconds_since_prev_creator_death": "coalesce((SELECT cast(floor((m.created_ms - max(c.created_ms)) / 1000) AS bigint) FROM mints c WHERE c.creator_wallet = m.creator_wallet AND c.created_ms < m.created_ms), -1)",
    "creator_recent_launch_siblings": "(SELECT count(*) - 1 FROM mints c WHERE c.creator_wallet = m.creator_wallet AND c.created_ms BETWEEN m.created_ms - {r} AND m.created_ms + {r})",
}


@query("j4_creator_history", t.oracle(f"SELECT m.mint_address, {CREATOR['creator_launch_count']} AS creator_launch_count, {CREATOR['creator_migrated_count']} AS creator_migrated_count FROM mints m"))
def _(spark, sf):
    return creators.creator_history(t.mints(spark, sf))


@query("j5_creator_stats_unbounded", t.oracle(f"""
SELECT m.mint_address, count(*) OVER (PARTITION BY creator_wallet) - 1 AS creator_launch_count,
  cast(sum(migrated) OVER (PARTITION BY creator_wallet) AS bigint) AS creator_migrated_count,
  {CREATOR['seconds_since_prev_creator_death']} AS seconds_since_prev_creator_death FROM mints m"""))
def _(spark, sf):
    return creators.creator_stats_unbounded(t.mints(spark, sf))


@query("j6_creator_siblings", t.oracle(f"SELECT m.mint_address, {CREATOR['creator_recent_launch_siblings'].format(r=2000)} AS creator_recent_launch_siblings FROM mints m"))
def _(spark, sf):
    return creators.creator_siblings(t.mints(spark, sf), radius_ms=2000)


STATIC_COLS = """round(initial_buy_sol, 6) AS initial_buy_sol,
  (twitter <> '')::int AS has_twitter, (telegram <> '')::int AS has_telegram, (website <> '')::int AS has_website,
  length(name)::int AS name_length, length(symbol)::int AS symbol_length, (created_ms // 3600000 % 24)::int AS created_hour_utc"""


@query("f5_static_features", t.oracle(f"""SELECT mint_address, {STATIC_COLS},
  dayofweek(epoch_ms(created_ms))::int AS created_dow, (isodow(epoch_ms(created_ms)) - 1)::int AS created_dow_monday FROM mints"""))
def _(spark, sf):
    m = t.mints(spark, sf)
    monday = ops.static_features(m, monday_first=True).select("mint_address", F.col("created_dow").alias("created_dow_monday"))
    return rounded(ops.static_features(m).join(monday, "mint_address"))


@query("w11_hhi_delta", t.oracle("""
SELECT mint_address, snapshot_age_sec, round(coalesce(b - lag(b) OVER w, 0.0), 6) + 0.0::double AS buyer_hhi_delta, round(coalesce(s - lag(s) OVER w, 0.0), 6) + 0.0::double AS seller_hhi_delta
FROM (SELECT mint_address, snapshot_age_sec, coalesce(buyer_hhi, 0.0) AS b, coalesce(seller_hhi, 0.0) AS s FROM g LEFT JOIN f_a3_concentration USING (mint_address, snapshot_age_sec))
WINDOW w AS (PARTITION BY mint_address ORDER BY snapshot_age_sec)""", GRID, SEEN, *FAMILIES["a3_concentration"][0], family_cte("a3_concentration")))
def _(spark, sf):
    g = ops.snapshot_grid(t.mints(spark, sf), AGES).select(*KEY)
    f = g.join(ops.wallet_features(base(spark, sf), AGES).select(*KEY, "buyer_hhi", "seller_hhi"), KEY, "left").fillna(0)
    return rounded(ops.hhi_delta(f).drop("buyer_hhi", "seller_hhi"))


@query("j1_trades_as_of", t.oracle("SELECT mint_address, age AS snapshot_age_sec, trade_id, ts_ms, secs FROM seen", SEEN))
def _(spark, sf):
    return ops.over_ages(base(spark, sf), AGES).select(*KEY, "trade_id", "ts_ms", "secs")


@query("j2_tag_wallets", t.oracle("""SELECT trade_id, wallet, coalesce(tracked, 0) AS tracked, coalesce(is_kol, 0) AS is_kol, coalesce(bundle_cluster_id, '') AS bundle_cluster_id
FROM trades LEFT JOIN wallets ON address = wallet"""))
def _(spark, sf):
    from launchlens.operators.joins import tag_wallets

    return tag_wallets(t.trades(spark, sf), t.wallets(spark, sf)).select("trade_id", "wallet", "tracked", "is_kol", "bundle_cluster_id")


@query("j3_join_wallet_skill", t.oracle("""SELECT DISTINCT x.mint_address, x.wallet, x.is_buy, round(w.skill_score, 6) AS skill_score, round(w.median_hold_sec, 6) AS median_hold_sec
FROM trades x JOIN wallet_stats w USING (wallet) WHERE is_high_freq = 0 AND is_flipper = 0 AND is_unprofitable = 0""", PAIRS, STATS))
def _(spark, sf):
    from launchlens.operators.joins import join_wallet_skill

    return rounded(join_wallet_skill(t.trades(spark, sf), stats(spark, sf)))


MOMENTS = [60, 120, 300, 600]


@query("a15_offline_snapshot", t.oracle(f"""
SELECT s.mint_address, s.age AS decision_moment_sec, max(s.cutoff) AS snapshot_ts, max(st.initial_buy_sol) AS initial_buy_sol,
  max(cr.creator_launch_count) AS creator_launch_count, max(cr.creator_migrated_count) AS creator_migrated_count,
  max(st.has_twitter) AS has_twitter, max(st.has_telegram) AS has_telegram, max(st.has_website) AS has_website,
  max(st.name_length) AS name_length, max(st.symbol_length) AS symbol_length, max(st.created_hour_utc) AS created_hour_utc, max(st.dow) AS created_dow,
  s.age AS age_sec, round(arg_max(s.price_sol, seq), 6) AS last_price_sol, round(arg_max(s.market_cap_sol, seq), 3) AS last_mcap_sol,
  round(max(s.market_cap_sol), 3) AS peak_mcap_sol_so_far, round(max(s.price_sol), 6) AS peak_price_so_far,
  round(coalesce(sum(sol_amount) FILTER (is_buy = 1), 0.0), 6) AS sol_inflow, round(coalesce(sum(sol_amount) FILTER (is_buy = 0), 0.0), 6) AS sol_outflow,
  count(*) FILTER (is_buy = 1) AS buy_count, count(*) FILTER (is_buy = 0) AS sell_count,
  round(CASE WHEN count(*) FILTER (is_buy = 0) > 0 THEN count(*) FILTER (is_buy = 1) / count(*) FILTER (is_buy = 0) ELSE 99.0::double END, 6) AS buy_sell_ratio,
  count(DISTINCT wallet) FILTER (is_buy = 1) AS unique_buyers, count(DISTINCT wallet) FILTER (is_buy = 1 AND tracked = 1) AS tracked_buyers,
  count(DISTINCT wallet) FILTER (is_buy = 1 AND is_kol = 1) AS kol_buyers, count(DISTINCT wallet) FILTER (is_buy = 1 AND bundle_cluster_id <> '') AS bundle_buyers,
  count(*) AS trade_count, round(count(*) / greatest(1.0::double, s.age / 60), 6) AS trades_per_min
FROM offline s JOIN wallets w ON w.address = s.wallet
JOIN (SELECT mint_address, {STATIC_COLS}, (isodow(epoch_ms(created_ms)) - 1)::int AS dow FROM mints) st USING (mint_address)
JOIN (SELECT m.mint_address, {CREATOR['creator_launch_count']} AS creator_launch_count, {CREATOR['creator_migrated_count']} AS creator_migrated_count FROM mints m) cr USING (mint_address)
GROUP BY s.mint_address, s.age""", f"""offline AS (SELECT a.age, m.created_ms + a.age * 1000 AS cutoff, t.*,
  row_number() OVER (PARTITION BY t.mint_address, a.age ORDER BY t.ts_ms, t.trade_id) AS seq
  FROM mints m, (SELECT unnest({MOMENTS}) AS age) a, trades t WHERE t.mint_address = m.mint_address AND t.ts_ms <= m.created_ms + a.age * 1000)"""))
def _(spark, sf):
    out = ops.offline_snapshot(t.trades(spark, sf), t.mints(spark, sf), t.wallets(spark, sf), MOMENTS)
    return rounded(out.withColumn("last_mcap_sol", F.round("last_mcap_sol", 3)).withColumn("peak_mcap_sol_so_far", F.round("peak_mcap_sol_so_far", 3)))


_WIDE = {c: k for _, (_, cols, _) in FAMILIES.items() for c, (k, _) in cols.items()}
_WIDE_ORACLE = t.oracle(
    "SELECT mint_address, snapshot_age_sec, cutoff AS snapshot_ts, "
    + ", ".join(shown(c, k) for c, k in _WIDE.items())
    + ", " + STATIC_COLS + ", dayofweek(epoch_ms(created_ms))::int AS created_dow, migrated, round(v_sol_in_curve, 6) AS v_sol_in_curve, "
    + ", ".join(f"{e.format(r=3600000).replace('m.', 'gm.')} AS {c}" for c, e in CREATOR.items())
    + ", " + ", ".join(f"{v} AS {c}" for c, v in ops.PLACEHOLDERS.items())
    + ", 'unknown' AS network_status, 0.0::double AS buyer_hhi_delta, 0.0::double AS seller_hhi_delta"
    + " FROM (SELECT *, age AS snapshot_age_sec FROM grid) gm "
    + " ".join(f"LEFT JOIN (SELECT * FROM f_{n}) USING (mint_address, snapshot_age_sec)" for n in FAMILIES),
    SEEN, *dict.fromkeys(x for extra, _, _ in FAMILIES.values() for x in extra), *[family_cte(n) for n in FAMILIES],
)


# the token row also has last_price_sol: take the snapshot's
_WIDE_ORACLE = _WIDE_ORACLE.replace("(SELECT *, age AS snapshot_age_sec FROM grid) gm", "(SELECT * EXCLUDE (last_price_sol, trade_count), age AS snapshot_age_sec FROM grid) gm")


def snapshots(spark, sf, **kw):
    return ops.snapshot_features(t.trades(spark, sf), t.mints(spark, sf), stats(spark, sf), AGES, **kw)


@query("a14_snapshot_features", _WIDE_ORACLE)
def _(spark, sf):
    out = snapshots(spark, sf)
    return out.select(
        *KEY, "snapshot_ts", *[typed(c, k) for c, k in _WIDE.items()],
        *[c for c in out.columns if c not in _WIDE and c not in KEY and c not in ("snapshot_ts", "initial_buy_sol")],
        round_off_tie(F.col("initial_buy_sol")).alias("initial_buy_sol"),
    )


@query("w3_returns", RETURNS_SQL)
def _(spark, sf):
    from launchlens.operators.joins import trade_returns

    return rounded(trade_returns(t.trades(spark, sf)))
