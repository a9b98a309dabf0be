"""Label and migration-snapshot queries."""

from pyspark.sql import functions as F

from launchlens.functions import rounded
from launchlens.operators import features, ingest, labels as ops
from launchlens.plans import query
from launchlens.plans.features import FAMILIES, GRID, SEEN, family_cte
from launchlens.plans.trades import BEST
from launchlens.sources import tables as t

NOW = t.AS_OF_MS
AGES = t.AGES
# Horizons fitted to the compressed clock, in seconds.
H = {"60s": 60, "300s": 120, "10m": 150, "15m": 180, "1h": 240, "4h": 300, "24h": 360}
POST = {"5m": 60, "30m": 120, "1h": 180, "4h": 240, "24h": 300, "72h": 500}

SNAP = """snap AS (SELECT g.mint_address, g.snapshot_age_sec, f.last_price_sol AS p, f.peak_mcap_sol_so_far AS peak_mcap, coalesce(w.pressure_60_buy_pct, 0.0) AS share_before,
  m.created_ms + g.snapshot_age_sec * 1000 AS cut, m.migrated, m.migrated_ms, m.rugged_ms, m.last_trade_ms
  FROM g JOIN mints m USING (mint_address) LEFT JOIN f_a13_price_state f USING (mint_address, snapshot_age_sec) LEFT JOIN f_a7_pressure_window w USING (mint_address, snapshot_age_sec))"""
SNAP_CTES = (GRID, SEEN, *FAMILIES["a13_price_state"][0], family_cte("a13_price_state"), family_cte("a7_pressure_window"), SNAP)
FWD = """fwd AS (SELECT s.*, t.ts_ms, t.trade_id, t.price_sol, t.is_buy, t.wallet, t.ts_ms - s.cut AS d,
    greatest(s.p, max(t.price_sol) OVER (PARTITION BY s.mint_address, s.snapshot_age_sec ORDER BY t.ts_ms, t.trade_id)) AS top
  FROM snap s LEFT JOIN trades t ON t.mint_address = s.mint_address AND t.ts_ms > s.cut)"""


def _h(h):
    return f"d <= {H[h] * 1000}"


def _due(h, e):
    return f"CASE WHEN cut + {H[h] * 1000} <= {NOW} THEN {e} END"


def _flag(c):
    return f"coalesce(({c})::int, 0)"


MAX = lambda h: f"max(price_sol) FILTER ({_h(h)})"
MIN = lambda h: f"min(price_sol) FILTER ({_h(h)})"
LAST = lambda h: f"arg_max(price_sol, ts_ms * 1000000000 + trade_id) FILTER ({_h(h)})"
PEAK_TS = f"(arg_max(ts_ms, (price_sol, -ts_ms)) FILTER ({_h('24h')}))"
GAIN = "CASE WHEN p > 0 AND max(price_sol) IS NOT NULL THEN (max(price_sol) - p) / p ELSE 0.0 END"
NEXT = f"(count(*) FILTER (is_buy = 1 AND {_h('60s')}) / nullif(count(ts_ms) FILTER ({_h('60s')}), 0))"

LABELS = {
    "migrated": ("i", "migrated"),
    **{f"peaked_{k}": ("i", _flag(f"{GAIN} >= {k / 100}")) for k in (30, 100, 300, 500)}, "peak_pct_max": ("d", GAIN),
    "will_rug": ("i", _due("24h", _flag(f"rugged_ms > cut AND rugged_ms <= cut + {H['24h'] * 1000}"))),
    "will_migrate": ("i", _due("24h", _flag(f"migrated_ms > cut AND migrated_ms <= cut + {H['24h'] * 1000}"))),
    "migrates_within_15min": ("i", _due("15m", _flag(f"migrated_ms > cut AND migrated_ms <= cut + {H['15m'] * 1000}"))),
    "hits_2x_within_1h": ("i", _due("1h", _flag(f"p > 0 AND {MAX('1h')} >= 2 * p"))),
    "hits_5x_within_24h": ("i", _due("24h", _flag(f"p > 0 AND {MAX('24h')} >= 5 * p"))),
    "hits_10x_within_24h": ("i", _due("24h", _flag(f"p > 0 AND {MAX('24h')} >= 10 * p"))),
    "peak_pct_within_24h": ("d", _due("24h", f"CASE WHEN p > 0 THEN coalesce(({MAX('24h')} - p) / p, 0.0) END")),
    "local_top_60s": ("i", _due("60s", f"1 - {_flag(MAX('60s') + ' > p')}")),
    "buy_pressure_continues_60s": ("i", _due("60s", _flag(f"{NEXT} >= 0.5 AND {NEXT} >= share_before"))),
    "rug_within_5min": ("i", _due("300s", _flag(f"p > 0 AND {MIN('300s')} <= 0.3::double * p"))),
    "time_to_peak_sec": ("d", _due("24h", f"({PEAK_TS} - cut) / 1000")),
    "time_to_peak_5x_sec": ("d", _due("24h", f"(min(ts_ms) FILTER (p > 0 AND price_sol >= 5 * p AND {_h('24h')}) - cut) / 1000")),
    "peak_within_5min": ("i", _due("24h", _flag(f"{PEAK_TS} <= cut + {H['300s'] * 1000}"))),
    **{f"alive_at_{h}": ("i", _due(h, _flag(f"last_trade_ms >= cut + {H[h] * 1000} AND NOT coalesce(rugged_ms <= cut + {H[h] * 1000}, false)"))) for h in ("1h", "4h", "24h")},
    "will_die_fast": ("i", _due("10m", _flag(f"last_trade_ms <= cut + {H['10m'] * 1000}"))),
    **{n: ("d", _due(h, f"CASE WHEN p > 0 THEN coalesce({LAST(h)} / p - 1, 0.0) END")) for n, h in
       {"hold_1h_pct": "1h", "hold_4h_pct": "4h", "hold_24h_pct": "24h", "pnl_pct_60s": "60s", "pnl_pct_300s": "300s"}.items()},
    **{f"price_up_{h}": ("i", _due(h, _flag(f"p > 0 AND {LAST(h)} > p"))) for h in ("60s", "300s")},
    "drawdown_20pct_300s": ("i", _due("300s", _flag(f"p > 0 AND {MIN('300s')} <= 0.8::double * p"))),
    "drawdown_from_peak_pct": ("d", "CASE WHEN peak_mcap > 0 THEN (peak_mcap / 1e9 - p) / (peak_mcap / 1e9) * 100 END"),
    "max_drawdown_within_24h_pct": ("d", _due("24h", f"coalesce(min(price_sol / top - 1) FILTER (top > 0 AND {_h('24h')}), 0.0)")),
    "unique_buyers_next_60s": ("i", _due("60s", f"count(DISTINCT wallet) FILTER (is_buy = 1 AND {_h('60s')})")),
    "unique_sellers_next_60s": ("i", _due("60s", f"count(DISTINCT wallet) FILTER (is_buy = 0 AND {_h('60s')})")),
    "labels_resolved_at": ("i", f"CASE WHEN cut + {H['24h'] * 1000} <= {NOW} THEN cut + {H['24h'] * 1000} END"),
}
DURABLE = f"""durable AS (SELECT mint_address, snapshot_age_sec, avg((c >= p)::int) AS v FROM (
  SELECT mint_address, snapshot_age_sec, max(p) AS p, arg_max(price_sol, ts_ms * 1000000000 + trade_id) AS c FROM fwd WHERE {_h('300s')} GROUP BY mint_address, snapshot_age_sec, (d - 1) // 10000) GROUP BY 1, 2)"""


def _shown(name):
    kind, e = LABELS[name]
    return f"cast({e} AS bigint) AS {name}" if kind == "i" else f"round({e}, 6) + 0.0::double AS {name}"


GROUPING = "GROUP BY mint_address, snapshot_age_sec, p, peak_mcap, share_before, cut, migrated, migrated_ms, rugged_ms, last_trade_ms"


def labels_sql(names):
    with_dur = "pump_durability_5min" in names
    names = [n for n in names if n != "pump_durability_5min"]
    body = f"SELECT mint_address, snapshot_age_sec, cut, {', '.join(_shown(n) for n in names)} FROM fwd {GROUPING}"
    if with_dur:
        dur = _due("300s", "coalesce(v, 0.0)")
        body = f"SELECT x.* EXCLUDE (cut), round({dur}, 6) AS pump_durability_5min FROM ({body}) x LEFT JOIN durable USING (mint_address, snapshot_age_sec)"
        return t.oracle(body, *SNAP_CTES, FWD, DURABLE)
    return t.oracle(f"SELECT * EXCLUDE (cut) FROM ({body})", *SNAP_CTES, FWD)


def snapshot_inputs(spark, sf):
    tr, m = t.trades(spark, sf), t.mints(spark, sf)
    b = features.trades_as_of(tr, m, AGES)
    state = features.price_state(features.core_features(b, AGES), m).select(*features.KEY, "last_price_sol", "peak_mcap_sol_so_far")
    g = features.snapshot_grid(m, AGES).select(*features.KEY)
    return g.join(state, features.KEY, "left").join(features.recent_window_features(b, AGES), features.KEY, "left")


def resolved(spark, sf):
    return ops.resolve_labels(snapshot_inputs(spark, sf), t.trades(spark, sf), t.mints(spark, sf), NOW, AGES, H, chunk_ms=60_000)


def _register(key, names):
    @query(key, labels_sql(names))
    def run(spark, sf):
        out = rounded(resolved(spark, sf).select(*features.KEY, *names))
        ints = {n for n in names if LABELS.get(n, ("d",))[0] == "i"}
        return out.select(*[F.col(c).cast("long").alias(c) if c in ints else F.col(c) for c in out.columns])


ALL = [*LABELS, "pump_durability_5min"]
_register("l1_peaked", ["peaked_30", "peaked_100", "peaked_300", "peaked_500", "peak_pct_max"])
_register("l2_migrated", ["migrated"])
_register("l4_will_rug", ["will_rug"])
_register("l5_will_migrate", ["will_migrate", "migrates_within_15min"])
_register("l6_hits_multiples", ["hits_2x_within_1h", "hits_5x_within_24h", "hits_10x_within_24h"])
_register("l7_peak_within_24h", ["peak_pct_within_24h"])
_register("l8_local_top", ["local_top_60s"])
_register("l9_buy_pressure_continues", ["buy_pressure_continues_60s"])
_register("l10_rug_within_5min", ["rug_within_5min"])
_register("l11_time_to_peak", ["time_to_peak_sec", "time_to_peak_5x_sec", "peak_within_5min"])
_register("l12_alive", ["alive_at_1h", "alive_at_4h", "alive_at_24h", "will_die_fast"])
_register("l13_hold_returns", ["hold_1h_pct", "hold_4h_pct", "hold_24h_pct", "pnl_pct_60s", "pnl_pct_300s", "price_up_60s", "price_up_300s"])
_register("l14_drawdowns", ["drawdown_20pct_300s", "drawdown_from_peak_pct", "max_drawdown_within_24h_pct"])
_register("l15_next_minute_wallets", ["unique_buyers_next_60s", "unique_sellers_next_60s"])
_register("l16_pump_durability", ["local_top_60s", "pump_durability_5min"])
_register("l0_resolve_labels", ALL)


@query("l3_detect_rugs", t.oracle(f"""
SELECT mint_address, min(ts_ms) + 20000 AS rugged_ms FROM (
  SELECT mint_address, ts_ms, price_sol, max(price_sol) OVER w AS peak, lead(ts_ms) OVER w AS nxt FROM trades WHERE price_sol > 0 WINDOW w AS (PARTITION BY mint_address ORDER BY ts_ms, trade_id))
WHERE price_sol <= (1 - 0.85::double) * peak AND coalesce(nxt, {NOW}) - ts_ms > 20000 GROUP BY 1"""))
def _(spark, sf):
    return ops.detect_rugs(t.trades(spark, sf), NOW, quiet_ms=20_000, chunk_ms=60_000)


def _p(h, inner):
    return f"CASE WHEN t0 + {POST[h] * 1000} <= {NOW} THEN {inner} END"


def _w(h):
    return f"FILTER (d <= {POST[h] * 1000})"


POST_SQL = {
    "post_mig_peak_mcap_sol": ("d2", _p("24h", f"coalesce(max(price_sol) {_w('24h')}, 0.0) * 1e9")),
    **{n: ("d", _p(h, f"CASE WHEN p > 0 THEN coalesce((max(price_sol) {_w(h)} - p) / p, 0.0) END")) for n, h in
       {"post_mig_peak_pct": "24h", "post_mig_peak_pct_30m": "30m", "post_mig_peak_pct_1h": "1h", "post_mig_peak_pct_4h": "4h", "post_mig_peak_pct_24h": "24h"}.items()},
    **{n: ("i", _p(h, _flag(f"p > 0 AND max(price_sol) {_w(h)} >= {k}::double * p"))) for n, h, k in [
        ("post_mig_hits_2x", "24h", 2), ("post_mig_hits_5x", "24h", 5), ("post_mig_hits_10x", "24h", 10), ("post_mig_hits_130pct_4h", "4h", 2.3),
        ("post_mig_hits_186pct_4h", "4h", 2.86), ("post_mig_hits_50pct_30m", "30m", 1.5), ("post_mig_hits_100pct_1h", "1h", 2),
        ("post_mig_hits_30x_24h", "24h", 30), ("post_mig_hits_100x_24h", "24h", 100)]},
    **{n: ("i", _p(h, _flag(f"p > 0 AND min(price_sol) {_w(h)} <= {k}::double * p"))) for n, h, k in [
        ("post_mig_drawdown_50_5min", "5m", 0.5), ("post_mig_drawdown_50_30min", "30m", 0.5), ("post_mig_drawdown_30_5min", "5m", 0.7)]},
    "post_mig_rugs_1h": ("i", _p("1h", _flag(f"rugged_ms > t0 AND rugged_ms <= t0 + {POST['1h'] * 1000}"))),
    **{f"post_mig_alive_{h}": ("i", _p(h, _flag(f"last_trade_ms >= t0 + {POST[h] * 1000} AND NOT coalesce(rugged_ms <= t0 + {POST[h] * 1000}, false)"))) for h in ("1h", "4h", "24h", "72h")},
    "post_mig_time_to_peak_min": ("d", _p("24h", f"((arg_max(ts_ms, (price_sol, -ts_ms)) {_w('24h')}) - t0) / 60000")),
    "post_mig_volume_24h_usd": ("d", _p("24h", f"coalesce(sum(sol_amount) {_w('24h')}, 0.0) * 145")),
    "post_mig_hits_1m_usd": ("i", _p("24h", _flag(f"max(price_sol) {_w('24h')} * 1e9 * 145 >= 1e6"))),
}
MIG = """mig AS (SELECT m.mint_address, m.migrated_ms AS t0, m.rugged_ms, m.last_trade_ms, (SELECT arg_max(price_sol, x.ts_ms * 1000000000 + x.trade_id) FROM trades x WHERE x.mint_address = m.mint_address AND x.ts_ms <= m.migrated_ms) AS p
  FROM mints m WHERE migrated = 1)"""


@query("l17_post_migration_labels", t.oracle(
    "SELECT x.mint_address, t0 AS migrated_ms, " + ", ".join(
        f"cast({e} AS bigint) AS {n}" if k == "i" else f"round({e}, {k[1:] or 6}) + 0.0::double AS {n}" for n, (k, e) in POST_SQL.items())
    + ", (SELECT max(liquidity_usd) FROM pairs_feed f WHERE f.mint_address = x.mint_address) AS post_mig_max_liquidity_usd"
    + " FROM (SELECT mig.*, t.ts_ms, t.trade_id, t.price_sol, t.sol_amount, t.ts_ms - t0 AS d FROM mig LEFT JOIN trades t ON t.mint_address = mig.mint_address AND t.ts_ms > t0) x"
    + " GROUP BY x.mint_address, t0, p, rugged_ms, last_trade_ms", MIG))
def _(spark, sf):
    out = ops.post_migration_labels(t.trades(spark, sf), t.mints(spark, sf), NOW, POST, 145.0, t.pairs_feed(spark, sf), chunk_ms=60_000)
    cols = []
    for c in out.columns:
        kind = POST_SQL.get(c, ("",))[0]
        cols.append(F.col(c).cast("long").alias(c) if kind == "i" else F.round(c, 2).alias(c) if kind == "d2" else F.round(F.col(c) + 1e-9, 6).alias(c) if kind == "d" else F.col(c))
    return out.select(*cols)


MIG_AGES = [0, 1, 2, 4, 8]
MIG_SNAP_SQL = f"""
SELECT g.mint_address, g.t0 AS migrated_ms, g.age AS snapshot_age_min, g.cut AS snapshot_ts, round(coalesce(n.price, g.p), 6) AS current_price_sol, round(coalesce(n.price, g.p) * 1e9, 2) AS current_mcap_sol,
  coalesce(w.b, 0) AS window_buys, coalesce(w.s, 0) AS window_sells, coalesce(w.u, 0) AS window_unique_buyers, coalesce(w.tb, 0) AS window_tracked_buyers, coalesce(w.kb, 0) AS window_kol_buyers,
  round(coalesce(n.price, g.p) / g.p - 1, 6) + 0.0::double AS pct_from_migration, round(greatest(0.0, coalesce(n.hi, 0.0) / g.p - 1), 6) AS peak_pct_so_far,
  round((g.t0 - g.created_ms) / 60000, 6) AS pre_mig_age_min, round(b.peak, 2) AS pre_mig_peak_mcap_sol, b.u AS pre_mig_unique_buyers, b.n AS pre_mig_trade_count, b.nb AS pre_mig_buy_count, b.ns AS pre_mig_sell_count,
  b.tb AS pre_mig_tracked_buyers, b.kb AS pre_mig_kol_buyers, b.bb AS pre_mig_bundle_buyers, round(CASE WHEN b.ns > 0 THEN b.nb / b.ns WHEN b.nb > 0 THEN 99.0 ELSE 0.0 END, 6) AS pre_mig_buy_sell_ratio,
  round(coalesce(v.v, 0.0), 6) AS pre_mig_volatility_pct, l.liquidity_usd
FROM mgrid g
LEFT JOIN (SELECT g.mint_address, g.age, arg_max(t.price_sol, t.ts_ms * 1000000000 + t.trade_id) AS price, max(t.price_sol) AS hi FROM mgrid g JOIN trades t ON t.mint_address = g.mint_address AND t.ts_ms > g.t0 AND t.ts_ms <= g.cut GROUP BY 1, 2) n USING (mint_address, age)
LEFT JOIN (SELECT g.mint_address, g.age, count(*) FILTER (is_buy = 1) AS b, count(*) FILTER (is_buy = 0) AS s, count(DISTINCT wallet) FILTER (is_buy = 1) AS u, count(DISTINCT wallet) FILTER (is_buy = 1 AND tracked = 1) AS tb,
    count(DISTINCT wallet) FILTER (is_buy = 1 AND is_kol = 1) AS kb FROM mgrid g JOIN trades t ON t.mint_address = g.mint_address AND t.ts_ms > g.prev AND t.ts_ms <= g.cut AND t.ts_ms > g.t0 JOIN wallets ON address = wallet GROUP BY 1, 2) w USING (mint_address, age)
LEFT JOIN (SELECT g.mint_address, max(market_cap_sol) AS peak, count(*) AS n, count(*) FILTER (is_buy = 1) AS nb, count(*) FILTER (is_buy = 0) AS ns, count(DISTINCT wallet) FILTER (is_buy = 1) AS u, count(DISTINCT wallet) FILTER (is_buy = 1 AND tracked = 1) AS tb,
    count(DISTINCT wallet) FILTER (is_buy = 1 AND is_kol = 1) AS kb, count(DISTINCT wallet) FILTER (is_buy = 1 AND bundle_cluster_id <> '') AS bb
  FROM mig g JOIN trades t ON t.mint_address = g.mint_address AND t.ts_ms <= g.t0 JOIN wallets ON address = wallet GROUP BY 1) b USING (mint_address)
LEFT JOIN (SELECT mint_address, stddev_pop(r) AS v FROM (SELECT t.mint_address, (price_sol - lag(price_sol) OVER w) / lag(price_sol) OVER w AS r, price_sol, lag(price_sol) OVER w AS prev FROM mig g JOIN trades t ON t.mint_address = g.mint_address AND t.ts_ms <= g.t0
  WINDOW w AS (PARTITION BY t.mint_address ORDER BY ts_ms, trade_id)) WHERE price_sol > 0 AND prev > 0 GROUP BY 1 HAVING count(*) >= 2) v USING (mint_address)
LEFT JOIN best l USING (mint_address)"""
MGRID = f"""mgrid AS (SELECT mig.*, m.created_ms, a.age, t0 + a.age * 60000 AS cut, t0 + a.prev * 60000 AS prev FROM mig JOIN mints m USING (mint_address), (SELECT age, coalesce(lag(age) OVER (ORDER BY age), age) AS prev FROM (SELECT unnest({MIG_AGES}) AS age)) a)"""


def migration_rows(spark, sf):
    pairs = ingest.best_pair(t.pairs_feed(spark, sf)).select("mint_address", "liquidity_usd")
    return ops.migration_snapshots(t.trades(spark, sf), t.mints(spark, sf), t.wallets(spark, sf), MIG_AGES, pairs)


@query("l19_migration_snapshots", t.oracle(MIG_SNAP_SQL, MIG, MGRID, BEST))
def _(spark, sf):
    cols = """mint_address migrated_ms snapshot_age_min snapshot_ts current_price_sol window_buys window_sells window_unique_buyers window_tracked_buyers window_kol_buyers pct_from_migration peak_pct_so_far
      pre_mig_age_min pre_mig_unique_buyers pre_mig_trade_count pre_mig_buy_count pre_mig_sell_count pre_mig_tracked_buyers pre_mig_kol_buyers pre_mig_bundle_buyers pre_mig_buy_sell_ratio pre_mig_volatility_pct liquidity_usd""".split()
    x = migration_rows(spark, sf).withColumn("mc", F.round("current_mcap_sol", 2)).withColumn("pk", F.round("pre_mig_peak_mcap_sol", 2))
    num = {"current_price_sol", "pct_from_migration", "peak_pct_so_far", "pre_mig_age_min", "pre_mig_buy_sell_ratio", "pre_mig_volatility_pct"}
    return x.select(*[F.round(F.col(c) + 1e-9, 6).alias(c) if c in num else F.col(c) for c in cols], F.col("mc").alias("current_mcap_sol"), F.col("pk").alias("pre_mig_peak_mcap_sol"))
