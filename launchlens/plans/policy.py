"""Scoring, sizing, exit and tuning queries."""

from pyspark.sql import functions as F

from launchlens.functions import rounded

from launchlens.operators import exits, joins, labels, policy as ops
from launchlens.plans import query
from launchlens.plans.closes import POSTMORTEM, postmortem

from launchlens.plans.wallets import PAIRS, STATS, stats
from launchlens.sources import tables as t

NOW = t.AS_OF_MS
TARGETS = [*ops.PRE_TARGETS, *ops.POST_TARGETS]

def scores(spark, sf):
    """One row of all predictions per trade, some missing; veto probabilities are kept small."""
    i = F.col("trade_id")
    small = {"will_rug": 0.2, "rug_within_5min": 0.4, "peak_within_5min": 0.7, "post_mig_rugs_1h": 0.2}
    wide = {"unique_buyers_next_60s": 20.0, "unique_sellers_next_60s": 20.0, "drawdown_from_peak_pct": 40.0}
    cols = []
    for k, n in enumerate(TARGETS):
        v = (i * (31 + 2 * k) + 17 * k) % 1000 / 1000.0 * small.get(n, wide.get(n, 1.0))
        cols.append(F.when((i + k) % 13 != 0, v).alias(n))
    mig = F.when(F.col("mint_address") % 10 == 0, 1).otherwise(0)
    return t.trades(spark, sf).select(i, "mint_address", "ts_ms", "price_sol", "sol_amount", mig.alias("migrated"), *cols)

def _score_sql():
    small = {"will_rug": 0.2, "rug_within_5min": 0.4, "peak_within_5min": 0.7, "post_mig_rugs_1h": 0.2}
    wide = {"unique_buyers_next_60s": 20.0, "unique_sellers_next_60s": 20.0, "drawdown_from_peak_pct": 40.0}
    cols = ", ".join(
        f"CASE WHEN (trade_id + {k}) % 13 <> 0 THEN (trade_id * {31 + 2 * k} + {17 * k}) % 1000 / 1000.0::double * {small.get(n, wide.get(n, 1.0))}::double END AS {n}"
        for k, n in enumerate(TARGETS)
    )
    return f"""scores AS (SELECT trade_id, mint_address, ts_ms, price_sol, sol_amount, CASE WHEN mint_address % 10 = 0 THEN 1 ELSE 0 END AS migrated, {cols} FROM trades),
z AS (SELECT trade_id, mint_address, ts_ms, price_sol, sol_amount, migrated, {', '.join(f'coalesce({n}, 0.0) AS {n}' for n in TARGETS)} FROM scores)"""

SCORES = _score_sql()
C = lambda x: f"greatest(0.0, least(1.0, {x}))"
PRE = f"""CASE WHEN will_rug > 0.12 OR rug_within_5min > 0.30 OR peak_within_5min > 0.55 OR peaked_100 < 0.05 THEN 0.0 ELSE
  (0.55 * (0.25*peaked_30 + 0.30*peaked_100 + 0.15*peaked_300 + 0.30*hits_2x_within_1h)
   + 0.30 * (0.30*buy_pressure_continues_60s + 0.20*{C('pump_durability_5min/2')} + 0.20*alive_at_1h + 0.15*alive_at_4h + 0.15*{C('(unique_buyers_next_60s-unique_sellers_next_60s)/8')})
   + 0.15 * (0.50*migrates_within_15min + 0.30*will_migrate)) * (1 - will_rug) END"""
POST = f"""CASE WHEN post_mig_rugs_1h > 0.10 THEN 0.0 ELSE (0.40*{C('post_mig_ev_with_ladder_sol*4')}
  + 0.35*(0.15*post_mig_hits_50pct_30m + 0.20*post_mig_hits_2x + 0.20*post_mig_hits_100pct_1h + 0.15*post_mig_hits_130pct_4h + 0.10*post_mig_hits_186pct_4h + 0.10*post_mig_hits_30x_24h + 0.10*post_mig_alive_4h)
  + 0.25*(0.40*{C('post_mig_peak_pct_4h/2')} + 0.30*{C('post_mig_peak_pct_24h/3')} + 0.30*{C('post_mig_peak_pct/2')})) * (1 - post_mig_rugs_1h) END"""
HOLD = f"""CASE WHEN migrated = 1 THEN 0.30*{C('post_mig_peak_pct_4h/2')} + 0.20*post_mig_hits_100pct_1h + 0.15*post_mig_hits_50pct_30m + 0.15*post_mig_alive_4h + 0.10*{C('post_mig_peak_pct_24h/3')} + 0.10*{C('unique_buyers_next_60s/20')}
  - (0.25*{C('drawdown_from_peak_pct/30')} + 0.15*post_mig_drawdown_30_5min + 0.15*post_mig_drawdown_50_5min + 0.15*post_mig_rugs_1h + 0.15*local_top_60s + 0.15*{C('unique_sellers_next_60s/20')})
 ELSE 0.25*price_up_60s + 0.15*price_up_300s + 0.20*buy_pressure_continues_60s + 0.15*peaked_100 + 0.15*alive_at_1h + 0.10*{C('unique_buyers_next_60s/15')}
  - (0.20*{C('drawdown_from_peak_pct/30')} + 0.25*local_top_60s + 0.20*drawdown_20pct_300s + 0.20*will_die_fast + 0.15*peak_within_5min + 0.15*{C('(trade_id % 6)/4')})
  + CASE WHEN drawdown_from_peak_pct < 12 THEN 0.6*(0.50*migrates_within_15min + 0.30*will_migrate) ELSE 0.0 END END"""
PEAK = f"""CASE WHEN migrated = 1 THEN CASE WHEN post_mig_peak_pct_4h IS NOT NULL THEN greatest(20.0, least(500.0, greatest(post_mig_peak_pct_4h, coalesce(post_mig_peak_pct_24h, 0.0)) * 100 * 1.1)) ELSE 60 * 1.1 END
  ELSE greatest(10.0, least(200.0, (10 + 85 * {C('coalesce(peaked_100, 0.0)')} + 35 * {C('coalesce(peaked_300, 0.0)')}) * 1.1)) END"""

def is_migrated():
    return F.col("migrated") == 1


def dbl(sql):
    """Decimal literals as doubles, so that DuckDB does not compute in decimals."""
    import re

    return re.sub(r"(?<![\w.])(\d+\.\d+)(?!::|\d)", r"\1::double", sql)

@query("p1_predicted_peak", t.oracle(dbl(f"SELECT trade_id, round({PEAK}, 6) AS predicted_peak_pct FROM scores"), SCORES))
def _(spark, sf):
    return rounded(scores(spark, sf).select("trade_id", ops.predicted_peak(is_migrated(), 1.1).alias("predicted_peak_pct")))

@query("p2_entry_score_pre", t.oracle(dbl(f"SELECT trade_id, round({PRE}, 6) AS score FROM z"), SCORES))
def _(spark, sf):
    return rounded(scores(spark, sf).select("trade_id", ops.entry_score_pre().alias("score")))

@query("p3_entry_score_post", t.oracle(dbl(f"SELECT trade_id, round({POST}, 6) AS score FROM z"), SCORES))
def _(spark, sf):
    return rounded(scores(spark, sf).select("trade_id", ops.entry_score_post().alias("score")))

@query("p4_hold_score", t.oracle(dbl(f"SELECT trade_id, round({HOLD}, 6) + 0.0 AS score FROM z"), SCORES))
def _(spark, sf):
    return rounded(scores(spark, sf).select("trade_id", ops.hold_score(is_migrated(), (F.col("trade_id") % 6).cast("double")).alias("score")))

SIZE = "greatest(0.01, least(0.10 + 0.10 * least(1.0, (score - 0.10) / (1 - 0.10)), {cash} * 0.30))"

@query("p5_position_size", t.oracle(dbl(f"SELECT trade_id, round({SIZE.format(cash='(trade_id % 40) / 40.0')}, 6) AS size FROM (SELECT trade_id, {PRE} AS score FROM z)"), SCORES))
def _(spark, sf):
    x = scores(spark, sf).withColumn("score", ops.entry_score_pre())
    return rounded(x.select("trade_id", ops.position_size(F.col("score"), F.lit(0.10), F.col("trade_id") % 40 / 40.0).alias("size")))

@query("p6_adaptive_tiers", t.oracle(dbl("""SELECT id, round(greatest(10.0, least(60.0, pp * 0.40)), 6) AS t1_trig, round(greatest(20.0, least(150.0, pp * 0.75)), 6) AS t2_trig, round(greatest(45.0, least(300.0, pp * 1.2)), 6) AS t3_trig,
  0.4 AS t1_sell, 0.3 AS t2_sell, 0.3 AS t3_sell, round(greatest(10.0, least(60.0, pp * 0.40)), 6) AS trail_arm, 20.0 AS trail_pct
FROM (SELECT id, greatest(10.0, least(300.0, predicted_peak_pct * 2 - 50)) AS pp FROM positions)""")))
def _(spark, sf):
    p = t.positions(spark, sf)
    return rounded(p.select("id", *[c.alias(n) for n, c in ops.adaptive_tiers(F.col("predicted_peak_pct") * 2 - 50).items()]))

@query("p7_select_entries", t.oracle(dbl(f"""
SELECT tick, mint_address, trade_id, round(score, 6) AS score, round(size, 6) AS size FROM (
  SELECT *, row_number() OVER (PARTITION BY tick ORDER BY trade_id) AS rn FROM (SELECT *, {SIZE.format(cash='4.0')} AS size FROM (SELECT ts_ms AS tick, mint_address, trade_id, {PRE} AS score FROM z))
  WHERE score >= 0.10 AND size >= 0.05 AND (SELECT count(*) < 100000 AND sum(entry_sol - sol_realized_so_far) < 1e6 FROM positions WHERE status = 'open' AND is_moonbag = 0)) WHERE rn <= 3"""), SCORES))
def _(spark, sf):
    s = scores(spark, sf).select(F.col("ts_ms").alias("tick"), "mint_address", "trade_id", ops.entry_score_pre().alias("score"))
    e = ops.open_exposure(t.positions(spark, sf))
    return rounded(ops.select_entries(s, e, 4.0, order="trade_id", max_open=100_000, max_exposure=1e6))

def exit_states(spark, sf):
    i = F.col("trade_id")
    return t.trades(spark, sf).select(
        i, F.when(i % 29 == 0, 1).otherwise(0).alias("rugged"), F.when(i % 7 == 0, 1).otherwise(0).alias("migrated"),
        F.when(i % 11 != 0, (i % 45).cast("double")).alias("trade_silent_min"), ((i * 37) % 160 - 50.0).alias("cur_pct"), ((i * 53) % 90).cast("double").alias("peak_pct"),
        ((i * 13) % 130).cast("double").alias("age_min"), (i % 100).alias("trade_count"),
        F.when(i % 3 == 0, F.array(F.lit("T1"))).when(i % 3 == 1, F.array(F.lit("T1"), F.lit("T2"))).otherwise(F.array().cast("array<string>")).alias("tiers_hit"),
        F.when(i % 5 != 0, F.lit(30.0)).alias("t1_trig"), F.lit(60.0).alias("t2_trig"), F.lit(90.0).alias("t3_trig"), F.lit(20.0).alias("trail_pct"),
        ((i * 19) % 100 / 100.0 - 0.5).alias("hold"),
    )

STATES = """states AS (SELECT trade_id, trade_id % 29 = 0 AS rugged, trade_id % 7 = 0 AS mig, CASE WHEN trade_id % 11 <> 0 THEN trade_id % 45 END AS quiet, (trade_id * 37) % 160 - 50.0::double AS cur,
  (trade_id * 53) % 90 AS peak, (trade_id * 13) % 130 AS age, trade_id % 100 AS n, CASE trade_id % 3 WHEN 0 THEN ['T1'] WHEN 1 THEN ['T1','T2'] ELSE []::varchar[] END AS hit, trade_id % 5 <> 0 AS tiers, (trade_id * 19) % 100 / 100.0::double - 0.5::double AS hold FROM trades)"""

@query("p8_classify_exit", t.oracle("""SELECT trade_id, CASE WHEN rugged THEN 'RUGGED' WHEN mig AND quiet > 30 THEN 'MIGRATED_NO_TRACKING' WHEN cur < -40 THEN 'HARD_STOP_-40'
  WHEN NOT mig AND peak < 10 AND age > 10 AND quiet > CASE WHEN n < 50 THEN 10 ELSE 15 END THEN 'STALE_DATA' WHEN NOT mig AND age > 60 AND peak < 5 AND abs(cur) < 15 THEN 'STALE_FLAT'
  WHEN NOT mig AND age > 90 AND peak < 10 THEN 'NO_PUMP_TIMEOUT' WHEN NOT mig AND age > 90 AND peak >= 10 AND peak < 30 AND cur < -10 THEN 'STALLED_PUMP'
  WHEN tiers AND NOT list_contains(hit, 'T1') AND cur >= 30 THEN 'T1' WHEN tiers AND NOT list_contains(hit, 'T2') AND cur >= 60 THEN 'T2' WHEN tiers AND NOT list_contains(hit, 'T3') AND cur >= 90 THEN 'T3'
  WHEN tiers AND len(hit) >= 1 AND cur < CASE WHEN peak <> 0 THEN peak ELSE cur END - 20 THEN 'TRAIL_STOP' WHEN hold < -0.15 THEN 'ML_SELL' END AS action FROM states""", STATES))
def _(spark, sf):
    return exit_states(spark, sf).select("trade_id", ops.classify_exit().alias("action"))

LADDER = exits.ExitRules("ladder", [20.0, 60.0, 200.0], [0.5, 0.3, 0.2], trail_pct=20.0, stop_loss_pct=30.0, max_hold_min=2.0)
LOCK = exits.ExitRules("lock", [20.0, 60.0, 200.0], [0.5, 0.3, 1.0], realized_lock=True, stop_loss_pct=30.0, max_hold_min=2.0)
STEPPED = exits.ExitRules("stepped", trail_steps=[[20.0, 10.0], [50.0, 15.0], [150.0, 20.0], [500.0, 25.0]], stop_loss_pct=30.0, max_hold_min=2.0)
RUNNER = exits.ExitRules("runner", [40.0, 200.0, 500.0], [0.3, 0.3, 0.4], stop_loss_pct=60.0, max_hold_min=2.0, reserve_share=0.05, reentry_dip_pct=30.0, reentry_share=0.28)

def replay(spark, sf, *rules):
    p = t.positions(spark, sf).select("id", "mint_address", "entered_ms", "entry_price", "entry_sol", "token_amount")
    return exits.replay_exits(p, t.trades(spark, sf), exits.exit_rule_sets(spark, list(rules)), NOW, tick_ms=1000)

@query("p9_replay_exits")
def _(spark, sf):
    p = t.positions(spark, sf)
    p = p.select("id", "mint_address", "entered_ms", "entry_price", "entry_sol", "token_amount", *[c.alias(n) for n, c in ops.adaptive_tiers(F.col("predicted_peak_pct")).items() if n in ("t1_trig", "t2_trig", "t3_trig", "trail_pct")])
    rules = exits.exit_rule_sets(spark, [exits.ExitRules("adaptive", max_hold_min=2.0)])
    return rounded(exits.replay_exits(p, t.trades(spark, sf), rules, NOW, tick_ms=1000))

# One take-profit, one stop, one time limit: the first barrier decides, which SQL can express.
@query("p9_first_barrier", t.oracle(f"""
SELECT id, CASE WHEN entry_price <= 0 THEN 'OPEN' WHEN hit_ms IS NOT NULL THEN CASE WHEN hit_pct < -30 THEN 'STOP_LOSS' ELSE 'TIERED_FULL' END WHEN entered_ms + 60000 <= {NOW} THEN 'TIME_EXIT' ELSE 'OPEN' END AS reason,
  CASE WHEN entry_price <= 0 THEN entered_ms WHEN hit_ms IS NOT NULL THEN hit_ms ELSE least(entered_ms + 60000, {NOW}) END AS exit_ms,
  round(CASE WHEN entry_price <= 0 OR (hit_ms IS NULL AND entered_ms + 60000 > {NOW}) THEN 0.0 ELSE greatest(0.0, token_amount * coalesce(hit_price, last_price, entry_price) * (1 - 0.01::double) - 0.0003::double) END, 6) AS realized_sol
FROM (SELECT p.id, p.entry_price, p.entered_ms, p.token_amount, min(x.ts_ms) FILTER (bar) AS hit_ms, arg_min(pct, x.ts_ms) FILTER (bar) AS hit_pct, arg_min(price, x.ts_ms) FILTER (bar) AS hit_price, arg_max(price, x.ts_ms) AS last_price
  FROM positions p LEFT JOIN (SELECT p.id, l.ts_ms, l.price, (l.price / p.entry_price - 1) * 100 AS pct, ((l.price / p.entry_price - 1) * 100 < -30 OR (l.price / p.entry_price - 1) * 100 >= 35) AS bar
    FROM positions p JOIN (SELECT mint_address, ts_ms, arg_max(price_sol, trade_id) AS price FROM trades WHERE price_sol > 0 GROUP BY 1, 2) l ON l.mint_address = p.mint_address AND l.ts_ms > p.entered_ms AND l.ts_ms <= p.entered_ms + 60000 AND l.ts_ms <= {NOW} WHERE p.entry_price > 0) x USING (id)
  GROUP BY 1, 2, 3, 4)"""))
def _(spark, sf):
    return rounded(exits.first_barrier(t.positions(spark, sf), t.trades(spark, sf), 35.0, 30.0, 60_000, NOW, tick_ms=1000))

@query("p21_exit_rule_sets")
def _(spark, sf):
    out = replay(spark, sf, LADDER, LOCK, STEPPED, RUNNER)
    return rounded(out.groupBy("rule_set", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl_sol").alias("net_sol"), F.avg("pnl_pct").alias("avg_pct")))

@query("l18_ladder_value")
def _(spark, sf):
    tr = t.trades(spark, sf)
    a = labels.migration_anchors(tr, t.mints(spark, sf))
    rules = exits.exit_rule_sets(spark, [exits.ExitRules("ladder", [130.0, 186.0], [0.5, 1.0], stop_loss_pct=50.0, max_hold_min=4.0)])
    return rounded(exits.ladder_value(tr, a, rules, NOW, 1000))

@query("p10_curve_quote", t.oracle(dbl("""SELECT trade_id, round(CASE WHEN m.migrated = 0 THEN greatest(0.0, vt - vs * vt / (vs + net)) ELSE net / price END, 6) AS tokens_out,
  round(greatest(0.0, CASE WHEN m.migrated = 0 THEN greatest(0.0, vs - vs * vt / (vt + token_amount)) ELSE token_amount * price END * (1 - 0.01) - 0.0003), 6) AS sol_out
FROM (SELECT t.trade_id, t.token_amount, greatest(0.0, t.sol_amount - 0.0003) * (1 - 0.01) AS net, t.price_sol + 0.001 AS price, m.migrated, m.v_sol_in_curve AS vs, m.v_tokens_in_curve AS vt FROM trades t JOIN mints m USING (mint_address)) m""")))
def _(spark, sf):
    m = t.mints(spark, sf).select("mint_address", "migrated", F.col("v_sol_in_curve").alias("vs"), F.col("v_tokens_in_curve").alias("vt"))
    x = t.trades(spark, sf).join(m, "mint_address")
    vs, vt, price, mig = F.col("vs"), F.col("vt"), F.col("price_sol") + 0.001, F.col("migrated")
    return rounded(x.select("trade_id", ops.curve_buy(F.col("sol_amount"), vs, vt, price, mig).alias("tokens_out"), ops.curve_sell(F.col("token_amount"), vs, vt, price, mig).alias("sol_out")))

FLOORS = "(SELECT round(0.05 + 0.025 * k, 3)::double AS f FROM (SELECT unnest(range(14)) AS k))"

@query("p12_tune_threshold", t.oracle(f"""
SELECT n_closes, n_new, best_floor, round(best_ev, 6) AS best_ev, CASE WHEN abs(t - 0.3::double) < 0.005::double THEN 0.3::double ELSE t END AS threshold, reason FROM (
  SELECT n_closes, n_new, best_floor, best_ev, CASE WHEN n_closes < 25 THEN 0.3::double WHEN best_floor IS NOT NULL THEN best_floor WHEN n_new < 5 THEN 0.3::double ELSE 0.325::double END AS t,
    CASE WHEN n_closes < 25 THEN 'few_closes' WHEN best_floor IS NOT NULL THEN 'best_ev' WHEN n_new < 5 THEN 'few_new_closes' ELSE 'step_up' END AS reason
  FROM (SELECT (SELECT count(*) FROM recent) AS n_closes, (SELECT count(*) FROM recent WHERE closed_ms > 500000) AS n_new, (SELECT min(f) FROM ev WHERE v > 0) AS best_floor, (SELECT max(v) FROM ev) AS best_ev))""",
    POSTMORTEM, f"recent AS (SELECT * FROM postmortem WHERE closed_ms > {NOW} - 604800000 ORDER BY closed_ms DESC, position_id DESC LIMIT 500)",
    f"ev AS (SELECT f, avg(realized_pnl_pct) AS v FROM {FLOORS} x, recent r WHERE round(r.entry_score, 3) >= x.f GROUP BY 1 HAVING count(*) >= 5)"))
def _(spark, sf):
    return rounded(ops.tune_threshold(postmortem(spark, sf), 0.3, NOW, last_open_ms=NOW - 1000, last_move_ms=500_000))

@query("p13_calibrate_peak", t.oracle("""
SELECT n, round(ratio, 6) AS ratio, round(CASE WHEN n < 40 OR ratio IS NULL OR abs(nxt - 1.2::double) < 0.01 THEN 1.2::double ELSE nxt END, 6) AS multiplier FROM (
  SELECT n, ratio, greatest(0.4::double, least(1.6::double, 1.2::double + 0.3::double * (greatest(0.4::double, least(1.6::double, 1.2::double * ratio)) - 1.2::double))) AS nxt FROM (
    SELECT count(*) AS n, sum(greatest(0.0, actual_peak_pct)) / sum(predicted_peak_pct) AS ratio FROM (SELECT * FROM postmortem WHERE predicted_peak_pct > 0 AND actual_peak_pct IS NOT NULL ORDER BY closed_ms DESC, position_id DESC LIMIT 1000)))""", POSTMORTEM))
def _(spark, sf):
    return rounded(ops.calibrate_peak(postmortem(spark, sf), 1.2, NOW, lookback_ms=10 * NOW))

@query("p14_normalize_exit_reason", t.oracle("SELECT id, CASE WHEN exit_reason LIKE 'HARD_STOP%' THEN 'HARD_STOP' WHEN exit_reason IS NULL OR id % 17 = 0 THEN 'ML_SELL' ELSE exit_reason END AS reason FROM (SELECT id, CASE WHEN id % 17 = 0 THEN 'manual' ELSE exit_reason END AS exit_reason FROM positions)"))
def _(spark, sf):
    r = F.when(F.col("id") % 17 == 0, "manual").otherwise(F.col("exit_reason"))
    return t.positions(spark, sf).select("id", ops.normalize_exit_reason(r).alias("reason"))

LEDGERS = """later AS (SELECT * FROM positions WHERE entered_ms <= 500000),
earlier AS (SELECT id, CASE WHEN exited_ms <= 400000 THEN 'closed' ELSE 'open' END AS was, CASE WHEN id % 8 = 0 THEN ['T1'] ELSE []::varchar[] END AS old_tiers FROM positions WHERE entered_ms <= 400000),
changes AS (SELECT l.*, e.was, coalesce(e.old_tiers, []) AS old_tiers, CASE WHEN l.exited_ms <= 500000 THEN 'closed' ELSE 'open' END AS now_status FROM later l LEFT JOIN earlier e USING (id))"""

@query("p15_position_events", t.oracle("""
SELECT id, mint_address, 'open' AS event, NULL AS reason, NULL::int AS is_notable, NULL::int AS gave_back FROM changes WHERE now_status = 'open' AND was IS NULL
UNION ALL SELECT id, mint_address, 'tier:' || unnest(list_filter(tiers_hit, lambda x: NOT list_contains(old_tiers, x))), NULL, NULL, NULL FROM changes WHERE now_status = 'open'
UNION ALL SELECT id, mint_address, 'close', CASE WHEN exit_reason LIKE 'HARD_STOP%' THEN 'HARD_STOP' ELSE exit_reason END, (abs(realized_pnl_pct) >= 5 OR highest_pct >= 30)::int, (highest_pct > 50 AND realized_pnl_pct < 20)::int
FROM changes WHERE now_status = 'closed' AND coalesce(was, 'open') = 'open'""", LEDGERS))
def _(spark, sf):
    p = t.positions(spark, sf)
    state = lambda at: F.when(F.col("exited_ms") <= at, "closed").otherwise("open")
    before = p.filter("entered_ms <= 400000").select("id", state(400_000).alias("status"), F.when(F.col("id") % 8 == 0, F.array(F.lit("T1"))).otherwise(F.array().cast("array<string>")).alias("tiers_hit"))
    return ops.position_events(before, p.filter("entered_ms <= 500000").withColumn("status", state(500_000)))

CHAIN = ("""opens AS (SELECT mint_address, entered_ms AS ts_ms, min(id) AS id FROM positions GROUP BY 1, 2)""",
    """chain AS (SELECT mint_address, min(ts_ms) AS ts_ms, arg_min(id, ts_ms) AS id FROM opens GROUP BY 1
  UNION ALL SELECT c.mint_address, n.ts_ms, n.id FROM chain c, LATERAL (SELECT ts_ms, id FROM opens o WHERE o.mint_address = c.mint_address AND o.ts_ms >= c.ts_ms + 100000 ORDER BY ts_ms LIMIT 1) n)""")

@query("p16_rate_limited_calls", t.oracle("""SELECT mint_address, ts_ms, id FROM (SELECT *, row_number() OVER (PARTITION BY ts_ms // 10000 ORDER BY ts_ms, id) AS rn FROM chain) WHERE rn <= 5""", *CHAIN).replace("WITH trades", "WITH RECURSIVE trades", 1))
def _(spark, sf):
    opens = t.positions(spark, sf).select("id", "mint_address", F.col("entered_ms").alias("ts_ms"))
    return ops.rate_limited_calls(opens, dedup_ms=100_000, window_ms=10_000, limit=5)

@query("p16_rolling_calls", t.oracle("""SELECT mint_address, ts_ms, id FROM numbered JOIN ring USING (n) WHERE ok""", *CHAIN,
    "numbered AS (SELECT *, row_number() OVER (ORDER BY ts_ms, id) AS n FROM chain)",
    """ring AS (SELECT 0::bigint AS n, []::bigint[] AS held, false AS ok
  UNION ALL SELECT c.n, CASE WHEN k < 4 THEN list_append(list_filter(held, lambda x: x >= c.ts_ms - 10000), c.ts_ms::bigint) ELSE held END, k < 4 FROM (
    SELECT c.n, c.ts_ms, r.held, len(list_filter(r.held, lambda x: x >= c.ts_ms - 10000)) AS k FROM ring r JOIN numbered c ON c.n = r.n + 1) c)""").replace("WITH trades", "WITH RECURSIVE trades", 1))
def _(spark, sf):
    opens = t.positions(spark, sf).select("id", "mint_address", F.col("entered_ms").alias("ts_ms"))
    return ops.rolling_limited_calls(opens, dedup_ms=100_000, window_ms=10_000, limit=4)

# Dedup alone has a closed form: the next call of a token is its first open at least 100 s later.
@query("p16_calls_without_cap", t.oracle("""
SELECT mint_address, ts_ms, id FROM chain""", *CHAIN).replace("WITH trades", "WITH RECURSIVE trades", 1))
def _(spark, sf):
    opens = t.positions(spark, sf).select("id", "mint_address", F.col("entered_ms").alias("ts_ms"))
    return ops.deduplicated_calls(opens, dedup_ms=100_000)

POOL = "pool AS (SELECT wallet FROM wallet_stats WHERE is_high_freq = 0 AND is_unprofitable = 0)"

@query("p17_wallet_pool_gate", t.oracle(f"SELECT mint_address, count(DISTINCT wallet) AS pool_buyers FROM trades WHERE is_buy = 1 AND ts_ms > {NOW} - 400000 AND ts_ms <= {NOW} AND wallet IN (SELECT wallet FROM pool) GROUP BY 1 HAVING count(DISTINCT wallet) >= 2", PAIRS, STATS, POOL))
def _(spark, sf):
    pool = stats(spark, sf).filter("is_high_freq = 0 AND is_unprofitable = 0")
    return ops.wallet_pool_gate(t.trades(spark, sf), pool, NOW, 400_000, 2)

@query("p18_mint_state_gate", t.oracle("SELECT trade_id, mint_address FROM trades WHERE mint_address IN (SELECT mint_address FROM mints WHERE migrated = 1)"))
def _(spark, sf):
    return ops.mint_state_gate(t.trades(spark, sf), t.mints(spark, sf), "migrated", 1).select("trade_id", "mint_address")

@query("p19_ml_gate", t.oracle(f"""SELECT mint_address, local_top_60s, hits_2x_within_1h FROM (SELECT mint_address, max(prob) FILTER (target = 'local_top_60s') AS local_top_60s, max(prob) FILTER (target = 'hits_2x_within_1h') AS hits_2x_within_1h
  FROM (SELECT mint_address, target, arg_max(prob, ts_ms * 1000000000 + prediction_id) AS prob FROM predictions WHERE ts_ms <= {NOW} GROUP BY 1, 2) GROUP BY 1) WHERE local_top_60s <= 0.25 AND hits_2x_within_1h >= 0.15"""))
def _(spark, sf):
    from launchlens.operators.closes import gate_condition

    row = joins.prediction_row(joins.latest_prediction(t.predictions(spark, sf), NOW, 10 * NOW), ["local_top_60s", "hits_2x_within_1h"])
    return row.filter(gate_condition("local_top_60s", "<=", 0.25) & gate_condition("hits_2x_within_1h", ">=", 0.15))

def _fresh(target):
    return f"(SELECT arg_max(CASE WHEN p.ts_ms > o.entered_ms - 120000 THEN prob END, p.ts_ms * 1000000000 + p.prediction_id) FROM predictions p WHERE p.mint_address = o.mint_address AND p.target = '{target}' AND p.ts_ms <= o.entered_ms AND p.ts_ms > o.entered_ms - 120000) AS {target}"

@query("p20_signal_snapshot", t.oracle(f"""
SELECT id, mint_address, entered_ms, peaked_100, hits_2x_within_1h, will_migrate, NULL::double AS will_die_fast,
  concat_ws(',', CASE WHEN peaked_100 IS NOT NULL THEN 'peaked_100:' || round(peaked_100 * 100, 0)::int END, CASE WHEN hits_2x_within_1h >= 0.05 THEN 'hits_2x_within_1h:' || round(hits_2x_within_1h * 100, 0)::int END, CASE WHEN will_migrate >= 0.05 THEN 'will_migrate:' || round(will_migrate * 100, 0)::int END) AS signals,
  (SELECT arg_max(g.age // 30, g.cutoff) FROM grid g WHERE g.mint_address = y.mint_address AND g.cutoff <= y.entered_ms) AS smart_buyer_count
FROM (SELECT o.id, o.mint_address, o.entered_ms, {_fresh('peaked_100')}, {_fresh('hits_2x_within_1h')}, {_fresh('will_migrate')} FROM positions o) y"""))
def _(spark, sf):
    from launchlens.operators.features import snapshot_grid

    z = F.lit(0.0)
    s = snapshot_grid(t.mints(spark, sf), t.AGES).select("mint_address", F.col("cutoff_ms").alias("snapshot_ts"), F.floor(F.col("snapshot_age_sec") / 30).alias("smart_buyer_count"), z.alias("whale_buyer_count"), z.alias("top_buyer_skill_p90"), z.alias("avg_buyer_hold_sec"))
    out = ops.signal_snapshot(t.positions(spark, sf), t.predictions(spark, sf), s, fresh_ms=120_000, chunk_ms=60_000)
    return out.drop("whale_buyer_count", "top_buyer_skill_p90", "avg_buyer_hold_sec").withColumn("signals", F.array_join("signals", ","))
