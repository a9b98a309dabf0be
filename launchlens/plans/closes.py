"""Post-mortem, calibration and what-if queries."""

from pyspark.sql import functions as F

from launchlens.functions import rounded
from launchlens.operators import closes as ops
from launchlens.operators.joins import POSTMORTEM_TARGETS, predictions_as_of
from launchlens.plans import query
from launchlens.plans.joins import asof_pred
from launchlens.sources import tables as t

NOW = t.AS_OF_MS
MARKS = [1, 2, 4, 8]

PATH = f"""path AS (SELECT p.id AS position_id, p.mint_address, k.mark AS milestone_min, p.exited_ms + k.mark * 60000 AS due_ms, p.exit_price,
    arg_max(x.price_sol, x.ts_ms * 1000000000 + x.trade_id) AS price_at_mark, max(x.price_sol) AS peak_price, count(x.trade_id) AS trades_in_win
  FROM positions p CROSS JOIN (SELECT unnest({MARKS}) AS mark) k
  LEFT JOIN trades x ON x.mint_address = p.mint_address AND x.ts_ms > p.exited_ms AND x.ts_ms <= p.exited_ms + k.mark * 60000 AND x.price_sol > 0
  WHERE p.status = 'closed' AND p.exit_price > 0 AND p.exited_ms + k.mark * 60000 <= {NOW} GROUP BY 1, 2, 3, 4, 5)"""


def path(spark, sf):
    c = t.positions(spark, sf).filter("status = 'closed'")
    return ops.post_exit_path(c, t.trades(spark, sf), NOW, MARKS, unit_ms=1000, base=4)


@query("w7_post_exit_path", t.oracle("""SELECT position_id, mint_address, milestone_min, due_ms, round(exit_price, 6) AS exit_price, round(price_at_mark, 6) AS price_at_mark, round(peak_price, 6) AS peak_price, trades_in_win,
  round((price_at_mark - exit_price) / exit_price * 100, 6) AS pct_at_mark, round((peak_price - exit_price) / exit_price * 100, 6) AS peak_pct FROM path""", PATH))
def _(spark, sf):
    return rounded(path(spark, sf))


@query("w8_post_exit_summary", t.oracle("""SELECT position_id, round(coalesce(p, 0.0), 6) AS post_exit_peak_pct,
  CASE WHEN m >= 8 THEN CASE WHEN p IS NULL THEN 'no_data' WHEN p >= 100 THEN 'moon_after' WHEN p >= 30 THEN 'ran_after' WHEN p > -30 THEN 'flat' ELSE 'dumped' END END AS post_exit_outcome
FROM (SELECT position_id, max((peak_price - exit_price) / exit_price * 100) AS p, max(milestone_min) AS m FROM path GROUP BY 1)""", PATH))
def _(spark, sf):
    return rounded(ops.post_exit_summary(path(spark, sf), last_mark=8))


@query("w10_running_drawdown", t.oracle("""SELECT mint_address, round(min(price_sol / top - 1), 6) + 0.0::double AS max_drawdown FROM (
  SELECT *, max(price_sol) OVER (PARTITION BY mint_address ORDER BY ts_ms, trade_id) AS top FROM trades WHERE price_sol > 0) GROUP BY 1"""))
def _(spark, sf):
    return rounded(ops.running_drawdown(t.trades(spark, sf), ["mint_address"], "ts_ms", "trade_id", "price_sol"))


POSTMORTEM = f"""postmortem AS (SELECT o.id AS position_id, o.mint_address, o.strategy, o.entry_score, o.predicted_peak_pct, o.highest_pct AS actual_peak_pct, o.realized_pnl_pct, o.exit_reason,
  cast(floor((o.exited_ms - o.entered_ms) / 1000) AS bigint) AS hold_duration_sec, {asof_pred('o', 'entered_ms', POSTMORTEM_TARGETS)}, o.exited_ms AS closed_ms, o.realized_pnl_sol FROM positions o WHERE status = 'closed')"""


def postmortem(spark, sf):
    return ops.postmortem(t.positions(spark, sf), t.predictions(spark, sf), chunk_ms=60_000)


@query("p11_postmortem", t.oracle("SELECT * EXCLUDE (realized_pnl_sol) REPLACE (round(realized_pnl_pct, 6) AS realized_pnl_pct, round(entry_score, 6) AS entry_score) FROM postmortem", POSTMORTEM))
def _(spark, sf):
    return postmortem(spark, sf).select("*").withColumn("realized_pnl_pct", F.round(F.col("realized_pnl_pct") + 1e-9, 6)).withColumn("entry_score", F.round(F.col("entry_score") + 1e-9, 6))


@query("a33_exit_ledger", t.oracle("""SELECT exit_reason, count(*) AS n, round(sum(realized_pnl_sol), 6) AS net_sol, round(avg(realized_pnl_pct), 6) AS avg_pct, round(max(realized_pnl_pct), 6) AS best_pct,
  round(min(realized_pnl_pct), 6) AS worst_pct, round(sum(realized_pnl_sol) / count(*), 6) AS per_trade_sol, grouping(exit_reason)::int AS is_total FROM positions WHERE status = 'closed' GROUP BY ROLLUP (exit_reason)"""))
def _(spark, sf):
    return rounded(ops.exit_ledger(t.positions(spark, sf))).withColumn("is_total", F.col("is_total").cast("int"))


BUCKET = "CASE WHEN {c} >= 0 AND {c} < 0.1 THEN 0 WHEN {c} >= 0.1 AND {c} < 0.25 THEN 1 WHEN {c} >= 0.25 AND {c} < 0.5 THEN 2 WHEN {c} >= 0.5 AND {c} < 1.01 THEN 3 END"


@query("a34_bucket_performance", t.oracle(f"""SELECT {BUCKET.format(c='pred_will_rug')} AS bucket, count(*) AS n, round(avg((realized_pnl_sol > 0)::int) * 100, 6) AS win_pct, round(avg(realized_pnl_sol), 6) AS per_trade_sol
FROM postmortem WHERE {BUCKET.format(c='pred_will_rug')} IS NOT NULL GROUP BY 1""", POSTMORTEM))
def _(spark, sf):
    c = t.positions(spark, sf).filter("status = 'closed'")
    p = predictions_as_of(c, "id", "entered_ms", t.predictions(spark, sf), ["will_rug"], chunk_ms=60_000)
    return rounded(ops.bucket_performance(c.join(p, "id"), "pred_will_rug"))


@query("a35_calibration_table", t.oracle(f"""SELECT p.target, {BUCKET.format(c='prob')} AS bucket, count(*) AS n, round(avg(prob), 6) AS mean_predicted, round(avg(actual), 6) AS actual_rate, round(avg(prob) - avg(actual), 6) + 0.0::double AS gap
FROM predictions p JOIN (SELECT mint_address, target, (last_price_sol > initial_buy_sol * CASE WHEN target = 'peaked_30' THEN 0.1::double ELSE 0.3::double END)::int AS actual FROM mints, (SELECT DISTINCT target FROM predictions)) l USING (mint_address, target) GROUP BY 1, 2"""))
def _(spark, sf):
    limit = F.when(F.col("target") == "peaked_30", 0.1).otherwise(0.3)
    labels = t.mints(spark, sf).withColumn("target", F.explode(F.array(*[F.lit(x) for x in t.PREDICTION_TARGETS]))).select(
        "mint_address", "target", (F.col("last_price_sol") > F.col("initial_buy_sol") * limit).cast("int").alias("actual")
    )
    return rounded(ops.calibration_table(t.predictions(spark, sf), labels, [0, 0.1, 0.25, 0.5, 1.01]))


@query("a36_cohort_pnl", t.oracle("""
SELECT CASE WHEN k IS NULL THEN 'unknown' WHEN k = 0 THEN '0' WHEN k <= 2 THEN '1-2' ELSE '3+' END AS cohort, count(*) AS n, round(sum(realized_pnl_sol), 6) AS net_sol, round(avg(realized_pnl_sol), 6) AS per_trade_sol
FROM (SELECT p.*, (SELECT arg_max(g.age // 30, g.cutoff) FROM grid g WHERE g.mint_address = p.mint_address AND g.cutoff <= p.entered_ms) AS k FROM positions p WHERE status = 'closed') GROUP BY 1"""))
def _(spark, sf):
    from launchlens.operators.features import snapshot_grid

    s = snapshot_grid(t.mints(spark, sf), t.AGES).select("mint_address", F.col("cutoff_ms").alias("snapshot_ts"), F.floor(F.col("snapshot_age_sec") / 30).alias("smart_buyer_count"))
    return rounded(ops.cohort_pnl(t.positions(spark, sf), s, chunk_ms=60_000))


@query("a37_slippage_table", t.oracle("""SELECT exit_reason, count(*) AS n, round(avg(highest_pct), 6) AS mean_peak_pct, round(avg(realized_pnl_pct), 6) AS mean_realized_pct, round(avg(highest_pct - realized_pnl_pct), 6) AS mean_gap_pts
FROM positions WHERE status = 'closed' GROUP BY 1"""))
def _(spark, sf):
    return rounded(ops.slippage_table(t.positions(spark, sf)))


GATES = {
    "hits_2x": [("pred_hits_2x_within_1h", ">=", 0.15)], "peaked": [("pred_peaked_100", "<=", 0.25)],
    "stacked": [("pred_hits_2x_within_1h", ">=", 0.15), ("pred_peaked_100", "<=", 0.25)],
}


@query("a39_gate_whatif", t.oracle("""
SELECT gate, count(*) AS n_before, count(*) FILTER (keep) AS n_after, count(*) FILTER (keep AND realized_pnl_sol > 0) AS wins_kept, count(*) FILTER (NOT keep AND realized_pnl_sol < 0) AS losses_removed,
  round(sum(realized_pnl_sol), 6) AS pnl_before, round(sum(realized_pnl_sol) FILTER (keep), 6) AS pnl_after, round(avg(realized_pnl_sol), 6) AS per_trade_before, round(avg(realized_pnl_sol) FILTER (keep), 6) AS per_trade_after
FROM (SELECT 'hits_2x' AS gate, coalesce(pred_hits_2x_within_1h >= 0.15, false) AS keep, realized_pnl_sol FROM postmortem UNION ALL SELECT 'peaked', coalesce(pred_peaked_100 <= 0.25, false), realized_pnl_sol FROM postmortem
  UNION ALL SELECT 'stacked', coalesce(pred_hits_2x_within_1h >= 0.15 AND pred_peaked_100 <= 0.25, false), realized_pnl_sol FROM postmortem) GROUP BY 1""", POSTMORTEM))
def _(spark, sf):
    c = t.positions(spark, sf).filter("status = 'closed'")
    p = predictions_as_of(c, "id", "entered_ms", t.predictions(spark, sf), ["hits_2x_within_1h", "peaked_100"], chunk_ms=60_000)
    return rounded(ops.gate_whatif(c.join(p, "id"), GATES))


@query("a40_ab_pnl_gap", t.oracle("""
SELECT mint_address, cast(sum(n_a) AS bigint) AS n_a, cast(sum(n_b) AS bigint) AS n_b, round(sum(pnl_a), 6) + 0.0::double AS pnl_a, round(sum(pnl_b), 6) + 0.0::double AS pnl_b, round(sum(pnl_b) - sum(pnl_a), 6) + 0.0::double AS gap_sol
FROM (SELECT mint_address, count(*) FILTER (strategy = 's0') AS n_a, count(*) FILTER (strategy = 's1') AS n_b, sum(realized_pnl_sol) FILTER (strategy = 's0') AS pnl_a, sum(realized_pnl_sol) FILTER (strategy = 's1') AS pnl_b
  FROM positions WHERE status = 'closed' GROUP BY 1) WHERE n_a > 0 AND n_b > 0 GROUP BY ROLLUP (mint_address)"""))
def _(spark, sf):
    return rounded(ops.ab_pnl_gap(t.positions(spark, sf), "s0", "s1"))


@query("a41_version_trajectory", t.oracle("""
SELECT strategy, first_close_ms, n, round(net_sol, 6) AS net_sol, round(per_trade_sol, 6) AS per_trade_sol, round(per_trade_sol - lag(per_trade_sol) OVER (ORDER BY first_close_ms, strategy), 6) AS change_per_trade
FROM (SELECT strategy, min(exited_ms) AS first_close_ms, count(*) AS n, sum(realized_pnl_sol) AS net_sol, avg(realized_pnl_sol) AS per_trade_sol FROM positions WHERE status = 'closed' GROUP BY 1)"""))
def _(spark, sf):
    return rounded(ops.version_trajectory(t.positions(spark, sf)))
