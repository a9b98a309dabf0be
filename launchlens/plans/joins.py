"""Filter and join queries."""

from pyspark.sql import functions as F

from launchlens.functions import rounded
from launchlens.operators import filters, joins as ops
from launchlens.plans import query
from launchlens.sources import tables as t

NOW = 300_000
SNAPS = f"snaps AS (SELECT mint_address, age AS snapshot_age_sec, cutoff AS snapshot_ts FROM grid WHERE cutoff <= {NOW})"


def snaps(spark, sf, now=NOW):
    from launchlens.operators.features import snapshot_grid

    return snapshot_grid(t.mints(spark, sf), t.AGES, now).withColumnRenamed("cutoff_ms", "snapshot_ts")


F1_SQL = f"SELECT mint_address, created_ms FROM mints WHERE created_ms > {NOW} - 390000 AND created_ms < {NOW} - 5000 AND rugged = 0 AND name IS NOT NULL AND trade_count >= 20"


@query("f1_snapshot_candidates", t.oracle(F1_SQL))
def _(spark, sf):
    return filters.snapshot_candidates(t.mints(spark, sf), NOW, [5, 15, 30, 60, 120, 300]).select("mint_address", "created_ms")


@query("f2_due_snapshots", t.oracle(f"""SELECT c.mint_address, a.age AS snapshot_age_sec FROM ({F1_SQL}) c, ages a
WHERE ({NOW} - created_ms) / 1000.0 >= a.age AND ({NOW} - created_ms) / 1000.0 <= a.age + 90 AND NOT (a.age = CASE WHEN c.mint_address % 2 = 0 THEN 300 ELSE 120 END)"""))
def _(spark, sf):
    m = t.mints(spark, sf)
    cand = filters.snapshot_candidates(m, NOW, [5, 15, 30, 60, 120, 300])
    have = m.select("mint_address", F.when(F.col("mint_address") % 2 == 0, 300).otherwise(120).alias("snapshot_age_sec"))
    return filters.due_snapshots(cand, have, NOW, t.AGES)


@query("f3_entry_candidates", t.oracle(f"""
SELECT mint_address, created_ms, round(last_price_sol, 6) AS last_price_sol FROM mints m WHERE created_ms > 0 AND created_ms < {t.AS_OF_MS} - 180000 AND rugged = 0 AND migrated = 0
  AND last_price_sol > 0 AND last_price_sol < 1000 AND current_market_cap_sol >= 15 AND name IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM positions p WHERE p.mint_address = m.mint_address AND p.status = 'open')
  AND NOT EXISTS (SELECT 1 FROM positions p WHERE p.mint_address = m.mint_address AND p.status = 'closed' AND p.exited_ms > {t.AS_OF_MS} + 20000)
  AND EXISTS (SELECT 1 FROM snaps s WHERE s.mint_address = m.mint_address) ORDER BY created_ms DESC, mint_address LIMIT 16""", SNAPS))
def _(spark, sf):
    out = filters.entry_candidates(
        t.mints(spark, sf), t.positions(spark, sf), snaps(spark, sf), t.AS_OF_MS, cooldown_ms=-20_000,
        age_ms=(180_000, t.AS_OF_MS), max_price=1000.0,
    )
    return rounded(out.select("mint_address", "created_ms", "last_price_sol"))


@query("f4_needs_scoring", t.oracle(f"""
SELECT s.mint_address, max(s.snapshot_ts) AS snapshot_ts FROM snaps s JOIN mints m USING (mint_address)
WHERE m.created_ms > {NOW} - 1800000 AND m.rugged = 0 AND m.trade_count >= 20
  AND NOT EXISTS (SELECT 1 FROM predictions p WHERE p.mint_address = s.mint_address AND p.ts_ms > {NOW} - 8000 AND p.ts_ms <= {NOW})
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 24""", SNAPS))
def _(spark, sf):
    return filters.needs_scoring(snaps(spark, sf), t.mints(spark, sf), t.predictions(spark, sf), NOW, fresh_ms=8000)


@query("f6_recent_mints", t.oracle("SELECT mint_address, created_ms FROM mints WHERE created_ms > 20000 - 18000 ORDER BY created_ms DESC, mint_address LIMIT 30"))
def _(spark, sf):
    return filters.recent_mints(t.mints(spark, sf), 20_000, 18_000, 30).select("mint_address", "created_ms")


TARGETS = """targeted AS (SELECT trade_id, CASE WHEN trade_id % 7 = 0 THEN NULL WHEN trade_id % 11 = 0 THEN 'infinity'::double ELSE sol_amount END AS y FROM trades)"""


def targeted(spark, sf):
    i = F.col("trade_id")
    y = F.when(i % 7 == 0, None).when(i % 11 == 0, F.lit(float("inf"))).otherwise(F.col("sol_amount"))
    return t.trades(spark, sf).select("trade_id", y.alias("y"))


@query("f7_clean_target", t.oracle("SELECT trade_id, y FROM targeted WHERE y IS NOT NULL AND NOT isinf(y)", TARGETS))
def _(spark, sf):
    return filters.clean_target(targeted(spark, sf), "y", regression=True)


@query("f8_cap_outliers", t.oracle("SELECT trade_id, least(sol_amount, 100.0::double) AS sol_amount, (sol_amount > 100)::int AS was_capped FROM trades"))
def _(spark, sf):
    return filters.cap_outliers(t.trades(spark, sf).select("trade_id", "sol_amount"), "sol_amount", 100.0)


@query("f10_impute_missing", t.oracle("SELECT trade_id, coalesce(y, -1.0::double) AS y FROM targeted", TARGETS))
def _(spark, sf):
    return filters.impute_missing(targeted(spark, sf), ["y"])


@query("f12_to_usd", t.oracle("SELECT mint_address, round(last_price_sol * 145, 6) AS last_price_usd, round(current_market_cap_sol * 145, 2) AS current_market_cap_usd FROM mints"))
def _(spark, sf):
    out = filters.to_usd(t.mints(spark, sf), 145.0, ["last_price_sol", "current_market_cap_sol"])
    return out.select("mint_address", F.round(F.col("last_price_usd") + 1e-9, 6).alias("last_price_usd"), F.round("current_market_cap_usd", 2).alias("current_market_cap_usd"))


@query("j7_positions_open", t.oracle("""SELECT p.id, p.mint_address, p.entered_ms, m.symbol, m.migrated, round(m.last_price_sol, 6) AS now_price
FROM positions p LEFT JOIN mints m USING (mint_address) WHERE p.status = 'open'"""))
def _(spark, sf):
    out = ops.positions_with_mint(t.positions(spark, sf), t.mints(spark, sf), "open")
    return rounded(out.select("id", "mint_address", "entered_ms", "symbol", "migrated", "now_price"))


@query("j7_positions_closed", t.oracle("""SELECT p.id, p.mint_address, p.exited_ms, p.exit_reason, m.symbol, round(realized_pnl_pct, 6) AS realized_pnl_pct
FROM positions p LEFT JOIN mints m USING (mint_address) WHERE p.status = 'closed' ORDER BY p.exited_ms DESC, p.id LIMIT 50"""))
def _(spark, sf):
    out = ops.positions_with_mint(t.positions(spark, sf), t.mints(spark, sf), "closed", 50)
    return rounded(out.select("id", "mint_address", "exited_ms", "exit_reason", "symbol", "realized_pnl_pct"))


def asof_pred(alias, at, targets, prefix="pred_"):
    return ", ".join(
        f"(SELECT arg_max(prob, p.ts_ms * 1000000000 + p.prediction_id) FROM predictions p WHERE p.mint_address = {alias}.mint_address AND p.target = '{x}' AND p.ts_ms <= {alias}.{at}) AS {prefix}{x}"
        for x in targets
    )


@query("j8_entry_predictions", t.oracle(f"SELECT o.id, {asof_pred('o', 'entered_ms', ops.POSTMORTEM_TARGETS)} FROM positions o"))
def _(spark, sf):
    return ops.predictions_as_of(t.positions(spark, sf), "id", "entered_ms", t.predictions(spark, sf), ops.POSTMORTEM_TARGETS, chunk_ms=60_000)


@query("j9_latest_prediction", t.oracle(f"SELECT mint_address, target, arg_max(prob, ts_ms * 1000000000 + prediction_id) AS prob FROM predictions WHERE ts_ms > {NOW} - 60000 AND ts_ms <= {NOW} GROUP BY 1, 2"))
def _(spark, sf):
    return ops.latest_prediction(t.predictions(spark, sf), NOW)


@query("j12_has_fresh_prediction", t.oracle(f"SELECT mint_address FROM mints m WHERE EXISTS (SELECT 1 FROM predictions p WHERE p.mint_address = m.mint_address AND ts_ms > {NOW} - 8000 AND ts_ms <= {NOW})"))
def _(spark, sf):
    return ops.with_fresh_prediction(t.mints(spark, sf), t.predictions(spark, sf), NOW, 8000).select("mint_address")


@query("j11_post_exit_trades", t.oracle("""SELECT p.id AS position_id, p.mint_address, t.trade_id, t.ts_ms, round(t.price_sol, 6) AS price_sol
FROM positions p JOIN trades t ON t.mint_address = p.mint_address AND t.ts_ms > p.exited_ms AND t.ts_ms <= p.exited_ms + 20000 AND t.price_sol > 0 WHERE p.status = 'closed'"""))
def _(spark, sf):
    closed = t.positions(spark, sf).filter("status = 'closed'")
    return rounded(ops.post_exit_trades(closed, t.trades(spark, sf), 20_000, slot_ms=10_000))


@query("j13_targets_for_backfill", t.oracle("SELECT mint_address, bonding_curve_key FROM mints WHERE mint_address IN (SELECT mint_address FROM positions WHERE status = 'open') OR created_ms > 20000 - 12000"))
def _(spark, sf):
    return ops.targets_for_backfill(t.mints(spark, sf), t.positions(spark, sf), 20_000, 12_000).select("mint_address", "bonding_curve_key")


@query("j14_incomplete_post_exit", t.oracle(f"""
SELECT id, mint_address, round(exit_price, 6) AS exit_price, exited_ms FROM positions p WHERE status = 'closed' AND exit_price > 0 AND exited_ms + 60000 <= {t.AS_OF_MS}
  AND (SELECT count(*) FROM (SELECT id, unnest(range(id % 5)) FROM positions WHERE status = 'closed') c WHERE c.id = p.id) < 4 ORDER BY exited_ms DESC, id LIMIT 120"""))
def _(spark, sf):
    p = t.positions(spark, sf)
    marks = F.explode(F.filter(F.array(*[F.lit(i) for i in range(5)]), lambda x: x < F.col("id") % 5))
    checks = p.filter("status = 'closed'").select(F.col("id").alias("position_id"), marks.alias("mark"))
    return rounded(ops.incomplete_post_exit(p, checks, t.AS_OF_MS, first_mark_min=1, n_marks=4))


@query("j15_latest_snapshot", t.oracle("SELECT mint_address, max(snapshot_ts) AS snapshot_ts, max(snapshot_age_sec) AS newest_age, min(snapshot_age_sec) AS youngest_age FROM snaps GROUP BY 1", SNAPS))
def _(spark, sf):
    s = snaps(spark, sf)
    young = ops.latest_snapshot(s, "snapshot_age_sec", newest=False).select("mint_address", F.col("snapshot_age_sec").alias("youngest_age"))
    return ops.latest_snapshot(s).select("mint_address", "snapshot_ts", F.col("snapshot_age_sec").alias("newest_age")).join(young, "mint_address")


@query("j16_price_drift", t.oracle(f"""
SELECT p.id, p.mint_address, round(CASE WHEN migrated = 0 AND last_price_sol > 0 AND rp > 0 THEN abs(rp - last_price_sol) / rp * 100 END, 6) AS drift_pct,
  (migrated = 1 AND {t.AS_OF_MS} - last_trade_ms > 5000)::int AS is_stale,
  coalesce((CASE WHEN migrated = 0 AND last_price_sol > 0 AND rp > 0 THEN abs(rp - last_price_sol) / rp * 100 END > 10)::int, 0) AS is_drift,
  round(CASE WHEN migrated = 0 AND last_price_sol > 0 AND rp > 0 AND abs(rp - last_price_sol) / rp * 100 > 10 THEN rp END, 6) AS corrected_price
FROM positions p JOIN (SELECT *, last_price_sol * (1 + (mint_address % 5) * 0.05::double) AS rp FROM mints) m USING (mint_address) WHERE p.status = 'open'"""))
def _(spark, sf):
    m = t.mints(spark, sf)
    ref = m.select("mint_address", (F.col("last_price_sol") * (1 + (F.col("mint_address") % 5) * 0.05)).alias("ref_price"))
    return rounded(ops.price_drift(t.positions(spark, sf), m, ref, t.AS_OF_MS, stale_ms=5000))


@query("j17_stack_pre_predictions", t.oracle(f"SELECT o.mint_address, {asof_pred('o', 'migrated_ms', ops.STACKED_TARGETS, 'pre_pred_')} FROM mints o WHERE migrated = 1"))
def _(spark, sf):
    moved = t.mints(spark, sf).filter("migrated = 1").withColumn("token", F.col("mint_address"))
    out = ops.predictions_as_of(moved, "token", "migrated_ms", t.predictions(spark, sf), ops.STACKED_TARGETS, "pre_pred_", chunk_ms=60_000)
    return out.withColumnRenamed("token", "mint_address")


@query("w9_rank_in_tick", t.oracle("""SELECT ts_ms, mint_address, trade_id, prob FROM (SELECT p.*, prediction_id AS trade_id, row_number() OVER (PARTITION BY ts_ms ORDER BY prob DESC, mint_address, prediction_id) AS rn FROM predictions p) WHERE rn <= 3"""))
def _(spark, sf):
    from launchlens.functions import top_rows

    p = t.predictions(spark, sf)
    return top_rows(p, ["ts_ms"], [F.col("prob").desc(), F.col("mint_address"), F.col("prediction_id")], 3).select(
        "ts_ms", "mint_address", F.col("prediction_id").alias("trade_id"), "prob"
    )
