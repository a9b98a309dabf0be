"""Portfolio queries."""

from pyspark.sql import functions as F

from launchlens.functions import rounded
from launchlens.operators import closes as ops, market
from launchlens.plans import query
from launchlens.sources import tables as t

NOW = t.AS_OF_MS


def summary_sql(risk):
    return f"""SELECT *, round(CASE WHEN peak_total_value > 0 THEN (total_value - peak_total_value) / peak_total_value ELSE 0.0 END, 6) AS drawdown,
  round((total_value - 50.0::double) / 50.0::double, 6) AS pct_change, round(CASE WHEN total_closed > 0 THEN wins / total_closed ELSE 0.0 END, 6) AS win_rate FROM (
  SELECT *, round(greatest(60.0::double, total_value), 6) AS peak_total_value FROM (
  SELECT *, round(50.0::double + realized_pnl_sol - at_risk, 6) AS cash, round(50.0::double + realized_pnl_sol - at_risk + open_mtm, 6) AS total_value FROM (
  SELECT round(coalesce(sum(realized_pnl_sol) FILTER (status = 'closed'), 0.0), 6) AS realized_pnl_sol, count(*) FILTER (status = 'closed') AS total_closed,
    count(*) FILTER (status = 'closed' AND realized_pnl_sol > 0) AS wins, count(*) FILTER (status = 'closed' AND realized_pnl_sol < 0) AS losses, count(*) FILTER (status = 'open') AS open_positions,
    round(coalesce(sum(entry_sol) FILTER (status = 'open'), 0.0), 6) AS open_cost, round(coalesce(sum({risk}) FILTER (status = 'open'), 0.0), 6) AS at_risk,
    round(coalesce(sum(tokens_remaining * last_price_sol) FILTER (status = 'open'), 0.0), 6) AS open_mtm,
    count(*) FILTER (status = 'open' AND sol_realized_so_far >= entry_sol) AS house_money_count, round(coalesce(sum(sol_realized_so_far) FILTER (status = 'open'), 0.0), 6) AS realized_locked
  FROM positions LEFT JOIN mints USING (mint_address) WHERE entered_ms >= 100000)))"""


def summary(spark, sf, clamp):
    out = market.portfolio_summary(t.positions(spark, sf), t.mints(spark, sf), 50.0, 100_000, 60.0, clamp)
    return rounded(out)


@query("a27_portfolio_summary", t.oracle(summary_sql("entry_sol - sol_realized_so_far")))
def _(spark, sf):
    return summary(spark, sf, False)


@query("a27_portfolio_summary_clamped", t.oracle(summary_sql("greatest(0.0, entry_sol - sol_realized_so_far)")))
def _(spark, sf):
    return summary(spark, sf, True)


@query("a38_strategy_summary", t.oracle("""SELECT strategy, count(*) FILTER (realized_pnl_sol > 0) AS wins, count(*) FILTER (realized_pnl_sol < 0) AS losses, round(sum(realized_pnl_sol), 6) AS total_pnl_sol
FROM positions WHERE status = 'closed' GROUP BY 1"""))
def _(spark, sf):
    return rounded(market.strategy_summary(t.positions(spark, sf)))


@query("w4_mark_positions", t.oracle("""SELECT id, p.mint_address, round(last_price_sol, 6) AS now_price, round((last_price_sol / entry_price - 1) * 100, 6) AS unrealized_pnl_pct,
  round(sol_realized_so_far + tokens_remaining * last_price_sol - entry_sol, 6) AS unrealized_pnl_sol, round(greatest(highest_pct, (last_price_sol / entry_price - 1) * 100), 6) AS highest_pct
FROM positions p JOIN mints USING (mint_address) WHERE status = 'open' AND entry_price > 0 AND last_price_sol > 0"""))
def _(spark, sf):
    return rounded(ops.mark_positions(t.positions(spark, sf), t.mints(spark, sf)))


@query("w4_highest_since_entry", t.oracle(f"""SELECT p.id, round(greatest(0.0, coalesce(max(CASE WHEN p.entry_price > 0 THEN (x.price_sol / p.entry_price - 1) * 100 END), 0.0)), 6) AS path_highest_pct
FROM positions p LEFT JOIN trades x ON x.mint_address = p.mint_address AND x.ts_ms > p.entered_ms AND x.ts_ms <= coalesce(p.exited_ms, {NOW}) GROUP BY 1"""))
def _(spark, sf):
    return rounded(ops.highest_since_entry(t.positions(spark, sf), t.trades(spark, sf), NOW, unit_ms=1000))


@query("w5_equity_curve", t.oracle(f"""
SELECT kind, ts_ms, id, round(realized, 6) AS realized, round(unrealized, 6) AS unrealized, round(50.0::double + realized + unrealized, 6) AS value FROM (
  SELECT 'start' AS kind, cast(100000 AS bigint) AS ts_ms, NULL::bigint AS id, 0.0::double AS realized, 0.0::double AS unrealized
  UNION ALL SELECT 'close', exited_ms, id, sum(realized_pnl_sol) OVER (ORDER BY exited_ms, id), 0.0 FROM positions WHERE status = 'closed' AND exited_ms > 100000
  UNION ALL SELECT 'now', {NOW}, NULL, (SELECT sum(realized_pnl_sol) FROM positions WHERE status = 'closed' AND exited_ms > 100000),
    (SELECT sum(tokens_remaining * last_price_sol + sol_realized_so_far - entry_sol) FROM positions JOIN mints USING (mint_address) WHERE status = 'open' AND entered_ms >= 100000))"""))
def _(spark, sf):
    return rounded(ops.equity_curve(t.positions(spark, sf), t.mints(spark, sf), 50.0, 100_000, NOW))
