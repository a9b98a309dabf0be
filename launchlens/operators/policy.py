"""Entry, exit and tuning rules as column expressions and grouped operators."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from launchlens.functions import asof_join, bound, clamp, clip01, nz, top_rows

# Fixed values of the policy.
ENTRY_THRESHOLD, HOLD_FLOOR = 0.10, -0.15
SIZE_BASE, SIZE_MAX, SIZE_LEAST = 0.10, 0.20, 0.05
MAX_OPEN, MAX_EXPOSURE, CASH_LEAST, PER_TICK = 25, 2.0, 0.05, 3
FEE, NETWORK_SOL = 0.01, 0.0003
THRESHOLD_FLOOR, THRESHOLD_CEILING, THRESHOLD_STEP = 0.05, 0.40, 0.025
EXIT_REASONS = [
    "HARD_STOP", "TRAIL_STOP", "STALE_DATA", "STALE_FLAT", "NO_PUMP_TIMEOUT", "MIGRATED_NO_TRACKING", "STALLED_PUMP", "RUGGED", "ML_SELL",
]
PRE_TARGETS = [
    "will_rug", "rug_within_5min", "peak_within_5min", "peaked_30", "peaked_100", "peaked_300", "hits_2x_within_1h", "alive_at_1h",
    "alive_at_4h", "buy_pressure_continues_60s", "pump_durability_5min", "will_migrate", "migrates_within_15min",
    "unique_buyers_next_60s", "unique_sellers_next_60s", "price_up_60s", "price_up_300s", "local_top_60s", "drawdown_20pct_300s",
    "will_die_fast", "drawdown_from_peak_pct",
]
POST_TARGETS = [
    "post_mig_rugs_1h", "post_mig_ev_with_ladder_sol", "post_mig_hits_2x", "post_mig_hits_50pct_30m", "post_mig_hits_100pct_1h",
    "post_mig_hits_130pct_4h", "post_mig_hits_186pct_4h", "post_mig_hits_30x_24h", "post_mig_peak_pct_4h", "post_mig_peak_pct_24h",
    "post_mig_peak_pct", "post_mig_alive_4h", "post_mig_drawdown_30_5min", "post_mig_drawdown_50_5min",
]


def _mix(weights: dict[str, float]) -> Column:
    """Weighted sum of probabilities, a missing one counts as 0."""
    return reduce(lambda a, b: a + b, [F.lit(w) * nz(t) for t, w in weights.items()])


def predicted_peak(is_migrated: Column, mult: float | Column = 1.0) -> Column:
    """Expected peak in percent from the prediction columns."""
    m = F.lit(mult) if isinstance(mult, (int, float)) else mult
    p4, p24 = F.col("post_mig_peak_pct_4h"), nz("post_mig_peak_pct_24h")
    post = F.when(p4.isNotNull(), clamp(F.greatest(p4, p24) * 100 * m, 20.0, 500.0)).otherwise(60 * m)
    pre = bound((10 + 85 * clip01(nz("peaked_100")) + 35 * clip01(nz("peaked_300"))) * m, 10.0, 200.0)
    return F.when(is_migrated, post).otherwise(pre)


def entry_score_pre() -> Column:
    """Score before migration: four vetoes, then pump, flow and migration parts, scaled by survival."""
    veto = (nz("will_rug") > 0.12) | (nz("rug_within_5min") > 0.30) | (nz("peak_within_5min") > 0.55) | (nz("peaked_100") < 0.05)
    pump = _mix({"peaked_30": 0.25, "peaked_100": 0.30, "peaked_300": 0.15, "hits_2x_within_1h": 0.30})
    flow = (
        _mix({"buy_pressure_continues_60s": 0.30, "alive_at_1h": 0.20, "alive_at_4h": 0.15})
        + 0.20 * clip01(nz("pump_durability_5min") / 2)
        + 0.15 * clip01((nz("unique_buyers_next_60s") - nz("unique_sellers_next_60s")) / 8)
    )
    mig = _mix({"migrates_within_15min": 0.50, "will_migrate": 0.30})
    return F.when(veto, 0.0).otherwise((0.55 * pump + 0.30 * flow + 0.15 * mig) * (1 - nz("will_rug")))


def entry_score_post() -> Column:
    """Score after migration."""
    pump = _mix({
        "post_mig_hits_50pct_30m": 0.15, "post_mig_hits_2x": 0.20, "post_mig_hits_100pct_1h": 0.20, "post_mig_hits_130pct_4h": 0.15,
        "post_mig_hits_186pct_4h": 0.10, "post_mig_hits_30x_24h": 0.10, "post_mig_alive_4h": 0.10,
    })
    peak = (
        0.40 * clip01(nz("post_mig_peak_pct_4h") / 2) + 0.30 * clip01(nz("post_mig_peak_pct_24h") / 3)
        + 0.30 * clip01(nz("post_mig_peak_pct") / 2)
    )
    ev = clip01(nz("post_mig_ev_with_ladder_sol") * 4)
    rug = nz("post_mig_rugs_1h")
    return F.when(rug > 0.10, 0.0).otherwise((0.40 * ev + 0.35 * pump + 0.25 * peak) * (1 - rug))


def hold_score(is_migrated: Column, smart_sellers: Column) -> Column:
    """Bull minus bear signals for an open position."""
    off = nz("drawdown_from_peak_pct")
    post_bull = (
        0.30 * clip01(nz("post_mig_peak_pct_4h") / 2) + 0.10 * clip01(nz("post_mig_peak_pct_24h") / 3)
        + 0.10 * clip01(nz("unique_buyers_next_60s") / 20)
        + _mix({"post_mig_hits_100pct_1h": 0.20, "post_mig_hits_50pct_30m": 0.15, "post_mig_alive_4h": 0.15})
    )
    post_bear = (
        0.25 * clip01(off / 30) + 0.15 * clip01(nz("unique_sellers_next_60s") / 20)
        + _mix({"post_mig_drawdown_30_5min": 0.15, "post_mig_drawdown_50_5min": 0.15, "post_mig_rugs_1h": 0.15, "local_top_60s": 0.15})
    )
    pre_bull = 0.10 * clip01(nz("unique_buyers_next_60s") / 15) + _mix({
        "price_up_60s": 0.25, "price_up_300s": 0.15, "buy_pressure_continues_60s": 0.20, "peaked_100": 0.15, "alive_at_1h": 0.15,
    })
    pre_bear = 0.20 * clip01(off / 30) + 0.15 * clip01(nz(smart_sellers) / 4) + _mix({
        "local_top_60s": 0.25, "drawdown_20pct_300s": 0.20, "will_die_fast": 0.20, "peak_within_5min": 0.15,
    })
    hope = F.when(off < 12, 0.6 * _mix({"migrates_within_15min": 0.50, "will_migrate": 0.30})).otherwise(0.0)
    return F.when(is_migrated, post_bull - post_bear).otherwise(pre_bull - pre_bear + hope)


def position_size(score: Column, threshold: Column, cash: Column) -> Column:
    """Linear between base and maximum above the threshold, at most 30% of the cash (P5)."""
    part = F.least(F.lit(1.0), (score - threshold) / (1 - threshold))
    return F.greatest(F.lit(0.01), F.least(SIZE_BASE + (SIZE_MAX - SIZE_BASE) * part, cash * 0.30))


def adaptive_tiers(predicted: Column) -> dict[str, Column]:
    """Tier triggers in percent and sold shares of the remainder, from the expected peak."""
    pp = bound(F.when(nz(predicted) != 0, predicted).otherwise(18.0), 10.0, 300.0)
    t1 = bound(pp * 0.40, 10.0, 60.0)
    return {
        "t1_trig": t1, "t1_sell": F.lit(0.40), "t2_trig": bound(pp * 0.75, 20.0, 150.0), "t2_sell": F.lit(0.30),
        "t3_trig": bound(pp * 1.2, 45.0, 300.0), "t3_sell": F.lit(0.30), "trail_arm": t1, "trail_pct": F.lit(20.0),
    }


def open_exposure(positions: DataFrame) -> DataFrame:
    """One row: open positions and SOL at risk, moonbags left out."""
    return positions.filter("status = 'open' AND is_moonbag = 0").agg(
        F.count(F.lit(1)).alias("n"), nz(F.sum(F.col("entry_sol") - nz("sol_realized_so_far"))).alias("exposure")
    )


def select_entries(
    scored: DataFrame, exposure: DataFrame, cash: float, threshold: float = ENTRY_THRESHOLD, tick: str = "tick", order: str = "rank",
    max_open: int = MAX_OPEN, max_exposure: float = MAX_EXPOSURE,
) -> DataFrame:
    """First three acceptable candidates per tick in candidate order, none when a limit is reached."""
    e = exposure.select(F.struct("n", "exposure")).scalar()
    x = scored.withColumn("size", position_size(F.col("score"), F.lit(threshold), F.lit(cash))).withColumn("_e", e)
    ok = (F.col("score") >= threshold) & (F.col("size") >= SIZE_LEAST) & (F.lit(cash) >= CASH_LEAST)
    room = (F.col("_e.n") < max_open) & (F.col("_e.exposure") < max_exposure)
    # acceptable rows sort first, so that no filter with the long score expression sits below the window
    x = x.withColumn("_ok", nz(ok & room, False)).drop("_e")
    return top_rows(x, [tick], [F.col("_ok").desc(), F.col(order)], PER_TICK).filter("_ok").drop("_ok")


def classify_exit() -> Column:
    """First matching exit rule of a position state; NULL keeps the position.

    State columns: rugged, migrated, trade_silent_min, cur_pct, peak_pct, age_min, trade_count,
    tiers_hit, t1_trig, t2_trig, t3_trig, trail_pct, hold.
    """
    cur, peak, age, quiet = F.col("cur_pct"), nz("peak_pct"), F.col("age_min"), F.col("trade_silent_min")
    pre = nz("migrated", 0) == 0
    hit = F.coalesce("tiers_hit", F.array().cast("array<string>"))
    tiers = F.col("t1_trig").isNotNull()
    fresh = lambda n: ~F.array_contains(hit, n)
    patience = F.when(nz("trade_count", 0) < 50, 10).otherwise(15)
    return (
        F.when(F.col("rugged") == 1, "RUGGED")
        .when(~pre & (quiet > 30), "MIGRATED_NO_TRACKING")
        .when(cur < -40, "HARD_STOP_-40")
        .when(pre & quiet.isNotNull() & (peak < 10) & (age > 10) & (quiet > patience), "STALE_DATA")
        .when(pre & (age > 60) & (peak < 5) & (F.abs(cur) < 15), "STALE_FLAT")
        .when(pre & (age > 90) & (peak < 10), "NO_PUMP_TIMEOUT")
        .when(pre & (age > 90) & (peak >= 10) & (peak < 30) & (cur < -10), "STALLED_PUMP")
        .when(tiers & fresh("T1") & (cur >= F.col("t1_trig")), "T1")
        .when(tiers & F.col("t2_trig").isNotNull() & fresh("T2") & (cur >= F.col("t2_trig")), "T2")
        .when(tiers & F.col("t3_trig").isNotNull() & fresh("T3") & (cur >= F.col("t3_trig")), "T3")
        .when(tiers & (F.size(hit) >= 1) & (cur < F.when(peak != 0, peak).otherwise(cur) - F.col("trail_pct")), "TRAIL_STOP")
        .when(F.col("hold") < HOLD_FLOOR, "ML_SELL")
    )


def curve_buy(sol: Column, v_sol: Column, v_tokens: Column, price: Column, migrated: Column) -> Column:
    """Tokens received for a gross amount: fees off, then constant product, or price without reserves (P10)."""
    net = F.greatest(F.lit(0.0), sol - NETWORK_SOL) * (1 - FEE)
    curve = F.greatest(F.lit(0.0), v_tokens - v_sol * v_tokens / (v_sol + net))
    usable = (nz(migrated, 0) == 0) & (nz(v_sol) > 0) & (nz(v_tokens) > 0)
    return F.when(usable, curve).otherwise(net / price)


def curve_sell(tokens: Column, v_sol: Column, v_tokens: Column, price: Column, migrated: Column) -> Column:
    """SOL received for tokens, fees off (P10)."""
    curve = F.greatest(F.lit(0.0), v_sol - v_sol * v_tokens / (v_tokens + tokens))
    usable = (nz(migrated, 0) == 0) & (nz(v_sol) > 0) & (nz(v_tokens) > 0)
    return F.greatest(F.lit(0.0), F.when(usable, curve).otherwise(tokens * price) * (1 - FEE) - NETWORK_SOL)


def normalize_exit_reason(reason: Column) -> Column:
    out = F.lit("ML_SELL")
    for known in EXIT_REASONS:
        out = F.when(F.startswith(reason, F.lit(known)), known).otherwise(out)
    return out


def tune_threshold(
    closes: DataFrame, current: float, as_of_ms: int, last_open_ms: int, last_move_ms: int = 0, last_loosen_ms: int | None = None,
    lookback_ms: int = 7 * 86_400_000, idle_ms: int = 3_600_000, newest: int = 500, min_closes: int = 25, min_bucket: int = 5,
    min_new: int = 5,
) -> DataFrame:
    """One row with the next entry threshold and why (P12). `closes` has closed_ms, entry_score, realized_pnl_pct."""
    floors = [round(THRESHOLD_FLOOR + THRESHOLD_STEP * k, 3) for k in range(14)]
    recent = (
        closes.filter((F.col("closed_ms") > as_of_ms - lookback_ms) & F.col("entry_score").isNotNull() & F.col("realized_pnl_pct").isNotNull())
        .orderBy(F.col("closed_ms").desc(), F.col("position_id").desc()).limit(newest)
    )
    cells = []
    for f in floors:
        above = F.round("entry_score", 3) >= f
        n, total = F.count(F.when(above, 1)), F.sum(F.when(above, F.col("realized_pnl_pct")))
        cells.append(F.when(n >= min_bucket, F.struct(F.lit(f).alias("floor"), (total / n).alias("ev"))))
    one = recent.agg(
        F.count(F.lit(1)).alias("n_closes"), F.count(F.when(F.col("closed_ms") > last_move_ms, 1)).alias("n_new"),
        F.array_compact(F.array(*cells)).alias("b"),
    )
    good = F.filter("b", lambda x: x["ev"] > 0)
    one = one.select("n_closes", "n_new", F.when(F.size(good) > 0, F.element_at(good, 1)["floor"]).alias("best_floor"), F.array_max(F.transform("b", lambda x: x["ev"])).alias("best_ev"))
    idle = as_of_ms - last_open_ms
    loosen = idle > idle_ms and current > THRESHOLD_FLOOR and (last_loosen_ms is None or as_of_ms - last_loosen_ms >= idle_ms)
    steps = (idle // idle_ms if last_loosen_ms is None else 1) if loosen else 0
    loose = max(THRESHOLD_FLOOR, current - steps * THRESHOLD_STEP)
    if loosen and abs(loose - current) >= 0.005:
        return one.select("n_closes", "n_new", "best_floor", "best_ev", F.lit(round(loose, 6)).alias("threshold"), F.lit("idle").alias("reason"))
    up = min(THRESHOLD_CEILING, current + THRESHOLD_STEP)
    proposal = (
        F.when(F.col("n_closes") < min_closes, F.struct(F.lit(current).alias("t"), F.lit("few_closes").alias("r")))
        .when(F.col("best_floor").isNotNull(), F.struct(clamp(F.col("best_floor"), THRESHOLD_FLOOR, THRESHOLD_CEILING).alias("t"), F.lit("best_ev").alias("r")))
        .when(F.col("n_new") < min_new, F.struct(F.lit(current).alias("t"), F.lit("few_new_closes").alias("r")))
        .otherwise(F.struct(F.lit(up).alias("t"), F.lit("step_up").alias("r")))
    )
    x = one.withColumn("_p", proposal)
    small = F.abs(F.col("_p.t") - current) < 0.005
    return x.select(
        "n_closes", "n_new", "best_floor", "best_ev", F.when(small, F.lit(current)).otherwise(F.col("_p.t")).alias("threshold"), F.col("_p.r").alias("reason")
    )


def calibrate_peak(
    closes: DataFrame, current: float, as_of_ms: int, lookback_ms: int = 3 * 86_400_000, epoch_ms: int = 0, newest: int = 1000,
    min_closes: int = 40, alpha: float = 0.3, bounds: tuple[float, float] = (0.4, 1.6), min_move: float = 0.01,
) -> DataFrame:
    """One row with the next multiplier of the predicted peak."""
    since = max(as_of_ms - lookback_ms, epoch_ms)
    s = (
        closes.filter((F.col("closed_ms") > since) & (F.col("predicted_peak_pct") > 0) & F.col("actual_peak_pct").isNotNull())
        .orderBy(F.col("closed_ms").desc(), F.col("position_id").desc()).limit(newest)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("predicted_peak_pct").alias("p"), F.sum(F.greatest(F.lit(0.0), "actual_peak_pct")).alias("a"))
    )
    s = s.withColumn("ratio", F.when(F.col("p") > 0, F.col("a") / F.col("p")))
    target = clamp(F.lit(current) * F.col("ratio"), *bounds)
    nxt = clamp(F.lit(current) + alpha * (target - F.lit(current)), *bounds)
    keep = (F.col("n") < min_closes) | F.col("ratio").isNull() | (F.abs(nxt - F.lit(current)) < min_move)
    return s.select("n", "ratio", F.when(keep, F.lit(current)).otherwise(nxt).alias("multiplier"))


def position_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """Opens, newly hit tiers and closes between two versions of the ledger, matched by id."""
    b = before.select("id", F.col("status").alias("_was"), F.col("tiers_hit").alias("_tiers"))
    x = after.join(b, "id", "left")
    none = F.array().cast("array<string>")
    opened = F.when((F.col("status") == "open") & F.col("_was").isNull(), F.array(F.lit("open")))
    tiers = F.when(
        F.col("status") == "open", F.transform(F.array_except(F.coalesce("tiers_hit", none), F.coalesce("_tiers", none)), lambda t: F.concat(F.lit("tier:"), t))
    )
    closed = F.when((F.col("status") == "closed") & (nz("_was", "open") == "open"), F.array(F.lit("close")))
    ev = F.explode(F.concat(F.coalesce(opened, none), F.coalesce(tiers, none), F.coalesce(closed, none)))
    notable = (F.abs(nz("realized_pnl_pct")) >= 5) | (nz("highest_pct") >= 30)
    gave_back = (nz("highest_pct") > 50) & (nz("realized_pnl_pct") < 20)
    is_close = F.col("event") == "close"
    return x.withColumn("event", ev).select(
        "id", "mint_address", "event", F.when(is_close, normalize_exit_reason(F.col("exit_reason"))).alias("reason"),
        F.when(is_close, notable.cast("int")).alias("is_notable"), F.when(is_close, gave_back.cast("int")).alias("gave_back"),
    )


def _fold_calls(dedup_ms: int):
    """Streaming fold over opens sorted by token and time: keep a call when its token was not called within dedup_ms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token = last = None
        for pdf in batches:
            keep = []
            for t, ts in zip(pdf["mint_address"].to_numpy(), pdf["ts_ms"].to_numpy()):
                ok = t != token or ts - last >= dedup_ms
                keep.append(ok)
                if ok:
                    token, last = t, ts
            yield pdf[keep]

    return run


def deduplicated_calls(opens: DataFrame, dedup_ms: int = 86_400_000) -> DataFrame:
    """Opens that are announced: a token's next call is its first open at least dedup_ms after the last one."""
    rows = opens.groupBy(F.col("mint_address").cast("int").alias("mint_address"), F.col("ts_ms").cast("long").alias("ts_ms")).agg(
        F.min("id").cast("long").alias("id")
    )
    return rows.repartition("mint_address").sortWithinPartitions("mint_address", "ts_ms").mapInPandas(
        _fold_calls(dedup_ms), "mint_address int, ts_ms long, id long"
    )


def rate_limited_calls(opens: DataFrame, dedup_ms: int = 86_400_000, window_ms: int = 3_600_000, limit: int = 30) -> DataFrame:
    """Each token once per day, and of these calls the first `limit` of every clock window.

    Windows are fixed and a call that the cap drops still counts for its token, so tokens and windows are decided apart."""
    calls = deduplicated_calls(opens, dedup_ms).withColumn("_window", F.floor(F.col("ts_ms") / window_ms))
    return top_rows(calls, ["_window"], [F.col("ts_ms"), F.col("id")], limit).select("mint_address", "ts_ms", "id")


def _fold_ring(window_ms: int, limit: int):
    """Streaming fold over calls sorted by segment and time: keep a call when fewer than `limit` kept ones of its segment lie in the window before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, held = None, deque()
        for pdf in batches:
            keep = []
            for s, ts in zip(pdf["_segment"].to_numpy(), pdf["ts_ms"].to_numpy()):
                if s != segment:
                    segment, held = s, deque()
                while held and held[0] < ts - window_ms:
                    held.popleft()
                keep.append(len(held) < limit)
                if keep[-1]:
                    held.append(ts)
            yield pdf.loc[keep, ["mint_address", "ts_ms", "id"]]

    return run


def segments(calls: DataFrame, window_ms: int, out: str = "_segment") -> DataFrame:
    """calls with the number of their segment: one begins where more than window_ms passed since the call before.

    The call before is sought inside the clock window, and for its first call in the table of windows, one row each."""
    slot = F.floor(F.col("ts_ms") / window_ms)
    rows = calls.withColumn("_slot", slot)
    inside = W.partitionBy("_slot").orderBy("ts_ms", "id")
    slots = rows.groupBy("_slot").agg(F.max("ts_ms").alias("_last"))
    before = slots.select("_slot", F.lag("_last").over(W.orderBy("_slot")).alias("_before"))
    rows = rows.join(before, "_slot").withColumn("_prev", F.coalesce(F.lag("ts_ms").over(inside), "_before"))
    rows = rows.withColumn("_new", (F.col("_prev").isNull() | (F.col("ts_ms") - F.col("_prev") > window_ms)).cast("long"))
    total = rows.groupBy("_slot").agg(F.sum("_new").alias("_n"))
    carried = total.select("_slot", (F.sum("_n").over(W.orderBy("_slot")) - F.col("_n")).alias("_carry"))
    return rows.join(carried, "_slot").withColumn(out, F.col("_carry") + F.sum("_new").over(inside.rowsBetween(W.unboundedPreceding, 0))).drop(
        "_slot", "_before", "_prev", "_new", "_carry")


def rolling_limited_calls(opens: DataFrame, dedup_ms: int = 86_400_000, window_ms: int = 3_600_000, limit: int = 30) -> DataFrame:
    """Each token once per dedup_ms, and of these calls those with fewer than `limit` kept ones in the window_ms before them.

    The window rolls with the calls, both ends included. A segment of calls without a gap longer than the window decides
    alone, so segments are folded apart, each with `limit` times in memory. A call that the cap drops still counts for its token."""
    calls = segments(deduplicated_calls(opens, dedup_ms), window_ms)
    return calls.select("_segment", "mint_address", "ts_ms", "id").repartition("_segment").sortWithinPartitions("_segment", "ts_ms", "id").mapInPandas(
        _fold_ring(window_ms, limit), "mint_address int, ts_ms long, id long")


def wallet_pool_gate(trades: DataFrame, pool: DataFrame, as_of_ms: int, window_ms: int, n: int) -> DataFrame:
    """Tokens bought by at least n distinct pool wallets inside the window."""
    buys = trades.filter((F.col("is_buy") == 1) & (F.col("ts_ms") > as_of_ms - window_ms) & (F.col("ts_ms") <= as_of_ms))
    who = buys.select("mint_address", "wallet").distinct().join(pool.select("wallet"), "wallet", "left_semi")
    return who.groupBy("mint_address").agg(F.count(F.lit(1)).alias("pool_buyers")).filter(F.col("pool_buyers") >= n)


def mint_state_gate(df: DataFrame, mints: DataFrame, col: str, value) -> DataFrame:
    return df.join(mints.filter(F.col(col) == value).select("mint_address"), "mint_address", "left_semi")


def signal_snapshot(opens: DataFrame, predictions: DataFrame, snapshots: DataFrame, fresh_ms: int = 600_000, chunk_ms: int = 3_600_000) -> DataFrame:
    """Signals shown with a new position: fresh probabilities, thresholded list, smart-money counts (P20)."""
    targets = ["peaked_100", "hits_2x_within_1h", "will_migrate", "will_die_fast"]
    rows = opens.select("id", "mint_address", "entered_ms")
    wanted = rows.withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    p = predictions.filter(F.col("prob").isNotNull() & F.col("target").isin(targets)).select(
        "mint_address", "target", F.col("ts_ms").alias("_pts"), F.col("prediction_id").alias("_pid"), "prob"
    )
    hit = asof_join(wanted, p, ["mint_address", "target"], "entered_ms", "_pts", ["prob", "_pts"], tie="_pid", chunk_ms=chunk_ms)
    fresh = F.when(F.col("_pts") > F.col("entered_ms") - fresh_ms, F.col("prob"))
    wide = hit.groupBy("id", "mint_address", "entered_ms").agg(*[F.max(F.when(F.col("target") == t, fresh)).alias(t) for t in targets])
    least = {"peaked_100": 0.0, "hits_2x_within_1h": 0.05, "will_migrate": 0.05, "will_die_fast": 0.0}
    shown = F.array_compact(F.array(*[F.when(F.col(t) >= m, F.concat(F.lit(t + ":"), F.round(F.col(t) * 100).cast("int").cast("string"))) for t, m in least.items()]))
    smart = ["smart_buyer_count", "whale_buyer_count", "top_buyer_skill_p90", "avg_buyer_hold_sec"]
    s = snapshots.select("mint_address", "snapshot_ts", *smart)
    return asof_join(wide.withColumn("signals", shown), s, ["mint_address"], "entered_ms", "snapshot_ts", smart, chunk_ms=chunk_ms)
