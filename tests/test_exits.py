"""Exit replay over blocks of ticks, against a plain loop and against its plan."""

import random
import re

import pytest

from launchlens.operators import exits

POSITION = "id long, mint_address int, entered_ms long, entry_price double, entry_sol double, token_amount double"
TRADE = "trade_id long, mint_address int, ts_ms long, price_sol double"


def made(spark, n=60):
    rnd = random.Random(7)
    trades = [(i, rnd.randrange(3), rnd.randrange(40_000), rnd.choice([0.0, 0.8, 0.95, 1.0, 1.1, 1.5])) for i in range(400)]
    positions = [(i, rnd.randrange(4), rnd.randrange(45_000), rnd.choice([0.0, 1.0, 1.2]), 1.0, 1.0) for i in range(n)]
    return spark.createDataFrame(trades, TRADE), spark.createDataFrame(positions, POSITION), trades, positions


def ticks_of(trades, p, hold_ms, as_of_ms):
    last = {}
    for tid, token, ts, price in trades:
        if token == p[1] and price > 0:
            old = last.get(ts // 1000, (-1, -1, 0.0, 0))
            last[ts // 1000] = (*max((ts, tid, price), old[:3]), old[3] + 1)
    return sorted((ts, price, n) for ts, _, price, n in last.values() if p[2] < ts <= min(p[2] + hold_ms, as_of_ms))


def dealt(df):
    return re.findall(r"hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("group", [2, 20_000])
def test_replay_meets_blocks_of_ticks(spark, monkeypatch, group):
    monkeypatch.setattr(exits, "GROUP_ROWS", group, raising=False)
    t, p, trades, positions = made(spark)
    sets = [exits.ExitRules("a", [10.0, 40.0], [0.5, 1.0], trail_pct=5.0, stop_loss_pct=15.0, max_hold_min=0.2), exits.ExitRules("b", [45.0], [1.0], max_hold_min=0.1)]
    out = exits.replay_exits(p, t, exits.exit_rule_sets(spark, sets), 42_000, tick_ms=1000)
    got = {(r["id"], r["rule_set"]): (r["reason"], r["exit_ms"], r["realized_sol"]) for r in out.collect()}
    want = {}
    for q in positions:
        for s in sets:
            f = exits.PositionFold({**s.__dict__, **dict(zip(["id", "mint_address", "entered_ms", "entry_price", "entry_sol", "token_amount"], q))})
            closed = f.outcome(f.t_in, "OPEN") if q[3] <= 0 else None
            for tick in ticks_of(trades, q, 12_000, 42_000) if closed is None else []:
                closed = closed or f.step(*tick)
            end = min(42_000, f.t_in + f.hold_ms)
            r = closed or f.waiting(end + 1) or f.outcome(end, "OPEN")
            want[q[0], s.rule_set] = (r[4], r[3], r[5])
    assert got == want


def test_replay_gathers_no_path_per_position(spark):
    t, p, _, _ = made(spark)
    rules = exits.exit_rule_sets(spark, [exits.ExitRules("a", [10.0], [1.0], max_hold_min=0.2)])
    assert not any(re.match(r"id#", d) for d in dealt(exits.replay_exits(p, t, rules, 42_000, tick_ms=1000)))


def test_own_tiers_reach_the_fold(spark):
    t = spark.createDataFrame([(1, 1, 1000, 1.2), (2, 1, 2000, 1.4), (3, 1, 3000, 2.5)], TRADE)
    p = spark.createDataFrame([(5, 1, 500, 1.0, 1.0, 1.0, 15.0, 35.0, 100.0, 9.0), (5, 1, 500, 1.0, 1.0, 1.0, 15.0, 35.0, 100.0, 9.0)],
                              POSITION + ", t1_trig double, t2_trig double, t3_trig double, trail_pct double")
    rules = exits.exit_rule_sets(spark, [exits.ExitRules("own", max_hold_min=1.0)])
    out = exits.replay_exits(p, t, rules, 10**6, tick_ms=1000)
    assert [r["tiers_hit"] for r in out.collect()] == [["T1", "T2", "T3"]] * 2
    assert not any(re.match(r"id#", d) for d in dealt(out))


@pytest.mark.parametrize("group", [2, 20_000])
def test_first_barrier_meets_blocks_of_ticks(spark, monkeypatch, group):
    monkeypatch.setattr(exits, "GROUP_ROWS", group, raising=False)
    t, p, trades, positions = made(spark)
    out = exits.first_barrier(p, t, 35.0, 15.0, 12_000, 42_000, tick_ms=1000)
    got = {r["id"]: (r["reason"], r["exit_ms"]) for r in out.collect()}
    want = {}
    for q in positions:
        hit = None
        for ts, price, _ in ticks_of(trades, q, 12_000, 42_000) if q[3] > 0 else []:
            move = (price / q[3] - 1) * 100
            if hit is None and (move < -15 or move >= 35):
                hit = ("STOP_LOSS" if move < -15 else "TIERED_FULL", ts)
        late = q[2] + 12_000 > 42_000
        want[q[0]] = ("OPEN", q[2]) if q[3] <= 0 else hit or ("OPEN" if late else "TIME_EXIT", min(q[2] + 12_000, 42_000))
    assert got == want
    assert not any(re.match(r"id#", d) for d in dealt(out))
