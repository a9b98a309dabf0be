"""Hand-worked tables for the rules that are easy to get wrong."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from launchlens.functions import asof_join, floor_quantile_rank, order_statistics, range_aggregate, running_total
from launchlens.models import prepare
from launchlens.operators import closes, creators, exits, features, labels, policy
from launchlens.sources import files, tables
from launchlens.streaming import streams

TRADE = "trade_id long, mint_address int, wallet long, is_buy int, sol_amount double, token_amount double, price_sol double, market_cap_sol double, ts_ms long"
MINT = "mint_address int, created_ms long, creator_wallet long, migrated int, migrated_ms long, rugged_ms long, last_trade_ms long, last_price_sol double, peak_market_cap_sol double"


def trades(spark, rows):
    """rows: (ts_ms, is_buy, sol, price, wallet)"""
    return spark.createDataFrame(
        [(i, 1, w, b, float(s), 1.0, float(p), float(p) * 1e9, ts) for i, (ts, b, s, p, w) in enumerate(rows, 1)], TRADE
    )


def mint(spark, created=0):
    return spark.createDataFrame([(1, created, 99, 0, None, None, 0, 0.0, 0.0)], MINT)


def base(spark, rows, ages):
    return features.trades_as_of(trades(spark, rows), mint(spark), ages)


def one(df):
    return df.first().asDict()


def test_floor_index_quantile(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "k int, v double")
    got = one(order_statistics(df, ["k"], "v", {"a": floor_quantile_rank(0.5), "b": floor_quantile_rank(0.9)}))
    assert (got["a"], got["b"]) == (3.0, 4.0)


@pytest.mark.parametrize("seed", range(3))
def test_order_statistics_match_sorting(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(3), rnd.choice([0.0, -1.5, 2.0, rnd.uniform(-5, 5), rnd.lognormvariate(0, 4)]), rnd.randrange(3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k int, v double, bin int")
    fn = {"a": floor_quantile_rank(0.5), "b": floor_quantile_rank(0.9)}
    got = {(r["k"], r["age"]): (r["a"], r["b"]) for r in order_statistics(df, ["k"], "v", fn, grow=("bin", "age", [5, 15, 30])).collect()}
    for k in range(3):
        for b, age in enumerate([5, 15, 30]):
            vals = sorted(v for kk, v, bb in rows if kk == k and bb <= b)
            pick = lambda q: vals[max(0, min(len(vals) - 1, math.floor(q * len(vals))))]
            assert got[(k, age)] == (pick(0.5), pick(0.9))


def test_open_run_is_not_counted(spark):
    got = one(features.path_features(base(spark, [(i, 1, 1, p, i) for i, p in enumerate([1, 2, 3, 2, 1])], [5]), [5]))
    assert (got["n_reversals_in_window"], got["longest_up_run_pct"], got["longest_down_run_pct"]) == (1, 2.0, 0.0)


def loop_runs(prices):
    rev = up = down = 0
    d0, start = 0, prices[0] if prices else 0
    for prev, p in zip(prices, prices[1:]):
        if not p or not prev:
            continue
        d = (p > prev) - (p < prev)
        if d and d0 and d != d0:
            rev += 1
            pct = (prev - start) / start if start > 0 else 0
            up, down, start = max(up, pct if d0 > 0 else 0), min(down, pct if d0 < 0 else 0), prev
        d0 = d or d0
    return rev, up, down


@pytest.mark.parametrize("seed", range(4))
def test_runs_over_many_segments(spark, seed):
    rnd = random.Random(seed)
    ts, rows = 0, []
    for i in range(120):
        ts += rnd.choice([0, 500, 3000])
        rows.append((ts, rnd.randrange(2), 1, rnd.choice([0, 1, 2, 2, 3, 5]), i % 7))
    ages = [5, 30, 60, 300]
    got = {r["snapshot_age_sec"]: r for r in features.path_features(base(spark, rows, ages), ages, chunk_ms=2000).collect()}
    for a in ages:
        rev, up, down = loop_runs([p for t, _, _, p, _ in rows if t <= a * 1000])
        r = got[a]
        assert r["n_reversals_in_window"] == rev and math.isclose(r["longest_up_run_pct"], up) and math.isclose(r["longest_down_run_pct"], down)


def loop_rolls(rows):
    best = dict.fromkeys(["b", "nb", "s", "ns", "u", "r"], 0)
    for i, (t0, *_r) in enumerate(rows):
        win = [r for r in rows[i:] if r[0] <= t0 + 30_000]
        b, s = [r for r in win if r[1]], [r for r in win if not r[1]]
        bs, ss = sum(r[2] for r in b), sum(r[2] for r in s)
        now = {"b": bs, "nb": len(b), "s": ss, "ns": len(s), "u": len({r[4] for r in s}), "r": bs / ss if ss > 0 else (99 if bs > 0 else 0)}
        best = {k: max(best[k], now[k]) for k in best}
    return best


@pytest.mark.parametrize("rows,ratio,sells", [([(0, 1, 5, 1, 1), (0, 0, 2, 1, 2), (10, 0, 1, 1, 3)], 5 / 3, 2), ([(0, 0, 4, 1, 1), (0, 1, 4, 1, 2)], 99, 1)])
def test_rolling_ties(spark, rows, ratio, sells):
    got = one(features.rolling_features(base(spark, rows, [60]), [60]))
    assert math.isclose(got["max_30s_buy_sell_ratio"], ratio) and got["max_30s_sell_count"] == sells


@pytest.mark.parametrize("seed", range(4))
def test_rolling_against_loop(spark, seed):
    rnd = random.Random(seed)
    rows = sorted((rnd.randrange(0, 200) * 1000, rnd.randrange(2), rnd.randrange(0, 9), 1, rnd.randrange(6)) for _ in range(150))
    ages = [5, 30, 60, 120, 300]
    got = {r["snapshot_age_sec"]: r for r in features.rolling_features(base(spark, rows, ages), ages).collect()}
    for a in ages:
        want = loop_rolls([r for r in rows if r[0] <= a * 1000])
        r = got[a]
        assert (r["max_30s_buy_count"], r["max_30s_sell_count"], r["max_30s_unique_sellers"]) == (want["nb"], want["ns"], want["u"])
        for c, k in (("max_30s_buy_sol", "b"), ("max_30s_sell_sol", "s"), ("max_30s_buy_sell_ratio", "r")):
            assert math.isclose(r[c], want[k], abs_tol=1e-9), (a, c)


def test_ratio_sentinels_and_acceleration_edge(spark):
    got = one(features.core_features(base(spark, [(0, 1, 1, 1, 1)], [60]), [60]))
    assert got["buy_sell_ratio"] == 99.0
    got = one(features.core_features(base(spark, [(0, 0, 1, 1, 1)], [60]), [60]))
    assert got["buy_sell_ratio"] == 0.0
    rows = [(20_000, 1, 2, 1, 1), (30_000, 1, 3, 1, 2)]  # second trade exactly at cutoff - 30 s: late half
    got = one(features.recent_window_features(base(spark, rows, [60]), [60]))
    assert got["inflow_accel_pct"] == 0.5 and got["buy_count_accel_pct"] == 0.0


def test_later_trades_change_nothing(spark):
    rows = [(i * 700, i % 3 > 0, i % 5, 1 + i % 4, i % 6) for i in range(60)]
    ages = [5, 15, 30]
    fams = [features.core_features, features.wallet_features, features.path_features, features.rolling_features, features.recent_window_features, features.amount_quantiles]
    more = rows + [(31_000 + i, 1, 50, 9, 90 + i) for i in range(20)]
    for fam in fams:
        a, b = (sorted(map(str, fam(base(spark, [(t, int(bb), s, p, w) for t, bb, s, p, w in x], ages), ages).collect())) for x in (rows, more))
        assert a == b, fam.__name__


def test_concentration_bounds(spark):
    rows = [(i * 100, 1, 1 + i % 7, 1, i % 9) for i in range(40)]
    for r in features.wallet_features(base(spark, rows, [5]), [5]).collect():
        assert 1 / r["unique_buyers"] <= r["buyer_hhi"] <= 1 and r["top1_buyer_sol_pct"] <= r["top3_buyer_sol_pct"] <= r["top5_buyer_sol_pct"] <= 1


def test_labels_without_later_trade(spark):
    t = trades(spark, [(0, 1, 1, 2, 1)])
    snap = spark.createDataFrame([(1, 5, 2.0, 2e9, 0.0)], "mint_address int, snapshot_age_sec int, last_price_sol double, peak_mcap_sol_so_far double, pressure_60_buy_pct double")
    got = one(labels.resolve_labels(snap, t, mint(spark), 10**9, [5]))
    assert got["peak_pct_max"] == 0.0 and got["peaked_30"] == 0
    early = one(labels.resolve_labels(snap, t, mint(spark), 30_000, [5]))
    assert early["local_top_60s"] is None and early["hits_2x_within_1h"] is None


def test_post_exit_limits(spark):
    t = trades(spark, [(1000, 1, 1, 9, 1), (61_000, 1, 1, 3, 1), (61_001, 1, 1, 5, 1)])  # at the exit, at the mark, after it
    c = spark.createDataFrame([(7, 1, 1000, 2.0)], "id long, mint_address int, exited_ms long, exit_price double")
    got = one(closes.post_exit_path(c, t, 10**9, [1]))
    assert (got["price_at_mark"], got["peak_price"], got["trades_in_win"]) == (3.0, 3.0, 1)


def test_exit_order(spark):
    state = dict(rugged=1, migrated=0, trade_silent_min=0.0, cur_pct=-60.0, peak_pct=0.0, age_min=1.0, trade_count=9, tiers_hit=[], t1_trig=10.0, t2_trig=20.0, t3_trig=45.0, trail_pct=20.0, hold=0.0)
    schema = "rugged int, migrated int, trade_silent_min double, cur_pct double, peak_pct double, age_min double, trade_count int, tiers_hit array<string>, t1_trig double, t2_trig double, t3_trig double, trail_pct double, hold double"
    got = spark.createDataFrame([tuple(state.values())], schema).select(policy.classify_exit().alias("a")).first()["a"]
    assert got == "RUGGED"


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_against_loop(spark, strict):
    rnd = random.Random(3)
    left = [(i, rnd.randrange(2), rnd.randrange(100)) for i in range(60)]
    right = [(i, rnd.randrange(2), rnd.randrange(100)) for i in range(60)]
    l, r = spark.createDataFrame(left, "id int, k int, at int"), spark.createDataFrame(right, "tie int, k int, ts int").withColumn("v", F.col("tie") * 10)
    got = {x["id"]: x["v"] for x in asof_join(l, r, ["k"], "at", "ts", ["v"], tie="tie", chunk_ms=7, strict=strict).collect()}
    for i, k, at in left:
        ok = [(ts, tie) for tie, kk, ts in right if kk == k and (ts < at if strict else ts <= at)]
        assert got[i] == (max(ok)[1] * 10 if ok else None)


def test_range_aggregate_against_loop(spark):
    rnd = random.Random(5)
    pts = [(rnd.randrange(2), rnd.randrange(5000), rnd.random()) for _ in range(300)]
    rng = [(i, rnd.randrange(2), a := rnd.randrange(5000), a + rnd.randrange(0, 3000)) for i in range(50)]
    p, r = spark.createDataFrame(pts, "k int, ts int, v double"), spark.createDataFrame(rng, "id int, k int, a int, b int")
    got = {x["id"]: (x["m"], x["n"]) for x in range_aggregate(r, p, ["k"], ["id"], "a", "b", "ts", {"m": (F.col("v"), "max"), "n": (F.lit(1), "sum")}, 3000).collect()}
    for i, k, a, b in rng:
        vals = [v for kk, ts, v in pts if kk == k and a < ts <= b]
        assert got[i] == ((max(vals), len(vals)) if vals else (None, None))


def test_running_total_without_keys(spark):
    df = spark.createDataFrame([(i, (i * 37) % 50, i) for i in range(50)], "id int, ts int, v int")
    got = {r["id"]: r["c"] for r in running_total(df, [], "ts", ["ts", "id"], "v", "c", chunk_ms=7).collect()}
    total = 0
    for ts, i in sorted(((i * 37) % 50, i) for i in range(50)):
        total += i
        assert got[i] == total


def test_drawdown(spark):
    t = trades(spark, [(i * 40_000, 1, 1, p, 1) for i, p in enumerate([1, 4, 2, 8, 6, 1, 9])])
    assert math.isclose(one(closes.running_drawdown(t, ["mint_address"], "ts_ms", "trade_id", "price_sol"))["max_drawdown"], 1 / 8 - 1)


def test_calls_with_cap_against_loop(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randrange(40), rnd.randrange(300)) for i in range(250)]
    df = spark.createDataFrame(rows, "id long, mint_address int, ts_ms long")
    got = {(r["mint_address"], r["ts_ms"]) for r in policy.rate_limited_calls(df, dedup_ms=100, window_ms=20, limit=3).collect()}
    last, kept = {}, []
    for ts, _, token in sorted({(ts, min(i for i, m, t in rows if m == token and t == ts), token) for _, token, ts in rows}):
        if ts - last.get(token, -(10**9)) >= 100:
            last[token] = ts
            kept.append((ts, token))
    assert got == {(token, ts) for k, (ts, token) in enumerate(kept) if sum(x // 20 == ts // 20 for x, _ in kept[:k]) < 3}


def test_exit_replay_ladder(spark):
    path = [(1000, 1.0), (2000, 1.25), (3000, 1.7), (4000, 1.4)]
    t = trades(spark, [(ts, 1, 1, p, 1) for ts, p in path])
    p = spark.createDataFrame([(5, 1, 500, 1.0, 1.0, 1.0)], "id long, mint_address int, entered_ms long, entry_price double, entry_sol double, token_amount double")
    rules = exits.exit_rule_sets(spark, [exits.ExitRules("x", [20.0, 60.0], [0.5, 0.5], trail_pct=20.0)])
    got = one(exits.replay_exits(p, t, rules, 10**6, tick_ms=1000))
    sold = lambda n, price: max(0, n * price * 0.99 - 0.0003)
    want = sold(0.5, 1.25) + sold(0.25, 1.7) + sold(0.25, 1.4)
    assert got["reason"] == "TRAIL_STOP" and got["exit_ms"] == 4000 and got["tiers_hit"] == ["T1", "T2"] and math.isclose(got["realized_sol"], want)


def test_latest_versions(spark, tmp_path):
    sink = streams.append_versions(str(tmp_path / "v"))
    sink(spark.createDataFrame([(1, 5), (2, 6)], "k int, v int"), 0)
    sink(spark.createDataFrame([(1, 9)], "k int, v int"), 1)
    got = {r["k"]: r["v"] for r in streams.latest_versions(spark.read.parquet(str(tmp_path / "v")), ["k"]).collect()}
    assert got == {1: 9, 2: 6}


def test_unknown_creators_share_no_history(spark):
    rows = [(1, 0, 7), (2, 8_000, None), (3, 16_000, None), (4, 20_000, 7)]
    m = spark.createDataFrame([(i, c, w, 0, None, None, 0, 0.0, 0.0) for i, c, w in rows], MINT)
    previous = {r[0]: r[1] for r in creators.creator_previous_launch(m).collect()}
    assert previous == {1: -1, 2: -1, 3: -1, 4: 20}
    siblings = {r[0]: r[1] for r in creators.creator_siblings(m).collect()}
    assert siblings == {1: 1, 2: 0, 3: 0, 4: 1}
    whole = {r["mint_address"]: (r["creator_launch_count"], r["seconds_since_prev_creator_death"]) for r in creators.creator_stats_unbounded(m).collect()}
    assert whole == {1: (1, -1), 2: (0, -1), 3: (0, -1), 4: (1, 20)}


def test_order_statistics_take_infinities_and_nan(spark):
    values = [float("nan"), float("inf"), float("-inf"), 1.0, 2.0]
    df = spark.createDataFrame([(1, v) for v in values], "k int, v double")
    got = [one(order_statistics(df, ["k"], "v", {"a": lambda n, r=r: F.lit(r)}))["a"] for r in range(5)]
    assert got[:4] == [float("-inf"), 1.0, 2.0, float("inf")] and math.isnan(got[4])


def test_refined_ranks_of_crowded_times(spark):
    rnd = random.Random(3)
    start = 1_700_000_000_000
    values = sorted(float(start + rnd.randrange(100 * 86_400_000)) for _ in range(3000))
    df = spark.createDataFrame([(1, v) for v in values], "k int, v double")
    fn = {"a": floor_quantile_rank(0.5), "b": floor_quantile_rank(0.9)}
    got = one(order_statistics(df, ["k"], "v", fn, refine=2))
    assert (got["a"], got["b"]) == (values[1500], values[2700])


def test_trades_are_not_dealt_by_token_alone(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        x = base(spark, [(i, i % 2, 1, 1.0, i) for i in range(20)], [5, 15])
        plan = features.core_features(x, [5, 15])._jdf.queryExecution().executedPlan().toString()
        assert x.count() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert any("_part" in d for d in dealt) and not any(re.fullmatch(r"mint_address#\d+, \d+", d) for d in dealt)


def test_replay_follows_the_rules_own_hold(spark):
    t = trades(spark, [(1_000, 1, 1, 1.0, 1), (400_000, 1, 1, 0.5, 1)])
    p = spark.createDataFrame([(5, 1, 500, 1.0, 1.0, 1.0)], "id long, mint_address int, entered_ms long, entry_price double, entry_sol double, token_amount double")
    rules = exits.exit_rule_sets(spark, [exits.ExitRules("x", max_hold_min=480.0)])
    got = one(exits.replay_exits(p, t, rules, 10**9, tick_ms=1000))
    assert (got["reason"], got["exit_ms"]) == ("STOP_LOSS", 400_000)
    near = one(exits.first_barrier(p, t, 35.0, 40.0, 480 * 60_000, 10**9, tick_ms=1000))
    assert (near["reason"], near["exit_ms"]) == ("STOP_LOSS", 400_000)


def test_falls_are_not_clipped_at_zero(spark):
    got = spark.createDataFrame([(-0.5,), (0.2,)], "x double").select(prepare.inverse_target(F.col("x"), "max_drawdown_within_24h_pct").alias("y")).collect()
    assert [r["y"] for r in got] == [-0.5, 0.0]
    assert "post_mig_time_to_peak_min" in prepare.REGRESSION_TARGETS


@pytest.mark.parametrize("slices", [1, 2, 6])
def test_snapshots_do_not_depend_on_the_batches(spark, tmp_path, slices):
    rows = trades(spark, [(ms, 1, 1, 1.0, ms) for ms in range(0, 720_000, 10_000)])
    out = str(tmp_path / "snapshots")
    mints_of = lambda t: t.groupBy("mint_address").agg(F.min("ts_ms").alias("created_ms")).withColumn("creator_wallet", F.lit(None).cast("long"))
    feats = lambda t, m: features.core_features(features.trades_as_of(t, m, [60, 300]), [60, 300]).select("mint_address", "snapshot_age_sec", "trade_count")
    sink = streams.snapshot_sink(str(tmp_path / "trades"), out, mints_of, feats, [60, 300], grace_sec=30)
    for i in range(slices):
        sink(rows.filter(F.floor(F.col("ts_ms") * slices / 720_000) == i), i)
    got = {(r["snapshot_age_sec"], r["trade_count"]) for r in spark.read.parquet(out).collect()}
    assert got == {(60, 7), (300, 31)}


def test_day_filter_reaches_the_scan(spark, tmp_path):
    plan = tables.trades(spark, "/root/testdata/sf0.001", tables.DAY)._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[([^\n]*)", plan)[1]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed
    out = str(tmp_path / "archive")
    files.archive_day(tables.trades(spark, "/root/testdata/sf0.001", tables.DAY), tables.DAY, out, "ts_real_ms")
    plan = files.read_trades(spark, out, tables.DAY, "ts_real_ms")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*day", plan)


def test_rolling_cap_against_a_plain_loop(spark):
    import random

    rnd = random.Random(6)
    rows, at = [], 0
    for i in range(400):
        at += rnd.choice([0, 1, 3, 9, 40])
        rows.append((i, i % 50, at))
    last, held, want = {}, [], []
    for i, token, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        if ts - last.get(token, -10**9) < 70:
            continue
        last[token] = ts
        if sum(x >= ts - 20 for x in held) < 3:
            held.append(ts)
            want.append((token, ts))
    opens = spark.createDataFrame(rows, "id long, mint_address int, ts_ms long")
    got = policy.rolling_limited_calls(opens, dedup_ms=70, window_ms=20, limit=3).collect()
    assert sorted((r["mint_address"], r["ts_ms"]) for r in got) == sorted(want)
    assert policy.rolling_limited_calls(opens.limit(0), 70, 20, 3).count() == 0
    cut = policy.segments(opens, 20).groupBy("_segment").agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b")).orderBy("a").collect()
    assert len(cut) > 5 and all(y["a"] - x["b"] > 20 for x, y in zip(cut, cut[1:]))
