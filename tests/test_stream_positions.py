"""The streamed exit machine against a plain loop over the same batches."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from launchlens.operators import exits
from launchlens.streaming import streams
from test_streams import drained, replay

TRADE = "trade_id long, mint_address int, ts_ms long, price_sol double"
POSITION = "id long, mint_address int, entered_ms long, entry_price double, entry_sol double, token_amount double"
RULES = [exits.ExitRules("a", [35.0], [1.0], stop_loss_pct=30.0, max_hold_min=0.1),
         exits.ExitRules("b", [20.0, 60.0], [0.5, 1.0], trail_pct=20.0, stop_loss_pct=50.0, max_hold_min=0.3, timeouts=True)]


def made():
    rnd = random.Random(5)
    trades = sorted(((i, rnd.randrange(3), rnd.randrange(60) * 1000, rnd.choice([0.0, 0.6, 0.9, 1.0, 1.1, 1.3, 1.8])) for i in range(300)), key=lambda r: r[2])
    positions = [(i, rnd.randrange(4), rnd.randrange(60) * 1000, rnd.choice([0.0, 1.0, 1.2]), 1.0, 1.0) for i in range(50)]
    return trades, [*positions, positions[0]]


def wanted(trades, positions, cuts):
    times, out = Counter(p[0] for p in positions), {}
    for p in dict.fromkeys(positions):
        for rule in RULES if p[3] > 0 else []:
            fold = exits.PositionFold({**rule.__dict__, **dict(zip([c.split()[0] for c in POSITION.split(", ")], p))})
            for i in range(cuts):
                ticks = {}
                for tid, token, ts, price in trades[i * len(trades) // cuts:(i + 1) * len(trades) // cuts]:
                    if token == p[1] and price > 0 and ts > p[2]:
                        old = ticks.get(ts, (-1, 0.0, 0))
                        ticks[ts] = (*max((tid, price), old[:2]), old[2] + 1)
                for ts in sorted(ticks):
                    if (p[0], rule.rule_set) not in out:
                        closed = fold.step(ts, ticks[ts][1], ticks[ts][2] * times[p[0]])
                        if closed:
                            out[p[0], rule.rule_set] = closed
    return out


@pytest.mark.parametrize("cuts", [1, 3])
def test_folds_go_on_over_batches(spark, tmp_path, cuts):
    trades, positions = made()
    stream = replay(spark, trades, TRADE, str(tmp_path / "in"), cuts)
    p = spark.createDataFrame(positions, POSITION)
    got = drained(spark, streams.stream_positions(stream, p, exits.exit_rule_sets(spark, RULES)), str(tmp_path / "out"))
    assert {(r["id"], r["rule_set"]): tuple(r) for r in got.collect()} == wanted(trades, positions, cuts)


def test_trades_and_positions_are_not_paired(spark, tmp_path):
    stream = replay(spark, made()[0], TRADE, str(tmp_path / "in"), 1)
    p = spark.range(3).select("id", F.col("id").cast("int").alias("mint_address"), F.lit(0).cast("long").alias("entered_ms"),
                              *[F.lit(1.0).alias(c) for c in ("entry_price", "entry_sol", "token_amount")])
    plan = streams.stream_positions(stream, p, exits.exit_rule_sets(spark, RULES))._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan
