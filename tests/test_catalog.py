"""A slice of the catalog against its oracle on the smallest data set; tools/check.py runs all of it."""

import duckdb
import pytest

from launchlens import plans

SF = "/root/testdata/sf0.001"
NAMES = [
    "a1_flow_features", "a16_wallet_token_pnl", "a17_wallet_skill", "a3_concentration", "w1_price_runs", "w2_max_rolling", "w4_highest_since_entry",
    "w7_post_exit_path", "j8_entry_predictions", "l0_resolve_labels", "l14_drawdowns", "m1_time_split", "m2_time_split_lean", "m6_binary_metrics",
    "m7_regression_metrics", "p2_entry_score_pre", "p9_first_barrier", "p16_rate_limited_calls", "s1_read_trades_day", "s4_decode_trade_events",
    "s7_enrich_trades", "s12_archive_day", "st2_stream_mint_state",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "part"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    fn, sql = plans.load()[name]
    df = fn(spark, SF)
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(map(str, rel.fetchall()))
    got = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    assert got == want


def test_names_and_oracles():
    cat = plans.load()
    assert len(cat) > 150 and sum(bool(s) for _, s in cat.values()) > 140
