"""Streaming queries: the event table is replayed as a stream in time-ordered files and drained."""

from pyspark.sql import functions as F

from launchlens.functions import rounded
from launchlens.functions.columns import round_off_tie
from launchlens.operators import exits
from launchlens.plans import query
from launchlens.models import training
from launchlens.plans.features import GRID, SEEN
from launchlens.plans.learning import pre_rows, trained
from launchlens.plans.policy import CHAIN
from launchlens.plans.wallets import PAIRS, STATS, stats
from launchlens.sources import files, tables as t
from launchlens.streaming import scoring, snapshots, streams as ops

COLS = ["trade_id", "mint_address", "wallet", "is_buy", "sol_amount", "token_amount", "price_sol", "market_cap_sol", "ts_ms"]
PARTS = 3
FILES = 4
CLOSE_MS = 10**10


def replayed(spark, sf, twice=False, closing_row=False, parts=PARTS):
    """Trades as a file stream, FILES files per time slice over the whole time range. `twice` repeats every fourth trade; the
    closing row lies far ahead and lets all windows end."""
    rows = t.trades(spark, sf).select(*COLS)
    if twice:
        rows = rows.withColumn("_c", F.explode(F.when(F.col("trade_id") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_c")
    root = files.work_dir(spark, "replay")
    first, last = rows.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    width = ((last or 0) - (first or 0)) // parts + 1
    for i in range(parts):
        slot = F.floor((F.col("ts_ms") - F.lit(first or 0)) / width)
        rows.filter(slot == i).repartition(FILES).write.mode("append").parquet(root)
    if closing_row:
        for k in (1, 2):
            rows.orderBy("trade_id").limit(1).withColumn("ts_ms", F.lit(CLOSE_MS * k).cast("long")).withColumn("mint_address", F.lit(-1)).write.mode("append").parquet(root)
    schema = rows.schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(root)


def drain(spark, stream, mode="append", sink=None, name="stream"):
    """Run until the input is used up; results of the batches are read back from their folders."""
    out = files.work_dir(spark, name)
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True)
    q = w.foreachBatch(sink or ops.append_versions(out)).start()
    q.awaitTermination()
    return spark.read.parquet(out) if sink is None else None


KEYS = ["trade_id", "mint_address", "wallet", "is_buy", "sol_amount", "token_amount"]
LATE = "20 minutes"


@query("st1_stream_trades", t.oracle("SELECT trade_id, mint_address, wallet, is_buy, sol_amount, token_amount, ts_ms FROM trades"))
def _(spark, sf):
    # a stream starts with its watermark at the epoch, where the compressed clock also starts
    s = replayed(spark, sf, twice=True).withColumn("ts_ms", F.col("ts_ms") + CLOSE_MS)
    return drain(spark, ops.stream_trades(s, KEYS, LATE)).select(*KEYS, (F.col("ts_ms") - CLOSE_MS).alias("ts_ms"))


@query("st2_stream_mint_state", t.oracle("""SELECT mint_address, max(ts_ms) AS last_trade_ms, round(arg_max(price_sol, ts_ms * 1000000000 + trade_id), 6) AS last_price_sol, max(market_cap_sol) AS peak_market_cap_sol, count(*) AS trade_count FROM trades GROUP BY 1"""))
def _(spark, sf):
    v = drain(spark, ops.stream_mint_state(replayed(spark, sf)), "update")
    out = ops.latest_versions(v, ["mint_address"])
    return out.withColumn("last_price_sol", round_off_tie(F.col("last_price_sol")))


SNAP_AGES = [60, 120, 300]
_SIDE = "{f}(sol_amount) FILTER (is_buy = {b})"


def _moments(side, b):
    one = lambda f: _SIDE.format(f=f, b=b)
    return f"""round(coalesce({one('avg')}, 0.0), 6) AS avg_{side}_sol, round(coalesce({one('max')}, 0.0), 6) AS max_{side}_sol,
  round(CASE WHEN count(*) FILTER (is_buy = {b}) >= 2 THEN {one('stddev_pop')} ELSE 0.0 END, 6) AS std_{side}_sol"""


@query("st3_stream_snapshots", t.oracle(f"""
SELECT mint_address, age AS snapshot_age_sec, round(coalesce(sum(sol_amount) FILTER (is_buy = 1), 0.0), 6) AS sol_inflow, round(coalesce(sum(sol_amount) FILTER (is_buy = 0), 0.0), 6) AS sol_outflow,
  count(*) FILTER (is_buy = 1) AS buy_count, count(*) FILTER (is_buy = 0) AS sell_count,
  round(CASE WHEN count(*) FILTER (is_buy = 0) > 0 THEN count(*) FILTER (is_buy = 1) / count(*) FILTER (is_buy = 0) ELSE 99.0::double END, 6) AS buy_sell_ratio,
  count(*) AS trade_count, round(count(*) / age * 60, 6) AS trades_per_min, {_moments('buy', 1)}, {_moments('sell', 0)},
  count(*) FILTER (is_buy = 1 AND wallet = creator_wallet) AS creator_buys_post_launch, count(*) FILTER (is_buy = 0 AND wallet = creator_wallet) AS creator_sells_post_launch,
  round(arg_max(price_sol, ts_ms * 1000000000 + trade_id), 6) AS trade_price_sol, round(max(price_sol), 6) AS peak_price_sol
FROM seen WHERE age IN (60, 120, 300) GROUP BY mint_address, age""", GRID, SEEN))
def _(spark, sf):
    # a stream starts with its watermark at the epoch, where the compressed clock also starts
    m = t.mints(spark, sf).withColumn("created_ms", F.col("created_ms") + CLOSE_MS)
    m = files.replace_table(m, files.work_dir(spark, "launches"))  # a file set of its own: a plain table for the stream
    s = replayed(spark, sf, closing_row=True, parts=6).withColumn("ts_ms", F.col("ts_ms") + CLOSE_MS)
    with snapshots.timers(spark):
        out = drain(spark, snapshots.stream_snapshots(s, m, SNAP_AGES, LATE))
    return rounded(out.drop("batch", "cutoff_ts"))


@query("st4_ingest_rate", t.oracle("""SELECT ts_ms // 60000 * 60000 AS minute_ms, cast(sum(CASE WHEN trade_id % 4 = 0 THEN 2 ELSE 1 END) AS bigint) AS parsed, count(*) AS new, count(*) FILTER (trade_id % 4 = 0) AS duplicates FROM trades GROUP BY 1"""))
def _(spark, sf):
    return drain(spark, ops.ingest_rate(replayed(spark, sf, twice=True, closing_row=True), KEYS, LATE)).filter(F.col("minute_ms") < CLOSE_MS - 60_000).drop("batch")


@query("st5_stream_flow", t.oracle("""SELECT mint_address, s AS start_ms, round(sum(CASE WHEN is_buy = 1 THEN sol_amount ELSE 0.0 END), 6) AS buy_sol, count(*) FILTER (is_buy = 1) AS buys,
  round(sum(CASE WHEN is_buy = 0 THEN sol_amount ELSE 0.0 END), 6) AS sell_sol, count(*) FILTER (is_buy = 0) AS sells
FROM (SELECT *, cast(floor(unnest(range(ts_ms - 20000, ts_ms + 1, 10000)) / 10000) AS bigint) * 10000 AS s FROM trades) GROUP BY 1, 2"""))
def _(spark, sf):
    s = ops.flow_windows(replayed(spark, sf, closing_row=True), LATE, "30 seconds", "10 seconds")
    return rounded(drain(spark, s).filter("mint_address >= 0").drop("batch", "sellers"))


@query("st6_stream_quiet_tokens", t.oracle("""
SELECT mint_address, min(ts_ms) AS start_ms, max(ts_ms) AS last_trade_ms, count(*) AS trades FROM (
  SELECT *, sum(brk) OVER (PARTITION BY mint_address ORDER BY ts_ms, trade_id) AS s FROM (
    SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY mint_address ORDER BY ts_ms, trade_id) > 15000 THEN 1 ELSE 0 END AS brk FROM trades)) GROUP BY mint_address, s"""))
def _(spark, sf):
    return drain(spark, ops.quiet_tokens(replayed(spark, sf, closing_row=True), "15 seconds", LATE)).filter("mint_address >= 0").drop("batch")


@query("st7_stream_positions")
def _(spark, sf):
    p = t.positions(spark, sf).select("id", "mint_address", "entered_ms", "entry_price", "entry_sol", "token_amount")
    # a file set of its own, so that the ledger is a plain table for the stream
    p = files.replace_table(p, files.work_dir(spark, "ledger"))
    rules = exits.exit_rule_sets(spark, [exits.ExitRules("barrier", [35.0], [1.0], stop_loss_pct=30.0, max_hold_min=1.0)])
    with snapshots.timers(spark):
        out = drain(spark, ops.stream_positions(replayed(spark, sf), p, rules))
    return rounded(out.drop("batch"))


FRESH_MS = 100_000


def replayed_snapshots(spark, sf, parts=4):
    """Wide snapshots with creator and rug state as a file stream, in time slices; the clock starts late enough for watermarks."""
    m = t.mints(spark, sf).select("mint_address", "creator_wallet", "rugged")
    wide = pre_rows(spark, sf)
    rows = wide.drop("creator_wallet", "rugged").join(m, "mint_address").withColumn("snapshot_ts", F.col("snapshot_ts") + CLOSE_MS)
    root = files.work_dir(spark, "snapshot-replay")
    first, last = rows.agg(F.min("snapshot_ts"), F.max("snapshot_ts")).first()
    width = ((last or 0) - (first or 0)) // parts + 1
    for i in range(parts):
        rows.filter(F.floor((F.col("snapshot_ts") - F.lit(first or 0)) / width) == i).coalesce(1).write.mode("append").parquet(root)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(root)


def worth(spark, sf):
    skill = files.replace_table(stats(spark, sf), files.work_dir(spark, "skill"))
    return scoring.worth_scoring(replayed_snapshots(spark, sf), skill, 5, FRESH_MS, LATE)


@query("st8_worth_scoring", t.oracle(f"""
SELECT mint_address, ts AS snapshot_ts, creator_wallet, round(skill_score, 6) AS creator_skill, round(win_rate, 6) AS creator_win_rate, mints_completed AS creator_completed FROM (
  WITH RECURSIVE able AS (SELECT g.mint_address, g.creator_wallet, g.cutoff AS ts FROM grid g JOIN trades t ON t.mint_address = g.mint_address AND t.ts_ms <= g.cutoff
      WHERE coalesce(g.rugged, 0) = 0 GROUP BY ALL HAVING count(*) >= 5),
    kept AS (SELECT mint_address, min(ts) AS ts FROM able GROUP BY 1
      UNION ALL SELECT k.mint_address, min(a.ts) FROM kept k JOIN able a ON a.mint_address = k.mint_address AND a.ts >= k.ts + {FRESH_MS} GROUP BY k.mint_address, k.ts)
  SELECT kept.*, creator_wallet FROM kept JOIN mints USING (mint_address)) LEFT JOIN wallet_stats ON wallet = creator_wallet""", PAIRS, STATS))
def _(spark, sf):
    with snapshots.timers(spark):
        out = drain(spark, worth(spark, sf))
    return rounded(out.select("mint_address", (F.col("snapshot_ts") - CLOSE_MS).alias("snapshot_ts"), "creator_wallet", "creator_skill", "creator_win_rate", "creator_completed"))


@query("st8_stream_scoring")
def _(spark, sf):
    models = training.load_models(spark, f"{trained(spark, sf)[0]}/pre/models")
    with snapshots.timers(spark):
        out = drain(spark, scoring.stream_scoring(worth(spark, sf), models))
    return rounded(out.drop("batch").withColumn("ts_ms", F.col("ts_ms") - CLOSE_MS))


@query("st9_stream_call_dedup", t.oracle("SELECT DISTINCT mint_address FROM trades"))
def _(spark, sf):
    return drain(spark, ops.call_dedup(replayed(spark, sf).select("mint_address", "ts_ms"))).select("mint_address")


@query("st9_first_calls", t.oracle("SELECT mint_address, ts_ms, id FROM chain", *CHAIN).replace("WITH trades", "WITH RECURSIVE trades", 1))
def _(spark, sf):
    opens = t.positions(spark, sf).groupBy("mint_address", F.col("entered_ms").alias("ts_ms")).agg(F.min("id").alias("id"))
    opens = opens.withColumn("ts_ms", F.col("ts_ms") + CLOSE_MS)
    root = files.work_dir(spark, "opens")
    part = F.least(F.lit(2), F.greatest(F.lit(0), F.floor((F.col("ts_ms") - CLOSE_MS) / 250_000)))  # in order of time
    for i in range(3):
        opens.filter(part == i).coalesce(1).write.mode("append").parquet(root)
    stream = spark.readStream.schema(opens.schema).option("maxFilesPerTrigger", 1).parquet(root)
    with snapshots.timers(spark):
        out = drain(spark, scoring.first_calls(stream, 100_000, LATE))
    return out.select("mint_address", (F.col("ts_ms") - CLOSE_MS).alias("ts_ms"), "id")


@query("st10_late_rows", t.oracle("""SELECT ts_ms // 60000 * 60000 AS minute_ms, count(*) AS rejected FROM trades WHERE NOT (sol_amount BETWEEN 0 AND 1000 AND token_amount BETWEEN 0 AND 1e15 AND ts_ms BETWEEN 86700000 - 86400000 AND 86700000 + 60000) GROUP BY 1"""))
def _(spark, sf):
    v = drain(spark, ops.late_rows(replayed(spark, sf), 86_700_000).select(F.unix_millis("window.start").alias("minute_ms"), "rejected"), "update")
    return ops.latest_versions(v, ["minute_ms"])
