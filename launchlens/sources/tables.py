"""Launch-and-trade tables derived from the generic test tables (mapping in FIXTURES.md).

Spark side and SQL side of every derived table stand next to each other: the functions return
DataFrames, PRELUDE holds the same tables as SQL common table expressions for the oracle.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from launchlens.functions import asof_join
from launchlens.sources.files import work_dir

# Fixed values of the test mapping.
CLOCK_ZERO_MS = 473_352_000
BUY_TYPES = ["purchase", "click", "view"]
AGES = [5, 15, 30, 60, 120, 300, 600]
AS_OF_MS = 720_000
DAY = "2024-01-10"
DAY_START_MS = 1_704_844_800_000
DAY_MS = 86_400_000
PREDICTION_TARGETS = [
    "will_rug", "rug_within_5min", "peak_within_5min", "peaked_100",
    "peaked_30", "hits_2x_within_1h", "will_migrate", "local_top_60s",
]
EXIT_REASONS = [
    "HARD_STOP_-40", "TRAIL_STOP", "STALE_DATA", "STALE_FLAT", "NO_PUMP_TIMEOUT",
    "MIGRATED_NO_TRACKING", "STALLED_PUMP", "RUGGED", "ML_SELL",
]


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """A derived table, written once per application and read from there, as the platform's own tables are."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        path = work_dir(spark, name)
        build().write.mode("overwrite").parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def _pick(items: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(i) for i in items]), (index + 1).cast("int"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/events.parquet")


def trades(spark: SparkSession, sf: str, day: str | None = None) -> DataFrame:
    """The trade table, optionally of one UTC day; the day is compared with the stored time, so the scan prunes by it."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    tokens = (F.lit(1) + F.col("event_id") % 7).cast("double")
    source = events(spark, sf)
    if day:
        kind = source.schema["ts"].dataType.simpleString()
        edge = lambda text: F.lit(text).cast(kind)
        source = source.filter((F.col("ts") >= edge(f"{day} 00:00:00")) & (F.col("ts") < edge(f"{date.fromisoformat(day) + timedelta(1)} 00:00:00")))
    return source.select(
        F.col("event_id").alias("trade_id"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("mint_address"),
        F.col("user_id").alias("wallet"),
        F.when(F.col("event_type").isin(BUY_TYPES), 1).otherwise(0).alias("is_buy"),
        F.col("value").alias("sol_amount"),
        tokens.alias("token_amount"),
        (F.col("value") / tokens).alias("price_sol"),
        (F.col("value") / tokens * 1e9).alias("market_cap_sol"),
        (F.floor(ms / 3_600_000.0).cast("long") * 1000 - CLOCK_ZERO_MS).alias("ts_ms"),
        ms.alias("ts_real_ms"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("is_junk"),
    )


def mints(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "mints", lambda: _mints(spark, sf))


def _mints(spark: SparkSession, sf: str) -> DataFrame:
    t = trades(spark, sf)
    k = F.col("mint_address")
    order = F.struct("ts_ms", "trade_id")
    return (
        t.groupBy("mint_address")
        .agg(
            F.min("ts_ms").alias("created_ms"),
            F.min("ts_real_ms").alias("created_real_ms"),
            F.min_by("sol_amount", order).alias("initial_buy_sol"),
            F.max("market_cap_sol").alias("peak_market_cap_sol"),
            F.max("ts_ms").alias("last_trade_ms"),
            F.max("ts_real_ms").alias("last_trade_real_ms"),
            F.max_by("price_sol", order).alias("last_price_sol"),
            F.count(F.lit(1)).alias("trade_count"),
        )
        .select(
            "*",
            (k % 20).cast("long").alias("creator_wallet"),
            F.concat(F.lit("token "), k.cast("string")).alias("name"),
            F.concat(F.lit("T"), k.cast("string")).alias("symbol"),
            F.when(k % 2 == 0, "x.com/t").otherwise("").alias("twitter"),
            F.when(k % 3 == 0, "t.me/t").otherwise("").alias("telegram"),
            F.when(k % 5 == 0, "site").otherwise("").alias("website"),
            F.when(k % 10 == 0, 1).otherwise(0).alias("migrated"),
            F.when(k % 10 == 0, F.col("created_ms") + 200_000).alias("migrated_ms"),
            F.when(k % 10 == 0, F.col("created_real_ms") + 200_000_000).alias("migrated_real_ms"),
            F.when(k % 13 == 0, 1).otherwise(0).alias("rugged"),
            F.when(k % 13 == 0, F.col("created_ms") + 400_000).alias("rugged_ms"),
            F.when(k % 13 == 0, F.col("created_real_ms") + 400_000_000).alias("rugged_real_ms"),
            (F.col("last_price_sol") * 1e9).alias("current_market_cap_sol"),
            (F.lit(30.0) + k % 50).alias("v_sol_in_curve"),
            (F.lit(1e6) + k * 1000.0).alias("v_tokens_in_curve"),
            F.concat(F.lit("curve-"), k.cast("string")).alias("bonding_curve_key"),
        )
    )


def wallets(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("wallet")
    return (
        trades(spark, sf).select("wallet").distinct().select(
            u.alias("address"),
            F.when(u % 7 == 0, 1).otherwise(0).alias("tracked"),
            F.when(u % 11 == 0, 1).otherwise(0).alias("is_kol"),
            F.when(u % 5 == 0, F.concat(F.lit("b"), (u % 3).cast("string"))).otherwise("").alias("bundle_cluster_id"),
        )
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return trades(spark, sf).select(
        F.col("trade_id").alias("prediction_id"),
        "ts_ms",
        "mint_address",
        _pick(PREDICTION_TARGETS, F.col("trade_id") % 8).alias("target"),
        ((F.col("trade_id") * 7919) % 1000 / 1000.0).alias("prob"),
    )


def positions(spark: SparkSession, sf: str) -> DataFrame:
    """One position per buy. Two thirds are closed, the exit price is the last price at or before the exit."""
    return stored(spark, sf, "positions", lambda: _positions(spark, sf))


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    t = trades(spark, sf)
    i = F.col("id")
    entered = t.filter("is_buy = 1").select(
        F.col("trade_id").alias("id"),
        "mint_address",
        F.concat(F.lit("s"), (F.col("trade_id") % 4).cast("string")).alias("strategy"),
        F.col("ts_ms").alias("entered_ms"),
        F.col("price_sol").alias("entry_price"),
        (F.col("sol_amount") / 500.0).alias("entry_sol"),
        F.col("market_cap_sol").alias("entry_mcap_sol"),
    )
    p = entered.withColumn("is_open", (i % 3 == 0) & (F.col("mint_address") % 2 == 0)).withColumn(
        "exited_ms", F.when(~F.col("is_open"), F.col("entered_ms") + (1 + i % 120) * 1000)
    )
    marked = asof_join(
        p.withColumn("_at", F.coalesce("exited_ms", F.lit(AS_OF_MS))),
        t.select("mint_address", "ts_ms", "trade_id", F.col("price_sol").alias("exit_price")),
        ["mint_address"], "_at", "ts_ms", ["exit_price"], tie="trade_id", chunk_ms=60_000,
    )
    closed = ~F.col("is_open")
    pnl_pct = F.when(F.col("entry_price") > 0, (F.col("exit_price") / F.col("entry_price") - 1) * 100).otherwise(0.0)
    tokens = F.when(F.col("entry_price") > 0, F.col("entry_sol") / F.col("entry_price")).otherwise(0.0)
    return marked.select(
        "id", "mint_address", "strategy", "entered_ms", "entry_price", "entry_sol", "entry_mcap_sol",
        tokens.alias("token_amount"),
        F.when(i % 4 == 0, tokens * 0.6).otherwise(tokens).alias("tokens_remaining"),
        F.when(i % 4 == 0, F.col("entry_sol") * 0.5 + (i % 9) * 0.05).otherwise(0.0).alias("sol_realized_so_far"),
        ((i * 37) % 100 / 250.0).alias("entry_score"),
        (F.lit(10.0) + (i * 53) % 190).alias("predicted_peak_pct"),
        ((i * 29) % 120).cast("double").alias("highest_pct"),
        F.when(i % 4 == 0, F.array(F.lit("T1"))).otherwise(F.array().cast("array<string>")).alias("tiers_hit"),
        F.when(closed, "closed").otherwise("open").alias("status"),
        "exited_ms",
        F.when(closed, F.col("exit_price")).alias("exit_price"),
        F.when(closed, _pick(EXIT_REASONS, i % 9)).alias("exit_reason"),
        F.when(closed, F.col("entry_sol") * pnl_pct / 100).alias("realized_pnl_sol"),
        F.when(closed, pnl_pct).alias("realized_pnl_pct"),
        F.when(i % 6 == 0, 1).otherwise(0).alias("is_moonbag"),
    )


def pairs_feed(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(
        (F.col("p_partkey") % 100).cast("int").alias("mint_address"),
        F.col("p_partkey").alias("pos"),
        (F.col("p_retailprice") / 1e6).alias("price_native"),
        F.col("p_retailprice").alias("liquidity_usd"),
        F.col("p_size").alias("m5_buys"),
        F.lit(0).alias("m5_sells"),
    )


_TARGETS_SQL = "[" + ",".join(f"'{t}'" for t in PREDICTION_TARGETS) + "]"
_REASONS_SQL = "[" + ",".join(f"'{t}'" for t in EXIT_REASONS) + "]"

PRELUDE = f"""
trades AS (
  SELECT event_id AS trade_id, cast(regexp_extract(props,'([0-9]+)',1) AS int) AS mint_address,
    user_id AS wallet, CASE WHEN event_type IN ('purchase','click','view') THEN 1 ELSE 0 END AS is_buy,
    value AS sol_amount, cast(1 + event_id % 7 AS double) AS token_amount,
    value / (1 + event_id % 7) AS price_sol, value / (1 + event_id % 7) * 1e9 AS market_cap_sol,
    cast(floor((epoch_us(ts) // 1000)/3600000.0) AS bigint)*1000 - {CLOCK_ZERO_MS} AS ts_ms,
    (epoch_us(ts) // 1000) AS ts_real_ms,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_junk
  FROM events),
ranked_trades AS (
  SELECT *, row_number() OVER (PARTITION BY mint_address ORDER BY ts_ms, trade_id) AS rn,
    row_number() OVER (PARTITION BY mint_address ORDER BY ts_ms DESC, trade_id DESC) AS rn_desc FROM trades),
mints AS (
  SELECT mint_address, min(ts_ms) AS created_ms, min(ts_real_ms) AS created_real_ms,
    max(CASE WHEN rn = 1 THEN sol_amount END) AS initial_buy_sol,
    max(market_cap_sol) AS peak_market_cap_sol, max(ts_ms) AS last_trade_ms,
    max(ts_real_ms) AS last_trade_real_ms,
    max(CASE WHEN rn_desc = 1 THEN price_sol END) AS last_price_sol, count(*) AS trade_count,
    cast(mint_address % 20 AS bigint) AS creator_wallet,
    'token ' || mint_address AS name, 'T' || mint_address AS symbol,
    CASE WHEN mint_address % 2 = 0 THEN 'x.com/t' ELSE '' END AS twitter,
    CASE WHEN mint_address % 3 = 0 THEN 't.me/t' ELSE '' END AS telegram,
    CASE WHEN mint_address % 5 = 0 THEN 'site' ELSE '' END AS website,
    CASE WHEN mint_address % 10 = 0 THEN 1 ELSE 0 END AS migrated,
    CASE WHEN mint_address % 10 = 0 THEN min(ts_ms) + 200000 END AS migrated_ms,
    CASE WHEN mint_address % 10 = 0 THEN min(ts_real_ms) + 200000000 END AS migrated_real_ms,
    CASE WHEN mint_address % 13 = 0 THEN 1 ELSE 0 END AS rugged,
    CASE WHEN mint_address % 13 = 0 THEN min(ts_ms) + 400000 END AS rugged_ms,
    CASE WHEN mint_address % 13 = 0 THEN min(ts_real_ms) + 400000000 END AS rugged_real_ms,
    max(CASE WHEN rn_desc = 1 THEN price_sol END) * 1e9 AS current_market_cap_sol,
    30.0::double + mint_address % 50 AS v_sol_in_curve, 1e6::double + mint_address * 1000.0::double AS v_tokens_in_curve,
    'curve-' || mint_address AS bonding_curve_key
  FROM ranked_trades GROUP BY mint_address),
wallets AS (
  SELECT DISTINCT wallet AS address, CASE WHEN wallet % 7 = 0 THEN 1 ELSE 0 END AS tracked,
    CASE WHEN wallet % 11 = 0 THEN 1 ELSE 0 END AS is_kol,
    CASE WHEN wallet % 5 = 0 THEN 'b' || (wallet % 3) ELSE '' END AS bundle_cluster_id FROM trades),
predictions AS (
  SELECT trade_id AS prediction_id, ts_ms, mint_address, ({_TARGETS_SQL})[trade_id % 8 + 1] AS target,
    (trade_id * 7919) % 1000 / 1000.0::double AS prob FROM trades),
entries AS (
  SELECT trade_id AS id, mint_address, 's' || (trade_id % 4) AS strategy, ts_ms AS entered_ms,
    price_sol AS entry_price, sol_amount / 500.0 AS entry_sol, market_cap_sol AS entry_mcap_sol,
    (trade_id % 3 = 0 AND mint_address % 2 = 0) AS is_open,
    CASE WHEN NOT (trade_id % 3 = 0 AND mint_address % 2 = 0) THEN ts_ms + (1 + trade_id % 120) * 1000 END AS exited_ms
  FROM trades WHERE is_buy = 1),
last_in_second AS (
  SELECT mint_address, ts_ms, arg_max(price_sol, trade_id) AS price FROM trades GROUP BY 1, 2),
marked AS (
  SELECT e.*, l.price AS mark_price FROM entries e ASOF LEFT JOIN last_in_second l
    ON e.mint_address = l.mint_address AND coalesce(e.exited_ms, {AS_OF_MS}) >= l.ts_ms),
positions AS (
  SELECT id, mint_address, strategy, entered_ms, entry_price, entry_sol, entry_mcap_sol,
    CASE WHEN entry_price > 0 THEN entry_sol / entry_price ELSE 0.0 END AS token_amount,
    CASE WHEN entry_price > 0 THEN entry_sol / entry_price ELSE 0.0 END * CASE WHEN id % 4 = 0 THEN 0.6::double ELSE 1.0::double END AS tokens_remaining,
    CASE WHEN id % 4 = 0 THEN entry_sol * 0.5::double + (id % 9) * 0.05::double ELSE 0.0 END AS sol_realized_so_far,
    (id * 37) % 100 / 250.0::double AS entry_score, 10.0::double + (id * 53) % 190 AS predicted_peak_pct,
    cast((id * 29) % 120 AS double) AS highest_pct,
    CASE WHEN id % 4 = 0 THEN ['T1'] ELSE []::varchar[] END AS tiers_hit,
    CASE WHEN is_open THEN 'open' ELSE 'closed' END AS status, exited_ms,
    CASE WHEN NOT is_open THEN mark_price END AS exit_price,
    CASE WHEN NOT is_open THEN ({_REASONS_SQL})[id % 9 + 1] END AS exit_reason,
    CASE WHEN NOT is_open THEN entry_sol * CASE WHEN entry_price > 0 THEN (mark_price / entry_price - 1) * 100 ELSE 0.0 END / 100 END AS realized_pnl_sol,
    CASE WHEN NOT is_open THEN CASE WHEN entry_price > 0 THEN (mark_price / entry_price - 1) * 100 ELSE 0.0 END END AS realized_pnl_pct,
    CASE WHEN id % 6 = 0 THEN 1 ELSE 0 END AS is_moonbag
  FROM marked),
pairs_feed AS (
  SELECT cast(p_partkey % 100 AS int) AS mint_address, p_partkey AS pos, p_retailprice / 1e6 AS price_native,
    p_retailprice AS liquidity_usd, p_size AS m5_buys, 0 AS m5_sells FROM part),
ages AS (SELECT unnest({AGES}) AS age),
grid AS (SELECT m.*, a.age, m.created_ms + a.age * 1000 AS cutoff FROM mints m, ages a)
"""


def oracle(body: str, *extra: str) -> str:
    """SQL text: the table expressions above, optional further ones, then the body."""
    return nudge_rounding("WITH " + ",\n".join([PRELUDE.strip(), *extra]) + "\n" + body)


def nudge_rounding(sql: str) -> str:
    """round(x, 6) becomes round((x) + 1e-9, 6), as `rounded` does.

    Averages of two-digit amounts often end exactly in a 5 at the seventh digit; the last bit of the
    sum would then decide the rounding. Off the tie, both engines agree.
    """
    out, at = [], 0
    while (i := sql.find("round(", at)) >= 0:
        depth, j, comma = 1, i + 6, None
        while depth:
            c = sql[j]
            depth += (c in "([{") - (c in ")]}")
            if c == "," and depth == 1:
                comma = j
            j += 1
        inner = nudge_rounding(sql[i + 6 : comma])
        digits = sql[comma + 1 : j - 1].strip()
        out.append(sql[at:i] + (f"round(({inner}) + 1e-9, 6)" if digits == "6" else f"round({inner}, {digits})"))
        at = j
    return "".join(out) + sql[at:]
