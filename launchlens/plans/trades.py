"""Source, clean-up and state queries."""

from pyspark.sql import functions as F

from launchlens.functions import rounded
from launchlens.operators import ingest as ops
from launchlens.plans import query
from launchlens.plans.wallets import PAIRS, STATS, stats
from launchlens.sources import binary, files, tables as t

DAY_FILTER = f"ts_real_ms >= {t.DAY_START_MS} AND ts_real_ms < {t.DAY_START_MS + t.DAY_MS}"
BASIC = "trade_id, mint_address, wallet, is_buy, sol_amount"


@query("s1_read_trades_day", t.oracle(f"SELECT {BASIC}, ts_real_ms FROM trades WHERE {DAY_FILTER}"))
def _(spark, sf):
    archive = files.work_dir(spark, "archive")
    files.archive_day(t.trades(spark, sf, t.DAY), t.DAY, archive, "ts_real_ms")
    rows = files.read_trades(spark, archive, t.DAY, "ts_real_ms")
    return rows.select("trade_id", "mint_address", "wallet", "is_buy", "sol_amount", "ts_real_ms")


def launch_messages(spark, sf):
    """Raw message text made from the events: creates by type, creates by shape, migrations, noise."""
    kind = F.col("event_type")
    k = F.regexp_extract("props", "([0-9]+)", 1)
    u, i, v = F.col("user_id").cast("string"), F.col("event_id"), F.col("value")
    when = lambda c, x: F.when(c, x)
    create, shaped, moved, noise = kind == "signup", kind == "purchase", kind == "click", kind == "error"
    body = F.struct(
        when(create, F.lit("create")).when(moved, F.lit("migrate")).alias("txType"),
        when(~noise, k).alias("mint"),
        when(create | (shaped & (F.col("user_id") % 5 != 0)), u).alias("traderPublicKey"),
        when(create, F.concat(F.lit("sig"), i.cast("string"))).alias("signature"),
        when(create & (i % 3 != 0), F.concat(F.lit("token "), k)).when(create, F.lit("")).alias("name"),
        when(create | shaped, F.concat(F.lit("T"), k)).alias("symbol"),
        when(~noise, F.concat(F.lit("curve-"), k)).alias("bondingCurveKey"),
        when(create, v).alias("solAmount"), when(shaped, v * 2).alias("initialBuy"),
        when(create | shaped, v + 30).alias("vSolInBondingCurve"),
        when((create | shaped) & (i % 4 != 0), F.lit(1000.0)).alias("vTokensInBondingCurve"),
        when(create, v * 10).alias("marketCapSol"), when(noise, F.lit("subscribed")).alias("message"),
    )
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return t.events(spark, sf).select(F.to_json(body).alias("value"), ms.alias("received_ms"), i.alias("seq"))


@query("s2_normalize_launch_events", t.oracle("""
SELECT k AS mint_address, u AS creator_wallet, CASE WHEN event_type = 'signup' THEN 'sig' || event_id END AS signature,
  CASE WHEN event_type = 'signup' AND event_id % 3 <> 0 THEN 'token ' || k END AS name, 'T' || k AS symbol, NULL AS uri,
  CASE WHEN event_type = 'signup' AND value <> 0 THEN value WHEN event_type = 'purchase' THEN value * 2 ELSE 0.0::double END AS initial_buy_sol, value + 30 AS v_sol_in_curve,
  CASE WHEN event_id % 4 <> 0 THEN 1000.0::double ELSE 0.0::double END AS v_tokens_in_curve,
  CASE WHEN event_type = 'signup' THEN value * 10 ELSE 0.0::double END AS current_market_cap_sol, CASE WHEN event_type = 'signup' THEN value * 10 ELSE 0.0::double END AS peak_market_cap_sol,
  round(CASE WHEN event_id % 4 <> 0 THEN (value + 30) / 1000.0::double ELSE 0.0::double END, 6) AS last_price_sol, ms AS last_trade_ms, ms AS created_ms, 'curve-' || k AS bonding_curve_key, 'pump' AS pool
FROM (SELECT *, (epoch_us(ts) // 1000) AS ms, regexp_extract(props,'([0-9]+)',1) AS k, cast(user_id AS varchar) AS u,
    row_number() OVER (PARTITION BY regexp_extract(props,'([0-9]+)',1) ORDER BY (epoch_us(ts) // 1000), event_id) AS rn
  FROM events WHERE event_type = 'signup' OR (event_type = 'purchase' AND user_id % 5 <> 0)) WHERE rn = 1"""))
def _(spark, sf):
    out = ops.normalize_launch_events(launch_messages(spark, sf))
    return out.withColumn("last_price_sol", F.round(F.col("last_price_sol") + 1e-9, 6))


@query("s3_apply_migrations", t.oracle("""
SELECT m.mint_address, (x.ms IS NOT NULL)::int AS migrated, x.ms AS migrated_ms, CASE WHEN x.ms IS NULL THEN 'pump' ELSE 'pumpamm' END AS pool
FROM mints m LEFT JOIN (SELECT regexp_extract(props,'([0-9]+)',1)::int AS k, min((epoch_us(ts) // 1000)) AS ms FROM events WHERE event_type = 'click' GROUP BY 1) x ON x.k = m.mint_address"""))
def _(spark, sf):
    moved = ops.migration_events(launch_messages(spark, sf)).withColumn("mint_address", F.col("mint_address").cast("int"))
    m = t.mints(spark, sf).select("mint_address").withColumn("pool", F.lit("pump"))
    return ops.apply_migrations(m, moved).select("mint_address", "migrated", "migrated_ms", "pool")


def log_rows(spark, sf):
    """Transactions with encoded trade events, a noise line, and broken payloads on some rows."""
    tr = t.trades(spark, sf)
    i = F.col("trade_id")
    wide = lambda c: F.lpad(F.hex(c), 64, "0")
    payload = F.concat(
        F.when(i % 17 == 0, F.lit("1B72A94DDEEB6376")).otherwise(F.lit(binary.TRADE_EVENT_TAG)),
        wide(F.col("mint_address").cast("long")),
        binary.le_hex(F.round(F.col("sol_amount") * 1e9).cast("long")), binary.le_hex(F.round(F.col("token_amount") * 1e6).cast("long")),
        F.when(F.col("is_buy") == 1, F.lit("01")).otherwise(F.lit("00")), wide(F.col("wallet")),
        binary.le_hex(F.floor(F.col("ts_real_ms") / 1000).cast("long")), binary.le_hex(i + 30_000_000_000), binary.le_hex(i + 1_000_000),
    )
    cut = F.when(i % 19 == 0, F.substring(payload, 1, 100)).otherwise(payload)
    line = F.concat(F.lit(binary.LOG_PREFIX), F.base64(F.unhex(cut)))
    return tr.select(
        F.concat(F.lit("sig"), i.cast("string")).alias("signature"), F.when(i % 11 == 0, "failed").alias("err"),
        F.array(F.lit("Program log: Instruction: Buy"), line, F.lit("Program data: ???")).alias("logs"),
    )


@query("s4_decode_trade_events", t.oracle("""
SELECT 'sig' || trade_id AS signature, lpad(lower(hex(mint_address)), 64, '0') AS mint_address, sol_amount, token_amount, is_buy,
  lpad(lower(hex(wallet)), 64, '0') AS wallet, cast(floor(ts_real_ms / 1000) AS bigint) * 1000 AS ts_ms,
  round((trade_id + 30000000000) / 1e9, 6) AS v_sol_in_curve, round((trade_id + 1000000) / 1e6, 6) AS v_tokens_in_curve
FROM trades WHERE trade_id % 11 <> 0 AND trade_id % 17 <> 0 AND trade_id % 19 <> 0"""))
def _(spark, sf):
    return rounded(binary.decode_trade_events(log_rows(spark, sf))).withColumn("sol_amount", F.round("sol_amount", 2)).withColumn("token_amount", F.round("token_amount", 2))


def curve_rows(spark, sf):
    m = t.mints(spark, sf)
    k = F.col("mint_address").cast("long")
    body = F.concat(
        F.lit("00" * 8), binary.le_hex((k + 1) * 1_000_000), binary.le_hex((k + 80) * 1_000_000_000), binary.le_hex(k * 1_000_000),
        binary.le_hex((k % 4) * 200_000_000), binary.le_hex(F.lit(10**15).cast("long")), F.when(k % 2 == 0, F.lit("01")).otherwise(F.lit("00")),
    )
    # closed accounts come back empty
    data = F.when(k % 30 == 0, F.lit("")).otherwise(F.base64(F.unhex(body)))
    return m.select(F.col("bonding_curve_key").alias("account"), data.alias("data"))


CURVES = """curves AS (SELECT 'curve-' || mint_address AS account, (mint_address + 1)::double AS v_tokens, (mint_address + 80)::double AS v_sol,
  mint_address::double AS r_tokens, (mint_address % 4) * 0.2::double AS r_sol, 1e9::double AS total_supply, (mint_address % 2 = 0)::int AS complete,
  (mint_address + 80)::double / (mint_address + 1)::double AS price_sol, 1e9::double * ((mint_address + 80)::double / (mint_address + 1)::double) AS mcap_sol
  FROM mints WHERE mint_address % 30 <> 0)"""


@query("s5_decode_curve_state", t.oracle("SELECT account, v_tokens, v_sol, r_tokens, round(r_sol, 6) AS r_sol, total_supply, complete, round(price_sol, 6) AS price_sol, round(mcap_sol, 3) AS mcap_sol FROM curves", CURVES))
def _(spark, sf):
    out = binary.decode_curve_state(curve_rows(spark, sf)).withColumn("mcap_sol", F.round("mcap_sol", 3))
    return out.select("account", "v_tokens", "v_sol", "r_tokens", F.round(F.col("r_sol") + 1e-9, 6).alias("r_sol"), "total_supply", "complete", F.round(F.col("price_sol") + 1e-9, 6).alias("price_sol"), "mcap_sol")


@query("s6_filter_sane_trades", t.oracle(f"SELECT {BASIC} FROM trades WHERE sol_amount BETWEEN 0 AND 1000 AND token_amount BETWEEN 0 AND 1e15 AND ts_real_ms BETWEEN {t.DAY_START_MS} - 86400000 AND {t.DAY_START_MS} + 60000"))
def _(spark, sf):
    return ops.filter_sane_trades(t.trades(spark, sf), t.DAY_START_MS, "ts_real_ms").select("trade_id", "mint_address", "wallet", "is_buy", "sol_amount")


@query("s7_enrich_trades", t.oracle("""SELECT trade_id, t.mint_address, round(sol_amount / token_amount, 6) AS price_sol, round(sol_amount / token_amount * 1e9, 2) AS market_cap_sol,
  greatest(0, cast(floor((ts_ms - created_ms) / 1000) AS bigint)) AS seconds_from_creation
FROM trades t LEFT JOIN (SELECT * FROM mints WHERE rugged = 0) m ON m.mint_address = t.mint_address"""
    .replace("greatest(0, cast(floor((ts_ms - created_ms) / 1000) AS bigint))", "CASE WHEN created_ms IS NOT NULL THEN greatest(0, cast(floor((ts_ms - created_ms) / 1000) AS bigint)) END")))
def _(spark, sf):
    known = t.mints(spark, sf).filter("rugged = 0")
    out = ops.enrich_trades(t.trades(spark, sf), known).withColumn("market_cap_sol", F.round("market_cap_sol", 2))
    return rounded(out.select("trade_id", "mint_address", "price_sol", "seconds_from_creation")).join(out.select("trade_id", "market_cap_sol"), "trade_id")


@query("s8_dedup_trades", t.oracle("SELECT 'sig' || trade_id AS signature, mint_address, wallet, is_buy, sol_amount, token_amount FROM trades"))
def _(spark, sf):
    x = t.trades(spark, sf).select(F.concat(F.lit("sig"), F.col("trade_id").cast("string")).alias("signature"), *ops.TRADE_KEY[1:])
    return ops.dedup_trades(x.unionByName(x))


@query("s9_mint_state", t.oracle("""SELECT m.mint_address, max(t.ts_ms) AS last_trade_ms, round(arg_max(t.price_sol, t.ts_ms * 1000000000 + t.trade_id), 6) AS last_price_sol,
  round(arg_max(t.market_cap_sol, t.ts_ms * 1000000000 + t.trade_id), 2) AS current_market_cap_sol, round(greatest(max(t.market_cap_sol), max(m.initial_buy_sol) * 2e9), 2) AS peak_market_cap_sol, count(*) AS trade_count
FROM mints m JOIN trades t USING (mint_address) GROUP BY 1"""))
def _(spark, sf):
    m = t.mints(spark, sf).select("mint_address", "created_ms", (F.col("initial_buy_sol") * 2e9).alias("launch_mcap_sol"))
    out = ops.mint_state(t.trades(spark, sf), m)
    return out.select("mint_address", "last_trade_ms", F.round(F.col("last_price_sol") + 1e-9, 6).alias("last_price_sol"), F.round("current_market_cap_sol", 2).alias("current_market_cap_sol"), F.round("peak_market_cap_sol", 2).alias("peak_market_cap_sol"), "trade_count")


@query("s10_merge_price_sources", t.oracle("""
SELECT mint_address, round(arg_max(price_sol, o), 6) AS last_price_sol, round(arg_max(market_cap_sol, o), 2) AS current_market_cap_sol, arg_max(source, o) AS last_price_source, max(ts_ms) AS last_curve_write_ms,
  max(CASE WHEN source = 'rpc-sub' OR (source = 'dexscreener' AND trade_id % 2 = 0) THEN ts_ms END) AS last_trade_ms, round(max(CASE WHEN source <> 'price-verifier' THEN market_cap_sol END), 2) AS peak_market_cap_sol
FROM (SELECT *, ts_ms * 1000000000 + trade_id AS o, ['rpc-sub','price-verifier','dexscreener'][trade_id % 3 + 1] AS source FROM trades) GROUP BY 1"""))
def _(spark, sf):
    src = F.element_at(F.array(F.lit("rpc-sub"), F.lit("price-verifier"), F.lit("dexscreener")), (F.col("trade_id") % 3 + 1).cast("int"))
    u = t.trades(spark, sf).select("mint_address", "ts_ms", F.col("trade_id").alias("seq"), "price_sol", F.col("market_cap_sol").alias("mcap_sol"), src.alias("source"))
    saw = (F.col("source") == "rpc-sub") | ((F.col("source") == "dexscreener") & (F.col("seq") % 2 == 0))
    out = ops.merge_price_sources(u.withColumn("traded_ms", F.when(saw, F.col("ts_ms"))))
    return out.select("mint_address", F.round(F.col("last_price_sol") + 1e-9, 6).alias("last_price_sol"), F.round("current_market_cap_sol", 2).alias("current_market_cap_sol"), "last_price_source", "last_curve_write_ms", "last_trade_ms", F.round("peak_market_cap_sol", 2).alias("peak_market_cap_sol"))


BEST = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mint_address ORDER BY liquidity_usd DESC, pos) AS rn FROM pairs_feed) WHERE rn = 1)"""


@query("s11_best_pair", t.oracle("SELECT mint_address, pos, round(price_native, 6) AS price_sol, round(price_native * 1e9, 2) AS mcap_sol, liquidity_usd, (m5_buys + m5_sells > 0)::int AS active FROM best", BEST))
def _(spark, sf):
    out = ops.best_pair(t.pairs_feed(spark, sf))
    return out.withColumn("price_sol", F.round(F.col("price_sol") + 1e-9, 6)).withColumn("mcap_sol", F.round("mcap_sol", 2))


@query("s12_archive_day", t.oracle(f"SELECT count(*) AS rows, min(ts_real_ms) AS min_ms, max(ts_real_ms) AS max_ms FROM trades WHERE {DAY_FILTER}"))
def _(spark, sf):
    out = files.work_dir(spark, "archive")
    return files.archive_day(t.trades(spark, sf, t.DAY), t.DAY, out, "ts_real_ms").select("rows", "min_ms", "max_ms")


@query("s13_drop_ignored", t.oracle(f"SELECT {BASIC} FROM trades WHERE mint_address NOT IN (3, 17, 42) AND is_junk = 0"))
def _(spark, sf):
    return ops.drop_ignored(t.trades(spark, sf), [3, 17, 42], "is_junk").select("trade_id", "mint_address", "wallet", "is_buy", "sol_amount")


@query("s16_write_predictions", t.oracle("""
SELECT ts_ms, mint_address, 'a' AS target, (trade_id * 31 % 1000) / 1000.0::double AS prob FROM trades WHERE trade_id % 5 <> 0
UNION ALL SELECT ts_ms, mint_address, 'b', (trade_id * 17 % 1000) / 1000.0::double FROM trades WHERE is_buy = 1"""))
def _(spark, sf):
    i = F.col("trade_id")
    wide = t.trades(spark, sf).select(
        "ts_ms", "mint_address", F.when(i % 5 != 0, (i * 31 % 1000) / 1000.0).alias("a"),
        F.when(F.col("is_buy") == 1, (i * 17 % 1000) / 1000.0).otherwise(float("nan")).alias("b"),
    )
    return files.write_predictions(wide, ["a", "b"])


@query("s17_replace_table", t.oracle("SELECT wallet, mints_completed, round(skill_score, 6) AS skill_score FROM wallet_stats", PAIRS, STATS))
def _(spark, sf):
    rows = stats(spark, sf).select("wallet", "mints_completed", "skill_score")
    return rounded(files.replace_table(rows, files.work_dir(spark, "wallet-stats")))


@query("s19_audit_migrations", t.oracle("""
SELECT m.mint_address, CASE WHEN c.v_sol IS NULL THEN 'keep_closed' WHEN c.r_sol < 0.5 AND c.v_sol > 85 AND c.mcap_sol > 30 THEN 'keep_drained' ELSE 'unflag' END AS verdict
FROM mints m LEFT JOIN curves c ON c.account = m.bonding_curve_key
WHERE m.migrated = 1 AND m.mint_address IN (SELECT mint_address FROM positions WHERE status = 'open')""", CURVES))
def _(spark, sf):
    return ops.audit_migrations(t.positions(spark, sf), t.mints(spark, sf), binary.decode_curve_state(curve_rows(spark, sf)))
