"""From raw messages to clean trades and token state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from launchlens.functions import nz, token_join, top_rows

SUPPLY = 1_000_000_000

LAUNCH_SCHEMA = (
    "txType string, mint string, traderPublicKey string, signature string, name string, symbol string, uri string, "
    "bondingCurveKey string, solAmount double, initialBuy double, vSolInBondingCurve double, "
    "vTokensInBondingCurve double, marketCapSol double, message string"
)


def _filled(c: str):
    return nz(F.length(c), 0) > 0


def parse_launch_messages(raw: DataFrame) -> DataFrame:
    """JSON text per row, with kind = create, migrate or other."""
    m = raw.withColumn("m", F.from_json("value", LAUNCH_SCHEMA)).select(*[c for c in raw.columns if c != "value"], "m.*")
    create = nz(F.col("txType") == "create", False) | (
        _filled("mint") & _filled("bondingCurveKey") & (_filled("name") | _filled("symbol"))
    )
    kind = F.when(create, "create").when(F.col("txType").isin("migrate", "migration"), "migrate").otherwise("other")
    return m.withColumn("kind", kind)


def normalize_launch_events(raw: DataFrame) -> DataFrame:
    """Launch rows from raw messages (columns value, received_ms, seq); the first message per token wins."""
    m = parse_launch_messages(raw).filter((F.col("kind") == "create") & _filled("mint") & _filled("traderPublicKey"))
    first = m.groupBy("mint").agg(F.min_by(F.struct(*m.columns), F.struct("received_ms", "seq")).alias("f")).select("f.*")
    blank = lambda c: F.when(_filled(c), F.col(c)).alias(c)
    v_sol, v_tok = nz("vSolInBondingCurve"), nz("vTokensInBondingCurve")
    buy = F.when(nz("solAmount") != 0, F.col("solAmount")).otherwise(nz("initialBuy"))
    return first.select(
        F.col("mint").alias("mint_address"), F.col("traderPublicKey").alias("creator_wallet"), blank("signature"),
        blank("name"), blank("symbol"), blank("uri"), buy.alias("initial_buy_sol"),
        v_sol.alias("v_sol_in_curve"), v_tok.alias("v_tokens_in_curve"),
        nz("marketCapSol").alias("current_market_cap_sol"), nz("marketCapSol").alias("peak_market_cap_sol"),
        F.when((v_sol > 0) & (v_tok > 0), v_sol / v_tok).otherwise(0.0).alias("last_price_sol"),
        F.col("received_ms").alias("last_trade_ms"), F.col("received_ms").alias("created_ms"),
        F.col("bondingCurveKey").alias("bonding_curve_key"), F.lit("pump").alias("pool"),
    )


def migration_events(raw: DataFrame) -> DataFrame:
    m = parse_launch_messages(raw).filter((F.col("kind") == "migrate") & _filled("mint"))
    return m.select(F.col("mint").alias("mint_address"), F.col("received_ms").alias("ts_ms"))


def apply_migrations(mints: DataFrame, migrations: DataFrame) -> DataFrame:
    """Mark tokens as migrated at their earliest migration message (S3)."""
    first = migrations.groupBy("mint_address").agg(F.min("ts_ms").alias("migrated_ms"))
    hit = F.col("migrated_ms").isNotNull()
    return (
        mints.drop("migrated", "migrated_ms").join(first, "mint_address", "left")
        .withColumn("migrated", hit.cast("int")).withColumn("pool", F.when(hit, "pumpamm").otherwise(F.col("pool")))
    )


def sane(as_of_ms: int, ts: str = "ts_ms"):
    """Condition of plausible trades: amounts in range, event time at most a day old or a minute ahead."""
    return (
        F.col("sol_amount").between(0, 1000) & F.col("token_amount").between(0, 1e15)
        & F.col(ts).between(as_of_ms - 86_400_000, as_of_ms + 60_000)
    )


def filter_sane_trades(trades: DataFrame, as_of_ms: int, ts: str = "ts_ms") -> DataFrame:
    return trades.filter(sane(as_of_ms, ts))


def enrich_trades(trades: DataFrame, mints: DataFrame) -> DataFrame:
    """Price, market cap and seconds since creation; the latter NULL for unknown tokens."""
    price = F.when(F.col("token_amount") > 0, F.col("sol_amount") / F.col("token_amount")).otherwise(0.0)
    secs = F.greatest(F.lit(0), F.floor((F.col("ts_ms") - F.col("created_ms")) / 1000))
    return (
        token_join(trades.drop("price_sol", "market_cap_sol"), mints.select("mint_address", "created_ms"), "left")
        .withColumn("price_sol", price).withColumn("market_cap_sol", F.col("price_sol") * SUPPLY)
        .withColumn("seconds_from_creation", F.when(F.col("created_ms").isNotNull(), secs)).drop("created_ms")
    )


TRADE_KEY = ["signature", "mint_address", "wallet", "is_buy", "sol_amount", "token_amount"]


def dedup_trades(trades: DataFrame, keys: list[str] = TRADE_KEY) -> DataFrame:
    return trades.dropDuplicates(keys)


def mint_state(trades: DataFrame, mints: DataFrame) -> DataFrame:
    """Token state after its trades: last time, price and reserves, highest market cap, number of trades."""
    s = trades.groupBy("mint_address").agg(
        F.max(F.struct("ts_ms", "trade_id", "price_sol", "market_cap_sol")).alias("l"),
        F.max("market_cap_sol").alias("top"), F.count(F.lit(1)).alias("trade_count"),
    )
    return mints.select("mint_address", "created_ms", "launch_mcap_sol").join(s, "mint_address", "left").select(
        "mint_address", F.coalesce("l.ts_ms", "created_ms").alias("last_trade_ms"), F.col("l.price_sol").alias("last_price_sol"),
        F.coalesce("l.market_cap_sol", "launch_mcap_sol").alias("current_market_cap_sol"),
        F.greatest("top", "launch_mcap_sol").alias("peak_market_cap_sol"), nz("trade_count", 0).alias("trade_count"),
    )


def merge_price_sources(updates: DataFrame) -> DataFrame:
    """Latest write per token over all sources.

    The last trade time only moves with writes that saw trades (traded_ms not NULL). Corrections
    from the verifier do not raise the peak.
    """
    order = F.struct("ts_ms", "seq")
    return updates.groupBy("mint_address").agg(
        F.max_by("price_sol", order).alias("last_price_sol"), F.max_by("mcap_sol", order).alias("current_market_cap_sol"),
        F.max_by("source", order).alias("last_price_source"), F.max("ts_ms").alias("last_curve_write_ms"),
        F.max_by("traded_ms", F.when(F.col("traded_ms").isNotNull(), order)).alias("last_trade_ms"),
        F.max(F.when(F.col("source") != "price-verifier", F.col("mcap_sol"))).alias("peak_market_cap_sol"),
    )


def best_pair(pairs: DataFrame) -> DataFrame:
    """Most liquid trading pair per token, the first on ties; unusable prices dropped afterwards."""
    b = top_rows(pairs, ["mint_address"], [nz("liquidity_usd").desc(), F.col("pos")], 1)
    return b.filter(F.col("price_native") > 0).select(
        "mint_address", "pos", F.col("price_native").alias("price_sol"), (F.col("price_native") * SUPPLY).alias("mcap_sol"),
        "liquidity_usd", ((nz("m5_buys", 0) + nz("m5_sells", 0)) > 0).cast("int").alias("active"),
    )


def drop_ignored(trades: DataFrame, skip_mints: list, junk_col: str | None = None) -> DataFrame:
    """Leave out a configured short list of tokens and, if named, flagged rows."""
    kept = trades.filter(~F.col("mint_address").isin(skip_mints)) if skip_mints else trades
    return kept.filter(nz(junk_col, 0) == 0) if junk_col else kept


def audit_migrations(positions: DataFrame, mints: DataFrame, curve_state: DataFrame) -> DataFrame:
    """Verdict on tokens held open and flagged as migrated.

    keep: the curve account is gone, or it is drained after a full curve. unflag: otherwise.
    """
    held = positions.filter("status = 'open'").select("mint_address").distinct()
    m = mints.filter("migrated = 1 AND bonding_curve_key IS NOT NULL").select("mint_address", "bonding_curve_key")
    c = curve_state.select(F.col("account").alias("bonding_curve_key"), "r_sol", "v_sol", "mcap_sol")
    real = (F.col("r_sol") < 0.5) & (F.col("v_sol") > 85) & (F.col("mcap_sol") > 30)
    return m.join(held, "mint_address", "left_semi").join(c, "bonding_curve_key", "left").select(
        "mint_address",
        F.when(F.col("v_sol").isNull(), "keep_closed").when(real, "keep_drained").otherwise("unflag").alias("verdict"),
    )
