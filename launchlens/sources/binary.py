"""Fixed byte layouts decoded with built-in functions only. Keys stay hexadecimal."""

from __future__ import annotations

from base64 import b64encode

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the two layouts.
TRADE_EVENT_TAG = "BDDB7FD34EE661EE"
TRADE_EVENT_BYTES = 113
CURVE_STATE_BYTES = 49
LOG_PREFIX = "Program data: "
SOL_UNITS = 1e9
TOKEN_UNITS = 1e6

# The first ten base64 characters depend on the tag alone: other payloads are skipped without decoding.
_TEXT_PREFIX = LOG_PREFIX + b64encode(bytes.fromhex(TRADE_EVENT_TAG)).decode()[:10]


def _swap(hexed: Column) -> Column:
    """Reverse the byte order of eight bytes in hexadecimal."""
    return F.concat(*[F.substring(hexed, i, 2) for i in range(15, 0, -2)])


def _hex_at(hexed: Column, start: int, size: int) -> Column:
    return F.substring(hexed, 2 * start + 1, 2 * size)


def u64_at(hexed: Column, start: int) -> Column:
    """Little-endian unsigned 64-bit integer at a byte offset, as decimal(20,0)."""
    big_endian = F.concat(*[_hex_at(hexed, start + i, 1) for i in range(7, -1, -1)])
    return F.conv(big_endian, 16, 10).cast("decimal(20,0)")


def i64_at(hexed: Column, start: int) -> Column:
    u = u64_at(hexed, start)
    return F.when(u >= F.lit("9223372036854775808").cast("decimal(20,0)"), u - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(u).cast("long")



def decode_trade_events(logs: DataFrame) -> DataFrame:
    """Rows (signature, err, logs array) to trades. Failed transactions, other lines, short payloads
    and other tags give no row."""
    # decoding happens inside the generator: every later expression reads its result, none repeats it
    lines = F.filter("logs", lambda x: F.startswith(x, F.lit(_TEXT_PREFIX)))
    payload = F.transform(lines, lambda x: F.hex(F.try_to_binary(F.substr(x, F.lit(len(LOG_PREFIX) + 1)), F.lit("base64"))))
    h = logs.filter(F.col("err").isNull()).select("signature", F.explode(payload).alias("_h"))
    h = h.filter(F.length("_h") >= 2 * TRADE_EVENT_BYTES)
    x = F.col("_h")
    return h.filter(_hex_at(x, 0, 8) == TRADE_EVENT_TAG).select(
        "signature",
        F.lower(_hex_at(x, 8, 32)).alias("mint_address"),
        (u64_at(x, 40).cast("double") / SOL_UNITS).alias("sol_amount"),
        (u64_at(x, 48).cast("double") / TOKEN_UNITS).alias("token_amount"),
        (_hex_at(x, 56, 1) != "00").cast("int").alias("is_buy"),
        F.lower(_hex_at(x, 57, 32)).alias("wallet"),
        (i64_at(x, 89) * 1000).alias("ts_ms"),
        (u64_at(x, 97).cast("double") / SOL_UNITS).alias("v_sol_in_curve"),
        (u64_at(x, 105).cast("double") / TOKEN_UNITS).alias("v_tokens_in_curve"),
    )


def decode_curve_state(accounts: DataFrame) -> DataFrame:
    """Rows (account, data as base64) to reserves, supply, price and market cap; short data gives no row."""
    h = accounts.withColumn("_b", F.try_to_binary(F.col("data"), F.lit("base64"))).filter(F.length("_b") >= CURVE_STATE_BYTES)
    x = F.hex("_b")
    tok = lambda at: u64_at(x, at).cast("double") / TOKEN_UNITS
    sol = lambda at: u64_at(x, at).cast("double") / SOL_UNITS
    out = h.select(
        "account", tok(8).alias("v_tokens"), sol(16).alias("v_sol"), tok(24).alias("r_tokens"), sol(32).alias("r_sol"),
        tok(40).alias("total_supply"), (_hex_at(x, 48, 1) != "00").cast("int").alias("complete"),
    )
    price = F.when((F.col("v_sol") > 0) & (F.col("v_tokens") > 0), F.col("v_sol") / F.col("v_tokens")).otherwise(0.0)
    return out.withColumn("price_sol", price).withColumn("mcap_sol", F.col("total_supply") * F.col("price_sol"))


def le_hex(value: Column) -> Column:
    """Little-endian hexadecimal text of a long, the inverse of u64_at."""
    return _swap(F.lpad(F.hex(value), 16, "0"))
