"""Joining trades to the table of tokens when one token may hold a large share of the trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Parts of a token's trades. The token table is copied this often, the trades never.
SALTS = 32


def token_join(trades: DataFrame, tokens: DataFrame, how: str = "inner", key: str = "mint_address", ts: str = "ts_ms", salts: int = SALTS) -> DataFrame:
    """Trades with the columns of their token (one row per token); how is inner, left or left_semi.

    Rows are dealt by (token, hash of the time), so no task reads more than about 1/salts of a token's trades, and an
    aggregation per token combines in each task before it shuffles."""
    part = F.pmod(F.xxhash64(ts), F.lit(salts)).cast("int")
    spread = tokens.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return trades.withColumn("_part", part).join(spread, [key, "_part"], how).drop("_part")
