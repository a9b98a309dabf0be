"""Snapshots on a stream: per-token accumulators in state, one event-time timer per age (ST3).

A trade is known by the index of the first age whose cutoff covers it, so an accumulator holds one small part per index
and nothing has to be recomputed: when the watermark passes a cutoff, the parts up to it are added up and sent on. A
token's trades are dealt over PARTS accumulators, so that no task holds all of a busy token; a streaming aggregation puts
them together. The cost of a batch depends on its own trades, not on those before it, and the result does not depend on
how the stream is cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from launchlens.functions import units
from launchlens.operators.features import core_from_bins, _bin_of

PARTS = 8
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

_SUMS = ["n", "nb", "ns", "sb", "ss", "cb", "cs"]
_SQUARES = ["qb", "qs"]  # may pass a long, so they are kept as text
_TOPS = ["xb", "xs", "xp"]
_PART = ", ".join([*[f"{c} long" for c in _SUMS], *[f"{c} string" for c in _SQUARES], *[f"{c} double" for c in _TOPS], "ts_ms long", "trade_id long", "price double"])
_NAMES = [c.split()[0] for c in _PART.split(", ")]
_OUT = f"mint_address int, snapshot_age_sec int, cutoff_ts timestamp, {_PART}"


@contextmanager
def timers(spark: SparkSession):
    """Streams that start inside keep their state where timers are supported."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _largest(a, b):
    return b if a is None else a if b is None else max(a, b)


def merged(a: tuple | None, b: tuple | None) -> tuple | None:
    """The accumulator of both parts' trades."""
    if a is None or b is None:
        return a or b
    x, y = dict(zip(_NAMES, a, strict=True)), dict(zip(_NAMES, b, strict=True))
    last = max((x, y), key=lambda p: (p["ts_ms"], p["trade_id"]))
    out = {c: x[c] + y[c] for c in _SUMS} | {c: str(int(x[c]) + int(y[c])) for c in _SQUARES} | {c: _largest(x[c], y[c]) for c in _TOPS}
    return tuple((out | {c: last[c] for c in ("ts_ms", "trade_id", "price")})[c] for c in _NAMES)


def _top(values: pd.Series) -> float | None:
    best = values.max()
    return None if pd.isna(best) else float(best)


def accumulated(rows: pd.DataFrame) -> tuple:
    """The accumulator of some trades of one index."""
    buy = rows["is_buy"] == 1
    side = {"b": rows[buy], "s": rows[~buy]}
    last = rows.sort_values(["ts_ms", "trade_id"]).iloc[-1]
    out = {"n": len(rows), "xp": _top(rows["price_sol"]), "ts_ms": int(last["ts_ms"]), "trade_id": int(last["trade_id"]),
           "price": None if pd.isna(last["price_sol"]) else float(last["price_sol"])}
    for k, x in side.items():
        whole = x["units"].astype(object)
        out |= {f"n{k}": len(x), f"s{k}": int(whole.sum()), f"q{k}": str(int((whole * whole).sum())), f"x{k}": _top(x["sol_amount"]), f"c{k}": int(x["own"].sum())}
    return tuple(out[c] for c in _NAMES)


class AgeTimers(StatefulProcessor):
    """Accumulators per index and a timer per cutoff that is still ahead. Sends an age only if a trade counts for it."""

    def __init__(self, ages: list[int]):
        self.ages = ages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.created = handle.getValueState("created", "created_ms long")
        self.parts = handle.getMapState("parts", "bin int", _PART)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            if not self.created.exists():
                created = int(pdf["created_ms"].iloc[0])
                self.created.update((created,))
                for age in self.ages:
                    if created + age * 1000 > timerValues.getCurrentWatermarkInMs():
                        self.handle.registerTimer(created + age * 1000)
            for b, group in pdf.groupby("bin"):
                at = (int(b),)
                have = tuple(self.parts.getValue(at)) if self.parts.containsKey(at) else None
                self.parts.updateValue(at, merged(have, accumulated(group)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cutoff = expiredTimerInfo.getExpiryTimeInMs()
        (created,) = self.created.get()
        k = self.ages.index((cutoff - created) // 1000)
        total = None
        for at, part in self.parts.iterator():
            if at[0] <= k:
                total = merged(total, tuple(part))
        if k == len(self.ages) - 1:
            self.parts.clear()
            self.created.clear()
        if total is not None:
            yield pd.DataFrame([(int(key[0]), self.ages[k], pd.Timestamp(cutoff, unit="ms"), *total)], columns=["mint_address", "snapshot_age_sec", "cutoff_ts", *_NAMES])

    def close(self) -> None:
        pass


def stream_snapshots(trades: DataFrame, mints: DataFrame, ages: list[int], late: str = "1 day", parts: int = PARTS) -> DataFrame:
    """One row of core features per (token, age), once the watermark passes its cutoff; append mode, inside `timers`.

    trades is a stream, mints a table (mint_address, created_ms, creator_wallet). Trades later than the bound, of unknown tokens
    and after the last age take no part, nor does an age that was already past when its token's first trade came."""
    ages = sorted(ages)
    since = F.col("ts_ms") - F.col("created_ms")
    rows = trades.withColumn("ts", F.timestamp_millis(F.col("ts_ms"))).withWatermark("ts", late).join(
        mints.select("mint_address", "created_ms", "creator_wallet"), "mint_address").filter(since <= ages[-1] * 1000)
    rows = rows.select(
        "mint_address", "ts", "ts_ms", "trade_id", "is_buy", "sol_amount", "price_sol", "created_ms", _bin_of(since, ages).alias("bin"), units("sol_amount").alias("units"),
        F.coalesce(F.col("wallet") == F.col("creator_wallet"), F.lit(False)).alias("own"), F.pmod(F.xxhash64("trade_id"), F.lit(parts)).cast("int").alias("part"))
    sent = rows.groupBy("mint_address", "part").transformWithStateInPandas(
        AgeTimers(ages), _OUT, "Append", "EventTime", eventTimeColumnName="cutoff_ts")
    bins = sent.select("mint_address", "snapshot_age_sec", "cutoff_ts", *_SUMS, *[F.col(c).cast("decimal(30,0)").alias(c) for c in _SQUARES], *_TOPS,
                       F.struct("ts_ms", "trade_id", F.col("price").alias("price_sol")).alias("last"))
    return core_from_bins(bins, ["cutoff_ts"])
