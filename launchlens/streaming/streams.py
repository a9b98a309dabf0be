"""Structured Streaming versions of the operators. Event time is column `ts`, from ts_ms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from launchlens.operators.exits import OUT_COLUMNS, OUT_SCHEMA, PositionFold
from launchlens.operators.ingest import TRADE_KEY, sane
from launchlens.sources.files import folder_exists

LATE = "1 day"


def with_event_time(df: DataFrame, ts_ms: str = "ts_ms") -> DataFrame:
    return df.withColumn("ts", F.timestamp_millis(F.col(ts_ms)))


def stream_trades(trades: DataFrame, keys: list[str] = TRADE_KEY, late: str = LATE, as_of_ms: int | None = None) -> DataFrame:
    """Plausible trades, each once; rows later than the bound are dropped (ST1, ST10)."""
    rows = trades.filter(sane(as_of_ms)) if as_of_ms is not None else trades.filter(
        F.col("sol_amount").between(0, 1000) & F.col("token_amount").between(0, 1e15)
    )
    return with_event_time(rows).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def late_rows(trades: DataFrame, as_of_ms: int, ts: str = "ts_ms") -> DataFrame:
    """Rows the lateness bound rejects, counted per minute of event time (ST10)."""
    return with_event_time(trades.filter(~sane(as_of_ms, ts)), ts).groupBy(F.window("ts", "60 seconds")).agg(F.count(F.lit(1)).alias("rejected"))


def stream_mint_state(trades: DataFrame) -> DataFrame:
    """Token state, updated with every micro-batch (ST2); run in update mode."""
    order = F.struct("ts_ms", "trade_id")
    return trades.groupBy("mint_address").agg(
        F.max("ts_ms").alias("last_trade_ms"), F.max_by("price_sol", order).alias("last_price_sol"),
        F.max("market_cap_sol").alias("peak_market_cap_sol"), F.count(F.lit(1)).alias("trade_count"),
    )


def ingest_rate(trades: DataFrame, keys: list[str] = TRADE_KEY, late: str = LATE) -> DataFrame:
    """Parsed, new and duplicate trades per minute (ST4); append mode."""
    w = F.window("ts", "60 seconds")
    per_key = with_event_time(trades).withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("w").agg(
        F.sum("n").alias("parsed"), F.count(F.lit(1)).alias("new"), F.sum(F.col("n") - 1).alias("duplicates")
    ).select((F.unix_millis("w.start")).alias("minute_ms"), "parsed", "new", "duplicates")


def flow_windows(trades: DataFrame, late: str = LATE, width: str = "30 seconds", slide: str = "1 second") -> DataFrame:
    """Sliding flow per token (ST5). Distinct sellers are approximate here; the batch operator is exact."""
    buy = F.col("is_buy") == 1
    return with_event_time(trades).withWatermark("ts", late).groupBy("mint_address", F.window("ts", width, slide).alias("w")).agg(
        F.sum(F.when(buy, F.col("sol_amount")).otherwise(0.0)).alias("buy_sol"), F.count(F.when(buy, 1)).alias("buys"),
        F.sum(F.when(buy, 0.0).otherwise(F.col("sol_amount"))).alias("sell_sol"), F.count(F.when(~buy, 1)).alias("sells"),
        F.approx_count_distinct(F.when(~buy, F.col("wallet")), 0.01).alias("sellers"),
    ).select("mint_address", F.unix_millis("w.start").alias("start_ms"), "buy_sol", "buys", "sell_sol", "sells", "sellers")


def quiet_tokens(trades: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    """Ended activity sessions: the token was silent for `gap` after end_ms (ST6); append mode."""
    return with_event_time(trades).withWatermark("ts", late).groupBy("mint_address", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("trades"), F.max("ts_ms").alias("last_trade_ms")
    ).select("mint_address", F.unix_millis("w.start").alias("start_ms"), "last_trade_ms", "trades")


def call_dedup(opens: DataFrame, late: str = "24 hours") -> DataFrame:
    """First open per token within the watermark (ST9)."""
    return with_event_time(opens).withWatermark("ts", late).dropDuplicatesWithinWatermark(["mint_address"])


def _tick_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Last price per token and time of the rows of a task, with their number."""
    for pdf in batches:
        g = pdf.sort_values(["ts_ms", "trade_id"]).groupby(["mint_address", "ts_ms"], as_index=False)
        yield g.agg(trade_id=("trade_id", "last"), price_sol=("price_sol", "last"), n=("trade_id", "size"))


def stream_positions(trades: DataFrame, positions: DataFrame, rules: DataFrame, parts: int = 8) -> DataFrame:
    """Exit state machine per open position and rule set over the trade stream (ST7); append mode, inside `timers`.

    The ledger, as it is when the stream starts first, is the initial state: open positions are dealt over (token, part), nine
    numbers each per rule set, and leave it when they close. The stream brings one row per token and time of a task to each part; no
    pair of a trade and a position is formed but those a fold steps through.
    """
    specs = [r.asDict() for r in rules.collect()]  # a handful of rules
    schema = "mint_address int, ts_ms long, trade_id long, price_sol double, n long"
    rows = trades.filter("price_sol > 0 AND mint_address IS NOT NULL AND ts_ms IS NOT NULL").select(
        F.col("mint_address").cast("int").alias("mint_address"), "ts_ms", "trade_id", "price_sol").mapInPandas(_tick_rows, schema)
    rows = rows.withColumn("_part", F.explode(F.array(*[F.lit(i) for i in range(parts)])))
    ledger = positions.filter("id IS NOT NULL AND mint_address IS NOT NULL AND entered_ms IS NOT NULL AND entry_price > 0").select(
        F.col("mint_address").cast("int").alias("mint_address"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("_part"),
        *[F.col(c).cast(k).alias(c) for c, k in OPEN.items()])
    return rows.groupBy("mint_address", "_part").transformWithStateInPandas(
        OpenPositions(specs), OUT_SCHEMA, "Append", "None", ledger.groupBy("mint_address", "_part"))


#: What the state keeps of a position, besides the numbers of its fold.
OPEN = {"id": "long", "entered_ms": "long", "entry_price": "double", "entry_sol": "double", "token_amount": "double"}
KEPT = np.dtype([*[(c, "i8" if k == "long" else "f8") for c, k in OPEN.items()], ("times", "i8"), ("rule", "i4"), ("begun", "?"),
                 *zip(PositionFold.STATE, ("f8", "f8", "f8", "f8", "f8", "i8", "i8", "?", "i8"))])


class OpenPositions(StatefulProcessor):
    """Folds of the open positions of one (token, part) and all rule sets; a closed position leaves the state.

    Rows of the ledger with the same id are one position that sees each trade once per row; rows without an id are none."""

    def __init__(self, specs: list[dict]):
        self.specs = specs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("open", "rows binary")

    def _read(self) -> np.ndarray:
        return np.frombuffer(self.kept.get()[0], KEPT) if self.kept.exists() else np.zeros(0, KEPT)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        one = np.zeros(len(initialState), KEPT)
        for c in OPEN:
            one[c] = initialState[c].to_numpy()
        one["times"] = 1
        new = np.concatenate([one] * len(self.specs)) if self.specs else one[:0]
        new["rule"] = np.repeat(np.arange(len(self.specs)), len(one))
        rows = np.concatenate([self._read(), new])
        rows = rows[np.lexsort((rows["entered_ms"], rows["id"], rows["rule"]))]
        first = np.ones(len(rows), bool)
        first[1:] = (rows["id"][1:] != rows["id"][:-1]) | (rows["rule"][1:] != rows["rule"][:-1])
        times = np.add.reduceat(rows["times"], np.flatnonzero(first)) if len(rows) else rows["times"]
        rows = rows[first]
        rows["times"] = times
        self.kept.update((rows.tobytes(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts_ms", "trade_id"])
        # newest trade per tick, as the policy sees it
        pdf = pdf.groupby("ts_ms", as_index=False).agg(price_sol=("price_sol", "last"), n=("n", "sum"))
        ts, prices, counts = (pdf[c].to_numpy() for c in ("ts_ms", "price_sol", "n"))
        kept = self._read().copy()
        at = ts.searchsorted(kept["entered_ms"], "right")
        going, out = np.ones(len(kept), bool), []
        for i in np.flatnonzero(at < len(ts)):
            row = kept[i]
            r = {**self.specs[row["rule"]], **{c: row[c].item() for c in OPEN}, "mint_address": key[0]}
            fold = PositionFold(r, tuple(row[c].item() for c in PositionFold.STATE) if row["begun"] else None)
            closed, times = None, int(row["times"])
            for k in range(at[i], len(ts)):
                closed = fold.step(int(ts[k]), float(prices[k]), int(counts[k]) * times)
                if closed:
                    break
            if closed:
                going[i] = False
                out.append(closed)
            else:
                row["begun"] = True
                for name, value in zip(fold.STATE, fold.state()):
                    row[name] = value
        if len(kept):
            self.kept.update((kept[going].tobytes(),))
        yield pd.DataFrame(out, columns=OUT_COLUMNS)

    def close(self) -> None:
        pass


def append_versions(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink for update-mode results: one folder per batch, rewritten if the batch is retried."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest_versions(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Newest version of every key from the folders of `append_versions`."""
    cols = [c for c in versions.columns if c not in (*keys, "batch")]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("v")).select(*keys, "v.*")


def snapshot_sink(
    trades_path: str, out_path: str, mints_of: Callable[[DataFrame], DataFrame], features: Callable[[DataFrame, DataFrame], DataFrame], ages: list[int],
    grace_sec: int = 90,
) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that captures due snapshots (ST3).

    Each batch is added to the trade table; ages that were crossed since `grace_sec` before the newest event time of the
    batches so far, however much time this batch spans, and were not captured yet are computed from the trades of those
    tokens only.
    """
    from launchlens.operators.filters import due_snapshots

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{trades_path}/batch={batch_id}")
        trades = spark.read.parquet(trades_path).filter(F.col("batch") <= batch_id)
        now, before, start = trades.agg(F.max("ts_ms"), F.max(F.when(F.col("batch") < batch_id, F.col("ts_ms"))), F.min("ts_ms")).first()
        if now is None:
            return
        mints = mints_of(trades)
        if folder_exists(spark, out_path):
            have = spark.read.parquet(out_path).filter(F.col("batch") < batch_id).select("mint_address", "snapshot_age_sec")
        else:  # first batch: nothing captured yet
            have = spark.createDataFrame([], "mint_address int, snapshot_age_sec int")
        since = start if before is None else min(before, now)
        due = due_snapshots(mints, have, now, ages, grace_sec + (now - since + 999) // 1000)
        tokens = due.select("mint_address").distinct()
        rows = features(trades.join(tokens, "mint_address", "left_semi"), mints.join(tokens, "mint_address", "left_semi"))
        rows.join(due, ["mint_address", "snapshot_age_sec"], "left_semi").write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return write


def scoring_sink(out_path: str, score: Callable[[DataFrame], DataFrame], fresh_ms: int = 300_000) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: score new snapshots whose token has no prediction in the last five minutes (ST8)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy("mint_address").agg(F.max_by(F.struct(*batch.columns), "snapshot_ts").alias("s")).select("s.*")
        if folder_exists(spark, out_path):
            have = spark.read.parquet(out_path).filter(F.col("batch") < batch_id).groupBy("mint_address").agg(F.max("ts_ms").alias("_last"))
            newest = newest.join(have, "mint_address", "left").filter(F.col("_last").isNull() | (F.col("snapshot_ts") - F.col("_last") >= fresh_ms)).drop("_last")
        score(newest).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return write
