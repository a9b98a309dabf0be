"""Scoring a stream of snapshots with stored models, each token at most once in `fresh_ms` of event time (ST8).

The time of a token's last scored snapshot is state, one number per token, and a timer ends it; earlier predictions are
not read again. The wallet table joins as a static side, and the models score inside the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from launchlens.models.training import Model, score_columns

FRESH_MS = 300_000


class FirstInAWhile(StatefulProcessor):
    """Passes a row if the token's last passed row is at least fresh_ms older; rows of a batch are taken in order of time."""

    def __init__(self, fresh_ms: int, ts: str):
        self.fresh_ms, self.ts = fresh_ms, ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.ts, kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        before, keep = last, []
        for at in pdf[self.ts].tolist():
            keep.append(last is None or at - last >= self.fresh_ms)
            if keep[-1]:
                last = at
        if last != before:
            self.last.update((last,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + self.fresh_ms)
        yield pdf[keep]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_calls(opens: DataFrame, dedup_ms: int = 86_400_000, late: str = "1 hour") -> DataFrame:
    """Opens (mint_address, ts_ms, id) that are announced: a token's next call comes dedup_ms after its last one at the earliest (ST9).

    Append mode, inside `timers`. What ends a token's state is its own last call, not the watermark alone."""
    rows = opens.withColumn("event_ts", F.timestamp_millis(F.col("ts_ms"))).withWatermark("event_ts", late)
    return rows.groupBy("mint_address").transformWithStateInPandas(FirstInAWhile(dedup_ms, "ts_ms"), rows.schema, "Append", "EventTime").drop("event_ts")


def worth_scoring(snapshots: DataFrame, stats: DataFrame, least_trades: int = 5, fresh_ms: int = FRESH_MS, late: str = "1 day", ts: str = "snapshot_ts") -> DataFrame:
    """Snapshots of a stream that are to be scored, with the skill of the token's creator; append mode, inside `timers`.

    A snapshot needs least_trades trades, a token that has not rugged, and no scored one of its token in fresh_ms before it.
    stats is the wallet table; creators it does not know get nulls."""
    rows = snapshots.withColumn("event_ts", F.timestamp_millis(F.col(ts))).withWatermark("event_ts", late).filter(F.col("trade_count") >= least_trades)
    if "rugged" in rows.columns:
        rows = rows.filter(F.coalesce(F.col("rugged").cast("int"), F.lit(0)) == 0)
    kept = rows.groupBy("mint_address").transformWithStateInPandas(FirstInAWhile(fresh_ms, ts), rows.schema, "Append", "EventTime")
    skill = stats.select(F.col("wallet").alias("creator_wallet"), F.col("skill_score").alias("creator_skill"), F.col("win_rate").alias("creator_win_rate"),
                         F.col("mints_completed").alias("creator_completed"))
    return kept.drop("event_ts").join(skill, "creator_wallet", "left")


def stream_scoring(kept: DataFrame, models: list[Model], ts: str = "snapshot_ts") -> DataFrame:
    """One row per model and snapshot of `worth_scoring`: ts_ms, mint_address, target, prob, creator_skill; without null scores."""
    cols = [f"_p{i}" for i in range(len(models))]
    scored = score_columns(kept, models, cols)
    each = F.explode(F.array(*[F.struct(F.lit(m.target).alias("target"), F.col(c).alias("prob")) for m, c in zip(models, cols, strict=True)]))
    return scored.select(F.col(ts).alias("ts_ms"), "mint_address", "creator_skill", each.alias("z")).select(
        "ts_ms", "mint_address", "z.target", "z.prob", "creator_skill").filter(F.col("prob").isNotNull() & ~F.isnan("prob"))
