"""After the trade: ledgers, calibration, what-if gates, price paths after the exit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from launchlens.functions import asof_join, nz, prefix_sums, range_aggregate

# Marks after an exit, in minutes.
#: Sizes the block levels of price paths; longer paths are cut into more blocks, none is shortened.
LONGEST_HOLD_MS = 400 * 86_400_000
POST_EXIT_MARKS = [5, 15, 30, 60, 120, 240, 480]


def mark_positions(positions: DataFrame, mints: DataFrame) -> DataFrame:
    """Open positions at the current price: percentage, profit and highest percentage so far."""
    x = positions.filter("status = 'open'").join(mints.select("mint_address", F.col("last_price_sol").alias("now_price")), "mint_address")
    x = x.filter((F.col("entry_price") > 0) & (F.col("now_price") > 0))
    pct = (F.col("now_price") / F.col("entry_price") - 1) * 100
    value = nz("sol_realized_so_far") + nz("tokens_remaining") * F.col("now_price")
    return x.select(
        "id", "mint_address", "now_price", pct.alias("unrealized_pnl_pct"), (value - F.col("entry_sol")).alias("unrealized_pnl_sol"),
        F.greatest(nz("highest_pct"), pct).alias("highest_pct"),
    )


def highest_since_entry(positions: DataFrame, trades: DataFrame, as_of_ms: int, unit_ms: int = 1) -> DataFrame:
    """Highest percentage over entry on the whole price path (entry, exit or as_of] (path form of W4)."""
    end = F.coalesce("exited_ms", F.lit(as_of_ms))
    p = positions.select("id", "mint_address", "entered_ms", "entry_price", end.alias("_end"))
    x = range_aggregate(
        p, trades, ["mint_address"], ["id"], "entered_ms", "_end", "ts_ms", {"top": (F.col("price_sol"), "max")}, LONGEST_HOLD_MS, unit_ms
    )
    pct = F.when(F.col("entry_price") > 0, (F.col("top") / F.col("entry_price") - 1) * 100)
    return x.select("id", F.greatest(F.lit(0.0), nz(pct)).alias("path_highest_pct"))


def equity_curve(positions: DataFrame, mints: DataFrame, starting: float, started_ms: int, as_of_ms: int) -> DataFrame:
    """Start point, cumulative realised profit after each close, final point with open positions marked."""
    closed = positions.filter(
        (F.col("status") == "closed") & F.col("exited_ms").isNotNull() & (F.col("exited_ms") > started_ms)
    ).select(F.col("exited_ms").alias("ts_ms"), "id", nz("realized_pnl_sol").alias("pnl"))
    curve = prefix_sums(closed, [], ["ts_ms", "id"], {"pnl": "realized"}).select(
        "ts_ms", "id", "realized", F.lit(0.0).alias("unrealized")
    )
    held = positions.filter((F.col("status") == "open") & (F.col("entered_ms") >= started_ms)).join(
        mints.select("mint_address", F.col("last_price_sol").alias("_now")), "mint_address", "left"
    )
    mtm = held.agg(
        nz(F.sum(nz("tokens_remaining") * nz("_now") + nz("sol_realized_so_far") - nz("entry_sol"))).alias("unrealized")
    )
    last = closed.agg(nz(F.sum("pnl")).alias("realized")).select(
        F.lit(as_of_ms).cast("long").alias("ts_ms"), F.lit(None).cast("long").alias("id"), "realized", mtm.scalar().alias("unrealized")
    )
    first = closed.sparkSession.range(1).select(
        F.lit(started_ms).cast("long").alias("ts_ms"), F.lit(None).cast("long").alias("id"), F.lit(0.0).alias("realized"), F.lit(0.0).alias("unrealized")
    )
    points = first.withColumn("kind", F.lit("start")).unionByName(curve.withColumn("kind", F.lit("close"))).unionByName(
        last.withColumn("kind", F.lit("now"))
    )
    return points.withColumn("value", F.lit(starting) + F.col("realized") + F.col("unrealized"))


def post_exit_path(
    closes: DataFrame, trades: DataFrame, as_of_ms: int, marks_min: list[int] = POST_EXIT_MARKS, unit_ms: int = 1, base: int = 8
) -> DataFrame:
    """Per close and due mark: last price, peak since the exit, trades, and both as percentages.

    The stretches between marks are disjoint ranges; their aggregates are accumulated over the marks
    of a position, so the path is read once for all marks.
    """
    edges = [0, *marks_min]
    spans = F.explode(
        F.array(
            *[
                F.struct(F.lit(b).alias("mark"), (F.col("exited_ms") + a * 60_000).alias("lo"), (F.col("exited_ms") + b * 60_000).alias("hi"))
                for a, b in zip(edges, edges[1:])
            ]
        )
    )
    p = closes.filter((F.col("exit_price") > 0) & F.col("exited_ms").isNotNull()).select(
        F.col("id").alias("position_id"), "mint_address", "exited_ms", "exit_price", spans.alias("s")
    ).select("position_id", "mint_address", "exited_ms", "exit_price", "s.*").filter(F.col("hi") <= as_of_ms)
    got = range_aggregate(
        p, trades.filter("price_sol > 0"), ["mint_address"], ["position_id", "mark"], "lo", "hi", "ts_ms",
        {
            "peak": (F.col("price_sol"), "max"), "n": (F.lit(1).cast("long"), "sum"),
            "last": (F.struct("ts_ms", "trade_id", "price_sol"), "last"),
        },
        max(b - a for a, b in zip(edges, edges[1:])) * 60_000, unit_ms, base,
    )
    w = W.partitionBy("position_id").orderBy("mark").rowsBetween(W.unboundedPreceding, 0)
    x = got.select(
        "position_id", "mint_address", F.col("mark").alias("milestone_min"), F.col("hi").alias("due_ms"), "exit_price",
        F.max("last").over(w)["price_sol"].alias("price_at_mark"), F.max("peak").over(w).alias("peak_price"),
        nz(F.sum("n").over(w), 0).alias("trades_in_win"),
    )
    pct = lambda c: (F.col(c) - F.col("exit_price")) / F.col("exit_price") * 100
    return x.withColumn("pct_at_mark", pct("price_at_mark")).withColumn("peak_pct", pct("peak_price"))


def post_exit_summary(path: DataFrame, last_mark: int = POST_EXIT_MARKS[-1]) -> DataFrame:
    """Peak over all marks (0 when unknown) and, once the last mark exists, the class of the exit."""
    a = path.groupBy("position_id").agg(F.max("peak_pct").alias("p"), F.max("milestone_min").alias("m"))
    cls = (
        F.when(F.col("p").isNull(), "no_data").when(F.col("p") >= 100, "moon_after").when(F.col("p") >= 30, "ran_after")
        .when(F.col("p") > -30, "flat").otherwise("dumped")
    )
    return a.select("position_id", nz("p").alias("post_exit_peak_pct"), F.when(F.col("m") >= last_mark, cls).alias("post_exit_outcome"))


def running_drawdown(prices: DataFrame, keys: list[str], ts: str, tie: str, price: str, chunk_ms: int = 60_000) -> DataFrame:
    """Deepest fall from the running peak per key, as a negative fraction."""
    rows = prices.filter(F.col(price) > 0).withColumn("_chunk", F.floor(F.col(ts) / chunk_ms).cast("long"))
    inside = W.partitionBy(*keys, "_chunk").orderBy(ts, tie).rowsBetween(W.unboundedPreceding, 0)
    part = rows.withColumn("_dd", F.col(price) / F.max(price).over(inside) - 1).groupBy(*keys, "_chunk").agg(
        F.min("_dd").alias("dd"), F.max(price).alias("hi"), F.min(price).alias("lo")
    )
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    return part.withColumn("_before", F.max("hi").over(earlier)).groupBy(*keys).agg(
        F.min(F.least(F.col("dd"), F.col("lo") / F.col("_before") - 1)).alias("max_drawdown")
    )


def postmortem(closes: DataFrame, predictions: DataFrame, chunk_ms: int = 3_600_000) -> DataFrame:
    """Predicted against realised per close, with seven predictions as of the entry."""
    from launchlens.operators.joins import POSTMORTEM_TARGETS, predictions_as_of

    c = closes.filter("status = 'closed'")
    p = predictions_as_of(c, "id", "entered_ms", predictions, POSTMORTEM_TARGETS, chunk_ms=chunk_ms)
    return c.join(p, "id", "left").select(
        F.col("id").alias("position_id"), "mint_address", "strategy", "entry_score", "predicted_peak_pct",
        nz("highest_pct").alias("actual_peak_pct"), "realized_pnl_pct", "exit_reason",
        F.floor((F.col("exited_ms") - F.col("entered_ms")) / 1000).alias("hold_duration_sec"),
        *[f"pred_{t}" for t in POSTMORTEM_TARGETS], F.col("exited_ms").alias("closed_ms"),
    )


def exit_ledger(closes: DataFrame) -> DataFrame:
    """Per exit reason and in total: closes, net, mean, best and worst."""
    c = closes.filter("status = 'closed'")
    return (
        c.rollup("exit_reason").agg(
            F.count(F.lit(1)).alias("n"), F.sum("realized_pnl_sol").alias("net_sol"), F.avg("realized_pnl_pct").alias("avg_pct"),
            F.max("realized_pnl_pct").alias("best_pct"), F.min("realized_pnl_pct").alias("worst_pct"),
            (F.sum("realized_pnl_sol") / F.count(F.lit(1))).alias("per_trade_sol"), F.grouping("exit_reason").alias("is_total"),
        )
    )


def bucket(col: Column, edges: list[float]) -> Column:
    """Index of [edges[i], edges[i+1]); NULL outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        out = F.when((col >= edges[i]) & (col < edges[i + 1]), i).otherwise(out)
    return out


def bucket_performance(closes: DataFrame, col: str, edges: list[float] = [0, 0.1, 0.25, 0.5, 1.01]) -> DataFrame:  # noqa: B006
    """Win rate and profit per trade by bucket of a prediction."""
    x = closes.withColumn("bucket", bucket(F.col(col), edges)).filter(F.col("bucket").isNotNull())
    return x.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), (F.avg((F.col("realized_pnl_sol") > 0).cast("int")) * 100).alias("win_pct"),
        F.avg("realized_pnl_sol").alias("per_trade_sol"),
    )


def calibration_table(predictions: DataFrame, labels: DataFrame, edges: list[float], on: list[str] = ["mint_address", "target"]) -> DataFrame:  # noqa: B006
    """Mean prediction against actual rate per target and probability bucket."""
    x = predictions.filter(F.col("prob").isNotNull()).join(labels.filter(F.col("actual").isNotNull()), on)
    return x.withColumn("bucket", bucket(F.col("prob"), edges)).groupBy("target", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean_predicted"), F.avg("actual").alias("actual_rate"),
        (F.avg("prob") - F.avg("actual")).alias("gap"),
    )


def cohort_pnl(closes: DataFrame, snapshots: DataFrame, col: str = "smart_buyer_count", chunk_ms: int = 3_600_000) -> DataFrame:
    """Profit by cohort of a count at entry: 0, 1-2, 3+."""
    c = closes.filter("status = 'closed'").select("id", "mint_address", "entered_ms", "realized_pnl_sol")
    s = snapshots.select("mint_address", "snapshot_ts", col)
    x = asof_join(c, s, ["mint_address"], "entered_ms", "snapshot_ts", [col], chunk_ms=chunk_ms)
    cohort = F.when(F.col(col).isNull(), "unknown").when(F.col(col) == 0, "0").when(F.col(col) <= 2, "1-2").otherwise("3+")
    return x.groupBy(cohort.alias("cohort")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("realized_pnl_sol").alias("net_sol"), F.avg("realized_pnl_sol").alias("per_trade_sol")
    )


def slippage_table(closes: DataFrame) -> DataFrame:
    """Mean gap between peak and realised percentage by exit reason."""
    c = closes.filter("status = 'closed'").withColumn("gap", F.col("highest_pct") - F.col("realized_pnl_pct"))
    return c.groupBy("exit_reason").agg(
        F.count(F.lit(1)).alias("n"), F.avg("highest_pct").alias("mean_peak_pct"), F.avg("realized_pnl_pct").alias("mean_realized_pct"),
        F.avg("gap").alias("mean_gap_pts"),
    )


def gate_condition(target: str, op: str, threshold: float) -> Column:
    c = F.col(target)
    return nz({"<=": c <= threshold, ">=": c >= threshold, "<": c < threshold, ">": c > threshold}[op], False)


def gate_whatif(closes: DataFrame, gates: dict[str, list[tuple[str, str, float]]]) -> DataFrame:
    """What each stack of gates would have kept: wins, losses, profit before and after.

    `closes` carries the entry predictions as columns. All gates are evaluated in one pass.
    """
    flags = []
    for name, conds in gates.items():
        keep = F.lit(True)
        for cond in conds:
            keep = keep & gate_condition(*cond)
        flags.append(F.struct(F.lit(name).alias("gate"), keep.alias("keep")))
    x = closes.select("realized_pnl_sol", F.explode(F.array(*flags)).alias("g")).select("realized_pnl_sol", "g.*")
    pnl, keep = F.col("realized_pnl_sol"), F.col("keep")
    return x.groupBy("gate").agg(
        F.count(F.lit(1)).alias("n_before"), F.count(F.when(keep, 1)).alias("n_after"),
        F.count(F.when(keep & (pnl > 0), 1)).alias("wins_kept"), F.count(F.when(~keep & (pnl < 0), 1)).alias("losses_removed"),
        F.sum(pnl).alias("pnl_before"), nz(F.sum(F.when(keep, pnl))).alias("pnl_after"),
        F.avg(pnl).alias("per_trade_before"), F.avg(F.when(keep, pnl)).alias("per_trade_after"),
    )


def ab_pnl_gap(closes: DataFrame, first: str, second: str) -> DataFrame:
    """Profit of two strategies on the tokens both closed, their difference per token and in total."""
    c = closes.filter((F.col("status") == "closed") & F.col("strategy").isin(first, second))
    a, b = F.col("strategy") == first, F.col("strategy") == second
    per = c.groupBy("mint_address").agg(
        F.count(F.when(a, 1)).alias("n_a"), F.count(F.when(b, 1)).alias("n_b"),
        nz(F.sum(F.when(a, F.col("realized_pnl_sol")))).alias("pnl_a"), nz(F.sum(F.when(b, F.col("realized_pnl_sol")))).alias("pnl_b"),
    ).filter("n_a > 0 AND n_b > 0")
    return per.rollup("mint_address").agg(
        *[F.sum(c).alias(c) for c in ("n_a", "n_b", "pnl_a", "pnl_b")], (F.sum("pnl_b") - F.sum("pnl_a")).alias("gap_sol")
    )


def version_trajectory(closes: DataFrame, version: str = "strategy") -> DataFrame:
    """Closes, net and per-trade profit by rule version in order of first close, with the change."""
    v = closes.filter("status = 'closed'").groupBy(version).agg(
        F.min("exited_ms").alias("first_close_ms"), F.count(F.lit(1)).alias("n"), F.sum("realized_pnl_sol").alias("net_sol"),
        F.avg("realized_pnl_sol").alias("per_trade_sol"),
    )
    # one row per version
    w = W.orderBy("first_close_ms", version)
    return v.withColumn("change_per_trade", F.col("per_trade_sol") - F.lag("per_trade_sol").over(w))
