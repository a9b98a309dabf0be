"""Point-in-time snapshot features: one row per (token, age), from trades at or before the cutoff.

A trade is not copied to every age. It gets the index of the first age whose cutoff covers it
(`bin`); each family aggregates per (token, bin) and then accumulates over the few bins. Families
that depend on trade order work on (token, bin, time chunk) segments and stitch the segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from launchlens.functions import (
    amount, floor_quantile_rank, nz, order_statistics, ratio, std_from_integer_sums, std_from_parts, std_of_units, token_join, top_rows, units,
)
from launchlens.operators.creators import (
    creator_history, creator_previous_launch, creator_siblings, creator_stats_unbounded,
)
from launchlens.operators.wallets import SMART_SKILL, WHALE_SKILL, unflagged
from launchlens.sources.files import replace_table, work_dir

# Ages in seconds at which a token is captured.
SNAPSHOT_AGES = [5, 15, 30, 60, 120, 300, 600, 900, 1800, 2400, 3600]
SUPPLY = 1_000_000_000
CHUNK_MS = 60_000
ROLL_MS = 30_000
KEY = ["mint_address", "snapshot_age_sec"]
#: What the families read of a trade.
BASE_COLUMNS = ["mint_address", "trade_id", "wallet", "is_buy", "sol_amount", "price_sol", "ts_ms", "created_ms", "creator_wallet", "bin", "secs"]

# Columns without a source in the data, with their constant.
PLACEHOLDERS = {
    "tracked_buyers": 0, "kol_buyers": 0, "bundle_buyers": 0, "weighted_buyer_quality": 0,
    "tracked_first_seen_sec": -1, "kol_first_seen_sec": -1,
    "creator_sol_to_sidewallets": 0, "creator_sidewallet_buyer_count": 0,
    "trend_signal_match": 0, "narrative_match_count": 0, "telegram_member_count": 0,
    "bot_sniper_buyer_count": 0, "sandwich_risk": 0, "reaction_speed_ms": 0,
    "rpc_latency_p90_ms": 0, "priority_fee_p90": 0,
}


def _age_array(ages: list[int]) -> Column:
    return F.array(*[F.lit(a) for a in ages])


def _bin_of(ms: Column, ages: list[int]) -> Column:
    """Index of the first age whose cutoff is at or after `ms` after creation; len(ages) when none is."""
    passed = F.lit(0)
    for a in ages:
        passed = passed + (ms > a * 1000).cast("int")
    return passed


def over_ages(df: DataFrame, ages: list[int]) -> DataFrame:
    """Repeat an aggregated (token, bin) row for each age it counts for."""
    return df.withColumn("snapshot_age_sec", F.explode(F.slice(_age_array(ages), F.col("bin") + 1, len(ages))))


def snapshot_grid(mints: DataFrame, ages: list[int], as_of_ms: int | None = None) -> DataFrame:
    """(token, age) pairs whose cutoff is not after as_of."""
    g = mints.select("mint_address", "created_ms", F.explode(_age_array(ages)).alias("snapshot_age_sec")).withColumn(
        "cutoff_ms", F.col("created_ms") + F.col("snapshot_age_sec") * 1000
    )
    return g if as_of_ms is None else g.filter(F.col("cutoff_ms") <= as_of_ms)


def trades_as_of(trades: DataFrame, mints: DataFrame, ages: list[int]) -> DataFrame:
    """Trades at or before the last cutoff of their token, with the bin and the seconds since creation."""
    joined = token_join(trades, mints.select("mint_address", "created_ms", "creator_wallet"))
    since = F.col("ts_ms") - F.col("created_ms")
    return (
        joined.filter(since <= max(ages) * 1000)
        .withColumn("bin", _bin_of(since, ages))
        .withColumn("secs", F.greatest(F.lit(0), F.floor(since / 1000)).cast("long"))
    )


def core_features(base: DataFrame, ages: list[int]) -> DataFrame:
    """Counts, flows, amount moments, creator activity and price state (A1, part of A2, A10, A13)."""
    buy, sell = F.col("is_buy") == 1, F.col("is_buy") == 0
    own = F.col("wallet") == F.col("creator_wallet")
    amt, whole = F.col("sol_amount"), units("sol_amount")
    squared = whole.cast("decimal(15,0)") * whole.cast("decimal(15,0)")
    one = base.groupBy("mint_address", "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(buy, 1)).alias("nb"),
        F.count(F.when(sell, 1)).alias("ns"),
        F.sum(F.when(buy, whole)).alias("sb"),
        F.sum(F.when(sell, whole)).alias("ss"),
        F.sum(F.when(buy, squared)).alias("qb"),
        F.sum(F.when(sell, squared)).alias("qs"),
        F.max(F.when(buy, amt)).alias("xb"),
        F.max(F.when(sell, amt)).alias("xs"),
        F.count(F.when(buy & own, 1)).alias("cb"),
        F.count(F.when(sell & own, 1)).alias("cs"),
        F.max("price_sol").alias("xp"),
        F.max(F.struct("ts_ms", "trade_id", "price_sol")).alias("last"),
    )
    return core_from_bins(over_ages(one, ages))


def core_from_bins(bins: DataFrame, also: list[str] = ()) -> DataFrame:
    """Core features from rows (token, age, one stretch of its trades), merged per token and age (and `also`)."""
    acc = bins.groupBy(*KEY, *also).agg(
        *[F.sum(c).alias(c) for c in ("n", "nb", "ns", "sb", "ss", "qb", "qs", "cb", "cs")],
        *[F.max(c).alias(c) for c in ("xb", "xs", "xp", "last")],
    )
    age = F.col("snapshot_age_sec")
    sb, ss = nz(amount("sb")), nz(amount("ss"))
    return acc.select(
        *KEY, *also,
        sb.alias("sol_inflow"), ss.alias("sol_outflow"),
        F.col("nb").alias("buy_count"), F.col("ns").alias("sell_count"),
        F.when(F.col("ns") > 0, F.col("nb") / F.col("ns")).when(F.col("nb") > 0, 99.0).otherwise(0.0).alias("buy_sell_ratio"),
        F.col("n").alias("trade_count"),
        F.when(age > 0, F.col("n") / age * 60).otherwise(0.0).alias("trades_per_min"),
        ratio(sb, "nb").alias("avg_buy_sol"), nz("xb").alias("max_buy_sol"),
        std_of_units("nb", "sb", "qb").alias("std_buy_sol"),
        ratio(ss, "ns").alias("avg_sell_sol"), nz("xs").alias("max_sell_sol"),
        std_of_units("ns", "ss", "qs").alias("std_sell_sol"),
        F.col("cb").alias("creator_buys_post_launch"), F.col("cs").alias("creator_sells_post_launch"),
        F.col("last.price_sol").alias("trade_price_sol"), F.col("xp").alias("peak_price_sol"),
    )


def amount_quantiles(base: DataFrame, ages: list[int]) -> DataFrame:
    """Floor-index median and 90th percentile of buy and sell amounts (rest of A2)."""
    q = order_statistics(
        base, ["mint_address", "is_buy"], "sol_amount",
        {"q50": floor_quantile_rank(0.5), "q90": floor_quantile_rank(0.9)}, grow=("bin", "snapshot_age_sec", ages),
    )
    buy = F.col("is_buy") == 1
    return q.groupBy(*KEY).agg(
        F.max(F.when(buy, F.col("q50"))).alias("median_buy_sol"), F.max(F.when(buy, F.col("q90"))).alias("p90_buy_sol"),
        F.max(F.when(~buy, F.col("q50"))).alias("median_sell_sol"), F.max(F.when(~buy, F.col("q90"))).alias("p90_sell_sol"),
    )


def _wallet_bins(base: DataFrame) -> DataFrame:
    buy = F.col("is_buy") == 1
    secs = F.when(buy, F.col("secs"))
    return base.groupBy("mint_address", "wallet", "bin").agg(
        F.sum(F.when(buy, units("sol_amount"))).alias("buy_vol"),
        F.sum(F.when(~buy, units("sol_amount"))).alias("sell_vol"),
        F.min(F.when(buy, F.struct("ts_ms", "trade_id", "secs"))).alias("first_buy"),
        F.min(F.when(~buy, F.struct("ts_ms", "trade_id", "secs"))).alias("first_sell"),
        F.count(secs).alias("n"), F.sum(secs).alias("s1"), F.sum(secs * secs).alias("s2"),
    )


def wallet_features(base: DataFrame, ages: list[int]) -> DataFrame:
    """Concentration, snipers, buyer ranks and timing of the ten largest buyers."""
    cum = (
        over_ages(_wallet_bins(base), ages)
        .groupBy(*KEY, "wallet")
        .agg(
            F.sum("buy_vol").alias("buy_vol"), F.sum("sell_vol").alias("sell_vol"),
            F.min("first_buy").alias("first_buy"), F.min("first_sell").alias("first_sell"),
            F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"),
        )
    )
    sides = (
        cum.select(
            *KEY,
            F.explode(
                F.array(
                    F.struct(
                        F.lit("b").alias("side"), F.col("buy_vol").alias("vol"), F.col("first_buy").alias("first"),
                        "n", "s1", "s2",
                    ),
                    F.struct(
                        F.lit("s").alias("side"), F.col("sell_vol").alias("vol"), F.col("first_sell").alias("first"),
                        "n", "s1", "s2",
                    ),
                )
            ).alias("x"),
        )
        .select(*KEY, "x.*")
        .filter(F.col("first").isNotNull())
    )
    totals = sides.groupBy(*KEY, "side").agg(
        F.count(F.lit(1)).alias("wallets"), F.sum("vol").alias("total"), F.sum(F.col("vol").cast("decimal(18,0)") * F.col("vol").cast("decimal(18,0)")).alias("sq"),
        F.count(F.when(F.col("first.secs") <= 30, 1)).alias("in30"), F.count(F.when(F.col("first.secs") <= 1, 1)).alias("in1"),
    )
    best = (
        top_rows(sides, [*KEY, "side"], [F.col("vol").desc(), F.col("first")], 10, rank="rk")
        .groupBy(*KEY, "side")
        .agg(
            *[F.sum(F.when(F.col("rk") <= k, F.col("vol"))).alias(f"top{k}") for k in (1, 3, 5)],
            F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"),
        )
    )
    x = totals.join(best, [*KEY, "side"])
    share = {k: F.when(F.col("total") > 0, F.col(f"top{k}") / F.col("total")).otherwise(0.0) for k in (1, 3, 5)}
    hhi = F.when(F.col("total") > 0, F.col("sq").cast("double") / F.col("total").cast("double") / F.col("total").cast("double")).otherwise(0.0)

    def on(side: str, c: Column) -> Column:
        return F.max(F.when(F.col("side") == side, c))

    out = x.groupBy(*KEY).agg(
        on("b", F.col("wallets")).alias("unique_buyers"),
        *[on("b", share[k]).alias(f"top{k}_buyer_sol_pct") for k in share], on("b", hhi).alias("buyer_hhi"),
        *[on("s", share[k]).alias(f"top{k}_seller_sol_pct") for k in share], on("s", hhi).alias("seller_hhi"),
        on("b", F.col("in30")).alias("sniper_buyer_count"), on("b", F.col("in1")).alias("first_block_buyer_count"),
        on("b", std_from_integer_sums("n", "s1", "s2")).alias("top10_buy_timing_std_sec"),
    )
    n = F.col("unique_buyers")
    return (
        out.withColumn("top10_buyers", F.when(n > 0, F.least(F.lit(10), n)))
        .withColumn("top50_buyers", F.when(n > 0, F.least(F.lit(50), n)))
        .withColumn("avg_buyer_rank", F.when(n > 0, (n + 1) / 2.0))
        .withColumn("median_buyer_rank", F.when(n > 0, F.floor(n / 2) + 1))
        .withColumn("pct_buyers_in_first_10", F.when(n > 0, F.least(F.lit(10), n) / n))
        .withColumn("fast_human_sniper_count", F.col("sniper_buyer_count"))
    )


def seconds_to_buyers(base: DataFrame, grid: DataFrame, counts: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Seconds from creation until the n-th distinct buyer, -1 while there are fewer."""
    first = (
        base.filter("is_buy = 1").groupBy("mint_address", "wallet").agg(F.min(F.struct("ts_ms", "trade_id", "secs")).alias("f"))
    )
    ranked = top_rows(first, ["mint_address"], [F.col("f")], max(counts), rank="rk")
    at = ranked.groupBy("mint_address").agg(*[F.max(F.when(F.col("rk") == n, F.col("f"))).alias(f"f{n}") for n in counts])
    return grid.join(at, "mint_address", "left").select(
        *KEY,
        *[
            F.when(F.col(f"f{n}.ts_ms") <= F.col("cutoff_ms"), F.col(f"f{n}.secs")).otherwise(-1).alias(f"seconds_to_{n}_unique_buyers")
            for n in counts
        ],
    )


def recent_window_features(base: DataFrame, ages: list[int]) -> DataFrame:
    """Buy pressure over the last 60 s and buy acceleration between its halves."""
    since = F.col("ts_ms") - F.col("created_ms")
    rows = base.withColumn(
        "snapshot_age_sec",
        F.explode(F.filter(_age_array(ages), lambda a: (since <= a * 1000) & (since >= a * 1000 - 60_000))),
    )
    late = since >= F.col("snapshot_age_sec") * 1000 - 30_000
    buy = F.col("is_buy") == 1
    amt = F.col("sol_amount")
    agg = rows.groupBy(*KEY).agg(
        F.count(F.when(buy, 1)).alias("nb"), F.count(F.when(~buy, 1)).alias("ns"),
        F.sum(F.when(buy, amt).otherwise(0.0)).alias("sb"), F.sum(F.when(~buy, amt).otherwise(0.0)).alias("ss"),
        F.count(F.when(buy & late, 1)).alias("ln"), F.count(F.when(buy & ~late, 1)).alias("en"),
        F.sum(F.when(buy & late, amt).otherwise(0.0)).alias("ls"), F.sum(F.when(buy & ~late, amt).otherwise(0.0)).alias("es"),
    )
    return agg.select(
        *KEY,
        ratio(F.col("nb"), F.col("nb") + F.col("ns")).alias("pressure_60_buy_pct"),
        (F.col("sb") - F.col("ss")).alias("pressure_60_net"),
        F.when(F.col("es") > 0, (F.col("ls") - F.col("es")) / F.col("es")).otherwise(0.0).alias("inflow_accel_pct"),
        F.when(F.col("en") > 0, (F.col("ln") - F.col("en")) / F.col("en")).otherwise(0.0).alias("buy_count_accel_pct"),
    )


def _segments(base: DataFrame, chunk_ms: int) -> DataFrame:
    """Order-dependent summary of each (token, bin, chunk) segment; a bounded number of values per segment."""
    seg = ["mint_address", "bin", "chunk"]
    rows = base.withColumn("chunk", F.floor(F.col("ts_ms") / chunk_ms).cast("long"))
    w = W.partitionBy(*seg).orderBy("ts_ms", "trade_id")
    past = w.rowsBetween(W.unboundedPreceding, -1)
    p, prev = F.col("price_sol"), F.col("prev")
    rows = (
        rows.select(*seg, "ts_ms", "trade_id", "price_sol", F.lag("price_sol").over(w).alias("prev"))
        .withColumn("dir", F.when((p != 0) & (prev != 0) & (p != prev), F.signum(p - prev)))
        .withColumn("last_dir", F.last("dir", ignorenulls=True).over(past))
        .withColumn("rev", F.coalesce(F.col("dir") != F.col("last_dir"), F.lit(False)))
        .withColumn("run_start", F.last(F.when(F.col("rev"), prev), ignorenulls=True).over(past))
    )
    order = F.struct("ts_ms", "trade_id")
    step = F.struct(prev.alias("prev"), F.col("dir").alias("dir"))
    pct = _run_pct(prev, F.col("run_start"))
    inner = F.col("rev") & F.col("run_start").isNotNull()
    ret = F.when((p > 0) & (prev > 0), (p - prev) / prev)
    return rows.groupBy(*seg).agg(
        F.min_by("price_sol", order).alias("first_price"), F.max_by("price_sol", order).alias("last_price"),
        F.min_by(step, F.when(F.col("dir").isNotNull(), order)).alias("step1"),
        F.min_by(step, F.when(F.col("rev"), order)).alias("rev1"),
        F.max_by(step, F.when(F.col("rev"), order)).alias("rev_last"),
        F.count(F.when(F.col("rev"), 1)).alias("n_rev"),
        F.max(F.when(inner & (F.col("last_dir") > 0), pct)).alias("up"),
        F.min(F.when(inner & (F.col("last_dir") < 0), pct)).alias("down"),
        F.count(ret).alias("rn"), F.avg(ret).alias("rmean"), F.var_pop(ret).alias("rvar"),
    )


def _run_pct(prev: Column, start: Column) -> Column:
    return F.when(start > 0, (prev - start) / start).otherwise(0.0)


def path_features(base: DataFrame, ages: list[int], chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Price reversals, longest closed up and down runs, volatility of consecutive returns.

    Segments are joined in time order: the step across a segment border, the first step of a segment
    and its first reversal are replayed per token; everything later in a segment is already final.
    """
    along = W.partitionBy("mint_address").orderBy("bin", "chunk")
    seg = (
        _segments(base, chunk_ms)
        .withColumn("prev_last", F.lag("last_price").over(along))
        .withColumn("token_first", F.first("first_price").over(along.rowsBetween(W.unboundedPreceding, 0)))
    )
    f, prev = F.col("first_price"), F.col("prev_last")
    border = F.when((f != 0) & (prev != 0) & (f != prev), F.signum(f - prev))

    def step(k: int, silent: bool, p: Column, d: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), F.lit(silent).alias("silent"), p.alias("prev"), d.alias("dir"))

    steps = seg.select(
        "mint_address", "bin", "chunk", "token_first",
        F.explode(
            F.array(
                step(0, False, prev, border),
                step(1, False, F.col("step1.prev"), F.col("step1.dir")),
                step(2, False, F.col("rev1.prev"), F.col("rev1.dir")),
                step(3, True, F.col("rev_last.prev"), F.when(F.col("n_rev") >= 2, F.col("rev_last.dir"))),
            )
        ).alias("s"),
    ).select("mint_address", "bin", "chunk", "token_first", "s.*").filter(F.col("dir").isNotNull())
    w = W.partitionBy("mint_address").orderBy("bin", "chunk", "k")
    past = w.rowsBetween(W.unboundedPreceding, -1)
    steps = (
        steps.withColumn("last_dir", F.lag("dir").over(w))
        .withColumn("rev", F.col("silent") | F.coalesce(F.col("dir") != F.col("last_dir"), F.lit(False)))
        .withColumn("start", F.coalesce(F.last(F.when(F.col("rev"), F.col("prev")), ignorenulls=True).over(past), "token_first"))
        .withColumn("counted", F.col("rev") & ~F.col("silent"))
        .withColumn("pct", _run_pct(F.col("prev"), F.col("start")))
    )
    outer = steps.groupBy("mint_address", "bin").agg(
        F.count(F.when(F.col("counted"), 1)).alias("n"),
        F.max(F.when(F.col("counted") & (F.col("last_dir") > 0), F.col("pct"))).alias("up"),
        F.min(F.when(F.col("counted") & (F.col("last_dir") < 0), F.col("pct"))).alias("down"),
    )
    border_ret = F.when((f > 0) & (prev > 0), (f - prev) / prev)
    parts = F.array_compact(
        F.array(
            F.when(
                F.col("rn") > 0,
                F.struct(F.col("rn").cast("double").alias("n"), F.col("rmean").alias("mean"), (F.col("rvar") * F.col("rn")).alias("m2")),
            ),
            F.when(border_ret.isNotNull(), F.struct(F.lit(1.0).alias("n"), border_ret.alias("mean"), F.lit(0.0).alias("m2"))),
        )
    )
    inner = seg.groupBy("mint_address", "bin").agg(
        F.sum(F.greatest(F.col("n_rev") - 1, F.lit(0))).alias("n"), F.max("up").alias("up"), F.min("down").alias("down"),
        F.flatten(F.collect_list(parts)).alias("parts"),
    )
    both = inner.unionByName(outer, allowMissingColumns=True)
    return (
        over_ages(both, ages)
        .groupBy(*KEY)
        .agg(
            F.sum("n").alias("n_reversals_in_window"),
            F.greatest(F.lit(0.0), F.max("up")).alias("longest_up_run_pct"),
            F.least(F.lit(0.0), F.min("down")).alias("longest_down_run_pct"),
            std_from_parts(F.flatten(F.collect_list("parts"))).alias("volatility_pct"),
        )
        .withColumn("volatility_pct", nz("volatility_pct"))
    )


def rolling_features(base: DataFrame, ages: list[int], chunk_ms: int = CHUNK_MS, roll_ms: int = ROLL_MS) -> DataFrame:
    """Maxima over 30 s windows that start at a trade and end at most at the cutoff.

    Windows that end before a cutoff are the same for every later age; they are evaluated once, as
    differences of running sums of integer amounts, inside (token, chunk) with a 30 s overlap.
    Windows cut off by a cutoff only exist for trades of its last 30 s.
    """
    assert chunk_ms >= roll_ms
    keep = ["mint_address", "ts_ms", "trade_id", "created_ms", "wallet", "is_buy"]
    home = F.floor(F.col("ts_ms") / chunk_ms).cast("long")
    buy = F.col("is_buy") == 1
    units = F.round(F.col("sol_amount") * 1e9).cast("long")
    rows = base.select(
        *keep, home.alias("home"),
        F.when(buy, units).otherwise(0).alias("b"), F.when(~buy, units).otherwise(0).alias("s"),
        buy.cast("long").alias("nb"), (~buy).cast("long").alias("ns"),
    )
    overlap = F.col("ts_ms") - F.col("home") * chunk_ms < roll_ms
    copies = rows.withColumn(
        "chunk", F.explode(F.when(overlap, F.array(F.col("home"), F.col("home") - 1)).otherwise(F.array("home")))
    )
    part = W.partitionBy("mint_address", "chunk")
    before = part.orderBy("ts_ms", "trade_id").rowsBetween(W.unboundedPreceding, -1)
    ahead = part.orderBy("ts_ms").rangeBetween(W.unboundedPreceding, roll_ms)
    vals = ["b", "s", "nb", "ns"]
    full = copies.select("*", *[nz(F.sum(v).over(before), 0).alias(f"{v}0") for v in vals])
    full = full.select("*", *[F.sum(v).over(ahead).alias(f"{v}1") for v in vals]).filter("chunk = home")
    full = full.select(
        "mint_address", _bin_of(F.col("ts_ms") + roll_ms - F.col("created_ms"), ages).alias("bin"),
        *[(F.col(f"{v}1") - F.col(f"{v}0")).alias(v) for v in vals],
    )
    share = F.when(F.col("s") > 0, F.col("b") / F.col("s")).when(F.col("b") > 0, 99.0).otherwise(0.0)
    tops = [F.max(v).alias(v) for v in vals] + [F.max(share).alias("r")]
    full = over_ages(full.filter(F.col("bin") < len(ages)).groupBy("mint_address", "bin").agg(*tops), ages).drop("bin")

    since = F.col("ts_ms") - F.col("created_ms")
    cut = rows.withColumn(
        "snapshot_age_sec",
        F.explode(F.filter(_age_array(ages), lambda a: (since <= a * 1000) & (since >= a * 1000 - roll_ms))),
    )
    suffix = W.partitionBy(*KEY).orderBy(F.col("ts_ms").desc(), F.col("trade_id").desc()).rowsBetween(W.unboundedPreceding, 0)
    tail = cut.select(*KEY, *[F.sum(v).over(suffix).alias(v) for v in vals]).groupBy(*KEY).agg(*tops)

    # distinct sellers: every sell opens the interval of window starts that see it, cut at the wallet's previous sell
    sells = copies.filter("is_buy = 0")
    lo, hi = F.col("chunk") * chunk_ms, (F.col("chunk") + 1) * chunk_ms - 1
    seen = F.lag("ts_ms").over(W.partitionBy("mint_address", "chunk", "wallet").orderBy("ts_ms", "trade_id"))
    spans = sells.select(
        "mint_address", "chunk", "created_ms",
        F.greatest(F.col("ts_ms") - roll_ms, nz(seen + 1, -(2**62)), lo).alias("x0"), F.least(F.col("ts_ms"), hi).alias("x1"),
    ).filter("x0 <= x1")
    marks = spans.select(
        "mint_address", "chunk", "created_ms",
        F.explode(
            F.array(
                F.struct(F.col("x0").alias("x"), F.lit(0).alias("kind"), F.lit(1).alias("d")),
                F.struct(F.col("x1").alias("x"), F.lit(1).alias("kind"), F.lit(-1).alias("d")),
            )
        ).alias("m"),
    ).select("mint_address", "chunk", "created_ms", "m.*")
    level = F.sum("d").over(W.partitionBy("mint_address", "chunk").orderBy("x", "kind").rowsBetween(W.unboundedPreceding, 0))
    live = (
        marks.withColumn("sellers", level)
        .withColumn("bin", _bin_of(F.col("x") + roll_ms - F.col("created_ms"), ages))
        .filter(F.col("bin") < len(ages))
        .groupBy("mint_address", "bin")
        .agg(F.max("sellers").alias("sellers"))
    )
    live = over_ages(live, ages).drop("bin")
    last = (
        cut.filter("is_buy = 0").groupBy(*KEY, "wallet").agg(F.count(F.lit(1)).alias("_"))
        .groupBy(*KEY).agg(F.count(F.lit(1)).alias("sellers"))
    )
    every = (
        full.unionByName(tail).unionByName(live, allowMissingColumns=True).unionByName(last, allowMissingColumns=True)
    )
    return every.groupBy(*KEY).agg(
        (nz(F.max("b"), 0) / 1e9).alias("max_30s_buy_sol"), nz(F.max("nb"), 0).alias("max_30s_buy_count"),
        nz(F.max("r"), 0.0).alias("max_30s_buy_sell_ratio"),
        (nz(F.max("s"), 0) / 1e9).alias("max_30s_sell_sol"), nz(F.max("ns"), 0).alias("max_30s_sell_count"),
        nz(F.max("sellers"), 0).cast("long").alias("max_30s_unique_sellers"),
    )


def wallet_skill_features(base: DataFrame, wallet_stats: DataFrame, ages: list[int]) -> DataFrame:
    """Skill of the distinct unflagged buyers and sellers seen so far."""
    pairs = base.groupBy("mint_address", "wallet", "is_buy").agg(F.min("bin").alias("bin"))
    known = pairs.join(unflagged(wallet_stats).select("wallet", "skill_score", "median_hold_sec"), "wallet")
    counts = known.groupBy("mint_address", "is_buy", "bin").agg(
        F.count(F.when(F.col("skill_score") >= SMART_SKILL, 1)).alias("smart"),
        F.count(F.when(F.col("skill_score") >= WHALE_SKILL, 1)).alias("whale"),
        F.sum("median_hold_sec").alias("hold"), F.count("median_hold_sec").alias("n_hold"),
    )
    buy = F.col("is_buy") == 1
    acc = over_ages(counts, ages).groupBy(*KEY).agg(
        F.sum(F.when(buy, F.col("smart")).otherwise(0)).alias("smart_buyer_count"),
        F.sum(F.when(buy, F.col("whale")).otherwise(0)).alias("whale_buyer_count"),
        nz(F.sum(F.when(buy, F.col("hold"))) / F.sum(F.when(buy, F.col("n_hold")))).alias("avg_buyer_hold_sec"),
        F.sum(F.when(~buy, F.col("smart")).otherwise(0)).alias("smart_seller_count"),
    )
    q = order_statistics(
        known, ["mint_address", "is_buy"], "skill_score", {"p90": floor_quantile_rank(0.9)}, grow=("bin", "snapshot_age_sec", ages)
    ).groupBy(*KEY).agg(
        nz(F.max(F.when(buy, F.col("p90")))).alias("top_buyer_skill_p90"),
        nz(F.max(F.when(~buy, F.col("p90")))).alias("top_seller_skill_p90"),
    )
    return acc.join(q, KEY, "left")


def static_features(mints: DataFrame, monday_first: bool = False) -> DataFrame:
    """Link flags, name lengths, UTC hour and day of week of the launch (F5); Sunday is 0 unless monday_first."""
    filled = lambda c: (F.length(nz(F.col(c), "")) > 0).cast("int")
    ts = F.timestamp_millis(F.col("created_ms"))
    day = F.weekday(ts) if monday_first else F.dayofweek(ts) - 1
    return mints.select(
        "mint_address", nz("initial_buy_sol").alias("initial_buy_sol"),
        filled("twitter").alias("has_twitter"), filled("telegram").alias("has_telegram"), filled("website").alias("has_website"),
        F.length(nz(F.col("name"), "")).alias("name_length"), F.length(nz(F.col("symbol"), "")).alias("symbol_length"),
        F.hour(ts).alias("created_hour_utc"), day.alias("created_dow"),
    )


def labelled_buyers(base: DataFrame, wallets: DataFrame, ages: list[int]) -> DataFrame:
    """Distinct tracked, known and bundled buyers, and when the first tracked and known one bought."""
    first = base.filter("is_buy = 1").groupBy("mint_address", "wallet").agg(F.min(F.struct("bin", "secs")).alias("f"))
    tagged = first.join(
        wallets.select(F.col("address").alias("wallet"), "tracked", "is_kol", "bundle_cluster_id"), "wallet", "left"
    )
    yes = {
        "tracked": nz("tracked", 0) == 1, "kol": nz("is_kol", 0) == 1,
        "bundle": nz(F.col("bundle_cluster_id"), "") != "",
    }
    per = tagged.groupBy("mint_address", F.col("f.bin").alias("bin")).agg(
        *[F.count(F.when(c, 1)).alias(f"{n}_buyers") for n, c in yes.items()],
        *[F.min(F.when(yes[n], F.col("f.secs"))).alias(f"{n}_first_seen_sec") for n in ("tracked", "kol")],
    )
    return over_ages(per, ages).groupBy(*KEY).agg(
        *[F.sum(f"{n}_buyers").alias(f"{n}_buyers") for n in yes],
        *[nz(F.min(f"{n}_first_seen_sec"), -1).alias(f"{n}_first_seen_sec") for n in ("tracked", "kol")],
    )


def price_state(core: DataFrame, mints: DataFrame, leaky_state: bool = False) -> DataFrame:
    """Last price (falling back to the token's), market cap and peak so far.

    The peak uses trades up to the cutoff; `leaky_state` uses the token's current peak instead.
    """
    m = mints.select("mint_address", F.col("last_price_sol").alias("_mp"), F.col("peak_market_cap_sol").alias("_mpeak"))
    last = F.when(nz("trade_price_sol") != 0, F.col("trade_price_sol")).otherwise(nz("_mp"))
    mcap = F.when(F.col("last_price_sol") > 0, F.col("last_price_sol") * SUPPLY).otherwise(0.0)
    peak = nz("_mpeak") if leaky_state else nz("peak_price_sol") * SUPPLY
    return (
        core.join(m, "mint_address", "left").withColumn("last_price_sol", last).withColumn("last_mcap_sol", mcap)
        .withColumn("peak_mcap_sol_so_far", F.greatest(peak, F.col("last_mcap_sol")))
        .drop("trade_price_sol", "peak_price_sol", "_mp", "_mpeak")
    )


def hhi_delta(snapshots: DataFrame) -> DataFrame:
    """Change of buyer and seller concentration since the previous age of the token."""
    w = W.partitionBy("mint_address").orderBy("snapshot_age_sec")
    return snapshots.select(
        "*", *[nz(F.col(f"{s}_hhi") - F.lag(f"{s}_hhi").over(w)).alias(f"{s}_hhi_delta") for s in ("buyer", "seller")]
    )


def snapshot_features(
    trades: DataFrame, mints: DataFrame, wallet_stats: DataFrame | None = None, ages: list[int] = SNAPSHOT_AGES,
    wallets: DataFrame | None = None, as_of_ms: int | None = None, creator_mode: str = "point_in_time",
    leaky_state: bool = False, chunk_ms: int = CHUNK_MS, with_hhi_delta: bool = False,
) -> DataFrame:
    """The wide snapshot row per (token, age), all families joined.

    The trades of the ages are met with their tokens once and written; the families read that table, each its own columns."""
    base = replace_table(trades_as_of(trades, mints, ages).select(*BASE_COLUMNS), work_dir(trades.sparkSession, "ages"))
    grid = snapshot_grid(mints, ages, as_of_ms)
    out = (
        grid.join(price_state(core_features(base, ages), mints, leaky_state), KEY, "left")
        .join(amount_quantiles(base, ages), KEY, "left")
        .join(wallet_features(base, ages), KEY, "left")
        .join(seconds_to_buyers(base, grid), KEY, "left")
        .join(path_features(base, ages, chunk_ms), KEY, "left")
        .join(rolling_features(base, ages, chunk_ms), KEY, "left")
        .join(recent_window_features(base, ages), KEY, "left")
    )
    skill = [
        "top_buyer_skill_p90", "smart_buyer_count", "whale_buyer_count", "avg_buyer_hold_sec", "top_seller_skill_p90",
        "smart_seller_count",
    ]
    if wallet_stats is not None:
        out = out.join(wallet_skill_features(base, wallet_stats, ages), KEY, "left")
    else:
        out = out.select("*", *[F.lit(0.0).alias(c) for c in skill])
    constants = dict(PLACEHOLDERS)
    if wallets is not None:
        out = out.join(labelled_buyers(base, wallets, ages), KEY, "left").fillna(
            -1, ["tracked_first_seen_sec", "kol_first_seen_sec"]
        )
        for c in ("tracked_buyers", "kol_buyers", "bundle_buyers", "tracked_first_seen_sec", "kol_first_seen_sec"):
            constants.pop(c)
    per_token = static_features(mints).join(creator_siblings(mints), "mint_address", "left")
    if creator_mode == "unbounded":
        per_token = per_token.join(creator_stats_unbounded(mints), "mint_address", "left")
    else:
        per_token = per_token.join(creator_history(mints), "mint_address", "left").join(
            creator_previous_launch(mints), "mint_address", "left"
        )
    state = mints.select("mint_address", nz("v_sol_in_curve").alias("v_sol_in_curve"), nz("migrated", 0).alias("migrated"))
    out = out.join(per_token, "mint_address", "left").join(state, "mint_address", "left")
    out = out.fillna(-1, ["seconds_since_prev_creator_death"]).fillna(0)
    n_buys = F.col("buy_count")
    out = out.withColumn("pct_sniper_buys", ratio("sniper_buyer_count", n_buys)).withColumn(
        "pct_first_block_buys", ratio("first_block_buyer_count", n_buys)
    )
    out = out.select(
        "*", *[F.lit(v).alias(c) for c, v in constants.items()], F.lit("unknown").alias("network_status"),
        F.col("cutoff_ms").alias("snapshot_ts"),
    ).drop("created_ms", "cutoff_ms")
    if with_hhi_delta:
        return hhi_delta(out)
    return out.withColumn("buyer_hhi_delta", F.lit(0.0)).withColumn("seller_hhi_delta", F.lit(0.0))


def offline_snapshot(
    trades: DataFrame, mints: DataFrame, wallets: DataFrame, moments: list[int], min_age_ms: int = 6 * 3_600_000,
    as_of_ms: int | None = None,
) -> DataFrame:
    """Older feature set at fixed moments; no row before the first trade."""
    old = mints if as_of_ms is None else mints.filter(F.col("created_ms") <= as_of_ms - min_age_ms)
    base = trades_as_of(trades, old, moments)
    mcap = (
        base.groupBy("mint_address", "bin")
        .agg(F.max(F.struct("ts_ms", "trade_id", "market_cap_sol")).alias("last"), F.max("market_cap_sol").alias("peak"))
    )
    mcap = over_ages(mcap, moments).groupBy(*KEY).agg(
        nz(F.max("last")["market_cap_sol"]).alias("last_mcap_sol"), nz(F.max("peak")).alias("peak_mcap_sol_so_far")
    )
    buyers = wallet_features(base, moments).select(*KEY, "unique_buyers")
    core = core_features(base, moments)
    age = F.col("snapshot_age_sec")
    return (
        core.join(mcap, KEY).join(buyers, KEY, "left").join(labelled_buyers(base, wallets, moments), KEY, "left")
        .join(static_features(old, monday_first=True), "mint_address").join(creator_history(old), "mint_address")
        .join(old.select("mint_address", "created_ms"), "mint_address")
        .fillna(0, ["unique_buyers", "tracked_buyers", "kol_buyers", "bundle_buyers"])
        .select(
            "mint_address", age.alias("decision_moment_sec"), (F.col("created_ms") + age * 1000).alias("snapshot_ts"),
            "initial_buy_sol", "creator_launch_count", "creator_migrated_count", "has_twitter", "has_telegram", "has_website",
            "name_length", "symbol_length", "created_hour_utc", "created_dow", age.alias("age_sec"),
            nz("trade_price_sol").alias("last_price_sol"), "last_mcap_sol", "peak_mcap_sol_so_far",
            nz("peak_price_sol").alias("peak_price_so_far"), "sol_inflow", "sol_outflow", "buy_count", "sell_count",
            F.when(F.col("sell_count") > 0, F.col("buy_count") / F.col("sell_count")).otherwise(99.0).alias("buy_sell_ratio"),
            "unique_buyers", "tracked_buyers", "kol_buyers", "bundle_buyers", "trade_count",
            (F.col("trade_count") / F.greatest(F.lit(1.0), age / 60)).alias("trades_per_min"),
        )
    )
