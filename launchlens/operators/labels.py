"""Outcome labels from the trades after a snapshot.

All label windows of a token start and end at fixed offsets from its anchor (launch or migration).
Trades are aggregated once into the stretches between those offsets; every label of every age is
then an aggregate over a run of stretches. Nothing is copied per age before that reduction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from launchlens.functions import nz, ratio, token_join
from launchlens.operators.features import KEY, SUPPLY, _age_array, _bin_of, labelled_buyers, over_ages, path_features
from launchlens.sources.files import replace_table, work_dir

# Label horizons in seconds.
HORIZONS = {"60s": 60, "300s": 300, "10m": 600, "15m": 900, "1h": 3600, "4h": 14_400, "24h": 86_400}
POST_HORIZONS = {"5m": 300, "30m": 1800, "1h": 3600, "4h": 14_400, "24h": 86_400, "72h": 259_200}
MIGRATION_AGES_MIN = [0, 30, 60, 360, 720, 1440]


def at_anchors(trades: DataFrame, anchors: DataFrame) -> DataFrame:
    """Trades with the anchor_ms of their token; those that have it already stay as they are."""
    return trades if "anchor_ms" in trades.columns else token_join(trades, anchors.select("mint_address", "anchor_ms"))


def forward_windows(
    trades: DataFrame, anchors: DataFrame, ages: list[int], horizons: dict[str, int], chunk_ms: int = 900_000
) -> DataFrame:
    """One row per (token, age): for every horizon highest, lowest and newest price of (cutoff, cutoff + horizon],
    trades, buys, volume, time of the highest price, deepest fall; and the highest price ever after.

    `anchors` has (mint_address, anchor_ms, and per age the price p in a map `price_at`).
    """
    edges = sorted({a for a in ages} | {a + h for a in ages for h in horizons.values()})
    at = {e: i for i, e in enumerate(edges)}
    rel = F.col("ts_ms") - F.col("anchor_ms")
    later = at_anchors(trades, anchors).select("mint_address", "anchor_ms", "ts_ms", "trade_id", "price_sol", "sol_amount", "is_buy").filter(rel > min(ages) * 1000)
    rows = (
        later.filter(rel <= edges[-1] * 1000)
        .withColumn("iv", _bin_of(rel, edges))
        .withColumn("chunk", F.floor(F.col("ts_ms") / chunk_ms).cast("long"))
    )
    seg = ["mint_address", "iv", "chunk"]
    inside = W.partitionBy(*seg).orderBy("ts_ms", "trade_id").rowsBetween(W.unboundedPreceding, 0)
    price = F.col("price_sol")
    pieces = (
        rows.withColumn("top", F.max("price_sol").over(inside))
        .groupBy(*seg)
        .agg(
            F.max(F.struct(price.alias("p"), (-F.col("ts_ms")).alias("neg_ts"))).alias("hi"), F.min("price_sol").alias("lo"),
            F.max(F.struct("ts_ms", "trade_id", "price_sol")).alias("last"), F.count(F.lit(1)).alias("n"),
            F.sum("is_buy").alias("nb"), F.sum("sol_amount").alias("vol"),
            F.min(F.when(F.col("top") > 0, price / F.col("top") - 1)).alias("dd"),
        )
    )
    # after the last edge only the highest price matters: one row per token
    beyond = later.filter(rel > edges[-1] * 1000).groupBy("mint_address").agg(
        F.max(F.struct(price.alias("p"), (-F.col("ts_ms")).alias("neg_ts"))).alias("hi")
    ).withColumn("iv", F.lit(len(edges)))
    pieces = pieces.unionByName(beyond, allowMissingColumns=True)
    spec = F.array(
        *[
            F.struct(
                F.lit(a).alias("age"), F.lit(at[a]).alias("from"), *[F.lit(at[a + h]).alias(f"to_{n}") for n, h in horizons.items()]
            )
            for a in ages
        ]
    )
    longest = max(horizons, key=horizons.get)
    wide = pieces.withColumn("s", F.explode(F.filter(spec, lambda s: s["from"] < F.col("iv")))).select(
        "mint_address", F.col("s.age").alias("snapshot_age_sec"), "iv", "chunk", "hi", "lo", "last", "n", "nb", "vol", "dd",
        *[(F.col("iv") <= F.col(f"s.to_{n}")).alias(f"in_{n}") for n in horizons],
    )
    # fall from the highest price of the earlier pieces; a bounded number of pieces per (token, age)
    earlier = W.partitionBy(*KEY).orderBy("iv", "chunk").rowsBetween(W.unboundedPreceding, -1)
    wide = wide.join(anchors.select("mint_address", "price_at"), "mint_address").withColumn("p", F.element_at("price_at", F.col("snapshot_age_sec")))
    before = F.greatest(F.max(F.col("hi.p")).over(earlier), F.col("p"))
    wide = wide.withColumn("fall", F.least(F.col("dd"), F.when(before > 0, F.col("lo") / before - 1)))
    aggs = [F.max("hi.p").alias("ever_max"), F.count(F.lit(1)).alias("ever_pieces")]
    for n in horizons:
        inn = F.col(f"in_{n}")
        aggs += [
            F.max(F.when(inn, F.col("hi.p"))).alias(f"max_{n}"), F.min(F.when(inn, F.col("lo"))).alias(f"min_{n}"),
            F.max(F.when(inn, F.col("last")))["price_sol"].alias(f"last_{n}"), nz(F.sum(F.when(inn, F.col("n"))), 0).alias(f"n_{n}"),
            nz(F.sum(F.when(inn, F.col("nb"))), 0).alias(f"buys_{n}"), nz(F.sum(F.when(inn, F.col("vol")))).alias(f"vol_{n}"),
            (-F.max(F.when(inn, F.col("hi")))["neg_ts"]).alias(f"peak_ts_{n}"),
        ]
    aggs.append(F.min(F.when(F.col(f"in_{longest}"), F.col("fall"))).alias("deepest_fall"))
    return wide.groupBy(*KEY).agg(*aggs)


def first_time_at_multiple(
    trades: DataFrame, anchors: DataFrame, multiple: float, ages: list[int], horizon_sec: int, slot_ms: int = 60_000
) -> DataFrame:
    """First trade time after each cutoff whose price is at least multiple * p (rest of L11).

    Time slots are screened by their highest price first; only the first qualifying slot of a
    (token, age) is read again.
    """
    rel = F.col("ts_ms") - F.col("anchor_ms")
    rows = at_anchors(trades, anchors).select("mint_address", "anchor_ms", "ts_ms", "price_sol")
    bins = [*ages]
    slot = F.floor(F.col("ts_ms") / slot_ms).cast("long")
    # splitting slots at the cutoffs keeps a slot on one side of every cutoff
    rows = rows.withColumn("slot", slot).withColumn("side", _bin_of(rel, bins)).filter(
        (rel > min(ages) * 1000) & (rel <= (max(ages) + horizon_sec) * 1000)
    )
    tops = rows.groupBy("mint_address", "slot", "side").agg(
        F.max("price_sol").alias("top")
    ).join(anchors.select("mint_address", "price_at"), "mint_address")
    spec = F.array(*[F.struct(F.lit(a).alias("age"), F.lit(i).alias("i")) for i, a in enumerate(ages)])
    goal = F.element_at("price_at", F.col("s.age")) * multiple
    want = (
        tops.withColumn("s", F.explode(F.filter(spec, lambda s: s["i"] < F.col("side"))))
        .withColumn("goal", goal).filter((F.col("goal") > 0) & (F.col("top") >= F.col("goal")))
        .groupBy("mint_address", F.col("s.age").alias("snapshot_age_sec"))
        .agg(F.min(F.struct("slot", "side", "goal")).alias("w"))
        .select("mint_address", "snapshot_age_sec", "w.slot", "w.side", "w.goal")
    )
    hit = rows.select("mint_address", "slot", "side", "ts_ms", "price_sol", "anchor_ms").join(want, ["mint_address", "slot", "side"])
    limit = F.col("anchor_ms") + (F.col("snapshot_age_sec") + horizon_sec) * 1000
    return hit.filter((F.col("price_sol") >= F.col("goal")) & (F.col("ts_ms") <= limit)).groupBy(*KEY).agg(F.min("ts_ms").alias("first_ms"))


def next_minute_wallets(trades: DataFrame, anchors: DataFrame, ages: list[int], sec: int = 60) -> DataFrame:
    """Distinct buyers and sellers in the minute after each cutoff."""
    rel = F.col("ts_ms") - F.col("anchor_ms")
    rows = at_anchors(trades, anchors).withColumn(
        "snapshot_age_sec", F.explode(F.filter(_age_array(ages), lambda a: (rel > a * 1000) & (rel <= (a + sec) * 1000)))
    )
    per = rows.groupBy(*KEY, "wallet").agg(F.max("is_buy").alias("b"), F.min("is_buy").alias("s"))
    return per.groupBy(*KEY).agg(F.sum("b").alias("buyers"), F.sum(1 - F.col("s")).alias("sellers"))


def pump_durability(trades: DataFrame, anchors: DataFrame, ages: list[int], sec: int = 300, bin_sec: int = 10) -> DataFrame:
    """Share of the traded 10 s bins of the next five minutes whose last price is at least p."""
    rel = F.col("ts_ms") - F.col("anchor_ms")
    rows = at_anchors(trades, anchors).select("mint_address", "anchor_ms", "ts_ms", "trade_id", "price_sol").withColumn(
        "snapshot_age_sec", F.explode(F.filter(_age_array(ages), lambda a: (rel > a * 1000) & (rel <= (a + sec) * 1000)))
    )
    slot = F.floor((rel - F.col("snapshot_age_sec") * 1000 - 1) / (bin_sec * 1000))
    last = rows.groupBy(*KEY, slot.alias("slot")).agg(
        F.max(F.struct("ts_ms", "trade_id", "price_sol"))["price_sol"].alias("c")
    ).join(anchors.select("mint_address", "price_at"), "mint_address").withColumn("p", F.element_at("price_at", F.col("snapshot_age_sec")))
    return last.groupBy(*KEY).agg(F.avg((F.col("c") >= F.col("p")).cast("int")).alias("durability"))


def anchors_from_snapshots(snapshots: DataFrame, mints: DataFrame) -> DataFrame:
    """(token, launch time, map age -> price) from snapshot rows; one entry per age."""
    m = snapshots.groupBy("mint_address").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("snapshot_age_sec"), F.col("last_price_sol")))).alias("price_at")
    )
    return m.join(mints.select("mint_address", F.col("created_ms").alias("anchor_ms")), "mint_address")


def resolve_labels(
    snapshots: DataFrame, trades: DataFrame, mints: DataFrame, as_of_ms: int, ages: list[int],
    horizons: dict[str, int] = HORIZONS, chunk_ms: int = 900_000,
) -> DataFrame:
    """All pre-migration labels per snapshot (L1, L2, L4-L16). A label is NULL until its horizon has passed.

    `snapshots` needs last_price_sol, peak_mcap_sol_so_far and pressure_60_buy_pct. The trades after the first age are met
    with their tokens once and written; the label families read that table.
    """
    a = anchors_from_snapshots(snapshots, mints)
    met = at_anchors(trades.select("mint_address", "trade_id", "wallet", "is_buy", "sol_amount", "price_sol", "ts_ms"), a)
    trades = replace_table(met.filter(F.col("ts_ms") - F.col("anchor_ms") > min(ages) * 1000), work_dir(trades.sparkSession, "later"))
    w = forward_windows(trades, a, ages, horizons, chunk_ms)
    five = first_time_at_multiple(trades, a, 5.0, ages, horizons["24h"])
    m = mints.select(
        "mint_address", "created_ms", nz("migrated", 0).alias("token_migrated"), "migrated_ms", "rugged_ms",
        F.col("last_trade_ms").alias("token_last_ms"),
    )
    x = (
        snapshots.select(
            *KEY, F.col("last_price_sol").alias("p"), (F.col("peak_mcap_sol_so_far") / SUPPLY).alias("peak_price"),
            F.col("pressure_60_buy_pct").alias("share_before"),
        )
        .join(m, "mint_address").join(w, KEY, "left").join(five, KEY, "left")
        .join(next_minute_wallets(trades, a, ages, horizons["60s"]), KEY, "left")
        .join(pump_durability(trades, a, ages, horizons["300s"]), KEY, "left")
        .withColumn("cutoff_ms", F.col("created_ms") + F.col("snapshot_age_sec") * 1000)
    )
    p, cut = F.col("p"), F.col("cutoff_ms")
    ok = p > 0

    def until(h: str) -> Column:
        return cut + horizons[h] * 1000

    def due(h: str, c: Column) -> Column:
        return F.when(until(h) <= as_of_ms, c)

    def flag(c: Column) -> Column:
        return nz(c.cast("int"), 0)

    gain = F.when(ok & F.col("ever_max").isNotNull(), (F.col("ever_max") - p) / p).otherwise(0.0)
    reached = lambda h, k: due(h, flag(ok & (F.col(f"max_{h}") >= k * p)))
    hold = lambda h: due(h, F.when(ok, nz(F.col(f"last_{h}") / p - 1)))
    within = lambda c, h: due(h, flag((F.col(c) > cut) & (F.col(c) <= until(h))))
    alive = lambda h: due(h, flag((F.col("token_last_ms") >= until(h)) & ~nz(F.col("rugged_ms") <= until(h), False)))
    share_next = ratio("buys_60s", "n_60s")
    return x.select(
        *KEY, F.col("token_migrated").alias("migrated"),
        *[flag(gain >= k).alias(f"peaked_{int(k * 100)}") for k in (0.3, 1.0, 3.0, 5.0)], gain.alias("peak_pct_max"),
        within("rugged_ms", "24h").alias("will_rug"), within("migrated_ms", "24h").alias("will_migrate"),
        within("migrated_ms", "15m").alias("migrates_within_15min"),
        reached("1h", 2).alias("hits_2x_within_1h"), reached("24h", 5).alias("hits_5x_within_24h"), reached("24h", 10).alias("hits_10x_within_24h"),
        due("24h", F.when(ok, nz((F.col("max_24h") - p) / p))).alias("peak_pct_within_24h"),
        due("60s", 1 - flag(F.col("max_60s") > p)).alias("local_top_60s"),
        due("60s", flag((nz("n_60s", 0) > 0) & (share_next >= 0.5) & (share_next >= nz("share_before")))).alias("buy_pressure_continues_60s"),
        due("300s", flag(ok & (F.col("min_300s") <= 0.3 * p))).alias("rug_within_5min"),
        due("24h", (F.col("peak_ts_24h") - cut) / 1000).alias("time_to_peak_sec"),
        due("24h", (F.col("first_ms") - cut) / 1000).alias("time_to_peak_5x_sec"),
        due("24h", flag(F.col("peak_ts_24h") <= until("300s"))).alias("peak_within_5min"),
        *[alive(h).alias(f"alive_at_{h}") for h in ("1h", "4h", "24h")],
        due("10m", flag(F.col("token_last_ms") <= until("10m"))).alias("will_die_fast"),
        *[hold(h).alias(f"hold_{h}_pct") for h in ("1h", "4h", "24h")], *[hold(h).alias(f"pnl_pct_{h}") for h in ("60s", "300s")],
        *[due(h, flag(ok & (F.col(f"last_{h}") > p))).alias(f"price_up_{h}") for h in ("60s", "300s")],
        due("300s", flag(ok & (F.col("min_300s") <= 0.8 * p))).alias("drawdown_20pct_300s"),
        F.when(F.col("peak_price") > 0, (F.col("peak_price") - p) / F.col("peak_price") * 100).alias("drawdown_from_peak_pct"),
        due("24h", nz("deepest_fall")).alias("max_drawdown_within_24h_pct"),
        due("60s", nz("buyers", 0)).alias("unique_buyers_next_60s"), due("60s", nz("sellers", 0)).alias("unique_sellers_next_60s"),
        due("300s", nz("durability")).alias("pump_durability_5min"),
        F.when(until("24h") <= as_of_ms, until("24h")).alias("labels_resolved_at"),
    )


def detect_rugs(trades: DataFrame, as_of_ms: int, fall: float = 0.85, quiet_ms: int = 600_000, chunk_ms: int = 3_600_000) -> DataFrame:
    """First time a token was 85% below its running peak and then silent for ten minutes (L3)."""
    rows = trades.filter("price_sol > 0").select("mint_address", "ts_ms", "trade_id", "price_sol").withColumn(
        "_chunk", F.floor(F.col("ts_ms") / chunk_ms).cast("long")
    )
    sums = rows.groupBy("mint_address", "_chunk").agg(F.max("price_sol").alias("hi"), F.min("ts_ms").alias("t0"))
    along = W.partitionBy("mint_address").orderBy("_chunk")
    carry = sums.select(
        "mint_address", "_chunk", F.max("hi").over(along.rowsBetween(W.unboundedPreceding, -1)).alias("_hi"), F.lead("t0").over(along).alias("_next")
    )
    inside = W.partitionBy("mint_address", "_chunk").orderBy("ts_ms", "trade_id")
    x = rows.join(carry, ["mint_address", "_chunk"]).select(
        "mint_address", "ts_ms", "price_sol",
        F.greatest(F.max("price_sol").over(inside.rowsBetween(W.unboundedPreceding, 0)), "_hi").alias("peak"),
        F.coalesce(F.lead("ts_ms").over(inside), "_next").alias("next_ms"),
    )
    silent = nz(F.col("next_ms"), as_of_ms) - F.col("ts_ms") > quiet_ms
    return x.filter(silent & (F.col("price_sol") <= (1 - fall) * F.col("peak"))).groupBy("mint_address").agg(
        (F.min("ts_ms") + quiet_ms).alias("rugged_ms")
    )


def migration_anchors(trades: DataFrame, mints: DataFrame) -> DataFrame:
    """Migrated tokens with their price at migration."""
    m = mints.filter("migrated = 1 AND migrated_ms IS NOT NULL").select("mint_address", F.col("migrated_ms").alias("anchor_ms"))
    last = (
        token_join(trades, m).filter(F.col("ts_ms") <= F.col("anchor_ms")).groupBy("mint_address")
        .agg(F.max(F.struct("ts_ms", "trade_id", "price_sol"))["price_sol"].alias("p"))
    )
    return m.join(last, "mint_address", "left").withColumn("price_at", F.create_map(F.lit(0), nz("p")))


def post_migration_labels(
    trades: DataFrame, mints: DataFrame, as_of_ms: int, horizons: dict[str, int] = POST_HORIZONS, usd_rate: float | None = None,
    pairs: DataFrame | None = None, chunk_ms: int = 900_000,
) -> DataFrame:
    """Labels per migrated token, anchored at the migration."""
    a = migration_anchors(trades, mints)
    x = (
        a.join(forward_windows(trades, a, [0], horizons, chunk_ms).drop("snapshot_age_sec"), "mint_address", "left")
        .join(mints.select("mint_address", "rugged_ms", "last_trade_ms"), "mint_address")
    )
    p, t0 = F.col("p"), F.col("anchor_ms")
    ok = p > 0
    until = lambda h: t0 + horizons[h] * 1000
    due = lambda h, c: F.when(until(h) <= as_of_ms, c)
    flag = lambda c: nz(c.cast("int"), 0)
    up = lambda h, k: due(h, flag(ok & (F.col(f"max_{h}") >= k * p)))
    down = lambda h, k: due(h, flag(ok & (F.col(f"min_{h}") <= k * p)))
    peak = lambda h: due(h, F.when(ok, nz((F.col(f"max_{h}") - p) / p)))
    alive = lambda h: due(h, flag((F.col("last_trade_ms") >= until(h)) & ~nz(F.col("rugged_ms") <= until(h), False)))
    cols = [
        "mint_address", due("24h", nz("max_24h") * SUPPLY).alias("post_mig_peak_mcap_sol"), peak("24h").alias("post_mig_peak_pct"),
        up("24h", 2).alias("post_mig_hits_2x"), up("24h", 5).alias("post_mig_hits_5x"), up("24h", 10).alias("post_mig_hits_10x"),
        due("1h", flag((F.col("rugged_ms") > t0) & (F.col("rugged_ms") <= until("1h")))).alias("post_mig_rugs_1h"),
        *[alive(h).alias(f"post_mig_alive_{h}") for h in ("1h", "4h", "24h", "72h")],
        *[peak(h).alias(f"post_mig_peak_pct_{h}") for h in ("30m", "1h", "4h", "24h")],
        up("4h", 2.30).alias("post_mig_hits_130pct_4h"), up("4h", 2.86).alias("post_mig_hits_186pct_4h"),
        up("30m", 1.5).alias("post_mig_hits_50pct_30m"), up("1h", 2.0).alias("post_mig_hits_100pct_1h"),
        up("24h", 30).alias("post_mig_hits_30x_24h"), up("24h", 100).alias("post_mig_hits_100x_24h"),
        down("5m", 0.5).alias("post_mig_drawdown_50_5min"), down("30m", 0.5).alias("post_mig_drawdown_50_30min"),
        down("5m", 0.7).alias("post_mig_drawdown_30_5min"),
        due("24h", (F.col("peak_ts_24h") - t0) / 60_000).alias("post_mig_time_to_peak_min"),
    ]
    if usd_rate is not None:
        cols += [
            due("24h", nz("vol_24h") * usd_rate).alias("post_mig_volume_24h_usd"),
            due("24h", flag(F.col("max_24h") * SUPPLY * usd_rate >= 1e6)).alias("post_mig_hits_1m_usd"),
        ]
    out = x.select(*cols, t0.alias("migrated_ms"))
    if pairs is not None:
        liq = pairs.groupBy("mint_address").agg(F.max("liquidity_usd").alias("post_mig_max_liquidity_usd"))
        out = out.join(liq, "mint_address", "left")
    return out


def migration_snapshots(
    trades: DataFrame, mints: DataFrame, wallets: DataFrame, ages_min: list[int] = MIGRATION_AGES_MIN, pairs: DataFrame | None = None,
    as_of_ms: int | None = None,
) -> DataFrame:
    """Feature rows at fixed ages after migration, with the token's state before it."""
    ages = [a * 60 for a in ages_min]
    a = migration_anchors(trades, mints)
    m = a.join(mints.select("mint_address", "created_ms", "creator_wallet", "name", "symbol", "twitter", "telegram", "website"), "mint_address")
    joined = token_join(trades, m.select("mint_address", "anchor_ms", "created_ms", "creator_wallet"))
    rel = F.col("ts_ms") - F.col("anchor_ms")
    after = joined.filter((rel > 0) & (rel <= max(ages) * 1000)).withColumn("bin", _bin_of(rel, ages)).withColumn(
        "secs", F.floor(rel / 1000).cast("long")
    )
    before = joined.filter(rel <= 0).withColumn("bin", F.lit(0)).withColumn("secs", F.floor((F.col("ts_ms") - F.col("created_ms")) / 1000).cast("long"))
    buy = F.col("is_buy") == 1
    win = after.groupBy("mint_address", "bin").agg(
        F.count(F.when(buy, 1)).alias("window_buys"), F.count(F.when(~buy, 1)).alias("window_sells"),
        F.max("price_sol").alias("hi"), F.max(F.struct("ts_ms", "trade_id", "price_sol")).alias("last"),
    )
    tags = wallets.select(F.col("address").alias("wallet"), "tracked", "is_kol")
    who = (
        after.filter(buy).select("mint_address", "bin", "wallet").distinct().join(tags, "wallet", "left").groupBy("mint_address", "bin")
        .agg(
            F.count(F.lit(1)).alias("window_unique_buyers"), F.count(F.when(F.col("tracked") == 1, 1)).alias("window_tracked_buyers"),
            F.count(F.when(F.col("is_kol") == 1, 1)).alias("window_kol_buyers"),
        )
    )
    state = over_ages(win, ages).groupBy(*KEY).agg(F.max("hi").alias("hi"), F.max("last")["price_sol"].alias("now"))
    at_age = F.get(_age_array(ages), F.col("bin")).alias("snapshot_age_sec")
    win = win.join(who, ["mint_address", "bin"], "left").select("mint_address", at_age, *[c for c in ("window_buys", "window_sells")], "window_unique_buyers", "window_tracked_buyers", "window_kol_buyers")
    pre = before.groupBy("mint_address").agg(
        F.count(F.lit(1)).alias("pre_mig_trade_count"), F.count(F.when(buy, 1)).alias("pre_mig_buy_count"),
        F.count(F.when(~buy, 1)).alias("pre_mig_sell_count"), F.max("market_cap_sol").alias("pre_mig_peak_mcap_sol"),
    ).withColumn(
        "pre_mig_buy_sell_ratio",
        F.when(F.col("pre_mig_sell_count") > 0, F.col("pre_mig_buy_count") / F.col("pre_mig_sell_count")).when(F.col("pre_mig_buy_count") > 0, 99.0).otherwise(0.0),
    )
    wal = labelled_buyers(before, wallets, [0]).select(
        "mint_address", F.col("tracked_buyers").alias("pre_mig_tracked_buyers"), F.col("kol_buyers").alias("pre_mig_kol_buyers"),
        F.col("bundle_buyers").alias("pre_mig_bundle_buyers"),
    )
    uniq = before.filter(buy).select("mint_address", "wallet").distinct().groupBy("mint_address").agg(F.count(F.lit(1)).alias("pre_mig_unique_buyers"))
    vol = path_features(before, [0]).select("mint_address", F.col("volatility_pct").alias("pre_mig_volatility_pct"))
    grid = m.withColumn("snapshot_age_sec", F.explode(_age_array(ages)))
    if as_of_ms is not None:
        grid = grid.filter(F.col("anchor_ms") + F.col("snapshot_age_sec") * 1000 <= as_of_ms)
    from launchlens.operators.creators import creator_history

    hist = creator_history(mints).select(
        "mint_address", F.col("creator_launch_count").alias("pre_mig_creator_launches"), F.col("creator_migrated_count").alias("pre_mig_creator_migrations")
    )
    x = grid.join(state, KEY, "left").join(win, KEY, "left")
    for d in (pre, wal, uniq, vol, hist):
        x = x.join(d, "mint_address", "left")
    now = F.coalesce("now", "p")
    ts = F.timestamp_millis(F.col("anchor_ms"))
    filled = lambda c: (F.length(nz(F.col(c), "")) > 0).cast("int").alias(f"has_{c}")
    counts = ["pre_mig_unique_buyers", "pre_mig_trade_count", "pre_mig_buy_count", "pre_mig_sell_count", "pre_mig_tracked_buyers", "pre_mig_kol_buyers", "pre_mig_bundle_buyers", "pre_mig_creator_launches", "pre_mig_creator_migrations"]
    windows = ["window_buys", "window_sells", "window_unique_buyers", "window_tracked_buyers", "window_kol_buyers"]
    out = x.select(
        "mint_address", F.col("anchor_ms").alias("migrated_ms"), F.expr("cast(snapshot_age_sec / 60 as int)").alias("snapshot_age_min"),
        (F.col("anchor_ms") + F.col("snapshot_age_sec") * 1000).alias("snapshot_ts"),
        (now * SUPPLY).alias("current_mcap_sol"), now.alias("current_price_sol"), *[nz(c, 0).alias(c) for c in windows],
        F.when(F.col("p") > 0, now / F.col("p") - 1).alias("pct_from_migration"),
        F.when(F.col("p") > 0, F.greatest(F.lit(0.0), nz("hi") / F.col("p") - 1)).alias("peak_pct_so_far"),
        ((F.col("anchor_ms") - F.col("created_ms")) / 60_000).alias("pre_mig_age_min"), "pre_mig_peak_mcap_sol", *[nz(c, 0).alias(c) for c in counts],
        nz("pre_mig_buy_sell_ratio").alias("pre_mig_buy_sell_ratio"), nz("pre_mig_volatility_pct").alias("pre_mig_volatility_pct"),
        F.lit(0).alias("pre_mig_sandwich_risk"), filled("twitter"), filled("telegram"), filled("website"),
        F.length(nz(F.col("name"), "")).alias("name_length"), F.length(nz(F.col("symbol"), "")).alias("symbol_length"),
        F.hour(ts).alias("migration_hour_utc"), (F.dayofweek(ts) - 1).alias("migration_dow"),
    )
    amm = ["liquidity_usd", "amm_volume_h1_usd", "amm_volume_h24_usd", "amm_buys_h24", "amm_sells_h24", "amm_price_change_h1", "amm_price_change_h24", "amm_initial_liquidity_usd"]
    if pairs is not None:
        have = [c for c in amm if c in pairs.columns]
        out = out.join(pairs.select("mint_address", *have), "mint_address", "left")
        amm = [c for c in amm if c not in have]
    return out.select("*", *[F.lit(None).cast("double").alias(c) for c in amm])
