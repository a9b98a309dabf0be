"""Track record of token creators, as known at launch or over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from launchlens.functions import asof_join, nz, totals_before

HOUR_MS = 3_600_000


def _without_creator(mints: DataFrame, **values: int) -> DataFrame:
    """Tokens whose creator is unknown, with fixed values."""
    return mints.filter(F.col("creator_wallet").isNull()).select("mint_address", *[F.lit(v).cast("long").alias(n) for n, v in values.items()])


def creator_history(mints: DataFrame) -> DataFrame:
    """Per token: launches and migrations of its creator strictly before its own launch (0 without a creator)."""
    known = mints.filter(F.col("creator_wallet").isNotNull())
    launched = known.select("creator_wallet", F.col("created_ms").alias("ms"), F.lit(1).alias("launches"), F.lit(0).alias("migrations"))
    moved = known.filter("migrated = 1").select(
        "creator_wallet", F.coalesce("migrated_ms", "created_ms").alias("ms"), F.lit(0).alias("launches"), F.lit(1).alias("migrations")
    )
    counted = totals_before(
        known.select("mint_address", "creator_wallet", "created_ms"), launched.unionByName(moved),
        ["creator_wallet"], "created_ms", "ms", ["launches", "migrations"],
    )
    none = _without_creator(mints, creator_launch_count=0, creator_migrated_count=0)
    return counted.select(
        "mint_address", F.col("launches").alias("creator_launch_count"), F.col("migrations").alias("creator_migrated_count")
    ).unionByName(none)


def creator_previous_launch(mints: DataFrame) -> DataFrame:
    """Whole seconds since the creator's previous distinct launch time; -1 for the first, or without a creator."""
    m = mints.filter(F.col("creator_wallet").isNotNull()).select("mint_address", "creator_wallet", "created_ms")
    prev = asof_join(
        m, m.select("creator_wallet", F.col("created_ms").alias("prev_ms")), ["creator_wallet"], "created_ms", "prev_ms",
        ["prev_ms"], chunk_ms=24 * HOUR_MS, strict=True,
    )
    since = F.floor((F.col("created_ms") - F.col("prev_ms")) / 1000)
    none = _without_creator(mints, seconds_since_prev_creator_death=-1)
    return prev.select("mint_address", F.coalesce(since, F.lit(-1)).cast("long").alias("seconds_since_prev_creator_death")).unionByName(none)


def creator_stats_unbounded(mints: DataFrame) -> DataFrame:
    """Online variant that looks at the whole table: other launches, all migrations, previous launch (0, 0, -1 without a creator)."""
    known = mints.filter(F.col("creator_wallet").isNotNull())
    total = known.groupBy("creator_wallet").agg(
        (F.count(F.lit(1)) - 1).alias("creator_launch_count"), F.sum("migrated").alias("creator_migrated_count")
    )
    return (
        known.select("mint_address", "creator_wallet").join(total, "creator_wallet")
        .drop("creator_wallet")
        .unionByName(_without_creator(mints, creator_launch_count=0, creator_migrated_count=0))
        .join(creator_previous_launch(mints), "mint_address")
    )


def creator_siblings(mints: DataFrame, radius_ms: int = HOUR_MS) -> DataFrame:
    """Other launches of the creator within +-radius, both ends included; 0 without a creator."""
    m = mints.filter(F.col("creator_wallet").isNotNull()).select("mint_address", "creator_wallet", "created_ms")
    edges = m.select(
        "mint_address", "creator_wallet",
        F.explode(
            F.array(
                F.struct((F.col("created_ms") - radius_ms).alias("at"), F.lit(-1).alias("sign")),
                F.struct((F.col("created_ms") + radius_ms + 1).alias("at"), F.lit(1).alias("sign")),
            )
        ).alias("e"),
    ).select("mint_address", "creator_wallet", "e.at", "e.sign")
    counted = totals_before(edges, m.withColumn("n", F.lit(1)), ["creator_wallet"], "at", "created_ms", ["n"])
    return counted.groupBy("mint_address").agg((F.sum(F.col("sign") * F.col("n")) - 1).alias("creator_recent_launch_siblings")).unionByName(
        _without_creator(mints, creator_recent_launch_siblings=0)
    )
