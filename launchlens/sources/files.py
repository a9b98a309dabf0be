"""Readers and writers of the trade archive and the derived tables."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

DAY_MS = 86_400_000


def day_start_ms(day: str) -> int:
    """Milliseconds of the start of a UTC day given as YYYY-MM-DD."""
    return (date.fromisoformat(day) - date(1970, 1, 1)).days * DAY_MS


def on_day(df: DataFrame, day: str, ts: str = "ts_ms") -> DataFrame:
    start = day_start_ms(day)
    return df.filter((F.col(ts) >= start) & (F.col(ts) < start + DAY_MS))


def read_trades(spark: SparkSession, path: str, day: str | None = None, ts: str = "ts_ms") -> DataFrame:
    """Trade table, optionally one UTC day. A `day` partition column prunes whole directories."""
    df = spark.read.parquet(path)
    if day is None:
        return df
    if "day" in df.columns:
        df = df.filter(F.col("day") == day)
    return on_day(df, day, ts) if ts in df.columns else df


def archive_day(trades: DataFrame, day: str, out: str, ts: str = "ts_ms") -> DataFrame:
    """Write one UTC day as compressed Parquet under out/day=YYYY-MM-DD; one row of what was written.

    An empty day writes nothing and reports zero rows.
    """
    spark = trades.sparkSession
    rows = on_day(trades, day, ts)
    schema = "rows long, min_ms long, max_ms long, files long, bytes long"
    if rows.isEmpty():
        return spark.createDataFrame([(0, None, None, 0, 0)], schema)
    target = f"{out.rstrip('/')}/day={day}"
    rows.write.mode("overwrite").option("compression", "zstd").parquet(target)
    back = spark.read.parquet(target)
    files = (
        back.select("_metadata.file_path", "_metadata.file_size").distinct()
        .agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"))
    )
    return back.agg(
        F.count(F.lit(1)).alias("rows"), F.min(ts).alias("min_ms"), F.max(ts).alias("max_ms")
    ).select("*", F.lit(files.select(F.struct("files", "bytes")).scalar()).alias("_f")).select("rows", "min_ms", "max_ms", "_f.*")


def write_predictions(scored: DataFrame, targets: list[str], ts: str = "ts_ms") -> DataFrame:
    """Wide scores to the tall prediction log, without NULL and NaN."""
    tall = scored.unpivot([ts, "mint_address"], targets, "target", "prob")
    return tall.filter(F.col("prob").isNotNull() & ~F.isnan("prob"))


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Full rebuild of a derived table; the source must not be read from `path` itself."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def folder_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def work_dir(spark: SparkSession, name: str) -> str:
    """Folder for written tables: inside spark.checkpoint.dir, which all executors reach; a temporary one in local mode only."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    leaf = f"{name}-{uuid.uuid4().hex}"
    if root:
        return f"{root.rstrip('/')}/{leaf}"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.mkdtemp(prefix='launchlens-')}/{leaf}"
