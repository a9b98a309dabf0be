"""Training tables of some thousand rows are dealt over more than one task."""

from pyspark.sql import functions as F

from launchlens.models import boosting


def test_binned_rows_are_dealt(spark, tmp_path):
    df = spark.range(0, 20_000, 1, 8).select(F.col("id").alias("row_key"), (F.col("id") % 50).cast("double").alias("a"))
    path = str(tmp_path / "binned")
    table = boosting._binned(df, ["a"], [[10.0, 20.0]], [F.col("a")], "row_key", path)
    files = [f for f in table.inputFiles() if f.endswith(".parquet")]
    assert len(files) >= 4 and table.count() == 20_000
