"""Exact deduplication on DataFrame functions alone.

Rows are grouped by the 128-bit MD5 of their text, combined in each task before the shuffle, so a text that a third of
all rows share costs one row per task. Only groups of two rows and more go on. Texts do not travel for the others: the
hash space has FILTER_CELLS cells, and the cells that hold a group of two or more are broadcast (at most FILTER_CELLS
numbers whatever the input). Inside groups the smallest and the largest text are compared byte by byte, combined per
task as well; a group in which they differ is a hash collision and is grouped anew by the text itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlens.llm.common import stored

FILTER_CELLS = 1 << 18


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("h", F.unhex(F.md5("text")))


def _cell(h: str = "h"):
    return F.pmod(F.xxhash64(h), F.lit(FILTER_CELLS))


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min"):
    """Stored tables (groups: h, keep_id, group_size of two rows and more; cells; collisions: h)."""
    best = {"min": F.min, "max": F.max}[keep]
    rows = _hashed(docs, id_col, text_col)
    groups = stored(
        rows.groupBy("h").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )
    cells = stored(groups.select(_cell().alias("cell")).distinct())
    collisions = stored(
        rows.join(F.broadcast(cells), _cell() == F.col("cell"), "left_semi")
        .groupBy("h").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
        .filter("lo <> hi").select("h")
    )
    return groups, cells, collisions


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the row with the smallest id
    stays (the largest with keep="max"); null ids stay only if the group has no other. Rows that repeat both id and
    text come out as often as they went in, all marked alike; `drop_copies` returns one of them. An empty table gives
    an empty result. Only the two named columns are read."""
    best = {"min": F.min, "max": F.max}[keep]
    groups, cells, collisions = content_groups(docs, id_col, text_col, keep)
    rows = _hashed(docs, id_col, text_col)
    ids = rows.select("doc_id", "h", F.unhex(F.sha2("text", 256)).alias("sha"))
    alone = ids.join(F.broadcast(cells), _cell() == F.col("cell"), "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha"
    )
    grouped = (
        ids.join(F.broadcast(cells), _cell() == F.col("cell"), "left_semi").join(groups, "h", "left")
        .join(collisions, "h", "left_anti")
        .select(
            "doc_id",
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).alias("group_size"), "sha",
        )
    )
    collided = rows.join(collisions, "h", "left_semi")
    classes = collided.groupBy("h", "text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    settled = collided.join(classes, ["h", "text"]).select(
        "doc_id", "keep_id", "group_size", F.unhex(F.sha2("text", 256)).alias("sha")
    )
    return alone.unionByName(grouped).unionByName(settled).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns; one row of each distinct text.

    Rows outside the broadcast cells have a text of their own and pass without a shuffle."""
    groups, cells, collisions = content_groups(docs, id_col, text_col, keep)
    names = docs.columns
    tagged = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                         F.col(id_col).alias("id")).withColumn("h", F.unhex(F.md5("text")))
    alone = tagged.join(F.broadcast(cells), _cell() == F.col("cell"), "left_anti")
    shared = tagged.join(F.broadcast(cells), _cell() == F.col("cell"), "left_semi")
    kept = (
        shared.join(groups, "h", "left").filter(F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id")))
        .join(collisions, "h", "left_anti").dropDuplicates(["h"]).select("row")
    )
    settled = (
        shared.join(collisions, "h", "left_semi").groupBy("h", "text")
        .agg(F.min_by("row", "id").alias("lo"), F.max_by("row", "id").alias("hi"), F.first("row").alias("any"))
        .select(F.coalesce("lo" if keep == "min" else "hi", "any").alias("row"))
    )
    return alone.select("row").unionByName(kept).unionByName(settled).select(*[F.col("row")[c].alias(c) for c in names])
