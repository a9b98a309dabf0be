import hashlib

import pytest
from pyspark.sql import functions as F

from launchlens.llm import exact

SCHEMA = "doc_id long, text string, kept string, h int"


def rows_of(spark, rows, keep="max"):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    return sorted(exact.exact_dedup(df, keep=keep).collect(), key=str), df


def test_groups_nulls_and_repeated_rows(spark):
    got, df = rows_of(spark, [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b" * 200_000), (None, "a"), (2, "a"), (6, "A")])
    keeps = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got if r.doc_id is not None)
    assert keeps == [(1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True), (3, 4, 2, False), (4, 4, 2, True),
                     (5, 5, 1, True), (6, 6, 1, True)]
    assert {r.text_sha256 for r in got if r.doc_id == 3} == {hashlib.sha256(b"").hexdigest()}
    kept = exact.drop_copies(df, keep="max").collect()
    assert sorted(r.doc_id for r in kept) == [2, 4, 5, 6] and kept[0].h == 7


def test_smallest_stays_and_empty_table(spark):
    got, df = rows_of(spark, [(1, "a"), (2, "a")], keep="min")
    assert [(r.doc_id, r.kept) for r in sorted(got)] == [(1, True), (2, False)]
    assert exact.exact_dedup(df.limit(0)).count() == 0 and exact.drop_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("keep", ["min", "max"])
def test_hash_collisions_are_told_apart_by_bytes(spark, monkeypatch, keep):
    # a hash that sends every text of the same length to one group
    def weak(docs, id_col, text_col):
        text = F.coalesce(F.col(text_col), F.lit(""))
        return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn(
            "h", F.unhex(F.md5(F.length("text").cast("string"))))

    monkeypatch.setattr(exact, "_hashed", weak)
    got, _ = rows_of(spark, [(1, "aa"), (2, "bb"), (3, "aa"), (4, "c"), (5, "bb"), (6, "dd")], keep)
    best = max if keep == "max" else min
    assert [(r.doc_id, r.keep_id, r.group_size) for r in sorted(got)] == [
        (1, best(1, 3), 2), (2, best(2, 5), 2), (3, best(1, 3), 2), (4, 4, 1), (5, best(2, 5), 2), (6, 6, 1)]


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a", "x", 1)], SCHEMA)
    plan = exact.exact_dedup(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
