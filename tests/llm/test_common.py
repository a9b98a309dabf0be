import numpy as np

from launchlens.llm import toxicity
from launchlens.llm.common import discard, drop_rows, read, stored


def test_drop_rows_with_clashing_names_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (None, "c", 0), (2, "b", 0)], "doc_id long, _cell string, _dropped int")
    gone = spark.createDataFrame([(2,), (9,), (None,)], "_dropped long")
    got = drop_rows(df, "doc_id", gone, "_dropped")
    assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, df.filter("doc_id is null or doc_id <> 2").collect()))
    assert drop_rows(df, "doc_id", gone.limit(0), "_dropped").count() == 4 and drop_rows(df.limit(0), "doc_id", gone, "_dropped").count() == 0


def test_words_are_told_apart_by_all_their_bytes():
    parts = ["internationalisationA", "internationalisationB", "INTERNATIONALISATIONA", "x internationalisationA"]
    own = []
    for p in parts:
        f, owner = toxicity.features([p])
        grams = len(f) - len(p.split())
        own.append(set(f[grams:].tolist()))
        assert np.all(owner == 0)
    assert own[0] != own[1] and own[0] == own[2] and own[0] < own[3]
    # the same word has the same feature wherever it stands in a batch
    f, owner = toxicity.features(["one two", "three internationalisationA"])
    assert own[0] <= set(f[owner == 1].tolist())


def test_stored_leaves_no_shuffle_files_and_discard_takes_stored_tables_only(spark):
    known = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    df = spark.range(100).repartition(3, "id").groupBy("id").count()
    held = df.collect()
    before = {i for i in range(2000) if known.contains(i)}
    table = stored(df)
    assert {i for i in range(2000) if known.contains(i)} <= before
    assert sorted(table.collect()) == sorted(held) == sorted(df.collect())
    own = spark.range(4)
    discard(table, own, read(spark, "/root/testdata/sf0.001", "labels"))
    path = spark._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent()
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert own.count() == 4 and read(spark, "/root/testdata/sf0.001", "labels").count()
    discard(stored(spark.range(5)).limit(0))
