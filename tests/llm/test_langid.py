import numpy as np

from launchlens.llm import langid, queries
from launchlens.llm.common import read


def test_gradients_match_differences():
    net = langid.Network(["a", "b", "c"], hidden=4)
    x = np.array([[65, 200, 48], [97, 256, 50], [99, 256, 256]], np.int16)
    target = np.array([0, 2, 1])
    _, grad = net.gradients(x, target)
    for name, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        sides = []
        for e in (1e-2, -2e-2):
            net.p[name][at] += e
            sides.append(net.gradients(x, target)[0])
        net.p[name][at] += 1e-2
        assert abs((sides[0] - sides[1]) / 2e-2 - g[at]) < 1e-3 + 0.02 * abs(g[at]), name


def test_windows_cover_whole_texts():
    raw = [b"abc", b"", b"x" * (langid.WINDOW + 1)]
    grid, owner = langid.windows(raw)
    assert owner.tolist() == [0, 2, 2]
    assert b"".join(bytes(r[r != langid.PAD].astype(np.uint8)) for r in grid) == b"".join(raw)


def test_edges(spark):
    net = langid.fit(["the thing and that", "der die das und", "the and", "und die"] * 20, ["en", "de", "en", "de"] * 20, steps=60)
    df = spark.createDataFrame([(1, None, "en", 0), (2, "", "en", 0), (3, "12 ²! \n", "en", 0), (4, "the and the thing " * 9000, None, 0),
                                (4, "und die", "en", 0), (None, "und das", "en", 0)], "doc_id long, text string, lang_pred string, score int")
    got = sorted((str(r.doc_id), r.lang_pred, 0 <= r.score <= 1) for r in langid.identify(df, net).collect())
    assert got == [("1", "und", True), ("2", "und", True), ("3", "und", True), ("4", "de", True), ("4", "en", True), ("None", "de", True)]
    assert langid.identify(df.limit(0), net).count() == 0
    assert langid.fit([], []).languages == ["und"]
    # a document's probabilities are the mean over its letters, whatever stands beside it
    alone = langid.probabilities(net, ["und die " * 40])
    assert np.allclose(alone, langid.probabilities(net, ["x", "und die " * 40, ""])[1], atol=1e-5)


def test_held_out_accuracy(spark):
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(
        read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 150 and np.mean([r.lang_pred == r.lang for r in got]) > 0.97


def test_empty_and_unlabelled_tables(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "the and", None), (2, None, None)], "doc_id long, text string, lang string")
    net = langid.train(df, F.lit(True))
    assert [r.lang_pred for r in langid.identify(df, net).orderBy("doc_id").collect()] == ["und", "und"]
    empty = df.limit(0)
    assert langid.identify(empty, langid.train(empty, F.lit(True))).count() == 0
