import re

import pytest

from launchlens.llm import contamination as c
from launchlens.llm import queries
from launchlens.llm.common import read

DOC = "doc_id long, text string, item_id string, cover int"
ITEM = "item_id long, text string, doc_id string"
ITEMS = [
    (0, "A train travels 120 km in 3 hours. If Alice Brown drives 120 km in 2 hours, how fast is she compared with the train?", "x"),
    (1, "The quick brown fox jumps over the lazy dog near the quiet river bank.", "x"), (2, "too short", "x"), (3, None, "x"), (4, "", "x"),
    (5, "12 34 56 78 90 12", "x"),
]


@pytest.fixture(scope="module")
def found(spark):
    filler = "some words that stand around here and mean nothing at all. "
    docs = [
        (1, filler + ITEMS[0][1] + filler), (2, filler + ITEMS[1][1].upper().replace(" ", "!! ")),
        (3, "A train travels 95 km in 5 hours. If Bob drives 95 km in 4 hours, how fast is he compared with the train? " + filler),
        (3 + 10, "A train travels 95 km in 5 hours. If Bob drives 95 km in 4 hours, how fast is she compared with the train?"),
        (14, "A train travels 95 km in 5 hours. If Bob drives 70 km in 4 hours, how fast is she compared with the train?"),
        (4, "The quick brown fox jumps over nothing. The lazy dog sleeps."), (5, None), (6, ""), (7, "Too short!"), (8, "much too short it is"),
        (9, filler * 3000 + ITEMS[1][1]), (10, filler), (10, filler), (None, ITEMS[1][1]), (11, "1 2 3 4 5 6"),
    ]
    docs = spark.createDataFrame([(*d, "s", 1) for d in docs], DOC)
    return docs, spark.createDataFrame(ITEMS, ITEM)


def test_verbatim_shouted_and_reparameterised(found):
    docs, items = found
    got = {(r.doc_id, r.item_id): r.changed for r in c.contaminated(docs, items).collect()}
    assert got == {(1, 0): False, (2, 1): False, (7, 2): False, (9, 1): False, (13, 0): True}
    kept = c.clean_documents(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [3, 14, 4, 5, 6, 8, 10, 10, None, 11]))


def test_empty_tables(found):
    docs, items = found
    assert c.contaminated(docs.limit(0), items).count() == 0 and c.contaminated(docs, items.limit(0)).count() == 0
    assert c.clean_documents(docs, items.limit(0)).count() == docs.count()


def test_query_against_plain_windows(spark):
    sf = "/root/testdata/sf0.001"

    def words(t):
        return [re.sub(r"[0-9]+([.,][0-9]+)*", "<n>", w) for w in re.findall(r"[^\W\d_]+|[0-9]+(?:[.,][0-9]+)*", (t or "").lower())]

    def windows(t):
        w = words(t)
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)] or [tuple(w)]

    items = {r.item_id: [w for w in windows(r.text) if sum(x != "<n>" for x in w) >= 2] for r in read(spark, sf, "benchmark").collect()}
    want = set()
    for d in read(spark, sf, "documents").collect():
        own = set(windows(d.text))
        want |= {(d.doc_id, i) for i, ws in items.items() if ws and sum(w in own for w in ws) >= 0.8 * len(ws)}
    assert {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, sf).collect()} == want and want
