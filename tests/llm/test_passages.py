import random
import re
from collections import defaultdict

import numpy as np

from launchlens.llm import passages as p
from launchlens.llm import queries
from launchlens.llm.common import read

SCHEMA = "doc_id long, text string, start string, cluster int"


def prose(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randrange(3000)) + rng.choice(["", "", "", ".", ","]) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_planted_passages_are_found_and_clean_documents_left(spark):
    rng = random.Random(5)
    shared = [prose(rng, 51) for _ in range(6)]
    rows, holds = [], defaultdict(set)
    for i in range(80):
        w = prose(rng, rng.choice([20, 90, 300]))
        if i < 40:
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() for x in shared[i % 6]] if i % 4 == 0 else shared[i % 6]
            holds[i % 6].add(i)
        rows.append((i, rng.choice([" ", "\n"]).join(w)))
    near = prose(rng, 120)
    rows += [(100, " ".join(near)), (101, " ".join(near[:70] + ["changed"] + near[71:]))]
    rows += [(110, None), (111, ""), (112, "spam " * 400), (113, "spam " * 300), (114, rows[79][1]), (114, rows[79][1]), (None, rows[79][1])]
    got = p.repeated_passages(frame(spark, rows)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert set(by) == set(range(40)) | {79, 100, 101, 114}
    texts = dict(rows)
    for j, docs in holds.items():
        for d in docs:
            assert {r.cluster for r in by[d]} == {min(docs)} and all(r.kept == (d == min(docs)) for r in by[d])
            for r in by[d]:
                piece = texts[d][r.start:r.end].lower().split()
                inside = set(" ".join(shared[j]).lower().split())
                assert len(piece) >= p.WINDOW and sum(w in inside for w in piece) >= 0.8 * len(piece)
    assert sum(r.end - r.start for r in by[101]) > 0.8 * len(texts[101])


def test_empty_and_plain_tables(spark):
    assert p.repeated_passages(frame(spark, [])).count() == 0
    assert p.repeated_passages(frame(spark, [(1, "a b c"), (2, "a b c"), (3, None)])).count() == 0


def test_sliding_minimum():
    x = np.random.default_rng(0).integers(0, 1000, 200).astype(np.uint64)
    for width in (1, 2, 5, 18, 28):
        assert p._sliding_min(x, width).tolist() == [x[i:i + width].min() for i in range(len(x) - width + 1)]


def test_query_covers_every_exact_repeat(spark):
    """Every run of WINDOW + ANCHOR_SPAN words that two documents share is touched by a span of each."""
    sf = "/root/testdata/sf0.001"
    n = p.WINDOW + p.ANCHOR_SPAN
    where, texts = defaultdict(set), {}
    for r in read(spark, sf, "documents").collect():
        texts[r.doc_id] = r.text
        words = [(m[0].lower() if m[0].isascii() else re.sub("[A-Z]", lambda c: c[0].lower(), m[0]), m.span())
                 for m in re.finditer(r"[^\x20\x09-\x0D]+", r.text)]
        for i in range(len(words) - n + 1):
            run = tuple(w for w, _ in words[i:i + n])
            if len({run[k:k + 5] for k in range(n - 4)}) >= n // 2:
                where[run].add((r.doc_id, words[i][1][0], words[i + n - 1][1][1]))
    spans = defaultdict(list)
    for r in queries.op7_passages(spark, sf).collect():
        spans[r.doc_id].append((r.start, r.end))
        assert 0 <= r.start < r.end <= len(texts[r.doc_id])
    repeated = [v for v in where.values() if len({d for d, _, _ in v}) > 1]
    assert repeated and all(any(a < e and s < b for a, b in spans[d]) for v in repeated for d, s, e in v)


def spread(texts):
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_recall_at_the_working_threshold():
    """Share of pairs at 0.8 that a band brings together, against all pairs that are similar by brute force."""
    rng = random.Random(11)
    texts = []
    for _ in range(400):
        base = prose(rng, 49)
        texts += [base, base[:24] + ["other"] + base[25:]]
    cut = p.Passages([" ".join(t) for t in texts])
    sets = [{tuple(t[i:i + 5]) for i in range(45)} for t in texts]
    near = [i for i in range(0, 800, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    whole = [s[-800:] for s in cut.signatures]  # the passages of whole texts come last
    hit = [any(s[i] == s[i + 1] for s in whole) for i in near]
    print("recall", sum(hit) / len(hit))
    assert len(near) == 400 and cut.text[-800:].tolist() == list(range(800)) and sum(hit) >= 0.95 * len(hit)


def test_all_passages_of_a_bucket_are_compared(spark, monkeypatch):
    """Variants of two texts in one bucket, each variant similar to its text alone."""
    rng = np.random.default_rng(3)
    x, y = (rng.integers(0, 1 << 60, 45) for _ in range(2))
    sets, want = [], {}
    for k in range(8):
        for name, base in (("x", x), ("y", y)):
            row = base.copy()
            if k != 5:  # the text itself stands between its variants
                row[5 * k:5 * k + 5] = rng.integers(0, 1 << 60, 5)
            want[len(sets)] = name
            sets.append((len(sets), np.sort(row).tolist()))
    buckets = spark.createDataFrame([(s, k) for s in (1, 2) for k, _ in sets], "sig long, key long")
    frame_ = spark.createDataFrame(sets, "key long, shingles array<long>")
    for block in (1024, 8):
        monkeypatch.setattr(p, "BLOCK", block)
        labels = {r.node: r.component for r in p.components(p._links_inside(buckets, frame_), "a", "b").collect()}
        assert labels == {k: 0 if n == "x" else 1 for k, n in want.items()}


def test_variants_around_a_text_and_short_repeats(spark):
    rng = random.Random(2)
    base = prose(rng, 49)
    changed = [base[:k] + [f"new{k}"] + base[k + 1:] for k in (8, 14, 20, 26, 32, 38)]
    short = prose(rng, 7)
    got = p.repeated_passages(frame(spark, spread(changed[:3] + [base] + changed[3:] + [short, short, prose(rng, 7)]))).collect()
    assert {(r.doc_id, r.cluster) for r in got} == {(i, 0) for i in range(7)} | {(7, 7), (8, 7)}


def test_every_place_of_a_passage_is_found(spark):
    """The passage stands twice in one document, its partner is in another partition."""
    rng = random.Random(8)
    shared = prose(rng, 60)
    twice = prose(rng, 100) + shared + prose(rng, 100) + shared + prose(rng, 100)
    rows = [(1, " ".join(prose(rng, 50) + shared)), (2, " ".join(twice))]
    for parts in (1, 2):
        docs = spark.createDataFrame(spark.sparkContext.parallelize([(*r, "x", 1) for r in rows], parts), SCHEMA)
        assert docs.rdd.getNumPartitions() == parts
        got = [r for r in p.repeated_passages(docs).collect() if r.doc_id == 2]
        assert len(got) == 2 and all(r.cluster == 1 and not r.kept for r in got)
        for r in got:
            assert set(rows[1][1][r.start:r.end].split()) <= set(shared)


def test_signature_rows_have_one_document(spark):
    shared, own = " ".join(f"s{i}" for i in range(60)), [" ".join(f"o{d}x{i}" for i in range(60)) for d in range(6)]
    rows = [(4, shared), (2, shared), (9, shared), (7, own[0]), (7, own[0]), (8, own[1])]
    for parts in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        found = p._colliding(docs, "doc_id", "text")
        assert {r.key for r in found.collect()} == set(p.Passages([shared]).key.tolist())
        assert not any(r.several for r in found.collect())
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"MapInArrow.*\bhi#", plan)


def test_places_of_passages():
    text = "  Ä " + " ".join(f"s{i}" for i in range(28)) + " \n"
    start, end = p.Passages(["", text, "é b"], 0).places()
    assert [(int(a), int(b)) for a, b in zip(start, end)] == [(2, len(text) - 2)]


def test_colliding_passages_stand_once_per_signature(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    docs = spark.createDataFrame([(i, shared) for i in range(12)], "doc_id long, text string").repartition(3)
    found = [(r.sig, r.key) for r in p._colliding(docs, "doc_id", "text").collect()]
    assert len(found) == len(set(found)) == p.BANDS * len(set(p.Passages([shared]).key.tolist()))


def test_sets_of_asked_passages(spark):
    """Sets of asked passages against sets of their texts alone; an id may have several rows, and texts."""
    rng = random.Random(4)
    shared = prose(rng, 60)
    rows = [(1, " ".join(prose(rng, 70) + shared)), (1, " ".join(shared + prose(rng, 9))), (2, " ".join(prose(rng, 300))), (3, "a b c d e f g"), (3, None)]
    rows.append(rows[2])
    docs = frame(spark, rows)
    cut, want = p.Passages([t or "" for _, t in rows]), {}
    for i, (key, text) in enumerate(zip(cut.key.tolist(), cut.text.tolist(), strict=True)):
        first = cut.first[i] - cut._words.bounds[text]
        piece = " ".join((rows[text][1]).split()[first:first + cut.last[i] - cut.first[i] + 1])
        want[key, rows[text][0]] = sorted(p.Words([piece]).shingles(p.SHINGLE)[0].view(np.int64).tolist())
    asked = spark.createDataFrame(list(want) + [(5, 1)], "key long, doc long")
    sets = p._sets(docs, asked, "doc_id", "text")
    got = [(r.key, r.shingles) for r in sets.collect()]
    assert len(got) == len({k for k, _ in want}) and dict(got) == {k: v for (k, _), v in want.items()}


def test_stars_join_what_is_similar_within_a_group():
    rng = np.random.default_rng(9)
    base = rng.integers(-(1 << 62), 1 << 62, 400)
    group, sets = [], []
    for g in range(60):
        for _ in range(rng.integers(1, p.SMALL + 1)):
            group.append(g)
            sets.append(np.unique(base[40 * rng.integers(0, 2):][:30][rng.random(30) < 0.95]))
    group, sizes = np.array(group), np.array([len(x) for x in sets])
    a, b = p._stars(group, sizes, np.concatenate(sets))
    root = np.arange(len(sets))
    root[b] = a
    for g in range(60):
        own = np.flatnonzero(group == g)
        linked, want = p._similar(sizes[own], np.concatenate([sets[i] for i in own])), np.arange(len(own))
        for i, j in p._forest(linked):
            want[want == want[j]] = want[i]
        assert all((root[own[i]] == root[own[j]]) == (want[i] == want[j]) for i in range(len(own)) for j in range(len(own)))


def test_groups_may_span_batches(spark):
    rng = np.random.default_rng(1)
    x = np.sort(rng.integers(0, 1 << 60, 20)).tolist()
    sets = spark.createDataFrame([(k, x) for k in range(70)], "key long, shingles array<long>")
    buckets = spark.createDataFrame([(s, k) for s, n in ((1, 5), (2, 70), (3, 33)) for k in range(n)], "sig long, key long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        labels = {r.node: r.component for r in p.components(p._links_inside(buckets, sets), "a", "b").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert labels == {k: 0 for k in range(70)}


def test_spans_that_overlap_or_touch_become_one(spark):
    rng = random.Random(6)
    a, b = prose(rng, 55), prose(rng, 55)
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a + b)), (4, " ".join(a + prose(rng, 80) + b))]
    got = sorted((r.doc_id, r.start, r.end, r.cluster, r.kept) for r in p.repeated_passages(frame(spark, rows)).collect())
    for (d, _, end, _, _), (e, start, _, _, _) in zip(got, got[1:]):
        assert d != e or end < start
    assert {r[0] for r in got} == {1, 2, 3, 4} and all(r[4] == (r[0] < 3) for r in got if r[3] == r[0] or r[0] > 3)


def test_anchors_are_the_minima_of_spans_inside_a_text():
    rng = random.Random(13)
    texts = [prose(rng, n) for n in (3, 21, 22, 49, 50, 51, 200)] + [["w"] * 60 + prose(rng, 40)]
    cut = p.Passages([" ".join(t) for t in texts], 0)
    got = {(t, int(f - cut._words.bounds[t])) for t, f in zip(cut.text.tolist(), cut.first)}
    runs, want = p.run_hashes(cut._words.hashes, p.SHINGLE), set()
    for t, words in enumerate(texts):
        own = runs[cut._words.bounds[t]:][:max(0, len(words) - p.SHINGLE + 1)]
        for i in range(len(own) - p.ANCHOR_SPAN + 1):
            least = own[i:i + p.ANCHOR_SPAN].min()
            want |= {(t, i + int(k)) for k in np.flatnonzero(own[i:i + p.ANCHOR_SPAN] == least) if i + k + p.WINDOW <= len(words)}
        if p.SHINGLE <= len(words) < p.WINDOW + p.ANCHOR_SPAN:
            want.add((t, 0))
    rich = {(t, k) for t, k in want if len(texts[t]) < p.WINDOW or len({tuple(texts[t][j:j + p.SHINGLE]) for j in range(k, k + p.WINDOW - p.SHINGLE + 1)}) > 1}
    assert got == rich and len(got) > 20


def test_minima_at_places():
    x = np.random.default_rng(2).integers(0, 1000, 90).astype(np.uint64)
    for width in (1, 2, 5, 18, 28, 32):
        at = np.array([0, 7, 90 - width, 30])
        assert p._min_at(x, width, at).tolist() == [x[i:i + width].min() for i in at]
    assert len(p._min_at(x[:3], 28, np.zeros(0, np.int64))) == 0


def test_keys_of_shared_signatures():
    rng = np.random.default_rng(7)
    sig, key, doc = rng.integers(-9, 60, 400), rng.integers(-4, 5, 400), rng.integers(0, 4, 400)
    sig = np.concatenate([sig, np.arange(1000, 1300), [5000, 5000, 6000, 6000]])
    key = np.concatenate([key, np.arange(300), [1, 2, 1, 1]])
    doc = np.concatenate([doc, np.zeros(300, int), [3, 3, 2, 1]])
    groups = defaultdict(lambda: defaultdict(set))
    for s, k, d in zip(sig.tolist(), key.tolist(), doc.tolist()):
        groups[s][k].add(d)
    want = []
    for s in sorted(groups):
        keys = sorted(groups[s])
        if len(set().union(*groups[s].values())) > 1:
            want += [(s, k, min(groups[s][k]), keys[0], keys[max(0, i - 1)]) for i, k in enumerate(keys)]
    got = list(zip(*(x.tolist() for x in p._shared(sig, key, doc)), strict=True))
    assert got == want and (6000, 1, 1, 1, 1) in got and all(r[0] != 5000 for r in got)
    assert [len(x) for x in p._shared(*(np.zeros(0, np.int64),) * 3)] == [0] * 5


def test_signature_rows_are_grouped_without_a_window_or_members(spark):
    """Rows of signatures are sorted and told apart in arrays; each key comes with its smallest document, of any type of id."""
    rng = random.Random(3)
    shared, near = prose(rng, 49), prose(rng, 49)
    rows = [("b", shared), ("c", shared), ("a9", shared), ("d", near), ("d", near), ("a", near[:30] + ["x"] + near[31:])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id string, text string").repartition(3)
    found = p._colliding(docs, "doc_id", "text")
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.key: (r.doc, r.several) for r in found.collect()}
    key = p.Passages([" ".join(shared), " ".join(near)], 0).key.tolist()
    assert got[key[0]] == ("a9", False) and got[key[-1]] == ("d", True)
    spans = {(r.doc_id, r.cluster, r.kept) for r in p.repeated_passages(docs).collect()}
    assert spans == {("a9", "a9", True), ("b", "a9", False), ("c", "a9", False), ("a", "a", True), ("d", "a", False)}


def test_links_join_components(spark):
    labels = spark.createDataFrame([(k, 10) for k in (10, 11, 12)] + [(20, 20), (21, 20), (30, 30), (31, 30)], "node long, component long")
    links = spark.createDataFrame([(12, 21), (21, 12), (12, 21), (5, 31), (40, 41), (30, 31)], "a long, b long")
    got = sorted((r.node, r.component) for r in p._joined(labels, links).collect())
    assert got == [(5, 5)] + [(k, 10) for k in (10, 11, 12, 20, 21)] + [(30, 5), (31, 5), (40, 40), (41, 40)]
    assert p._joined(labels, links.limit(0)).count() == 7


def test_component_rounds_against_a_search(spark):
    rng = random.Random(21)
    edges = [(i, i + 1) for i in range(300, 340)] + [(a, rng.randrange(120)) for a in (rng.randrange(120) for _ in range(70))] + [(500, 501 + i) for i in range(50)]
    edges += [(None, 3), (4, None), (7, 7), (501, 500)]
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for root in sorted(near):
        todo = [root]
        while todo:
            if (k := todo.pop()) not in want:
                want[k] = root
                todo += near[k]
    got = p.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
