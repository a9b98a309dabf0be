import random
import re

import pytest

from launchlens.llm import components, jaccard
from launchlens.llm.common import read

SCHEMA = "doc_id long, text string, n int, gram string"


def brute(rows, k, percent):
    sets, nodes, links = [], {}, []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
        nodes[i] = i
        links.append(0)

    def root(x):
        while nodes[x] != x:
            x = nodes[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if a and b and rows[x][0] is not None and rows[y][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                links[x] += 1
                links[y] += 1
                p, q = sorted((root(rows[x][0]), root(rows[y][0])))
                nodes[q] = p
    return sorted(((i, len(s), n, root(i)) for (i, _), s, n in zip(rows, sets, links)), key=str)


def result(spark, rows, k=4, percent=85):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in jaccard.ngram_components(df, k, percent).collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.choice([1, 3, 4, 9, 30, 90]))] for _ in range(8)]
    rows = []
    for i in range(n):
        t = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(t)))
    return rows


EDGE = [(900, None), (901, ""), (902, " \n"), (903, "A b C"), (904, "a B c"), (905, "a b c d"), (None, "a b c d"),
        (906, "é " * 5000 + "x"), (907, "É " * 5000 + "x"), (908, "é " * 5000 + "X")]


def test_against_all_pairs(spark):
    rows = corpus(1, 160) + EDGE
    assert result(spark, rows) == brute(rows, 4, 85)


@pytest.mark.parametrize("block", [3, 7])
def test_blocks_are_cut_without_loss(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    monkeypatch.setattr(jaccard, "COLUMNS", 16)
    rows = corpus(2, 120)
    assert result(spark, rows, 3, 80) == brute(rows, 3, 80)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "A b c d e f g h"), (3, "other words stand here now")]
    assert {(r[0], r[3]) for r in result(spark, rows)} == {(1, 1), (2, 1), (3, 3)} and len(result(spark, rows)) == 4
    assert result(spark, []) == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (None, 3), (7, 7)], "x long, y long")
    got = {r.node: r.component for r in components.components(edges, "x", "y").collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_query_against_all_pairs_on_documents(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in jaccard.ngram_components(docs, 4, 85).collect()), key=str)
    assert got == brute(rows, 4, 85)


def test_similar_sets_share_a_signature():
    import numpy as np

    rng = np.random.default_rng(3)
    for percent in (80, 85):
        schemes = jaccard.Schemes(percent)
        for _ in range(300):
            n = int(rng.integers(1, 120))
            base = rng.integers(0, 2**63, n).astype(np.uint64)
            other = np.concatenate([base[int(rng.integers(0, max(1, n // 7))):], rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)])
            a, b = set(base.tolist()), set(other.tolist())
            if 100 * len(a & b) >= percent * len(a | b):
                sig, at, _, need = jaccard.block_signatures(schemes, [np.unique(base), np.unique(other)])
                common = len(set(sig[at == 0].tolist()) & set(sig[at == 1].tolist()))
                assert common and all(min(need[at == i]) <= common for i in (0, 1))


@pytest.mark.parametrize("percent", [80, 99])
def test_nodes_travel_in_48_bits_and_lose_no_partner(spark, percent):
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words[:n] + [tail]) for n in (2900, 400, 60) for tail in ("a", "b")]
    texts += [" ".join(f"{i}x{j}" for j in range(200)) for i in range(3)] + ["", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got = {r.node for r in jaccard._nodes_with_partners(docs, 5, percent).collect()}
    assert all(0 <= node < 1 << 48 for node in got)
    kept = {node & (1 << 40) - 1 for node in got}
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) for t in texts]
    for i, a in enumerate(sets):
        if any(j != i and a and 100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets)):
            assert i in kept
    assert not {6, 7, 8, 9} & kept


@pytest.mark.parametrize("rows_a_part", [2, 5])
def test_parts_and_rounds_lose_nothing(spark, monkeypatch, rows_a_part):
    monkeypatch.setattr(jaccard, "PART_ROWS", rows_a_part)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 3)
    monkeypatch.setattr(jaccard, "ROUND_GRAMS", 1)
    rows = corpus(5, 60)
    assert result(spark, rows, 3, 80) == brute(rows, 3, 80)


def test_a_large_group_is_not_copied_for_each_of_its_parts(spark, monkeypatch, tmp_path):
    given, whole = str(tmp_path / "rows"), jaccard._product

    def counted(rows, percent):
        with open(given, "a") as f:
            f.write(f"{len(rows)}\n")
        return whole(rows, percent)

    monkeypatch.setattr(jaccard, "_product", counted)
    base = " ".join(f"w{i}" for i in range(60))
    got = result(spark, [(i, f"{base} end{i}") for i in range(2600)])
    assert [r[2:] for r in got] == [(2599, 0)] * 2600
    assert sum(map(int, open(given))) <= 3 * 2600  # at most once in each size class
