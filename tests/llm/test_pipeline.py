import hashlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from launchlens.llm import exact, jaccard, queries
from launchlens.llm.common import read

SF = "/root/testdata/sf0.001"


def test_stages_and_result_against_plain_decisions(spark):
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard", "decontamination", "bpe_encoding"]
    docs = read(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in queries.op4_quality(spark, SF).collect() if r.predicted == 1}
    largest = {}
    for i in sorted(good):
        largest[texts[i]] = i
    after_exact = set(largest.values())
    sets = {i: {tuple(w[j:j + 5]) for w in [texts[i].lower().split()] for j in range(max(1, len(w) - 4)) if w} for i in after_exact}
    group = {i: i for i in after_exact}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in sorted(after_exact):
        for b in sorted(after_exact):
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    leaks = {r.doc_id for r in queries.op8_decontamination(spark, SF).collect()}
    want = {i for i in after_exact if root(i) == i} - leaks
    got = {r.doc_id: r for r in pipeline.run(spark, SF).collect()}
    assert set(got) == want and 0 < len(want) < len(texts)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i in sorted(want)[:30]:
        ids = library.encode(texts[i], add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_stages_take_nulls_repeats_and_extra_columns(spark):
    docs = read(spark, SF, "documents").limit(20).withColumn("component_id", F.lit("mine")).withColumn("h", F.lit(1))
    odd = spark.createDataFrame([(None, None), (None, "a b c"), (5000, None), (5001, ""), (5002, "x y"), (5002, "x y")], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.count() <= docs.count()
        if k + 1 < len(pipeline.STAGES):
            assert out.columns == docs.columns
            assert stage(spark, docs.limit(0), SF).count() == 0
            docs = out
    assert exact.drop_copies(docs).count() and jaccard.ngram_components(docs).count() == docs.count()
