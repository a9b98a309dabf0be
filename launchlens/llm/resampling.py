"""Importance resampling towards a target: hashed n-gram weights, Gumbel draws, ranks by a distributed radix sort.

Feature counts of source and target are arrays of `buckets` numbers, counted per task and summed by Spark; the gains made
of them are one broadcast array that scores each document. Ranks come from a least-significant-digit radix sort over the
composite key (score down, id up): every pass counts digits per block of the present order, turns the counts into global
offsets, and gives each row its destination, which is its place in the next order. The last destinations are the ranks.
No row passes the driver and no block is larger than BLOCK rows, whatever the keys are.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from launchlens.llm.common import map_texts, stored

BUCKETS = 10_000
#: Rows of a block and bits of a digit of the radix sort.
BLOCK, BITS = 1 << 18, 11
#: Words whose bucket a task remembers.
REMEMBERED = 1 << 17

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # the letters A-Z are lower-cased before


class Buckets:
    """Buckets of all runs of 1 to `longest` words of a text."""

    def __init__(self, longest: int, buckets: int):
        self.longest, self.buckets, self.known = longest, buckets, {}

    def __call__(self, text: str) -> tuple[np.ndarray, int]:
        """(bucket of each feature, number of words)."""
        words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower())
        features = list(words)
        for n in range(2, self.longest + 1):
            features += [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for f in set(features).difference(known):
            known[f] = zlib.crc32(f) % self.buckets
        return np.fromiter(map(known.__getitem__, features), np.int64, len(features)), len(words)


def feature_counts(docs: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of features per bucket over all rows; an array of `buckets` numbers whatever the input."""
    picked = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches):
        of, total = Buckets(longest, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(of(text.as_py())[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in picked.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # at most `buckets` rows
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares), per bucket."""
    k = len(source)
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1) -> DataFrame:
    """doc_id, n_features, n_words and weight, the floored mean gain of the features (0 without any); one row per row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def worker():
        table = shared.value
        of = Buckets(longest, len(table))

        def step(texts):
            found = [of(t) for t in texts]
            size = np.array([len(b) for b, _ in found], np.int64)
            total = np.array([int(table[b].sum()) for b, _ in found], np.int64)
            return [size, np.array([n for _, n in found], np.int64), total // np.maximum(size, 1)]

        return step

    return map_texts(docs, id_col, text_col, worker, "n_features long, n_words long, weight long")


def draw_score(weight: Column, id_: Column, seed: int) -> Column:
    """weight plus 1000 times a Gumbel draw made of the id and the seed, floored; a null id counts as empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


# ---------------------------------------------------------------------------------------------------------------------
# Radix sort


def _digits(value: Column, greatest: int, bits: int) -> list[Column]:
    """Digits of unsigned numbers up to greatest, lowest first."""
    return [F.shiftrightunsigned(value, bits * d).bitwiseAND((1 << bits) - 1) for d in range(-(-greatest.bit_length() // bits))]


def radix_order(rows: DataFrame, keys: list[tuple[str, bool]], position: str = "position", block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """rows plus `position`, 0, 1, 2 ... in the order of the integer columns `keys` (name, descending), most important first.

    Nulls come last. Rows with equal keys get neighbouring positions in any order. A key's least and greatest value settle
    how many digits it needs; its digits are the differences to the first value of its order."""
    rows = rows.select("*", *[F.col(name).cast("long").alias(f"_k{i}") for i, (name, _) in enumerate(keys)])
    # ids of rows lie in one write, so they are settled for all passes
    rows = stored(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_block", F.expr(f"_at div {block}")))
    ends = rows.agg(*[f(f"_k{i}").alias(f"{n}{i}") for i in range(len(keys)) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    passes = []
    for i in reversed(range(len(keys))):
        lo, hi, down, value = ends[f"lo{i}"], ends[f"hi{i}"], keys[i][1], F.col(f"_k{i}")
        if lo is None:
            continue
        if hi - lo < 1 << 62:
            away = F.coalesce((F.lit(hi) - value) if down else (value - F.lit(lo)), F.lit(hi - lo + 1))
            passes += _digits(away, hi - lo + 1, bits)
        else:  # the whole range of a long: its bits with the sign turned, then nulls
            turned = value.bitwiseXOR(F.lit((1 << 63) - 1 if down else -(1 << 63)))
            passes += _digits(F.coalesce(turned, F.lit(0).cast("long")), (1 << 64) - 1, bits) + [value.isNull().cast("long")]
    names = [c for c in rows.columns if c not in ("_at", "_block", "_digit")]
    for digit in passes:
        rows = rows.withColumn("_digit", digit)
        counts = rows.groupBy("_block", "_digit").agg(F.count(F.lit(1)).alias("n"))
        # offsets: all smaller digits, then the same digit in earlier blocks
        per_digit = counts.groupBy("_digit").agg(F.sum("n").alias("n"))  # at most 2^bits rows
        smaller = per_digit.select("_digit", (F.sum("n").over(W.orderBy("_digit")) - F.col("n")).alias("_smaller"))
        earlier = counts.select("_block", "_digit", (F.sum("n").over(W.partitionBy("_digit").orderBy("_block")) - F.col("n")).alias("_earlier"))
        offsets = earlier.join(F.broadcast(smaller), "_digit").select("_block", "_digit", (F.col("_smaller") + F.col("_earlier")).alias("_offset"))
        inside = F.row_number().over(W.partitionBy("_block", "_digit").orderBy("_at")) - 1
        placed = rows.withColumn("_inside", inside).join(offsets, ["_block", "_digit"])
        rows = stored(placed.select(*names, (F.col("_offset") + F.col("_inside")).alias("_at")).withColumn("_block", F.expr(f"_at div {block}")))
    out = rows.drop(*[f"_k{i}" for i in range(len(keys))], "_block")
    if not passes:  # no row, or nothing but nulls: any order is right
        counts = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("n"))
        offsets = counts.select("_block", (F.sum("n").over(W.orderBy("_block")) - F.col("n")).alias("_offset"))
        ranked = rows.withColumn("_inside", F.row_number().over(W.partitionBy("_block").orderBy("_at")) - 1).join(offsets, "_block")
        return ranked.withColumn(position, F.col("_inside") + F.col("_offset")).select(*[c for c in out.columns if c != "_at"], position)
    return out.withColumnRenamed("_at", position)


def resample(docs: DataFrame, target: DataFrame, seed: int = 2024, percent: int = 10, least_words: int = 20, longest: int = 1,
             buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank; one row per row of docs.

    Of the N rows with at least least_words words, the floor(percent * N / 100) highest scores are drawn and ranked from
    1; ties go to the smaller id, null ids come after all others, and rows that agree in both share out their ranks in
    any order. A null or empty text has no feature, weight 0 and is not drawn (least_words > 0). With an empty target the
    gains are those of a uniform one. Whole texts are read; other columns are not."""
    gain = gains(feature_counts(docs, text_col, longest, buckets), feature_counts(target, target_col, longest, buckets))
    scored = stored(weigh(docs, gain, id_col, text_col, longest).withColumn("score", draw_score(F.col("weight"), F.col("doc_id"), seed)))
    able = scored.filter(F.col("n_words") >= least_words).drop("n_words")
    drawn = percent * able.count() // 100
    ranked = radix_order(able, [("score", True), ("doc_id", False)])
    rank = F.when(F.col("position") < drawn, F.col("position") + 1)
    rest = scored.filter(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank")).unionByName(rest)
