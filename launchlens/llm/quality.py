"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every token hash has a fixed sparse ternary index vector. A token's word vector is the sum of the index vectors of its
neighbours over all documents, counted in each task and summed by Spark; the table has BUCKETS rows whatever the corpus.
A document is the mean of its tokens' word vectors, the mean product of adjacent index vectors (which shows repetition),
and the shares of token shapes. The network is trained on a bounded sample of labelled rows; its temperature is fitted
on a part of the sample that training has not seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlens.llm.common import cuts, map_texts, mix, release, sample_rows

#: Labelled rows the network is fitted on at most.
TRAIN_ROWS = 8000
BUCKETS = 1 << 13
WIDTH = 32
NONZERO = 4
HIDDEN = 24
EPOCHS = 60

_KIND = np.full(256, 3, np.uint8)  # symbols
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1  # letters
_KIND[[*range(48, 58)]] = 2  # digits
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
_STEP = 0x9E3779B97F4A7C15
SHAPES = 6  # lower, capitalised, upper case, digits, symbol, several symbols


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, shape, text) of each token: runs of letters, of digits, or of symbols."""
    raw = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    kind = _KIND[data]
    begin = np.flatnonzero((np.diff(kind, prepend=0) != 0) & (kind > 0))
    end = np.flatnonzero((np.diff(kind, append=0) != 0) & (kind > 0)) + 1
    n = len(data)
    power = np.full(n, _STEP, np.uint64)
    inverse = np.full(n, pow(_STEP, -1, 1 << 64), np.uint64)
    power[:1] = inverse[:1] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[data]] * np.cumprod(power))])
    bucket = (mix((sums[end] - sums[begin]) * np.cumprod(inverse)[begin]) >> np.uint64(51)).astype(np.int64)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    many, size = upper[end] - upper[begin], end - begin
    shape = np.select([kind[begin] == 2, (kind[begin] == 3) & (size == 1), kind[begin] == 3, (many > 1) & (many * 2 > size), many > 0],
                      [3, 4, 5, 2, 1], 0)
    starts = np.cumsum([0] + [len(r) for r in raw])
    return bucket, shape, np.searchsorted(starts, begin, side="right") - 1


def index_vectors() -> np.ndarray:
    """(BUCKETS, WIDTH) ternary, NONZERO entries in each row at most."""
    rng = np.random.default_rng(5)
    out = np.zeros((BUCKETS, WIDTH), np.int8)
    for _ in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, WIDTH, BUCKETS)] = rng.choice(np.array([-1, 1], np.int8), BUCKETS)
    return out


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(BUCKETS, WIDTH): sums of the index vectors of both neighbours over all documents, centred and scaled to length 1."""
    picked = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = [f"v{i}" for i in range(WIDTH)]

    def count(batches):
        index, total = index_vectors().astype(np.float32), np.zeros((BUCKETS, WIDTH))
        place = [np.nonzero(index[:, j])[0] for j in range(WIDTH)]
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for start, end in cuts(texts, 512, 1 << 21):
                bucket, _, doc = tokens(texts[start:end])
                pair = np.flatnonzero(doc[1:] == doc[:-1])
                a, b = bucket[pair], bucket[pair + 1]
                for j in range(WIDTH):  # only neighbours whose index vector has entry j
                    has = np.zeros(BUCKETS, np.float32)
                    has[place[j]] = index[place[j], j]
                    for x, y in ((a, b), (b, a)):
                        v = has[y]
                        k = np.flatnonzero(v)
                        total[:, j] += np.bincount(x[k], weights=v[k], minlength=BUCKETS)
        rows = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows)] + [pa.array(total[rows, j].astype(np.int64)) for j in range(WIDTH)],
                                         names=["bucket", *names])

    summed = picked.mapInArrow(count, "bucket long, " + ", ".join(f"{c} long" for c in names)).groupBy("bucket").agg(
        *[F.sum(c).alias(c) for c in names]).toPandas()
    out = np.zeros((BUCKETS, WIDTH))
    out[summed["bucket"].to_numpy(np.int64)] = summed[names].to_numpy(np.float64)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    out = np.divide(out, length, out=np.zeros_like(out), where=length > 0)
    out[length[:, 0] > 0] -= out[length[:, 0] > 0].mean(axis=0) if len(summed) else 0
    return out.astype(np.float32)


class Pooler:
    """Document vectors from word vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.index = vectors, index_vectors().astype(np.float32)

    def __call__(self, texts: list[str]) -> np.ndarray:
        bucket, shape, doc = tokens(texts)
        n = len(texts)
        out = np.zeros((n, 2 * WIDTH + SHAPES + 3), np.float32)
        count = np.bincount(doc, minlength=n)
        some = np.flatnonzero(count)
        if len(bucket):
            first = np.searchsorted(doc, some)
            out[some, :WIDTH] = np.add.reduceat(self.vectors[bucket], first, axis=0)
            same = np.concatenate([doc[1:] == doc[:-1], [False]])
            after = self.index[np.concatenate([bucket[1:], bucket[:1]])]
            out[some, WIDTH:2 * WIDTH] = np.add.reduceat(self.index[bucket] * after * same[:, None], first, axis=0)
            again = same & (np.concatenate([bucket[1:], bucket[:1]]) == bucket)
            out[:, 2 * WIDTH + SHAPES] = np.bincount(doc, weights=again, minlength=n)
            for s in range(SHAPES):
                out[:, 2 * WIDTH + s] = np.bincount(doc, weights=shape == s, minlength=n)
        out /= np.maximum(count, 1)[:, None]
        out[:, -2] = np.linalg.norm(out[:, :WIDTH], axis=1)
        out[:, -1] = np.log1p(count) / 10
        return out


class Network:
    """tanh layer, logistic output, divided by the temperature."""

    def __init__(self, width: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.temperature = np.zeros(width), np.ones(width), 1.0
        self.W1, self.b1 = rng.standard_normal((width, HIDDEN)) * width**-0.5, np.zeros(HIDDEN)
        self.W2, self.b2 = rng.standard_normal(HIDDEN) * HIDDEN**-0.5, np.zeros(1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.W1 + self.b1) @ self.W2 + self.b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Network:
    """Adam on cross-entropy with weight decay over four fifths of the rows, temperature on the last fifth."""
    net = Network(x.shape[1], seed)
    if not len(y) or y.min() == y.max():
        net.W2[:] = 0
        net.b2[0] = (4.0 if y[0] else -4.0) if len(y) else 0.0
        return net
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, own = order[:len(y) // 5], order[len(y) // 5:]
    net.mean, net.scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
    params = [net.W1, net.b1, net.W2, net.b2]
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    step, total = 0, EPOCHS * -(-len(own) // 128)
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(own), -(-len(own) // 128)):
            step += 1
            z = (x[rows] - net.mean) / net.scale
            h = np.tanh(z @ net.W1 + net.b1)
            d = (1 / (1 + np.exp(-np.clip(h @ net.W2 + net.b2[0], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(d, net.W2) * (1 - h * h)
            grads = [z.T @ back + 1e-4 * net.W1, back.sum(axis=0), h.T @ d + 1e-4 * net.W2, np.array([d.sum()])]
            rate = 0.005 * (1 - 0.95 * step / total)
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    if len(held) >= 20:
        z, t = net.logits(x[held]), y[held]
        grid = np.exp(np.linspace(-1, 2, 61))
        loss = [np.mean(np.logaddexp(0, z / g) - t * z / g) for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def _pooled(docs: DataFrame, vectors: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def worker():
        pool = Pooler(shared.value)
        return lambda texts: [list(pool(texts))]

    return map_texts(docs, id_col, text_col, worker, "x array<float>")


def train(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    """(word vectors of all documents, network of at most TRAIN_ROWS labelled rows where the condition learn holds)."""
    vectors = word_vectors(docs, text_col)
    marks = labels.filter(learn & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("mark"))
    picked = sample_rows(marks, id_col, TRAIN_ROWS)
    chosen = docs.select(id_col, text_col).join(F.broadcast(picked.select(id_col)), id_col, "left_semi")
    rows = _pooled(chosen, vectors, id_col, text_col).join(F.broadcast(picked), F.col("doc_id") == F.col(id_col) if id_col != "doc_id" else "doc_id")
    found = sorted(((list(r["x"]), int(r["mark"])) for r in rows.select("x", "mark").collect()))[:2 * TRAIN_ROWS]
    x = np.array([f for f, _ in found], np.float64).reshape(len(found), 2 * WIDTH + SHAPES + 3)
    return vectors, fit(x, np.array([m for _, m in found], np.float64))


def quality(docs: DataFrame, vectors: np.ndarray, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, the probability of good quality, one row per row of docs.

    Whole texts are scored; a null or empty one has the zero vector and gets that vector's score. Repeated rows are all
    scored; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def worker():
        pool, model = Pooler(shared.value[0]), shared.value[1]
        return lambda texts: [model.score(pool(texts).astype(np.float64))]

    return map_texts(docs, id_col, text_col, worker, "score double", chars_at_once=1 << 20)


def filter_documents(docs: DataFrame, vectors: np.ndarray, net: Network, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score at least `least`, with all their columns, in one pass and without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def keep(batches):
        pool, model = Pooler(shared.value[0]), shared.value[1]
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            good = [np.zeros(0, bool)]
            good += [model.score(pool(texts[a:b]).astype(np.float64)) >= least for a, b in cuts(texts, 512, 1 << 20)]
            yield batch.filter(pa.array(np.concatenate(good)))
        release()

    return docs.mapInArrow(keep, docs.schema)
