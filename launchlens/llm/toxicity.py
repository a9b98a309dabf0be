"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's score is logistic in hashed features: its words and the byte n-grams inside them, which also find inflected
and composed forms. A document is toxic if any sentence is: its probability is the noisy-or 1 - prod(1 - p) of all its
sentences. The weights are trained through the noisy-or from document labels; the sentences that carry the probability
are then known with their places.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlens.llm.common import map_texts, mix, sample_rows

#: Labelled rows the model is fitted on at most, and characters of a text that takes part.
TRAIN_ROWS = 12000
TRAIN_CHARS = 32768
BITS = 18
GRAM = 5
STEPS = 250
#: A feature takes part from this many toxic documents and share of its documents on.
LEAST_DOCS = 6
LEAST_SHARE = 0.5

#: Logit of a sentence without any feature of weight: it says nothing, however many of them a document has.
_NEVER = -60.0
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes inside a word: letters, digits and everything beyond ASCII; others count as one blank.
_LOWER[[b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]] = 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def sentences(text: str) -> list[tuple[int, int]]:
    """Places of sentences that hold more than white space, in characters."""
    return [m.span() for m in _SENTENCE.finditer(text) if not m[0].isspace()]


def features(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of many sentences: (feature, sentence) per occurrence."""
    raw = [b" " + p.encode("utf-8", "surrogatepass") + b" " for p in parts]
    low = _LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    owner = np.repeat(np.arange(len(raw), dtype=np.int32), [len(r) for r in raw])
    h = np.zeros(max(0, len(low) - GRAM + 1), np.uint64)
    code = _BYTE[low]
    for i in range(GRAM):
        h *= _STEP
        h += code[i:i + len(h)]
    blank = low == 32
    # n-grams may begin with the blank before a word, and hold no other blank
    breaks = np.concatenate([[0], np.cumsum(blank)])
    inside = breaks[GRAM:] == breaks[1:len(h) + 1]
    grams = (mix(h[inside]) >> np.uint64(64 - BITS)).astype(np.int32)
    edge = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=1))
    begin, end = edge[::2], edge[1::2]
    end = end[:len(begin)]
    begin = begin[:len(end)]
    # a word's own feature: all its bytes, from the differences of running sums
    power, inverse = np.full((2, len(low) + 1), np.uint64(1))
    power[1:], inverse[1:] = _STEP, _BACK
    power, inverse = np.cumprod(power), np.cumprod(inverse)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * power[:-1])])
    word = mix((sums[end] - sums[begin]) * inverse[begin]) >> np.uint64(64 - BITS)
    return np.concatenate([grams, word.astype(np.int32)]), np.concatenate([owner[:len(h)][inside], owner[begin]])


class Model:
    def __init__(self):
        self.w = np.zeros(1 << BITS, np.float32)
        self.b = np.float32(-2)

    def logits(self, parts: list[str]) -> np.ndarray:
        if not parts:
            return np.zeros(0)
        f, s = features(parts)
        known = self.w[f] != 0
        f, s = f[known], s[known]
        z = np.bincount(s, weights=self.w[f], minlength=len(parts)) + float(self.b)
        return np.where(np.bincount(s, minlength=len(parts)) > 0, z, _NEVER)


def _screened(texts: list[str], y: np.ndarray) -> np.ndarray:
    """Features that toxic documents hold clearly more often than others; the rest keeps weight zero."""
    toxic, every = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for a in range(0, len(texts), 64):
        f, doc = features(texts[a:a + 64])
        pairs = np.unique(doc.astype(np.int64) << BITS | f)
        f, doc = pairs & ((1 << BITS) - 1), pairs >> BITS
        np.add.at(every, f, 1)
        np.add.at(toxic, f, y[a + doc])
    return (toxic >= LEAST_DOCS) & (toxic >= LEAST_SHARE * every) & (toxic > 2 * y.mean() * every)


def fit(texts: list[str], labels: list[int], steps: int = STEPS) -> Model:
    """Gradient ascent on the noisy-or likelihood of all documents; deterministic."""
    model = Model()
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return model
    use = _screened(texts, y)
    held, at, counts = [], [], []
    for a in range(0, len(texts), 64):
        spans = [sentences(t) for t in texts[a:a + 64]]
        f, s = features([t[i:j] for t, p in zip(texts[a:a + 64], spans, strict=True) for i, j in p]) if any(spans) else (np.zeros(0, np.int32),) * 2
        held.append(f[use[f]])
        at.append(s[use[f]] + sum(counts))
        counts += [len(p) for p in spans]
    f, s, n = np.concatenate(held), np.concatenate(at), sum(counts)
    doc = np.repeat(np.arange(len(texts)), counts)
    some, s = np.unique(s, return_inverse=True)
    doc, n = doc[some], len(some)
    w, b = np.zeros(1 << BITS), float(model.b)
    m1, m2, c1, c2 = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.bincount(s, weights=w[f], minlength=n) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        total = np.bincount(doc, weights=np.logaddexp(0, z), minlength=len(texts))
        pull = np.where(y == 1, -np.exp(-total) / np.maximum(-np.expm1(-total), 1e-6), 1.0) / len(texts)
        dz = p * pull[doc]
        g = np.bincount(f, weights=dz[s], minlength=1 << BITS) + 1e-6 * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        c1, c2 = 0.9 * c1 + 0.1 * dz.sum(), 0.99 * c2 + 0.01 * dz.sum() ** 2
        rate = 0.1 * (1 - 0.9 * step / steps)
        w -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-7)
        b -= rate * (c1 / (1 - 0.9**step)) / (np.sqrt(c2 / (1 - 0.99**step)) + 1e-7)
    model.w, model.b = np.where(use, w, 0).astype(np.float32), np.float32(b)
    return model


def train(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled rows where the condition learn holds: at most TRAIN_ROWS, none longer than TRAIN_CHARS."""
    marks = labels.filter(learn & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("mark"))
    picked = sample_rows(marks.join(docs.filter(F.length(text_col) <= TRAIN_CHARS).select(id_col), id_col, "left_semi"), id_col, TRAIN_ROWS)
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(picked), id_col).filter(
        F.length("text") <= TRAIN_CHARS).select("text", "mark").collect()
    pairs = sorted((r["text"], int(r["mark"])) for r in rows)[:2 * TRAIN_ROWS]
    return fit([t for t, _ in pairs], [m for _, m in pairs])


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """doc_id, score, sentences (start, end, score of each sentence from `least` on), one row per row of docs.

    score is the noisy-or over all sentences of the whole text; a null, empty or blank text scores 0. Places are in
    characters, ends exclusive. Repeated rows are all scored; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def worker():
        net = shared.value

        def step(texts):
            places = [sentences(t) for t in texts]
            z = net.logits([t[a:e] for t, p in zip(texts, places, strict=True) for a, e in p])
            score, found, at = [], [], 0
            for spans in places:
                mine = z[at:at + len(spans)]
                at += len(spans)
                score.append(float(-np.expm1(-np.logaddexp(0, mine).sum())) if len(spans) else 0.0)
                p = 1 / (1 + np.exp(-np.clip(mine, -30, 30)))
                found.append([{"start": spans[i][0], "end": spans[i][1], "score": float(p[i])} for i in np.flatnonzero(p >= least)])
            return [score, found]
        return step

    return map_texts(docs, id_col, text_col, worker, "score double, sentences array<struct<start:int,end:int,score:double>>",
                     chars_at_once=1 << 20)
