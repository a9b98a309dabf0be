"""Language identification with a bidirectional gated recurrent network over bytes.

Texts are cut into windows of WINDOW bytes; in each, a forward and a backward recurrent state are kept per position, and
every position that holds a letter gets a probability for each language. A document's probabilities are the mean over
its letters, over the whole text. The network is trained on the driver by backpropagation through time on a sample of
bounded size; it is applied on the executors, to many windows at once.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlens.llm.common import map_texts, sample_rows

#: Learning rows and bytes that the network is fitted on at most.
TRAIN_ROWS = 4096
WINDOW = 64
HIDDEN = 12
STEPS = 700
BATCH = 192
PAD = 256
UNKNOWN = "und"

_LETTER_BYTE = np.zeros(257, bool)
_LETTER_BYTE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Network:
    """Input tables E (byte -> gate inputs), recurrent weights U and W per direction, and the output layer."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p["E" + d] = draw(257, 3 * hidden, scale=0.3)
            self.p["U" + d] = draw(hidden, 2 * hidden, scale=hidden**-0.5)
            self.p["W" + d] = draw(hidden, hidden, scale=hidden**-0.5)
        self.p["V"] = draw(2 * hidden, len(languages), scale=0.3)
        self.p["c"] = np.zeros(len(languages), np.float32)

    def scan(self, d: str, x: np.ndarray, keep: np.ndarray, tape: list | None = None) -> np.ndarray:
        """States (time, rows, hidden) of one direction; x is (time, rows) of byte values."""
        E, U, W, n = self.p["E" + d], self.p["U" + d], self.p["W" + d], self.hidden
        h = np.zeros((x.shape[1], n), np.float32)
        out = np.empty((*x.shape, n), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g = E.take(x[t], axis=0)
            gates = h @ U
            gates += g[:, :2 * n]
            _sigmoid(gates)
            z, r = gates[:, :n], gates[:, n:]
            rh = r * h
            c = rh @ W
            c += g[:, 2 * n:]
            np.tanh(c, out=c)
            if tape is not None:
                tape.append((t, h, z, r, rh, c))
            step = c - h
            step *= z
            h = h + step
            h *= keep[t][:, None]
            out[t] = h
        return out

    def positions(self, x: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """Probability of each language at each position: (time, rows, languages)."""
        V, n = self.p["V"], self.hidden
        y = self.scan("f", x, keep) @ V[:n]
        y += self.scan("b", x, keep) @ V[n:]
        y += self.p["c"]
        y -= y.max(axis=-1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=-1, keepdims=True)
        return y

    def gradients(self, x: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over letters of (time, rows) bytes with a language per row, and its gradients."""
        keep = (x != PAD).astype(np.float32)
        tapes = {"f": [], "b": []}
        h = {d: self.scan(d, x, keep, tapes[d]) for d in "fb"}
        n, V = self.hidden, self.p["V"]
        y = h["f"] @ V[:n] + h["b"] @ V[n:] + self.p["c"]
        y = np.exp(y - y.max(axis=-1, keepdims=True))
        y /= y.sum(axis=-1, keepdims=True)
        weight = _LETTER_BYTE[x].astype(np.float32)
        weight /= max(1.0, weight.sum())
        loss = -float((np.log(np.take_along_axis(y, target[None, :, None], -1)[..., 0] + 1e-9) * weight).sum())
        dy = y
        np.put_along_axis(dy, np.broadcast_to(target[None, :, None], (*x.shape, 1)), np.take_along_axis(dy, np.broadcast_to(target[None, :, None], (*x.shape, 1)), -1) - 1, -1)
        dy *= weight[..., None]
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        flat = dy.reshape(-1, dy.shape[-1])
        grad["c"] = flat.sum(axis=0)
        for k, d in enumerate("fb"):
            grad["V"][k * n:(k + 1) * n] = h[d].reshape(-1, n).T @ flat
            into = dy @ V[k * n:(k + 1) * n].T
            U, W = self.p["U" + d], self.p["W" + d]
            carry = np.zeros_like(into[0])
            for t, before, z, r, rh, c in reversed(tapes[d]):
                dh = (into[t] + carry) * keep[t][:, None]
                dc = dh * z * (1 - c * c)
                drh = dc @ W.T
                dzr = np.concatenate([dh * (c - before) * z * (1 - z), drh * before * r * (1 - r)], axis=1)
                carry = dh * (1 - z) + drh * r + dzr @ U.T
                grad["W" + d] += rh.T @ dc
                grad["U" + d] += before.T @ dzr
                one = np.zeros((len(x[t]), 257), np.float32)
                one[np.arange(len(x[t])), x[t]] = 1
                grad["E" + d] += one.T @ np.concatenate([dzr, dc], axis=1)
        return loss, grad


def windows(raw: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts cut into rows of size, padded with PAD; and the text of each row."""
    counts = np.array([-(-len(r) // size) for r in raw], np.int64)
    grid = np.full(int(counts.sum()) * size, PAD, np.int16)
    at = 0
    for r, c in zip(raw, counts.tolist(), strict=True):
        grid[at:at + len(r)] = np.frombuffer(r, np.uint8)
        at += c * size
    return grid.reshape(-1, size), np.repeat(np.arange(len(raw)), counts)


def fit(texts: list[str], languages: list[str], steps: int = STEPS, seed: int = 7) -> Network:
    """Train on windows of the texts; the same input always gives the same network."""
    names = sorted(set(languages)) or [UNKNOWN]
    net = Network(names, seed=seed)
    grid, owner = windows([t.encode("utf-8", "surrogatepass") for t in texts])
    labels = np.array([names.index(lang) for lang in languages], np.int64)[owner] if len(owner) else np.zeros(0, np.int64)
    useful = np.flatnonzero(_LETTER_BYTE[grid].any(axis=1))
    if not len(useful) or len(names) < 2:
        return net
    rng = np.random.default_rng(seed)
    by_language = [useful[labels[useful] == k] for k in range(len(names))]
    by_language = [rows for rows in by_language if len(rows)]
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        share = BATCH // len(by_language) + 1
        rows = np.concatenate([rng.choice(r, share) for r in by_language])
        _, grad = net.gradients(np.ascontiguousarray(grid[rows].T), labels[rows])
        rate = 0.02 * min(1, step / 30) * (1 - 0.9 * step / steps)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        for k, g in grad.items():
            g = g / max(1.0, norm)
            m1[k] += 0.1 * (g - m1[k])
            m2[k] += 0.01 * (g * g - m2[k])
            net.p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)
    return net


def probabilities(net: Network, texts: list[str], at_once: int = 4096) -> np.ndarray:
    """(texts, languages): the mean over all letter positions; zeros for a text without letters."""
    grid, owner = windows([t.encode("utf-8", "surrogatepass") for t in texts])
    total = np.zeros((len(texts), len(net.languages)))
    letters = np.zeros(len(texts))
    for a in range(0, len(grid), at_once):
        x = np.ascontiguousarray(grid[a:a + at_once].T)
        y = net.positions(x, (x != PAD).astype(np.float32))
        mask = _LETTER_BYTE[x]
        y *= mask[..., None]
        rows = owner[a:a + at_once]
        np.add.at(total, rows, y.sum(axis=0))
        np.add.at(letters, rows, mask.sum(axis=0))
    return total / np.maximum(letters, 1)[:, None]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, re.findall(r"[^\W\d_]", text[:256]))) or any(
        m[0].isalpha() for m in re.finditer(r"[^\W\d_]", text))


def train(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Network:
    """Fit on rows of docs where the condition learn holds: at most `rows` of them, 256 characters from a place in each
    that the id decides."""
    length = F.length(text_col)
    place = F.pmod(F.xxhash64(F.col(id_col)), F.greatest(length - 256, F.lit(1))) + 1
    picked = sample_rows(
        docs.filter(learn & F.col(lang_col).isNotNull() & (length > 0)).select(
            id_col, F.substring(F.col(text_col), place.cast("int"), F.lit(256)).alias("text"), F.col(lang_col).alias("lang")),
        id_col, rows).select("text", "lang").collect()
    pairs = sorted((r["text"], r["lang"]) for r in picked)
    return fit([t for t, _ in pairs], [lang for _, lang in pairs])


def identify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, one row per row of docs: the likeliest language of the whole text and its probability.

    A null text or one without a letter is `und` with score 0; equal probabilities give the first name in order.
    Repeated rows are all labelled, other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def worker():
        model = shared.value

        def step(texts):
            p = probabilities(model, texts)
            best = p.argmax(axis=1)
            known = [has_letter(t) for t in texts]
            return [[model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)],
                    [min(1.0, float(s)) if k else 0.0 for s, k in zip(p.max(axis=1), known, strict=True)]]
        return step

    return map_texts(docs, id_col, text_col, worker, "lang_pred string, score double", chars_at_once=1 << 20)
