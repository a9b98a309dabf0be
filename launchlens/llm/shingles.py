"""Word shingles as 64-bit numbers, computed over many texts at once in numpy."""

from __future__ import annotations

import numpy as np

from launchlens.llm.common import mix

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k word hashes in a row."""
    n = max(0, len(h) - k + 1)
    runs = np.zeros(n, np.uint64)
    for i in range(k):
        runs = runs * _STEP + h[i:n + i]
    return mix(runs)


class Words:
    """Hashes of the words of several texts: `hashes`, and `bounds` with the first word of each text (and the end).

    Words are runs of characters other than ASCII white space, with A-Z lowered. begin and end are byte offsets into
    the texts joined by a line feed."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.bytes = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        low = _LOWER[self.bytes]
        space = _SPACE[low]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.begin, self.end = edge[::2], edge[1::2]
        self.text_start = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
        self.bounds = np.searchsorted(self.begin, self.text_start)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[low] * _powers(_BASE, len(low)))])
        inverse = _powers(_INVERSE, len(low))
        size = (self.end - self.begin).astype(np.uint64)
        self.hashes = mix((sums[self.end] - sums[self.begin]) * inverse[self.begin] + size * _STEP)

    def shingles(self, k: int) -> list[np.ndarray]:
        """Sorted distinct k-word shingles of each text; with fewer words the whole sequence is one, without words none."""
        h = self.hashes
        runs = run_hashes(h, k)
        out = []
        for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(runs[a:b - k + 1]))
            elif b > a:
                x = np.array([b - a], np.uint64)
                for i in range(a, b):
                    x = mix(x * _STEP + h[i:i + 1])
                out.append(x)
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def set_keys(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of shingles, as two signed numbers."""
    with np.errstate(over="ignore"):
        a = mix(grams + np.uint64(0x1234567)).sum(dtype=np.uint64) if len(grams) else np.uint64(0)
        b = np.bitwise_xor.reduce(mix(grams ^ np.uint64(0x5DEECE66D))) if len(grams) else np.uint64(0)
    return int(a.view(np.int64)), int(b.view(np.int64))
