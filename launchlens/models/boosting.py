"""Gradient-boosted histogram trees, many targets in shared passes over one binned table.

Bin edges come from one quantile sketch of all features. Rows are binned once and stored as bytes; bin 0 is a missing
value. A pass reads that table once and adds up gradients per (target, node, feature, bin) in numpy, per task, for all
targets and all nodes of a level; the sums of one target and node meet in one place, where its best split is sought. The
driver sees one row per target and node. Per-task sums are whole numbers (GRAIN to the unit), so their order and the rerun
of a lost task change nothing.

Every split learns on which side missing values go; a split may also part missing from present values. Losses: logistic,
squared (on the standardised label) and Poisson (log link). Targets stop when the rows that only watch, one in ten by the
hash of their key, have not improved for `patience` rounds; the trees after the best round are cut off.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from launchlens.sources.files import drop_folder, work_dir

GRAIN = float(1 << 24)
#: Rounds after which the margins of the rows are written, so that a pass applies no more trees than that.
KEEP_MARGINS = 8
#: A table is written in no more files than that many rows each ask for; some thousand rows of many features and targets fill a task.
ROWS_PER_TASK = 4_096


@dataclass(frozen=True)
class Settings:
    iters: int = 40
    rate: float = 0.1
    depth: int = 4
    l2: float = 0.5
    bins: int = 64
    least_rows: int = 20
    patience: int = 8
    accuracy: float = 0.002  # of the quantile sketch


@dataclass
class Tree:
    """A whole binary tree: inner nodes in level order (feature -1: everything goes left), leaves with their values."""

    feature: list[int]
    bin: list[int]
    missing_left: list[bool]
    leaf: list[float]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = descend(x, np.array(self.feature), np.array(self.bin), np.array(self.missing_left), int(math.log2(len(self.leaf))))
        return np.array(self.leaf)[at]


def descend(x: np.ndarray, feature: np.ndarray, bin_: np.ndarray, missing_left: np.ndarray, levels: int) -> np.ndarray:
    """Place of each row of bins among the nodes of a level."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for level in range(levels):
        inner = node + (1 << level) - 1
        f = feature[inner]
        b = x[rows, np.maximum(f, 0)]
        left = np.where(b == 0, missing_left[inner], b <= bin_[inner]) | (f < 0)
        node = 2 * node + ~left
    return node


@dataclass
class Booster:
    """Trees of one target. `margin` is on the scale of the loss, `predict` on that of the label."""

    loss: str
    base: float
    scale: float
    trees: list[Tree] = field(default_factory=list)
    gains: dict[str, float] = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.leaves(x)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        if self.loss == "logistic":
            return 1 / (1 + np.exp(-np.clip(m, -40, 40)))
        return np.exp(np.clip(m, -40, 40)) if self.loss == "poisson" else m * self.scale

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(d: dict) -> Booster:
        return Booster(**{**d, "trees": [Tree(**t) for t in d["trees"]]})


def value(c: str) -> Column:
    """A feature as a double, NaN taken as missing."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def bin_edges(df: DataFrame, features: list[str], settings: Settings = Settings()) -> list[list[float]]:
    """Ascending upper edges per feature from one quantile sketch; a feature without values has none."""
    shares = [i / settings.bins for i in range(1, settings.bins)]
    rows = df.select(*[value(c).alias(f"f{i}") for i, c in enumerate(features)])
    found = rows.approxQuantile([f"f{i}" for i in range(len(features))], [0.0, *shares, 1.0], settings.accuracy) if features else []
    # the greatest value needs no edge of its own
    return [sorted(set(q) - {q[-1]}) if q else [] for q in found]


def to_bins(values: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Rows of doubles as rows of bins: 0 for nan, 1 up to the first edge, and so on."""
    out = np.zeros(values.shape, np.uint8)
    for i, e in enumerate(edges):
        v = values[:, i]
        out[:, i] = np.where(np.isnan(v), 0, np.searchsorted(np.array(e), v, side="left") + 1)
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow column of equally long lists of doubles as rows; null is nan."""
    flat = column.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def _binned(df: DataFrame, features: list[str], edges: list[list[float]], labels: list[Column], key: str, path: str) -> DataFrame:
    """Stored rows: x (bytes of bins), y (labels, null where a row takes no part), f (margins so far), watch."""
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = to_bins(matrix(b.column(0), width), edges) if width else np.zeros((b.num_rows, 0), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column(1), b.column(2)], names=["x", "y", "watch"])

    watch = F.pmod(F.xxhash64(key), F.lit(10)) == 0
    few = max(1, -(-df.count() // ROWS_PER_TASK))
    rows = df.select(F.array(*[value(c) for c in features]).cast("array<double>").alias("v"), F.array(*labels).cast("array<double>").alias("y"), watch.alias("watch"))
    rows.mapInArrow(run, "x binary, y array<double>, watch boolean").withColumn("f", F.array().cast("array<double>")).coalesce(few).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _arrays(b: pa.RecordBatch, width: int, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bins, labels, watch, margins) of a batch (x, y, watch, f)."""
    x = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, width)
    y = matrix(b.column(1), len(base))
    f = matrix(b.column(3), len(base)) if len(b.column(3).flatten()) else np.tile(base, (b.num_rows, 1))
    return x, y, np.asarray(b.column(2).to_numpy(zero_copy_only=False), bool), f


def _gradients(loss: str, y: np.ndarray, f: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second derivatives and the loss, on a scale where labels are of the size of 1."""
    if loss == "logistic":
        p = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
        return p - y, np.maximum(p * (1 - p), 1e-6), np.logaddexp(0, f) - y * f
    if loss == "poisson":
        e = np.exp(np.clip(f, -40, 40))
        return (e - y) / scale, np.maximum(e / scale, 1e-6), (e - y * f) / scale
    d = f - y / scale
    return d, np.ones_like(d), d * d / 2


FOUND = "slot int, gain double, feature int, bin int, missing_left boolean, gl double, hl double, gr double, hr double, g double, h double, n double"


def _pass(table: DataFrame, state: dict, level: int, bins: int, settings: Settings) -> tuple[dict, dict]:
    """({(target, node): its best split and sums}, {target: watched loss}) of one level.

    Each task sends one block of sums per target and node; the blocks of a node are added up one by one where its split is sought."""
    shared = table.sparkSession.sparkContext.broadcast(state)
    width, targets, nodes = state["width"], len(state["base"]), 1 << level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        cells = nodes * width * bins
        sums = {t: np.zeros((3, cells)) for t in s["active"]}
        loss = {t: np.zeros(2) for t in s["active"]}
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                x, y, watch, f = _arrays(whole.slice(start, 4096), width, s["base"])
                place = np.arange(width) * bins + x  # (row, feature)
                for t in s["active"]:
                    margin = f[:, t] + sum((tree.leaves(x) for tree in s["trees"][t]), np.zeros(len(x)))
                    g, h, lost = _gradients(s["loss"][t], y[:, t], margin, s["scale"][t])
                    seen = ~np.isnan(y[:, t])
                    if level == 0:
                        loss[t] += lost[seen & watch].sum(), (seen & watch).sum()
                    own = np.flatnonzero(seen & ~watch)
                    node = descend(x[own], *s["growing"][t], level)
                    at = (node[:, None] * (width * bins) + place[own]).ravel()
                    for k, w in enumerate((g[own], h[own])):
                        sums[t][k] += np.bincount(at, np.repeat(w, width), cells)
                    sums[t][2] += np.bincount(at, minlength=cells)
        whole_numbers = lambda a: np.rint(a * np.array([GRAIN, GRAIN, 1.0]).reshape(-1, *[1] * (a.ndim - 1))).astype(np.int64)
        for t in s["active"]:
            blocks = whole_numbers(sums[t].reshape(3, nodes, width * bins))
            some = [i for i in range(nodes) if blocks[2, i].any()]
            slots, parts = [t * nodes + i for i in some], [blocks[:, i].tobytes() for i in some]
            if level == 0:
                slots, parts = [*slots, -1 - t], [*parts, whole_numbers(np.array([loss[t][0], 0.0, loss[t][1]])).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(parts, pa.binary())], names=["slot", "part"])

    def search(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch.column("part"):
                block = np.frombuffer(part.as_buffer(), np.int64)
                total = block.copy() if total is None else total + block
        slot = key[0].as_py()
        sums = total.reshape(3, -1) / np.array([[GRAIN], [GRAIN], [1.0]])
        if slot < 0:
            row = (slot, 0.0, -1, 0, False, 0.0, 0.0, 0.0, 0.0, sums[0, 0], 0.0, sums[2, 0])
        else:
            g, h, n = sums.reshape(3, width, bins)
            split = best_split(g, h, n, settings)
            gain, f, b, missing_left, left, right = split or (0.0, -1, 0, False, (0.0, 0.0), (0.0, 0.0))
            row = (slot, gain, f, b, missing_left, *left, *right, g[0].sum(), h[0].sum(), n[0].sum())
        yield pa.RecordBatch.from_pylist([dict(zip(shape.names, row, strict=True))], schema=shape)

    kinds = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    shape = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in FOUND.split(", ")])
    rows = table.select("x", "y", "watch", "f").mapInArrow(run, "slot int, part binary").groupBy("slot").applyInArrow(search, FOUND).collect()
    shared.destroy()
    found = {divmod(r["slot"], nodes): r for r in rows if r["slot"] >= 0}  # one row per target and node
    return found, {-1 - r["slot"]: r["g"] / r["n"] for r in rows if r["slot"] < 0 and r["n"]}


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, s: Settings):
    """(gain, feature, bin, missing_left, (g, h) left, (g, h) right) of one node from its (feature, bin) sums, or None."""
    G, H, N = g[0].sum(), h[0].sum(), n[0].sum()
    best = None
    for missing_left in (False, True):
        gl, hl, nl = (np.cumsum(a[:, 1:], axis=1) + (a[:, :1] if missing_left else 0) for a in (g, h, n))
        gain = gl**2 / (hl + s.l2) + (G - gl) ** 2 / (H - hl + s.l2) - G**2 / (H + s.l2)
        gain[(nl < s.least_rows) | (N - nl < s.least_rows)] = -1
        at = int(np.argmax(gain))
        f, b = divmod(at, gain.shape[1])
        if gain[f, b] > 1e-7 and (best is None or gain[f, b] > best[0] + 1e-12):
            best = (float(gain[f, b]), f, b + 1, missing_left, (gl[f, b], hl[f, b]), (G - gl[f, b], H - hl[f, b]))
    return best


def fit(df: DataFrame, features: list[str], labels: dict[str, tuple[str, Column]], key: str, settings: Settings = Settings(), edges: list[list[float]] | None = None):
    """(edges, {name: Booster}) for labels {name: (loss, column)}; a row takes part where the column is not null.

    Every name needs at least one row, and there must be a feature. `key` names a column that tells rows apart."""
    spark, s = df.sparkSession, settings
    edges = bin_edges(df, features, s) if edges is None else edges
    names, width, bins = list(labels), len(features), s.bins + 2
    paths = [work_dir(spark, "binned")]
    table = _binned(df, features, edges, [c for _, c in labels.values()], key, paths[0])
    y = [F.col("y")[i] for i in range(len(names))]
    own = table.filter(~F.col("watch")).agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(y) for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop))]).first()
    out, state = {}, {"width": width, "base": [], "scale": [], "loss": [], "trees": [[] for _ in names], "active": list(range(len(names)))}
    for i, name in enumerate(names):
        loss, mean = labels[name][0], own[f"m{i}"] or 0.0
        if loss == "logistic":
            scale, base = 1.0, math.log((mean + 1e-6) / (1 - mean + 1e-6))
        elif loss == "poisson":
            scale = max(mean, 1e-6)
            base = math.log(scale)
        else:
            scale = (own[f"s{i}"] or 0.0) or 1.0
            base = mean / scale
        out[name] = Booster(loss, base, scale)
        for k, v in (("base", base), ("scale", scale), ("loss", loss)):
            state[k].append(v)
    state["base"] = np.array(state["base"])
    best = {}
    for round_ in range(s.iters + 1):
        nodes = (1 << s.depth) - 1
        grown = {t: (np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes, bool)) for t in state["active"]}
        leaf = {t: np.zeros(1 << s.depth) for t in state["active"]}
        for level in range(s.depth):
            sought, watched = _pass(table, state | {"growing": grown}, level, bins, s)
            if level == 0:
                for t in list(state["active"]):
                    lost = watched.get(t, -float(round_))  # without rows that watch, all rounds count
                    if t not in best or lost < best[t][0] - 1e-7:
                        best[t] = (lost, round_)
                    if round_ - best[t][1] >= s.patience or round_ == s.iters:
                        state["active"].remove(t)
                if not state["active"]:
                    break
            split = False
            for t in state["active"]:
                for node in range(1 << level):
                    if level and grown[t][0][((1 << level) - 1 + node - 1) // 2] < 0:
                        continue  # its parent was not split
                    r = sought.get((t, node))
                    if r is None:
                        continue
                    first = node << (s.depth - level)  # leftmost leaf below the node
                    if r["feature"] < 0:
                        if level == 0:
                            leaf[t][first] = -s.rate * r["g"] / (r["h"] + s.l2)
                        continue
                    inner = (1 << level) - 1 + node
                    for a, v in zip(grown[t], (r["feature"], r["bin"], r["missing_left"]), strict=True):
                        a[inner] = v
                    for side, (sg, sh) in enumerate(((r["gl"], r["hl"]), (r["gr"], r["hr"]))):
                        leaf[t][first + side * (1 << (s.depth - level - 1))] = -s.rate * sg / (sh + s.l2)
                    gains = out[names[t]].gains
                    gains[features[r["feature"]]] = gains.get(features[r["feature"]], 0.0) + r["gain"]
                    split = True
            if not split:
                break
        for t in state["active"]:
            tree = Tree(*[a.tolist() for a in grown[t]], leaf[t].tolist())
            out[names[t]].trees.append(tree)
            state["trees"][t].append(tree)
        if not state["active"]:
            break
        if round_ % KEEP_MARGINS == KEEP_MARGINS - 1:
            paths.append(work_dir(spark, "binned"))
            table = _with_margins(table, state, paths[-1])
            drop_folder(spark, paths.pop(0))
    for path in paths:
        drop_folder(spark, path)
    for i, name in enumerate(names):
        del out[name].trees[best.get(i, (0, 0))[1]:]
    return edges, out


def _with_margins(table: DataFrame, state: dict, path: str) -> DataFrame:
    """The table with the trees since the last time added to its margins; these trees are then forgotten."""
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast(dict(state))
    targets, width = len(state["base"]), state["width"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            x, _, _, f = _arrays(b, width, s["base"])
            f = f.copy()
            for t in range(targets):
                for tree in s["trees"][t]:
                    f[:, t] += tree.leaves(x)
            margins = pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, targets), pa.int32()), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), margins], names=["x", "y", "watch", "f"])

    table.select("x", "y", "watch", "f").mapInArrow(run, "x binary, y array<double>, watch boolean, f array<double>").write.mode("overwrite").parquet(path)
    state["trees"] = [[] for _ in state["trees"]]
    shared.destroy()
    return spark.read.parquet(path)


def isotonic(points: list[tuple[float, float, float]]) -> tuple[list[float], list[float]]:
    """Non-decreasing least-squares fit of (x, weight, mean) in order of x: places and values, straight lines between."""
    blocks: list[list[float]] = []  # weight, mean, first x, last x
    for x, w, m in points:
        blocks.append([w, m, x, x])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, _, last = blocks.pop()
            w1, m1, first, _ = blocks.pop()
            blocks.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), first, last])
    xs, ys = [], []
    for _, m, first, last in blocks:
        for x in dict.fromkeys([first, last]):
            xs.append(x)
            ys.append(m)
    return xs, ys
