"""Second-order gradient boosting with leaf-wise growth (M4) and its search (M6).

A tree grows best leaf first up to ``num_leaves`` (or level by level without that
limit).  A split is judged by the sums of gradients and curvatures of its sides,
with L1 and L2 penalties in gain and leaf value, and learns the side of rows whose
value is missing.  The loss is the squared error, whose curvature is the row count.

Features are binned once.  Gradients are rounded to a fixed unit, so sums are
exact and a tree does not depend on how the rows are dealt out.

A binned table of at most ``HELD_ROWS`` rows is broadcast and every fit is one
task, so a search runs its fits side by side.  A larger one stays distributed, as an
RDD without query plans: every step of a tree is one aggregation of the histograms of
its open leaves, of which the driver sees the chosen splits only.  Both grow the same trees.

Fitted ensembles are Spark ML models: scoring and saving stay in the JVM.
"""

from __future__ import annotations

import heapq
import itertools
import json
import random
import sys
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearlens import schema as S
from gearlens.operators.quantiles import running_counts
from gearlens.session import ensure_checkpoint_dir, shared_folder

FEATURES_VEC, PREDICTION = "__boosted_vector", "prediction"
#: Rows up to which the binned table is broadcast (about 30 MB at 13 features).
HELD_ROWS = 1_000_000
#: Most bins of a feature (bin 0 holds the missing values).
MAX_BIN = 255
#: Most combinations of the bins of features whose histograms are taken together.
JOINT = 512
#: Rows that a step over a held table takes at once.
BLOCK = 32768
#: Gains at or below this do not split.
LEAST_GAIN = 1e-6
#: Rounds between two written states of a distributed fit.
CHECKPOINT_ROUNDS = 10
#: Nodes whose histograms a task holds at once.
NODES_AT_ONCE = 2048
#: What a missing value becomes in the assembled vector, for splits that send it left or right.
LOW, HIGH = -1.0e300, 1.0e300


@dataclass(frozen=True)
class Settings:
    """Defaults are those of the leaf-wise library of the reference (fixed values)."""
    rounds: int = 100
    learning_rate: float = 0.1
    num_leaves: int | None = 31
    max_depth: int | None = None
    reg_alpha: float = 0.0
    reg_lambda: float = 0.0
    min_rows: int = 20
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    colsample_bylevel: float = 1.0
    seed: int = 42


#: Defaults of the depth-wise library of the reference (fixed values).
DEPTHWISE = Settings(rounds=100, learning_rate=0.3, num_leaves=None, max_depth=6, reg_lambda=1.0, min_rows=1)


#: The two searches of the notebook: spaces and number of draws (fixed values).
SPACES = {
    "depthwise": (DEPTHWISE, 20, {
        "max_depth": [3, 5, 6, 10, 15, 20],
        "learning_rate": [0.01, 0.1, 0.2, 0.3],
        "subsample": [0.5, 0.6, 0.7, 0.8, 0.9],
        "colsample_bytree": [0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
        "colsample_bylevel": [0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
        "rounds": [100, 500, 1000],
        "reg_alpha": [0, 0.01, 0.05],
        "reg_lambda": [0, 0.01, 0.05]}),
    "leafwise": (Settings(), 50, {
        "num_leaves": [20, 30, 50],
        "max_depth": [5, 10, 15],
        "learning_rate": [0.05, 0.1, 0.2],
        "rounds": [100, 200, 300],
        "reg_alpha": [0, 0.01, 0.1],
        "reg_lambda": [0, 0.01, 0.1]}),
}


# ---------------------------------------------------------------------------
# Binning
# ---------------------------------------------------------------------------
class Layout:
    """Bins of all features in one row of numbers: feature f has bins
    ``at[f] .. at[f + 1]``, the first of them for missing values, and a value x lies
    in bin 1 + (number of ``cuts[f]`` below x)."""

    def __init__(self, features: list[str], cuts: list[list[float]]):
        self.features = list(features)
        self.cuts = [np.array(c or [0.0], float) for c in cuts]
        sizes = [len(c) + 1 for c in self.cuts]
        self.at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.bins = int(self.at[-1])
        self.feature_of = np.repeat(np.arange(len(sizes)), sizes)
        self.bin_of = np.arange(self.bins) - self.at[self.feature_of]

    def part(self, features: list[int]) -> "Layout":
        """The bins of some features side by side; ``feature_of`` keeps their numbers."""
        if len(features) == len(self.features):
            return self
        out = Layout([self.features[f] for f in features], [self.cuts[f].tolist() for f in features])
        out.feature_of = np.array(features)[out.feature_of]
        return out

    def codes(self, columns: list[np.ndarray]) -> np.ndarray:
        """(rows, features) bins; values above the last cut lie in the last bin."""
        out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.uint8)
        for f, x in enumerate(columns):
            b = np.minimum(np.searchsorted(self.cuts[f], x, "left"), len(self.cuts[f]) - 1) + 1
            out[:, f] = np.where(np.isnan(x), 0, b)
        return out


def layout_of(df: DataFrame, features: list[str], max_bin: int = MAX_BIN) -> Layout:
    """Cuts of every feature: each distinct value where there are fewer than
    ``max_bin``, else the values at equal ranks.  One count per (feature, value),
    ranks by range: no sample, no column on one task; the driver gets the cuts."""
    values = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"`{c}`").cast("double").alias("x")) for i, c in enumerate(features)])
    freq = df.select(F.explode(values).alias("v")).select("v.f", "v.x").where("x IS NOT NULL AND NOT isnan(x)") \
        .groupBy("f", "x").agg(F.count(F.lit(1)).alias("c"))
    placed = running_counts(freq, "x", "c", by=("f",))
    kinds = placed.groupBy(F.col("f").alias("g")).agg(F.count(F.lit(1)).alias("kinds"))                 # one row a feature
    # a bin is closed by the value that reaches its share of the rows
    upto = F.col("__below") + F.col("c")
    rank = F.when(F.col("kinds") < max_bin, F.col("x")).otherwise(F.ceil(upto * (max_bin - 1) / F.col("__total")).cast("double"))
    cut = placed.join(F.broadcast(kinds), F.col("f") == F.col("g")).groupBy("f", rank.alias("r")).agg(F.max("x").alias("x"))
    found: list[list[float]] = [[] for _ in features]
    for r in cut.collect():                                                                            # at most max_bin rows a feature
        found[r["f"]].append(r["x"])
    return Layout(features, [sorted(c) for c in found])


BINNED = "h bigint, y double, fold int, codes binary"


def binned(df: DataFrame, layout: Layout, label: str, key: str | None = S.KEY, fold=None) -> DataFrame:
    """Labelled rows as (h, y, fold, codes: one byte a feature).  ``h`` decides which
    rounds sample a row: the key's hash, or without a key the row's own."""
    cols = [F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(layout.features)]
    h = F.xxhash64(F.col(f"`{key}`") if key and key in df.columns else F.struct(*cols, F.col(f"`{label}`").cast("double")))
    rows = df.where(F.col(f"`{label}`").isNotNull()).select(h.alias("h"), F.col(f"`{label}`").cast("double").alias("y"),
                                                           (fold if fold is not None else F.lit(-1)).cast("int").alias("fold"), *cols)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(3 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(layout.features))]
            codes = layout.codes(columns)
            packed = pa.array([r.tobytes() for r in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), packed], ["h", "y", "fold", "codes"])
    return rows.mapInArrow(bins, BINNED)


# ---------------------------------------------------------------------------
# One tree
# ---------------------------------------------------------------------------
def soft(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0) if alpha else g


def score(g, n, s: Settings):
    """What the rows of a side take off the loss, twice."""
    g = soft(g, s.reg_alpha)
    return g * g / np.maximum(n + s.reg_lambda, 1e-12)


def best_splits(grad: np.ndarray, rows: np.ndarray, layout: Layout, s: Settings, allowed: np.ndarray) -> np.ndarray:
    """Best split of each node from its histograms (nodes, bins): an array of
    (gain, feature, bin, missing goes left, G left, N left, G right, N right), gain 0
    where no split is allowed.  Ties go to the first feature, the lowest bin, and left."""
    out = np.zeros((len(grad), 8))
    cols = np.flatnonzero(allowed)                                                  # all bins of the features that may split
    bin_of, feature_of = layout.bin_of[cols], layout.feature_of[cols]
    first = np.maximum.accumulate(np.where(bin_of == 0, np.arange(len(cols)), 0))
    one = int((first == 0).sum())                                                   # bins of the first of them
    for lo in range(0, len(grad), NODES_AT_ONCE):
        g, n = grad[lo:lo + NODES_AT_ONCE], rows[lo:lo + NODES_AT_ONCE]
        if len(cols) < layout.bins:
            g, n = g[:, cols], n[:, cols]
        tg, tn = g[:, :one].sum(1)[:, None], n[:, :one].sum(1)[:, None]
        cg, cn = np.cumsum(g, 1), np.cumsum(n, 1)
        left_g, left_n = cg - cg[:, first], cn - cn[:, first]                       # present values up to a bin
        none_g, none_n = g[:, first], n[:, first]
        fits = bin_of > 0
        whole = score(tg, tn, s)
        ways, sides = [], []
        # without missing rows both sides are the same to them
        for lg, ln in ((left_g + none_g, left_n + none_n), (left_g, left_n))[:2 if none_n.any() else 1]:
            rg, rn = tg - lg, tn - ln
            gain = score(lg, ln, s)
            gain += score(rg, rn, s)
            gain -= whole
            gain[~(fits & (ln >= s.min_rows) & (rn >= s.min_rows) & (gain > LEAST_GAIN))] = 0.0
            ways.append(np.round(gain, 9))
            sides.append((lg, ln, rg, rn))
        i = np.arange(len(g))
        b = [w.argmax(1) for w in ways]
        gain, way = ways[0][i, b[0]], np.zeros(len(g), np.int64)
        if len(ways) > 1:
            other = ways[1][i, b[1]]
            way = ((other > gain) | (other == gain) & (b[1] < b[0])).astype(np.int64)
            gain = np.maximum(gain, other)
        b = np.where(way == 0, b[0], b[-1])
        parts = [np.where(way == 0, sides[0][k][i, b], sides[-1][k][i, b]) for k in range(4)]
        out[lo:lo + len(g)] = np.stack([gain, feature_of[b], bin_of[b], way == 0, *parts], 1)
    return out


class Tree:
    """Nodes of one tree as they grow, in arrays: sums of gradients and rows, best split
    (see best_splits), left child (the right one follows; -1 without), depth."""

    def __init__(self, s: Settings):
        self.s, self.size, self.chosen = s, 0, set()
        self.total, self.split = np.zeros((64, 2)), np.zeros((64, 8))
        self.left, self.depth = np.full(64, -1, np.int64), np.zeros(64, np.int64)
        self.open: np.ndarray = np.zeros(0, np.int64)

    def add(self, total: np.ndarray, depth) -> np.ndarray:
        """New nodes with these sums; their numbers."""
        n = len(total)
        while self.size + n > len(self.left):
            self.total, self.split = np.concatenate([self.total, np.zeros_like(self.total)]), np.concatenate([self.split, np.zeros_like(self.split)])
            self.left, self.depth = np.concatenate([self.left, np.full_like(self.left, -1)]), np.concatenate([self.depth, np.zeros_like(self.depth)])
        new = np.arange(self.size, self.size + n)
        self.total[new], self.depth[new] = total, depth
        self.size += n
        return new

    def set_splits(self, nodes: np.ndarray, splits: np.ndarray) -> None:
        """Best splits of new nodes; too deep ones have none."""
        self.split[nodes] = splits
        if self.s.max_depth is not None:
            self.split[nodes[self.depth[nodes] >= self.s.max_depth], 0] = 0.0
        self.open = np.concatenate([self.open, nodes[self.split[nodes, 0] > 0]])

    def expand(self, nodes: np.ndarray) -> np.ndarray:
        """Give each node its two children; their numbers, left and right in turn."""
        kids = self.add(self.split[nodes][:, 4:8].reshape(-1, 2), np.repeat(self.depth[nodes] + 1, 2))
        self.left[nodes] = kids[::2]
        self.open = self.open[self.left[self.open] < 0]
        return kids

    def wanted(self) -> np.ndarray:
        """Nodes to expand next; none when the tree is done.  Without a limit of leaves
        these are all that may split.  With one, splits are taken best first; where that
        needs children that are not known, all leaves that could still be taken are asked
        for at once, so that a tree takes as many steps as it has levels."""
        if self.s.num_leaves is None:
            return self.open
        limit = self.s.num_leaves - 1
        heap = [(-self.split[0, 0], 0)] if self.split[0, 0] > 0 else []
        self.chosen = set()
        while heap and len(self.chosen) < limit:
            _, i = heapq.heappop(heap)
            if self.left[i] < 0:
                return np.array([i, *[j for _, j in heapq.nsmallest(limit - len(self.chosen) - 1, heap) if self.left[j] < 0]], np.int64)
            self.chosen.add(i)
            for j in (int(self.left[i]), int(self.left[i]) + 1):
                if self.split[j, 0] > 0:
                    heapq.heappush(heap, (-self.split[j, 0], j))
        return np.zeros(0, np.int64)

    def inner(self) -> np.ndarray:
        """Whether each node is a split of the finished tree."""
        out = self.left[:self.size] >= 0
        if self.s.num_leaves is not None:
            out &= np.isin(np.arange(self.size), list(self.chosen))
        return out

    def down(self) -> tuple[np.ndarray, ...]:
        """Of each node: its left child, and the feature, last bin and side of missing values of its split."""
        _, feature, upto, low = self.split[:self.size, :4].T
        return self.left[:self.size], feature.astype(np.int64), upto, low > 0

    def own_values(self) -> np.ndarray:
        g, n = self.total[:self.size].T
        with np.errstate(divide="ignore", invalid="ignore"):
            v = -soft(g, self.s.reg_alpha) / (n + self.s.reg_lambda) * self.s.learning_rate
        return np.where(n + self.s.reg_lambda > 0, v, 0.0)

    def values(self) -> np.ndarray:
        """Value of every node as rows see it: the one of its ancestor that is a leaf."""
        inner, leaf = self.inner(), np.arange(self.size)
        for depth in range(int(self.depth[:self.size].max(initial=0))):
            i = np.flatnonzero((self.depth[:self.size] == depth) & (self.left[:self.size] >= 0))
            for side in (0, 1):
                kid = self.left[i] + side
                leaf[kid] = np.where(inner[i], kid, leaf[i])
        return self.own_values()[leaf]

    def table(self) -> list[tuple]:
        """Nodes in preorder: (id, value, rows, gain, left, right, feature, bin, missing goes left); -1 for leaves."""
        inner, value, out = self.inner(), self.own_values(), []
        todo = [(0, -1, 4)]
        while todo:
            i, parent, side = todo.pop()
            me = len(out)
            if parent >= 0:
                out[parent][side] = me
            out.append([me, float(value[i]), int(self.total[i, 1]), -1.0, -1, -1, -1, -1, True])
            if inner[i]:
                gain, feature, b, low = self.split[i, :4]
                out[me][3], out[me][6:] = float(gain), [int(feature), int(b), bool(low)]
                todo += [(int(self.left[i]) + 1, me, 5), (int(self.left[i]), me, 4)]
        return [tuple(r) for r in out]


def route(at: np.ndarray, columns: np.ndarray, tree: Tree, nodes: np.ndarray, use: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Move rows of the expanded ``nodes`` to their children.  Returns the rows of ``use`` that
    come to one of the ``wanted`` children, and its place among them.  ``columns``: (features, rows) bins."""
    _, feature, upto, low = tree.split[nodes, :4].T[:, :, None]
    bins = np.arange(MAX_BIN + 1)
    child = (tree.left[nodes][:, None] + ~np.where(bins == 0, low > 0, bins <= upto)).reshape(-1)    # of each (node, bin)
    start, codes = feature[:, 0].astype(np.int64) * len(at), columns.reshape(-1)
    place, kid = np.full(tree.size, -1, np.int64), np.full(tree.size, -1, np.int64)
    place[nodes], kid[wanted] = np.arange(len(nodes)), np.arange(len(wanted))
    expanded = place >= 0
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for lo in range(0, len(at), BLOCK):                       # small arrays stay in the cache; take() with clip skips a check of the indices
        node = at[lo:lo + BLOCK]
        rows = np.flatnonzero(expanded.take(node, mode="clip"))
        if not len(rows):
            continue
        node = place.take(node.take(rows, mode="clip"), mode="clip")
        rows += lo
        cell = start.take(node, mode="clip")
        cell += rows
        node *= MAX_BIN + 1
        node += codes.take(cell, mode="clip")
        node = child.take(node, mode="clip")
        at[rows] = node
        if len(wanted):
            node = kid.take(node, mode="clip")
            some = node >= 0
            some &= use.take(rows, mode="clip")
            some = np.flatnonzero(some)
            found.append((rows.take(some, mode="clip"), node.take(some, mode="clip")))
    return tuple(np.concatenate(x) for x in zip(*found))


def histograms(codes: np.ndarray, at: np.ndarray, grad: np.ndarray, node: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and rows by (node, bin); ``codes``: (rows, features) bins, ``at``: the
    features' places in the layout.  One feature at a time, so that its keys stay in the cache."""
    g, n = np.empty((nodes, int(at[-1]))), np.empty((nodes, int(at[-1])))
    for f in range(codes.shape[1]):
        lo, hi = int(at[f]), int(at[f + 1])
        keys = node * (hi - lo) + codes[:, f]
        g[:, lo:hi] = np.bincount(keys, grad, nodes * (hi - lo)).reshape(nodes, hi - lo)
        n[:, lo:hi] = np.bincount(keys, minlength=nodes * (hi - lo)).reshape(nodes, hi - lo)
    return g, n


def bundles(codes: np.ndarray, layout: Layout) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
    """Features whose bins occur in at most JOINT combinations are summed together: (features,
    each row's combination, the bin of each feature in each combination)."""
    out: list[tuple[list[int], np.ndarray, np.ndarray]] = []
    sizes = np.diff(layout.at)
    for f in np.argsort(sizes, kind="stable").tolist():
        of, rows, bins = out[-1] if out else ([], np.zeros(len(codes), np.uint16), np.zeros((0, 1), np.int64))
        joint = rows * sizes[f] + codes[:, f]
        there = np.flatnonzero(np.bincount(joint, minlength=1))
        if of and len(there) > JOINT:
            (of, rows, bins), joint = ([], rows, np.zeros((0, 1), np.int64)), codes[:, f].astype(np.int64)
            there = np.flatnonzero(np.bincount(joint, minlength=1))
        elif out:
            out.pop()
        place = np.zeros(int(there.max(initial=0)) + 1, np.uint16)
        place[there] = np.arange(len(there))
        out.append(([*of, f], place[joint], np.concatenate([bins[:, there // sizes[f]] if of else bins[:, :0].reshape(0, len(there)), (there % sizes[f])[None]])))
    return out


def drawn(pool: list[int], share: float, *seed) -> list[int]:
    return pool if share >= 1 else sorted(random.Random("-".join(map(str, seed))).sample(pool, max(1, int(share * len(pool)))))


def tree_features(features: int, s: Settings, tree_number: int) -> list[int]:
    return drawn(list(range(features)), s.colsample_bytree, s.seed, tree_number)


def allowed_bins(layout: Layout, features: int, s: Settings, tree_number: int, depth: int) -> np.ndarray:
    """Which bins' features may split nodes of a depth: drawn by tree, of these by level."""
    some = drawn(tree_features(features, s, tree_number), s.colsample_bylevel, s.seed, tree_number, depth)
    return np.isin(layout.feature_of, some)


def sampled(h: np.ndarray, s: Settings, tree_number: int) -> np.ndarray:
    """Rows of a tree's sample: by a hash of row and tree, wherever the row lies."""
    if s.subsample >= 1:
        return np.ones(len(h), bool)
    with np.errstate(over="ignore"):
        x = h.astype(np.uint64) ^ np.uint64((s.seed * 1_000_003 + tree_number) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(float) / 2.0**64 < s.subsample


def unit_of(rows: int, largest: float) -> float:
    """Gradients are multiples of this: so fine that the sum of all fits a double's 53 bits
    up to a million rows, a long beyond."""
    size = max(1.0, 4 * max(largest, 1e-300))
    bits = 52 if rows <= HELD_ROWS else 62
    return 2.0 ** -np.floor(min(45.0, bits - np.log2(max(rows, 1)) - np.log2(size)))


# ---------------------------------------------------------------------------
# A fit over a held table
# ---------------------------------------------------------------------------
class Held:
    """The binned table in one process."""

    def __init__(self, layout: Layout, h: np.ndarray, y: np.ndarray, fold: np.ndarray, codes: np.ndarray, together: list | None = None):
        self.layout, self.h, self.y, self.fold = layout, h, y, fold
        self.columns = np.ascontiguousarray(codes.T)
        self.together = bundles(codes, layout) if together is None else together

    def _histograms(self, lay: Layout, rows: np.ndarray, grad: np.ndarray, node: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of gradients and rows by (node, bin of ``lay``).  Sums of a bundle's combinations
        are added up to those of its features' bins, exactly, as gradients are multiples of a unit."""
        g, n = np.empty((nodes, lay.bins)), np.empty((nodes, lay.bins))
        at = {int(f): int(lo) for f, lo in zip(lay.feature_of[lay.at[:-1]], lay.at)}
        sizes = np.diff(self.layout.at)

        def sums(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
            total = np.zeros(nodes * size), np.zeros(nodes * size)
            step = BLOCK if 4 * nodes * size <= BLOCK else max(1, len(rows))
            for lo in range(0, len(rows), step):
                keys = codes.take(rows[lo:lo + step], mode="clip").astype(np.int64)
                if nodes > 1:
                    keys += node[lo:lo + step] * size
                for x, weights in zip(total, (grad[lo:lo + step], None)):
                    x += np.bincount(keys, weights, nodes * size)
            return total[0].reshape(nodes, size), total[1].reshape(nodes, size)
        for of, joint, bins in self.together:
            some = [i for i, f in enumerate(of) if f in at]
            if len(some) > 1 and len(rows) >= nodes * bins.shape[1]:
                both = sums(joint, bins.shape[1])
                for i in some:
                    f = of[i]
                    part = (bins[i][:, None] == np.arange(sizes[f])).astype(float)
                    for out, x in zip((g, n), both):
                        out[:, at[f]:at[f] + sizes[f]] = x @ part
            else:
                for f in (of[i] for i in some):
                    for out, x in zip((g, n), sums(self.columns[f], int(sizes[f]))):
                        out[:, at[f]:at[f] + sizes[f]] = x
        return g, n

    def grow(self, grad: np.ndarray, use: np.ndarray, s: Settings, number: int) -> tuple[Tree, np.ndarray]:
        """A tree over the rows of ``use``, and every row's node."""
        tree, lay = Tree(s), self.layout.part(tree_features(len(self.layout.features), s, number))
        at = np.zeros(len(self.y), np.int64)
        some = np.flatnonzero(use)
        g, n = self._histograms(lay, some, grad[some], at[:len(some)], 1)
        root = tree.add(np.array([[grad[some].sum(), len(some)]]), 0)
        tree.set_splits(root, best_splits(g, n, lay, s, allowed_bins(lay, len(self.layout.features), s, number, 0)))
        held = {0: (g, n, 0)}
        while (nodes := tree.wanted()).size:
            for lo in range(0, len(nodes), NODES_AT_ONCE):
                self._expand(tree, lay, nodes[lo:lo + NODES_AT_ONCE], at, grad, use, s, number, held)
        return tree, at

    def _expand(self, tree, lay, nodes, at, grad, use, s, number, held) -> None:
        """Histograms of the children with fewer rows; those of the others are what is left of their parents'."""
        kids = tree.expand(nodes)
        split = tree.split[nodes]
        small = tree.left[nodes] + (split[:, 5] > split[:, 7])
        # a node of too few rows, or at the last level, cannot split
        may = np.flatnonzero((tree.total[kids, 1] >= 2 * s.min_rows) & (tree.depth[kids] < (s.max_depth if s.max_depth is not None else np.inf)))
        some, node = route(at, self.columns, tree, nodes, use, small if len(may) else kids[:0])
        splits = np.zeros((len(kids), 8))
        if len(may):
            g, n = np.empty((len(kids), lay.bins)), np.empty((len(kids), lay.bins))
            mine, other = small - kids[0], 2 * tree.left[nodes] + 1 - small - kids[0]
            g[mine], n[mine] = self._histograms(lay, some, grad.take(some, mode="clip"), node, len(small))
            parents = [held.pop(i) for i in nodes.tolist()]
            g[other], n[other] = np.stack([a[k] for a, _, k in parents]) - g[mine], np.stack([b[k] for _, b, k in parents]) - n[mine]
            for depth in np.unique(tree.depth[kids[may]]).tolist():
                js = may[tree.depth[kids[may]] == depth]
                splits[js] = best_splits(g[js], n[js], lay, s, allowed_bins(lay, len(self.layout.features), s, number, depth))
        tree.set_splits(kids, splits)
        again = np.flatnonzero(tree.split[kids, 0] > 0)
        if len(again):
            g, n = g[again], n[again]
        for k, j in enumerate(kids[again].tolist()):
            held[j] = (g, n, k)

    def fit(self, s: Settings, valid: np.ndarray | None = None, stops: list[int] | None = None, keep: bool = True):
        """(mean, trees, {rounds: R² on ``valid``}); rows of ``valid`` are not learnt from."""
        train = ~valid if valid is not None else np.ones(len(self.y), bool)
        mean = float(self.y[train].mean()) if train.any() else 0.0
        unit = unit_of(len(self.y), float(np.abs(self.y - mean).max(initial=0.0)))
        pred, grad = np.full(len(self.y), mean), np.empty(len(self.y))
        trees, scores = [], {}
        for r in range(s.rounds):
            np.subtract(pred, self.y, out=grad)
            grad /= unit
            np.rint(grad, out=grad)
            grad *= unit
            tree, at = self.grow(grad, train & sampled(self.h, s, r), s, r)
            pred += tree.values().take(at, mode="clip")
            if keep:
                trees.append(tree.table())
            if stops and r + 1 in stops:
                scores[r + 1] = r_squared(self.y[valid], pred[valid])
        return mean, trees, scores


def r_squared(y: np.ndarray, pred: np.ndarray) -> float:
    spread = ((y - y.mean()) ** 2).sum() if len(y) else 0.0
    return float(1 - ((y - pred) ** 2).sum() / spread) if spread > 0 else float("nan")


def _held(rows: DataFrame, layout: Layout) -> tuple:
    """Arrays of the binned rows, by row hash so that they do not depend on partitions."""
    t = rows.toArrow()                                                                            # HELD_ROWS at most
    codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(t.num_rows, len(layout.features))
    h, y, fold = (t[c].to_numpy() for c in ("h", "y", "fold"))
    order = np.lexsort((y, h))
    codes = codes[order]
    return h[order], y[order], fold[order], codes, bundles(codes, layout)


# ---------------------------------------------------------------------------
# A fit over a distributed table
# ---------------------------------------------------------------------------
#: Rows of a chunk, and of a partition at most.  A chunk's sums of gradients fit a double's 53 bits.
CHUNK, PART_ROWS = 8192, 1_000_000
#: Nodes whose sums one task adds up and splits.
NODES_A_TASK = 256
CHUNKS = "h binary, y binary, codes binary"


def descend(codes: np.ndarray, down: tuple[np.ndarray, ...], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that come from the root to a node with ``ends`` >= 0, and that number; nodes
    with -1 are passed, the rows of others are left out.  ``down``: see Tree.down."""
    left, feature, upto, low = down
    rows, at, found = np.arange(len(codes)), np.zeros(len(codes), np.int64), []
    while len(rows):
        end = ends[at]
        if (done := end >= 0).any():
            found.append((rows[done], end[done]))
        if not (on := end == -1).all():
            rows, at = rows[on], at[on]
        code = codes[rows, feature[at]]
        at = left[at] + ~np.where(code == 0, low[at], code <= upto[at])
    if not found:
        return rows, rows
    return tuple(np.concatenate(x) for x in zip(*found))


class Spread:
    """The binned table with every row's prediction as an RDD of chunks (h, y, codes, pred).
    A tree takes hundreds of small jobs a model, so they carry no query plan: the plans of
    tables kept one upon the other filled the driver."""

    def __init__(self, rows: DataFrame, layout: Layout):
        self.rows, self.layout = rows, layout

    def _packed(self, n: int, mean: float, draws: bool) -> RDD:
        """``draws``: rounds take samples, so rows keep their hash."""
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, CHUNK):
                    c = b.slice(lo, CHUNK)
                    h, y = (c.column(k).to_numpy(zero_copy_only=False) for k in ("h", "y"))
                    packed = (h.astype(np.int64).tobytes(), y.astype(float).tobytes(), b"".join(c.column("codes").to_pylist()))
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], ["h", "y", "codes"])

        def chunk(r) -> tuple[np.ndarray, ...]:
            y = np.frombuffer(r[1], float)
            return np.frombuffer(r[0], np.int64) if draws else None, y, np.frombuffer(r[2], np.uint8).reshape(len(y), -1), np.full(len(y), mean)
        cores = self.rows.sparkSession.sparkContext.defaultParallelism
        parts = cores * max(1, -(-n // (cores * PART_ROWS)))                                         # every core has as many
        return self.rows.select("h", "y", "codes").repartition(parts).mapInArrow(pack, CHUNKS).rdd.map(chunk)

    def _splits(self, state: RDD, tree: Tree, steps: list[np.ndarray], kids: np.ndarray, s: Settings, number: int, unit: float) -> tuple[np.ndarray, np.ndarray]:
        """Sums and best splits of the nodes ``kids`` after ``steps`` of expansions: one aggregation."""
        lay, down, depth = self.layout, tree.down(), tree.depth[kids]
        ends = np.full(tree.size, -2, np.int64)
        ends[kids] = np.arange(len(kids))
        for nodes in reversed(steps):                                                                # -1 for the nodes above kids
            ends[nodes] = np.maximum(ends[tree.left[nodes]], ends[tree.left[nodes] + 1]).clip(-2, -1)

        def sums(chunks: Iterator[tuple]) -> Iterator[tuple[int, tuple[bytes, bytes]]]:
            held = []
            for h, y, codes, pred in chunks:
                some, node = descend(codes, down, ends)
                if s.subsample < 1:
                    use = sampled(h[some], s, number)
                    some, node = some[use], node[use]
                held.append((codes[some], np.rint((pred[some] - y[some]) / unit), node))
            if not held:
                return
            codes, grad, node = (np.concatenate(x) for x in zip(*held))
            if len(kids) > NODES_AT_ONCE:
                order = np.argsort(node, kind="stable")
                codes, grad, node = codes[order], grad[order], node[order]
            for lo in range(0, len(kids), NODES_AT_ONCE):
                size = min(NODES_AT_ONCE, len(kids) - lo)
                here = slice(*np.searchsorted(node, [lo, lo + size])) if size < len(kids) else slice(0, len(node))
                total = np.zeros((2, size, lay.bins), np.int64)
                for k in range(here.start, here.stop, CHUNK):
                    one = slice(k, min(k + CHUNK, here.stop))
                    for t, x in zip(total, histograms(codes[one], lay.at, grad[one], node[one] - lo, size)):
                        t += x.astype(np.int64)
                for k in np.flatnonzero(total[1, :, :lay.at[1]].any(1)).tolist():
                    yield lo + k, (total[0, k].tobytes(), total[1, k].tobytes())

        def best(found: Iterator[tuple[int, tuple[bytes, bytes]]]) -> Iterator[tuple[int, list[float]]]:
            total: dict[int, np.ndarray] = {}                                                        # the nodes of this partition
            for k, x in found:
                x = np.stack([np.frombuffer(v, np.int64) for v in x])
                total[k] = total[k] + x if k in total else x
            levels: dict[int, list[int]] = {}
            for k in sorted(total):
                levels.setdefault(int(depth[k]), []).append(k)
            for level, ks in levels.items():
                g, n = np.stack([total[k][0] for k in ks]) * unit, np.stack([total[k][1] for k in ks]).astype(float)
                split = best_splits(g, n, lay, s, allowed_bins(lay, len(lay.features), s, number, level))
                one = slice(0, int(lay.at[1]))
                yield from zip(ks, np.concatenate([g[:, one].sum(1)[:, None], n[:, one].sum(1)[:, None], split], 1).tolist())

        tasks = -(-len(kids) // NODES_A_TASK)
        total, splits = np.zeros((len(kids), 2)), np.zeros((len(kids), 8))
        for k, x in state.mapPartitions(sums).partitionBy(tasks, lambda k: k).mapPartitions(best).collect():  # one row an open leaf
            total[k], splits[k] = x[:2], x[2:]
        return total, splits

    def fit(self, s: Settings):
        """(mean, trees).  Predictions are carried from round to round as a persisted
        table, which the first step of a round fills, written to the checkpoint folder
        every CHECKPOINT_ROUNDS."""
        ensure_checkpoint_dir(self.rows.sparkSession)
        n, total, low, high = self.rows.agg(F.count(F.lit(1)), F.sum("y"), F.min("y"), F.max("y")).first()
        mean = total / n if n else 0.0
        unit = unit_of(n, max(abs((low or 0.0) - mean), abs((high or 0.0) - mean)))
        state, before = self._packed(n, mean, s.subsample < 1).persist(StorageLevel.MEMORY_AND_DISK), None
        trees = []
        try:
            for r in range(s.rounds):
                if r % CHECKPOINT_ROUNDS == 0:
                    state.checkpoint()                                                               # with the round's first step
                tree, steps = Tree(s), []
                root = tree.add(np.zeros((1, 2)), 0)
                total, splits = self._splits(state, tree, [], root, s, r, unit)
                if before is not None:
                    before.unpersist()
                tree.total[root] = total
                tree.set_splits(root, splits)
                while (nodes := tree.wanted()).size:
                    kids = tree.expand(nodes)
                    steps.append(nodes)
                    # a node of too few rows, or at the last level, cannot split
                    may = (tree.total[kids, 1] >= 2 * s.min_rows) & (tree.depth[kids] < (s.max_depth if s.max_depth is not None else np.inf))
                    splits = np.zeros((len(kids), 8))
                    if may.any():
                        splits[may] = self._splits(state, tree, steps, kids[may], s, r, unit)[1]
                    tree.set_splits(kids, splits)
                trees.append(tree.table())
                if r + 1 == s.rounds:
                    break
                before, state = state, self._moved(state, tree).persist(StorageLevel.MEMORY_AND_DISK)
        finally:
            for table in (before, state):
                if table is not None:
                    table.unpersist()
        return mean, trees

    def _moved(self, state: RDD, tree: Tree) -> RDD:
        inner, value, down = tree.inner(), tree.own_values(), tree.down()
        ends = np.where(inner, -1, np.arange(tree.size))

        def move(chunk: tuple) -> tuple:
            h, y, codes, pred = chunk
            pred = pred.copy()
            rows, node = descend(codes, down, ends)
            pred[rows] += value[node]
            return h, y, codes, pred
        return state.map(move)


# ---------------------------------------------------------------------------
# The fitted ensemble as a Spark ML model
# ---------------------------------------------------------------------------
NODE = ("treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,"
        "leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>")


def to_model(spark: SparkSession, layout: Layout, mean: float, trees: list[list[tuple]], label: str) -> PipelineModel:
    """Feature columns to ``prediction``.  The vector holds every feature twice, with
    missing values below and above all others: a split reads the one that sends them
    to the side it learnt.  The first tree is the mean."""
    width = len(layout.features)
    path = f"{shared_folder(spark, 'booster')}/{uuid.uuid4().hex}"
    shared = {"featuresCol": FEATURES_VEC, "labelCol": label, "predictionCol": PREDICTION}

    def meta(kind: str, more: dict) -> str:
        name = kind.rsplit(".", 1)[1]
        return json.dumps({"class": kind, "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": f"{name}_{uuid.uuid4().hex[:12]}",
                           "paramMap": shared, "defaultParamMap": {"impurity": "variance", "leafCol": ""}} | more)

    whole = [[(0, mean, 0, -1.0, -1, -1, -1, -1, True)], *trees]
    ml = "org.apache.spark.ml.regression"
    spark.createDataFrame([(meta(f"{ml}.GBTRegressionModel", {"numFeatures": 2 * width, "numTrees": len(whole)}),)], "value string") \
        .coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame([(i, meta(f"{ml}.DecisionTreeRegressionModel", {}), 1.0) for i in range(len(whole))], "_1 int, _2 string, _3 double") \
        .coalesce(1).write.parquet(f"{path}/treesMetadata")
    rows = []
    for i, tree in enumerate(whole):
        for me, value, n, gain, left, right, f, b, low in tree:
            split = (f + (0 if low else width), [float(layout.cuts[f][b - 1])], -1) if f >= 0 else (-1, [], -1)
            rows.append((i, (me, value, 0.0, [float(n), 0.0, 0.0], n, gain / max(n, 1) if f >= 0 else -1.0, left, right, split)))
    spark.createDataFrame(rows, NODE).coalesce(1).write.parquet(f"{path}/data")
    model = GBTRegressionModel.load(path)
    value = "coalesce(nullif(cast(`{}` as double), double('NaN')), {}D) AS `{}`"
    sides = [value.format(f, side, f"__{name}{i}") for name, side in (("low", LOW), ("high", HIGH)) for i, f in enumerate(layout.features)]
    fill = SQLTransformer(statement=f"SELECT *, {', '.join(sides)} FROM __THIS__")
    cols = [f"__{name}{i}" for name in ("low", "high") for i in range(width)]
    return PipelineModel(stages=[fill, VectorAssembler(inputCols=cols, outputCol=FEATURES_VEC), model])


# ---------------------------------------------------------------------------
# M4 fit, M6 search
# ---------------------------------------------------------------------------
def fit_boosted(df: DataFrame, features, label: str = S.TARGET, settings: Settings = Settings(), int_target: bool = False, key: str | None = S.KEY,
                held_rows: int = HELD_ROWS) -> PipelineModel:
    """M4: the boosted ensemble of the labelled rows.

    Null labels are left out, null and NaN features are missing values.  No labelled
    row: predictions are 0.  A constant feature never splits.  Ties between splits go to
    the first feature, then the lowest value, then missing rows left.  ``held_rows``:
    rows up to which the binned table is broadcast; the model does not depend on it."""
    spark = df.sparkSession
    layout, rows = _prepared(df, list(features), label, int_target, key)
    try:
        if rows.count() <= held_rows:
            mean, trees, _ = _run(spark, layout, rows, [(settings, None, [])], keep=True)[0]
        else:
            mean, trees = Spread(rows, layout).fit(settings)
    finally:
        rows.unpersist()
    return to_model(spark, layout, mean, trees, label)


def _prepared(df, features, label, int_target, key, folds: int = 0) -> tuple[Layout, DataFrame]:
    from gearlens.plans.model import split_bucket
    y = F.col(f"`{label}`").cast("double")
    keep = [key] if key and key in df.columns else []
    fold = (split_bucket(key) % folds) if folds and keep else (F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in features], label), F.lit(folds)) if folds else F.lit(-1))
    source = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, *features])], (y.cast("int").cast("double") if int_target else y).alias(label)) \
        .where(F.col(f"`{label}`").isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        layout = layout_of(source, features)
        rows = binned(source, layout, label, key, fold).persist(StorageLevel.MEMORY_AND_DISK)
        rows.count()
    finally:
        source.unpersist()
    return layout, rows


def _run(spark: SparkSession, layout: Layout, rows: DataFrame, jobs: list[tuple[Settings, int | None, list[int]]], keep: bool) -> list[tuple]:
    """Every job (settings, fold to hold out, rounds to score at) as one task over the
    broadcast table: [(mean, trees, scores)]."""
    shared = spark.sparkContext.broadcast(_held(rows, layout))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                s, fold, stops = jobs[i]
                data = Held(layout, *shared.value)
                got = data.fit(s, data.fold == fold if fold is not None else None, stops, keep)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([json.dumps(got)])], ["job", "got"])

    ids = spark.range(0, len(jobs), 1, max(1, len(jobs)))
    out: list = [None] * len(jobs)
    for r in ids.mapInArrow(work, "job bigint, got string").collect():                            # a model, or some scores, a job
        mean, trees, scores = json.loads(r["got"])
        out[r["job"]] = (mean, [[tuple(n) for n in t] for t in trees], {int(k): v for k, v in scores.items()})
    shared.unpersist()
    return out


def draw_settings(space: dict[str, list], n: int, base: Settings, seed: int = 42) -> list[Settings]:
    """``n`` different settings drawn from the space, all of it if it holds no more."""
    names = sorted(space)
    sizes = [len(space[k]) for k in names]
    total = int(np.prod([1, *sizes], dtype=object))
    picks = random.Random(seed).sample(range(total), min(n, total))
    out = []
    for p in picks:
        values = {}
        for k, size in zip(names, sizes):
            values[k] = space[k][p % size]
            p //= size
        out.append(replace(base, **values))
    return out


def boosted_search(df: DataFrame, features, space: dict[str, list], n: int, folds: int = 3, base: Settings = Settings(), label: str = S.TARGET,
                   seed: int = 42, key: str | None = S.KEY, held_rows: int = HELD_ROWS) -> list[tuple[Settings, float]]:
    """M6: mean R² over ``folds`` held-out folds of ``n`` settings, in the order drawn.

    Settings that differ in ``rounds`` only are one path: it is fitted once, to its
    largest number of rounds, and scored at each.  All paths and folds read one binned
    table.  Folds follow the key's hash; a fold without rows, or whose labels are all
    equal, has no score (NaN)."""
    spark = df.sparkSession
    drawn = draw_settings(space, n, base, seed)
    paths: dict[Settings, list[int]] = {}
    for s in drawn:
        paths.setdefault(replace(s, rounds=0), []).append(s.rounds)
    layout, rows = _prepared(df, list(features), label, False, key, folds)
    cost = lambda s, stops: max(stops) * min(2 ** (s.max_depth or 60), s.num_leaves or 2**60, 2**14)          # noqa: E731
    order = sorted(paths.items(), key=lambda p: -cost(*p))
    jobs = [(replace(path, rounds=max(stops)), fold, sorted(set(stops))) for path, stops in order for fold in range(folds)]
    try:
        if rows.count() <= held_rows:
            scores = [x[2] for x in _run(spark, layout, rows, jobs, keep=False)]
        else:
            scores = [_spread_scores(spark, layout, rows, *job, label) for job in jobs]
    finally:
        rows.unpersist()
    mean = {}
    for (path, stops), k in zip(order, itertools.count(0, folds)):
        for r in stops:
            mean[replace(path, rounds=r)] = float(np.mean([scores[k + f][r] for f in range(folds)]))
    return [(s, mean[s]) for s in drawn]


def _spread_scores(spark, layout, rows, s, fold, stops, label) -> dict[int, float]:
    """Scores of one path and fold where the table is not held: one fit, then the
    held-out rows' errors at every stop in one aggregation."""
    mean, trees = Spread(rows.where(F.col("fold") != fold), layout).fit(s)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column("y").to_numpy(zero_copy_only=False)
            codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(b.num_rows, len(layout.features))
            pred, out = np.full(len(y), mean), []
            for r, t in enumerate(trees, 1):
                pred += predict(t, codes)
                if r in stops:
                    out.append(((y - pred) ** 2).sum())
            yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int64()), pa.array([y.sum()]), pa.array([(y * y).sum()]), pa.array([out], pa.list_(pa.float64()))],
                                             ["n", "s", "q", "e"])
    x = rows.where(F.col("fold") == fold).select("y", "codes").mapInArrow(errors, "n bigint, s double, q double, e array<double>") \
        .agg(F.sum("n"), F.sum("s"), F.sum("q"), *[F.sum(F.col("e")[i]) for i in range(len(stops))]).first()
    spread = x[2] - x[1] ** 2 / x[0] if x[0] else 0.0
    return {r: 1 - x[3 + i] / spread if spread > 0 else float("nan") for i, r in enumerate(stops)}


def predict(table: list[tuple], codes: np.ndarray) -> np.ndarray:
    """Values of one tree's table for binned rows."""
    t = np.array([(v, le, ri, f, b, lo) for _, v, _, _, le, ri, f, b, lo in table], float)
    value, kids, f, upto, low = t[:, 0], t[:, 1:3].astype(int), t[:, 3].astype(int), t[:, 4], t[:, 5] > 0
    at = np.zeros(len(codes), int)
    while (open_ := np.flatnonzero(f[at] >= 0)).size:
        node = at[open_]
        code = codes[open_, f[node]]
        at[open_] = kids[node, np.where(np.where(code == 0, low[node], code <= upto[node]), 0, 1)]
    return value[at]


def settings_text(s: Settings, names) -> str:
    return json.dumps({k: v for k, v in asdict(s).items() if k in names}, sort_keys=True)


def search_table(spark: SparkSession, found: list[tuple[Settings, float]], space: dict) -> DataFrame:
    return spark.createDataFrame([(settings_text(s, set(space)), float(score)) for s, score in found], "params string, mean_cv_r2 double")


# the executors need no copy of this repository on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
