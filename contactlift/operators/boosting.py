"""Newton boosting of histogram trees as Spark passes over binned rows, many models at a time.

The two parameter profiles of the model jobs need what MLlib's trees do not offer: Newton leaf values with L1 and L2 terms,
a feature subset per *tree*, a base score, a leaf cap with best-first growth, a learned direction for missing values, and
stopping without training the rest. One pass over the rows serves every model that is being trained (folds, seeds and
parameter sets are dimensions of the histograms):

* **Binning, once** (``Binning.fit``, ``pack``): quantile cuts by aggregates (``percentile_approx`` per feature, the features
  in groups that are merged by tasks of their own, in one aggregate as many as their sketches take ``SKETCH_BYTES`` of a task); each batch of rows becomes a block of one byte per value, bin 0 holding missing values. The blocks are checkpointed and kept.
* **A pass** (``_pass``): every task walks its rows down each model's unfinished tree and adds gradient, hessian and row count
  per (open node, feature, bin). A shuffle by node adds up the tasks' sums, and the task that holds a node's whole histogram
  finds its best split. Histograms stay on the executors; the driver gets one narrow row per open node, whatever the number
  of rows, features, bins or tasks (or all tasks' sums, where these are at most ``DRIVER_BYTES``). A pass takes the open nodes as far as their histograms fit into ``MODEL_BYTES``.
* **Splits** (``Tree.grow``): gain = T(GL)^2/(HL+l2) + T(GR)^2/(HR+l2) - T(G)^2/(H+l2), T shrinking by l1, for every cut and for
  missing values on either side; a split needs ``min_rows`` and ``min_hessian`` on both sides and a gain above ``min_gain``.
* **Best-first growth**: a leaf cap takes the splits in order of gain. A node that is not among the first ``max_leaves - 1`` of
  the splits known so far never will be, as later ones only add to them, so levels are grown by one pass each, open only
  such nodes, and end in the same tree as a queue of leaves.
* **Margins**: a column of the blocks, brought up to date after every round and checkpointed every ``KEEP`` rounds. The first
  pass of a round also scores the held-out rows of the round before, so a profit log costs nothing extra, and training can
  stop when a model's mean profit has not risen for ``patience`` rounds.
* **Tables** (``train_tables``): several tables with bins and models of their own (the outer folds of a nested validation)
  share the passes; a block names its table.
* **Models of fewer features** (``Job.features``): a model that may use some of its table's features only is trained in the
  same passes over the same bins as those that use all.
* **Whole models by single tasks** (``_apart``): a pass costs a Spark job, so many rounds over tables that fit into a task cost
  jobs and little else. There a task gets a table's blocks once and trains whole models (those that stop together) by the same
  steps; the models are dealt to the tasks.

Missing (NULL or NaN) values are a bin of their own; infinite ones are ordinary values. Rows with a missing label are not
trained on. Ties between splits go to the lower feature, then the lower cut, then missing values to the right. A table
without rows, or with one class, gives trees of one leaf at the base score.
"""

from __future__ import annotations

import heapq
import math
import sys
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from contactlift.operators.metrics import COST, CUTOFF, GAIN

# workers get this module's functions with the task, also where the package is not installed on them
register_pickle_by_value(sys.modules[__name__])

KEEP = 5
# A task that adds up histograms reads about so many bytes.
GATHER_BYTES = 16 << 20
# Sums of all tasks up to so many bytes are added up by the driver: a small pass then is one stage.
DRIVER_BYTES = 1 << 20
# The open nodes of a pass: as many as their histograms fit into this many bytes of a task.
MODEL_BYTES = 512 << 20
# A task sends its sums in batches of about so many bytes.
SEND_BYTES = 4 << 20
TASK_ROWS, TASK_BYTES = 4096, 64 << 20
# Quantiles are found by groups of so many features, in at most so many groups (Spark's object hash aggregate sorts above 128).
GROUP_FEATURES, MAX_GROUPS = 8, 64
# The sketches that a task holds at a time may take so many bytes, or are those of so few features; of a row, so many in each.
SKETCH_BYTES, FEW_FEATURES, SKETCH_ROW_BYTES = 48 << 20, 24, 40
# Runs of at least so many passes over tables of at most so many bytes of bins are done by tasks that train whole models.
APART_PASSES, APART_BYTES = 200, 16 << 20
# Such a task looks for the splits of so many bytes of histograms at a time.
SPLIT_BYTES = 4 << 20
# Rows are dealt in pieces of so many; a block holds the pieces of a task up to so many rows.
PIECE_ROWS, BLOCK_ROWS = 1024, 16384
_PIECE = StructType([StructField(c, IntegerType()) for c in ("table", "n")] + [StructField(c, BinaryType()) for c in ("bins", "y", "fold")])
_STATE = StructType([*_PIECE.fields, StructField("margins", BinaryType())])
_SUMS = StructType([StructField(c, IntegerType()) for c in ("key", "part")] + [StructField("sums", BinaryType())])
_FOUND = "key int, gain double, feature int, cut int, missing_left boolean, sums binary"
_COPY = StructType([StructField(c, IntegerType()) for c in ("task", "table", "n")] + [StructField("at", LongType())]
                   + [StructField(c, BinaryType()) for c in ("bins", "y", "fold")])
_MODEL = StructType([StructField("model", IntegerType()), StructField("trees", BinaryType()), StructField("log", BinaryType())])
# How a tree's nodes travel.
_NODE = np.dtype([("feature", "<i4"), ("cut", "<i2"), ("missing_left", "?"), ("left", "<i4"), ("right", "<i4"), ("depth", "<i2"),
                  ("sums", "<f8", 3), ("gain", "<f8"), ("value", "<f8")])


@dataclass(frozen=True)
class Params:
    """One parameter set. ``max_leaves`` None: no cap. ``l1``/``l2`` shrink leaf values; ``colsample`` is per tree."""

    rounds: int = 300
    eta: float = 0.04
    max_depth: int = 6
    max_leaves: int | None = None
    colsample: float = 1.0
    max_bin: int = 31
    min_rows: int = 1
    min_hessian: float = 1.0
    l1: float = 0.0
    l2: float = 1.0
    min_gain: float = 0.0
    seed: int = 102191


def profile_a(eta: float = 0.04, nrounds: int = 300, colsample_bytree: float = 0.6, max_depth: int = 6, l1: float = 0.0,
              l2: float = 1.0, min_gain: float = 0.0, seed: int = 102191) -> Params:
    """31 bins, depth 6, a hessian of at least 1 per leaf, L2 of 1; the default run's parameters."""
    return Params(nrounds, eta, max_depth, None, colsample_bytree, 31, 1, 1.0, l1, l2, min_gain, seed)


def profile_b(learning_rate: float = 0.0155, num_iterations: int = 300, feature_fraction: float = 0.33, max_depth: int = 6,
              min_data_in_leaf: int = 5, min_gain_to_split: float = 0.0, lambda_l1: float = 0.0, lambda_l2: float = 0.0,
              num_leaves: int = 1024, max_bin: int = 255, seed: int = 102191) -> Params:
    """255 bins, best-first growth up to 1024 leaves, at least 5 rows per leaf; ``max_depth`` is honoured."""
    return Params(num_iterations, learning_rate, max_depth, num_leaves, feature_fraction, max_bin, min_data_in_leaf, 1e-3, lambda_l1,
                  lambda_l2, min_gain_to_split, seed)


# --- binned rows ---------------------------------------------------------------------------------------------------

def _doubles(df: DataFrame, features: Sequence[str], sizes: dict[str, int]) -> list[tuple[str, str]]:
    """(name, SQL of its double value, missing as null) of every feature; an array column is one feature per element."""
    types = dict(df.dtypes)
    out = []
    for f in features:
        if types[f].startswith("array"):
            parts = [(f"{f}[{i}]", f"cast(get(`{f}`, {i}) as double)") for i in range(sizes[f])]
        else:
            parts = [(f, f"cast(`{f}` as double)")]
        out += [(name, f"nullif({x}, double('NaN'))") for name, x in parts]
    return out


@dataclass
class Binning:
    """Quantile cuts of each feature: bin 0 is missing, bin i holds the values above cut i - 2 up to cut i - 1."""

    features: list[str]
    sizes: dict[str, int]
    names: list[str]
    cuts: list[np.ndarray]
    rows: int
    max_bin: int

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str], max_bin: int) -> Binning:
        types = dict(df.dtypes)
        arrays = [f for f in features if types[f].startswith("array")]
        sizes = {a: int(n or 0) for a, n in zip(arrays, df.select(*[F.max(F.size(a)) for a in arrays]).first())} if arrays else {}
        named = _doubles(df, features, sizes)
        probs = ", ".join(repr(i / max_bin) for i in range(1, max_bin))
        # a row becomes one row per group of features, so the tasks' sketches of a group meet in a task of its own
        take = max(GROUP_FEATURES, math.ceil(len(named) / MAX_GROUPS))
        groups = [F.struct(F.lit(at).alias("at"), F.array(*[F.expr(x) for _, x in named[at:at + take]]).cast("array<double>").alias("x"))
                  for at in range(0, max(1, len(named)), take)]
        # a task holds the sketches of all features of an aggregate, each with up to 50,000 boxed values and as many samples
        rows = df.count() if len(named) > FEW_FEATURES else 0
        some = max(FEW_FEATURES // take, SKETCH_BYTES // (take * SKETCH_ROW_BYTES * min(rows, 50000)), 1) if rows else len(groups)
        found = {}
        for at in range(0, len(groups), some):
            each = df.select(F.explode(F.array(*groups[at:at + some])).alias("g")).groupBy("g.at").agg(F.count(F.lit(1)).alias("n"), *[
                F.expr(e).alias(f"{c}{i}") for i in range(min(take, len(named)))
                for c, e in (("q", f"percentile_approx(get(g.x, {i}), array({probs}), {40 * max_bin})"), ("m", f"max(get(g.x, {i}))"))])
            found.update({r["at"]: r for r in each.collect()})  # one row per group: at most max_bin numbers per feature
        none = {"n": 0, **{f"q{i}": None for i in range(take)}}
        cuts = []
        for i in range(len(named)):
            row, at = found.get(i - i % take, none), i % take
            cuts.append(np.unique(np.array([c for c in row[f"q{at}"] or [] if c < row[f"m{at}"]], float)))
        return cls(list(features), sizes, [n for n, _ in named], cuts, int(found.get(0, none)["n"]), max_bin)

    def places(self, features: Sequence[str]) -> np.ndarray:
        """Where the values of some of the features stand, in order."""
        wanted, of = set(features), [f for f in self.features for _ in range(self.sizes.get(f, 1))]
        return np.array([i for i, f in enumerate(of) if f in wanted], int)

    def columns(self, df: DataFrame) -> list:
        return [F.expr(x).alias(f"x{i}") for i, (_, x) in enumerate(_doubles(df, self.features, self.sizes))]

    def bins(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((len(self.cuts), batch.num_rows), np.uint8)
        for i, cuts in enumerate(self.cuts):
            column = batch[f"x{i}"]
            x = column.to_numpy(zero_copy_only=False).astype(float)
            out[i] = np.where(np.isnan(x), 0, 1 + np.searchsorted(cuts, x, "left"))
        return out


def pack(df: DataFrame, binning: Binning, label: str, folds: Sequence[str], bases: Sequence[float], table: int = 0) -> DataFrame:
    """Blocks of rows: table, bins, label (-1: missing), folds (-1: none), one margin per model (its base).

    Rows are binned where they stand, and pieces of binned rows are dealt to the tasks."""
    def pieces(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, PIECE_ROWS):
                batch = whole.slice(at, PIECE_ROWS)
                y = batch["y"].fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int8)
                held = np.array([batch[f"f{i}"].fill_null(-1).to_numpy(zero_copy_only=False) for i in range(len(folds))], "<i4")
                yield _block(table, batch.num_rows, (binning.bins(batch), y, held), _PIECE.names)

    def blocks(batches):
        held: list[tuple] = []
        for row in _rows(batches):
            n = row["n"]
            held.append((n, *(np.frombuffer(row[c], kind).reshape(-1, n) for c, kind in (("bins", np.uint8), ("y", np.int8), ("fold", "<i4")))))
            if sum(h[0] for h in held) >= BLOCK_ROWS:
                yield joined(held)
                held = []
        if held:
            yield joined(held)

    def joined(held):
        n = sum(h[0] for h in held)
        margins = np.repeat(np.array(bases, float)[:, None], n, axis=1)
        return _block(table, n, (*(np.concatenate([h[i] for h in held], axis=1) for i in (1, 2, 3)), margins), _STATE.names)

    per_task = max(1, min(TASK_ROWS if binning.rows < TASK_ROWS * df.sparkSession.sparkContext.defaultParallelism else
                          math.ceil(binning.rows / df.sparkSession.sparkContext.defaultParallelism),
                          TASK_BYTES // (len(binning.cuts) + 8 * len(bases) + 8)))
    rows = df.select(*binning.columns(df), F.col(label).cast("int").alias("y"),
                     *[F.col(c).cast("int").alias(f"f{i}") for i, c in enumerate(folds)])
    dealt = rows.mapInArrow(pieces, _PIECE).repartition(_even(math.ceil(binning.rows / per_task), df.sparkSession.sparkContext.defaultParallelism))
    return dealt.mapInArrow(blocks, _STATE)


def _even(tasks: int, cores: int) -> int:
    """At least so many tasks, and as many in the last wave as in the others."""
    return max(1, tasks if tasks <= cores else cores * math.ceil(tasks / cores))


def _block(table: int, n: int, parts: Sequence, names: Sequence[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (table, n)]
                                      + [pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in parts], list(names))


# --- trees -----------------------------------------------------------------------------------------------------------

@dataclass
class Tree:
    """Arrays over nodes; feature -1 is a leaf. A value is missing (bin 0) or goes left if its bin is at most ``cut``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    sums: list[np.ndarray] = field(default_factory=lambda: [np.zeros(3)])  # gradient, hessian, rows
    gain: list[float] = field(default_factory=lambda: [0.0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def arrays(self) -> tuple:
        return (np.array(self.feature), np.array(self.cut), np.array(self.missing_left), np.array(self.left), np.array(self.right),
                np.array(self.value), max(self.depth))

    def chosen(self, cap: int | None) -> set[int]:
        """The nodes that are split if splits are taken in order of gain until ``cap`` leaves."""
        out, queue = set(), [(-self.gain[0], 0)] if self.gain[0] > 0 else []
        while queue and (cap is None or len(out) < cap - 1):
            _, node = heapq.heappop(queue)
            out.add(node)
            for child in (self.left[node], self.right[node]):
                if child >= 0 and self.gain[child] > 0:
                    heapq.heappush(queue, (-self.gain[child], child))
        return out

    def grow(self, nodes: list[int], found: list[tuple | None], subset: np.ndarray, p: Params) -> None:
        """Note the best split of each open node, as ``best_splits`` gives it."""
        for node, best in zip(nodes, found):
            if best is not None and self.depth[node] < p.max_depth:
                gain, f, self.cut[node], self.missing_left[node], left = best
                self.gain[node], self.feature[node] = gain, int(subset[f])
                for sums, side in ((left, self.left), (self.sums[node] - left, self.right)):
                    side[node] = len(self.feature)
                    for column, x in ((self.feature, -1), (self.cut, 0), (self.missing_left, False), (self.left, -1), (self.right, -1),
                                      (self.depth, self.depth[node] + 1), (self.sums, sums), (self.gain, 0.0), (self.value, 0.0)):
                        column.append(x)

    def close(self, p: Params) -> None:
        """Splits beyond the cap become leaves; leaf values are Newton steps."""
        chosen = self.chosen(p.max_leaves)
        for node in range(len(self.feature)):
            if node not in chosen:
                self.feature[node], self.left[node], self.right[node], self.gain[node] = -1, -1, -1, 0.0
            g, h, _ = self.sums[node]
            self.value[node] = float(-p.eta * _shrunk(g, p.l1) / (h + p.l2)) if h + p.l2 > 0 else 0.0

    def nodes(self):
        """Nodes that are reached from the root, in order."""
        todo, out = [0], []
        while todo:
            node = todo.pop(0)
            out.append(node)
            if self.feature[node] >= 0:
                todo += [self.left[node], self.right[node]]
        return out


def _packed(trees: Sequence[Tree]) -> bytes:
    out = []
    for t in trees:
        x = np.zeros(len(t.feature), _NODE)
        for name in _NODE.names:
            x[name] = getattr(t, name)
        out.append(np.int32(len(x)).tobytes() + x.tobytes())
    return zlib.compress(b"".join(out), 1)


def _unpacked(b: bytes) -> list[Tree]:
    b, at, out = zlib.decompress(b), 0, []
    while at < len(b):
        n = int(np.frombuffer(b, np.int32, 1, at)[0])
        x = np.frombuffer(b, _NODE, n, at + 4)
        out.append(Tree(**{name: np.ascontiguousarray(x[name]) for name in _NODE.names}))
        at += 4 + n * _NODE.itemsize
    return out


def _shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0) if l1 else g


def best_splits(hists: np.ndarray, p: Params) -> list[tuple | None]:
    """(gain, feature, cut, missing go left, sums of the left side) of each node, or None.

    A cut above an empty bin splits as the one below it, which goes first in ties, so bins that hold rows are cut, and the
    lowest one, where missing values may stand alone; without missing values there is one direction."""
    below = np.cumsum(hists[:, :, 1:, :], axis=2)  # values up to each cut; missing ones to the right
    missing = hists[:, :, 0, :]
    total = below[:, 0, -1, :] + missing[:, 0]  # the same for every feature but for rounding: the first one's
    cuts = hists[:, :, 1:, 2] > 0
    cuts[:, :, 0] = True
    node, feature, cut = np.nonzero(cuts)  # by node, feature, cut
    left, absent = below[node, feature, cut], missing[node, feature]

    def score(s):
        h = s[..., 1] + p.l2
        return np.where(h > 0, _shrunk(s[..., 0], p.l1) ** 2 / np.where(h > 0, h, 1.0), 0.0)

    whole = score(total)
    most = max(p.min_rows, 0.5)
    best: list[tuple | None] = [None] * len(hists)
    both = np.flatnonzero(absent[:, 2] > 0)
    for side, at in ((False, slice(None)), (True, both)):
        own, l = node[at], left[at] + absent[at] if side else left
        r = total[own] - l
        gain = score(l) + score(r) - whole[own]
        small = (l[:, 2] < most) | (r[:, 2] < most) | (l[:, 1] < p.min_hessian) | (r[:, 1] < p.min_hessian)
        gain = np.where(small | ~(gain > max(p.min_gain, 1e-10)), 0.0, gain).round(12)
        ends = np.searchsorted(own, np.arange(len(hists) + 1))
        for n, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            if i < j:
                x = i + int(gain[i:j].argmax())
                if gain[x] > 0:
                    place = int(both[x]) if side else x
                    found = (float(gain[x]), int(feature[place]), int(cut[place]) + 1, side, l[x].copy())
                    if best[n] is None or (-found[0], *found[1:4]) < (-best[n][0], *best[n][1:4]):
                        best[n] = found
    return best


def walk(tree: tuple, bins: np.ndarray) -> np.ndarray:
    """The node that each row (column of ``bins``) ends in."""
    feature, cut, missing_left, left, right, _, depth = tree
    n, leaf, own = bins.shape[1], feature < 0, np.arange(len(feature))
    start = np.where(leaf, 0, feature) * n
    # with a missing value to the right, bins count from 1 and bin 0 wraps round to 255, beyond every cut
    low = np.where(missing_left, 0, 1).astype(np.uint8)
    last = np.where(leaf, 0, cut - low).astype(np.uint8)
    child = np.stack([np.where(leaf, own, right), np.where(leaf, own, left)], axis=1).ravel()
    flat, rows, node = bins.reshape(-1), np.arange(n), np.zeros(n, np.intp)
    for _ in range(depth):
        goes_left = flat[start[node] + rows] - low[node] <= last[node]
        node = child[2 * node + goes_left]
    return node


# --- passes -----------------------------------------------------------------------------------------------------------

@dataclass
class Job:
    """One model: trained on rows outside fold ``held`` (None: all rows) of the ``column``-th fold column, with some of the
    table's ``features`` (None: all). Models of a ``group`` stop together."""

    params: Params
    held: int | None = None
    group: int = 0
    column: int = 0
    features: Sequence[str] | None = None


@dataclass
class _Work:
    """What a pass does for one model, the ``place``-th of its table."""

    model: int
    table: int
    place: int
    held: int | None
    column: int
    score: bool = False
    tree: tuple | None = None  # unfinished tree
    slots: np.ndarray | None = None  # node -> place in the histogram, or -1
    subset: np.ndarray | None = None
    width: int = 0
    params: Params | None = None
    keys: list[int] = field(default_factory=list)  # of each place in the histogram


def _margins(row: dict, place: int) -> np.ndarray:
    n = row["n"]
    return np.frombuffer(row["margins"], "<f8", n, place * n * 8)


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):  # one by one, as a row is a block or a histogram
            yield batch.slice(i, 1).to_pylist()[0]


def _add(work: _Work, row: dict, cutoff: float, strict: bool, sums: dict) -> None:
    bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, row["n"])
    y = np.frombuffer(row["y"], np.int8)
    fold = np.frombuffer(row["fold"], "<i4").reshape(-1, row["n"])
    p = 1.0 / (1.0 + np.exp(-_margins(row, work.place)))
    own = np.ones(len(y), bool) if work.held is None else fold[work.column] != work.held
    if work.score:
        hit = ~own & ((p > cutoff) if strict else (p >= cutoff))
        points = np.where(y == 1, GAIN, -COST)
        sums["log"] = sums.get("log", 0) + np.array([points[hit & (y >= 0)].sum(), (~own).sum(), (hit & (y < 0)).sum()], np.int64)
    if work.tree is None:
        return
    slot = work.slots[walk(work.tree, bins)]
    at = np.flatnonzero(own & (y >= 0) & (slot >= 0))
    at = at if len(at) < len(y) else slice(None)  # all rows: as they stand
    width, size = work.width, len(work.keys) * work.width
    place = slot[at].astype(np.int64) * width
    g, h = (p - y)[at], (p * (1.0 - p))[at]
    hist = sums.setdefault("hist", np.zeros((3, len(work.subset), size)))
    for i, f in enumerate(work.subset.tolist()):
        code = place + bins[f][at]
        hist[0, i] += np.bincount(code, g, size)
        hist[1, i] += np.bincount(code, h, size)
        hist[2, i] += np.bincount(code, minlength=size)


def _sent(rows):
    """(key, bytes) rows in lists of about ``SEND_BYTES``: many models have many small sums."""
    held, size = [], 0
    for key, x in rows:
        held.append((key, x))
        size += len(x)
        if size >= SEND_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _pass(state: DataFrame, tasks: int, works: list[_Work], cutoff: float, strict: bool) -> tuple[dict, dict]:
    """({key of an open node: its best split and its sums}, {model: points, rows and missing labels of the held-out rows})."""
    schema = pa.schema([("key", pa.int32()), ("part", pa.int32()), ("sums", pa.binary())])
    mine: dict[int, list[_Work]] = {}
    for w in works:
        mine.setdefault(w.table, []).append(w)
    nodes = {key: (w.width, w.params) for w in works for key in w.keys}

    def task(batches):
        from pyspark import TaskContext

        part, sums = TaskContext.get().partitionId(), {}
        for row in _rows(batches):
            for i, w in enumerate(mine.get(row["table"], ())):
                _add(w, row, cutoff, strict, sums.setdefault((row["table"], i), {}))
        for held in _sent((key, x) for (table, i), s in sums.items() for key, x in each(mine[table][i], s)):
            yield pa.RecordBatch.from_arrays([pa.array([key for key, _ in held], pa.int32()), pa.array([part] * len(held), pa.int32()),
                                              pa.array([x for _, x in held], pa.binary())], schema=schema)

    def each(w, s):
        if "log" in s:
            yield -1 - w.model, s["log"].tobytes()
        if "hist" in s:
            hist = s["hist"].reshape(3, len(w.subset), len(w.keys), w.width)
            for n, key in enumerate(w.keys):
                yield key, hist[:, :, n].tobytes()

    def split(key, total):
        if key < 0:
            return {"key": key, "sums": total.tobytes()}
        width, p = nodes[key]
        hist = total.reshape(3, -1, width).transpose(1, 2, 0)
        best, sums = best_splits(hist[None], p)[0], hist[0].sum(axis=0).tobytes()
        if best is None:
            return {"key": key, "sums": sums}
        gain, f, cut, missing_left, left = best
        return {"key": key, "gain": gain, "feature": f, "cut": cut, "missing_left": missing_left, "sums": sums + left.tobytes()}

    found_schema = pa.schema([("key", pa.int32()), ("gain", pa.float64()), ("feature", pa.int32()), ("cut", pa.int32()),
                              ("missing_left", pa.bool_()), ("sums", pa.binary())])

    def added(rows):  # rows come by key, then part
        last, total = None, None
        for row in rows:
            x = np.frombuffer(row["sums"], np.int64 if row["key"] < 0 else "<f8")
            if row["key"] != last and total is not None:
                yield split(last, total)
            total = total + x if row["key"] == last else x
            last = row["key"]
        if total is not None:
            yield split(last, total)

    def join(batches):
        yield pa.RecordBatch.from_pylist([*added(_rows(batches))], found_schema)

    partial = state.mapInArrow(task, _SUMS)
    bytes_ = sum(24 * len(w.subset) * len(w.keys) * w.width for w in works if w.tree is not None)
    if tasks * bytes_ <= DRIVER_BYTES:
        rows = added(sorted(partial.toArrow().to_pylist(), key=lambda r: (r["key"], r["part"])))
    else:
        groups = max(1, min(len(nodes), math.ceil(tasks * bytes_ / GATHER_BYTES)))
        # a node's sums meet in one task; repartitionById takes the task's number as it is
        dealt = partial.repartitionById(groups, F.pmod("key", F.lit(groups))).sortWithinPartitions("key", "part")
        rows = dealt.mapInArrow(join, _FOUND).toArrow().to_pylist()
    found, logs = {}, {}
    for r in rows:  # one row per open node
        if r["key"] < 0:
            logs[-1 - r["key"]] = np.frombuffer(r["sums"], np.int64)
        else:
            sums = np.frombuffer(r["sums"], "<f8")
            best = None if r.get("gain") is None else (r["gain"], r["feature"], r["cut"], r["missing_left"], sums[3:].copy())
            found[r["key"]] = best, sums[:3].copy()
    return found, logs


def _advanced(state: DataFrame, ended: dict[tuple[int, int], tuple], keep: bool) -> DataFrame:
    """The blocks with the trees that ended this round in the margins; ``ended``: (table, place) -> tree."""
    mine: dict[int, dict[int, tuple]] = {}
    for (table, place), tree in ended.items():
        mine.setdefault(table, {})[place] = tree

    def task(batches):
        for row in _rows(batches):
            bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, row["n"])
            m = np.frombuffer(row["margins"], "<f8").reshape(-1, row["n"]).copy()
            for place, tree in mine.get(row["table"], {}).items():
                m[place] += tree[5][walk(tree, bins)]
            yield _block(row["table"], row["n"], (row["bins"], row["y"], row["fold"], m), _STATE.names)

    out = state.mapInArrow(task, _STATE)
    return (out.checkpoint(eager=True) if keep else out).persist(StorageLevel.MEMORY_AND_DISK)


# --- training ------------------------------------------------------------------------------------------------------------

@dataclass
class Boosted:
    """A trained model. ``predict`` has the form of the MLlib path's, so model jobs take either."""

    params: Params
    binning: Binning
    base: float
    trees: list[Tree]

    def predict(self, df: DataFrame, id_col: str = "id_cliente", keep: Sequence[str] = (), name: str = "prob",
                rounds: int | None = None) -> DataFrame:
        """(id, kept columns, probability of the positive class) after the first ``rounds`` trees (all)."""
        trees = [t.arrays() for t in self.trees[:rounds]]
        binning, base, carried = self.binning, self.base, [id_col, *[c for c in keep if c != id_col]]
        rows = df.select(*[F.col(c) for c in carried], *binning.columns(df))

        def task(batches):
            for batch in batches:
                bins = binning.bins(batch)
                m = np.full(batch.num_rows, base)
                for t in trees:
                    m += t[5][walk(t, bins)]
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in carried], pa.array(1.0 / (1.0 + np.exp(-m)))], [*carried, name])

        kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried]
        return rows.mapInArrow(task, ", ".join([*kinds, f"`{name}` double"]))

    def nodes_frame(self, spark: SparkSession) -> DataFrame:
        """One row per node of each tree: split or leaf value, gain, cover (sum of hessians) and rows."""
        names, cuts = self.binning.names, self.binning.cuts
        rows = []
        for k, t in enumerate(self.trees):
            for i in t.nodes():
                f = int(t.feature[i])
                # beyond the last cut lie all values: the split is by missing values alone
                cut = None if f < 0 else float(cuts[f][t.cut[i] - 1]) if t.cut[i] <= len(cuts[f]) else math.inf
                rows.append((k, int(i), int(t.depth[i]), names[f] if f >= 0 else None, cut, bool(t.missing_left[i]) if f >= 0 else None,
                             int(t.left[i]) if f >= 0 else None, int(t.right[i]) if f >= 0 else None,
                             float(t.gain[i]) if f >= 0 else None, float(t.sums[i][1]), int(round(t.sums[i][2])), None if f >= 0 else float(t.value[i])))
        return spark.createDataFrame(rows, "tree int, node int, depth int, feature string, cut double, missing_left boolean, left int, "
                                           "right int, gain double, cover double, rows long, value double")

    def importance_frame(self, spark: SparkSession) -> DataFrame:
        """Shares of gain, cover and frequency per feature that is used, by sums over the trees' nodes."""
        each = self.nodes_frame(spark).where("feature is not null").groupBy("feature").agg(
            F.sum("gain").alias("gain"), F.sum("cover").alias("cover"), F.count(F.lit(1)).alias("splits"))
        total = each.agg(F.sum("gain").alias("all_gain"), F.sum("cover").alias("all_cover"), F.sum("splits").alias("all_splits"))
        # one row of totals
        return each.join(F.broadcast(total)).select("feature", (F.col("gain") / F.col("all_gain")).alias("gain"),
                                                    (F.col("cover") / F.col("all_cover")).alias("cover"),
                                                    (F.col("splits") / F.col("all_splits")).alias("frequency"))


def predict_together(models: Sequence[Boosted], names: Sequence[str], df: DataFrame, id_col: str = "id_cliente",
                     keep: Sequence[str] = (), of: Sequence[str] = ()) -> DataFrame:
    """(id, kept columns, one column of probabilities per model) of models that share one binning, whose rows are binned once.

    ``of`` names for each model the kept column that is 1 in the rows it scores; it is null in the others."""
    binning, carried = models[0].binning, [id_col, *[c for c in keep if c != id_col]]
    each = [(m.base, [t.arrays() for t in m.trees]) for m in models]
    rows = df.select(*[F.col(c) for c in carried], *binning.columns(df))

    def task(batches):
        for batch in batches:
            bins, out = binning.bins(batch), []
            mine = {c: batch[c].fill_null(0).to_numpy(zero_copy_only=False) == 1 for c in set(of)}
            for i, (base, trees) in enumerate(each):
                own = mine[of[i]] if of else np.ones(batch.num_rows, bool)
                some = np.ascontiguousarray(bins[:, own]) if of else bins
                m = np.full(some.shape[1], base)
                for t in trees:
                    m += t[5][walk(t, some)]
                prob = np.zeros(batch.num_rows)
                prob[own] = 1.0 / (1.0 + np.exp(-m))
                out.append(pa.array(prob, mask=~own))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in carried], *out], [*carried, *names])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried]
    return rows.mapInArrow(task, ", ".join([*kinds, *[f"`{n}` double" for n in names]]))


def _base(ones: int, n: int) -> float:
    return math.log(ones / (n - ones)) if 0 < ones < n else 0.0


def _bases(df: DataFrame, jobs: Sequence[Job], label: str, folds: Sequence[str]) -> list[float]:
    """The log-odds of each model's training rows, by one aggregate."""
    y = F.col(label).cast("int")
    parts = sorted({(j.column, j.held) for j in jobs if j.held is not None})
    own = [y, *[F.when(F.coalesce(F.col(folds[c]).cast("int") != held, F.lit(True)), y) for c, held in parts]]
    row = df.agg(*[x for i, e in enumerate(own) for x in (F.sum(e).alias(f"s{i}"), F.count(e).alias(f"n{i}"))]).first()
    place = {key: i + 1 for i, key in enumerate(parts)}
    at = [0 if j.held is None else place[j.column, j.held] for j in jobs]
    return [_base(int(row[f"s{i}"] or 0), int(row[f"n{i}"])) for i in at]


def train(df: DataFrame, features: Sequence[str], jobs: Sequence[Job], label: str = "clase01", folds: Sequence[str] = (),
          cutoff: float = CUTOFF, relative: bool = True, strict: bool = False, patience: int | None = None,
          binning: Binning | None = None) -> tuple[list[Boosted], list[tuple[int, int, float | None]]]:
    """Train all ``jobs`` over one binned copy of ``df``; also (model, round, profit on its held-out fold).

    With ``patience``, a group of models stops once the mean profit of its models has not risen for so many rounds; it then
    has ``patience`` trees beyond its best round and no more. Models without a held-out fold train all their rounds.
    ``folds`` names columns of fold numbers; ``Job.column`` counts them.
    """
    return train_tables([Table(df, features, jobs, folds, binning)], label, cutoff, relative, strict, patience)[0]


@dataclass
class Table:
    """A table to train on, with its features, models, fold columns and bins (None: fitted on it)."""

    df: DataFrame
    features: Sequence[str]
    jobs: Sequence[Job]
    folds: Sequence[str] = ()
    binning: Binning | None = None


def train_tables(tables: Sequence[Table], label: str = "clase01", cutoff: float = CUTOFF, relative: bool = True, strict: bool = False,
                 patience: int | None = None) -> list[tuple[list[Boosted], list[tuple[int, int, float | None]]]]:
    """What ``train`` returns, for each of several tables whose models are all trained in the same passes."""
    models: list[Boosted] = []
    jobs: list[Job] = []
    at: list[tuple[int, int]] = []  # a model's table and its place there
    packs = []
    for t, x in enumerate(tables):
        if not x.jobs:
            continue
        binning = x.binning or Binning.fit(x.df, x.features, max(j.params.max_bin for j in x.jobs))
        bases = _bases(x.df, x.jobs, label, x.folds)
        models += [Boosted(j.params, binning, base, []) for j, base in zip(x.jobs, bases)]
        jobs += [replace(j, group=(t, j.group)) for j in x.jobs]
        at += [(t, i) for i in range(len(x.jobs))]
        packs.append(pack(x.df, binning, label, list(x.folds), bases, t))
    log = _boost(packs, models, jobs, at, cutoff, relative, strict, patience) if packs else []
    out: list[tuple[list, list]] = [([], []) for _ in tables]
    for m, (t, _) in enumerate(at):
        out[t][0].append(models[m])
    for m, k, value in log:
        out[at[m][0]][1].append((at[m][1], k, value))
    return out


def _boost(packs, models, jobs, at, cutoff, relative, strict, patience) -> list[tuple[int, int, float | None]]:
    """Trains ``models``; returns the log."""
    state = reduce(DataFrame.union, packs).checkpoint(eager=True)
    usable = [np.arange(len(m.binning.names)) if j.features is None else m.binning.places(j.features) for m, j in zip(models, jobs)]
    widths = [m.binning.max_bin + 1 for m in models]
    if max(j.params.rounds * j.params.max_depth for j in jobs) >= APART_PASSES:
        size = {r["table"]: r["size"] for r in state.groupBy("table").agg(F.sum(F.length("bins")).alias("size")).collect()}  # one row per table
        # a table without rows sends no blocks to a task
        if all(0 < size.get(t, 0) <= APART_BYTES for t, _ in at):
            return _apart(state, models, jobs, at, usable, widths, cutoff, relative, strict, patience)
    trees, log = _grown(_Passes(state), jobs, at, usable, widths, cutoff, relative, strict, patience)
    for m, grown in zip(models, trees):
        m.trees += grown
    return log


class _Passes:
    """Passes over the blocks by all tasks."""

    def __init__(self, state: DataFrame):
        self.state = state.persist(StorageLevel.MEMORY_AND_DISK)
        self.tasks = state.rdd.getNumPartitions()
        self.old: list[DataFrame] = []  # blocks of earlier rounds, dropped when the next round's are there

    def passed(self, works: list[_Work], cutoff: float, strict: bool) -> tuple[dict, dict]:
        found, points = {}, {}
        for some in _batches(works):
            new, logs = _pass(self.state, self.tasks, some, cutoff, strict)
            found.update(new)
            points.update(logs)
        for frame in self.old:  # this round's blocks are there now
            frame.unpersist()
        self.old = []
        return found, points

    def advance(self, ended: dict[tuple[int, int], Tree], keep: bool) -> None:
        self.old = [self.state]
        self.state = _advanced(self.state, {place: tree.arrays() for place, tree in ended.items()}, keep)

    def close(self) -> None:
        for frame in [*self.old, self.state]:
            frame.unpersist()


class _Whole:
    """The same over one table's rows in the memory of a task."""

    def __init__(self, row: dict, bases: Sequence[float]):
        self.row = {**row, "margins": np.repeat(np.array(bases, float)[:, None], row["n"], axis=1)}

    def passed(self, works: list[_Work], cutoff: float, strict: bool) -> tuple[dict, dict]:
        found, points = {}, {}
        for w in works:
            sums: dict = {}
            _add(w, self.row, cutoff, strict, sums)
            if "log" in sums:
                points[w.model] = sums["log"]
            if "hist" in sums:
                hist = sums["hist"].reshape(3, len(w.subset), len(w.keys), w.width).transpose(2, 1, 3, 0)
                take = max(1, SPLIT_BYTES // (24 * len(w.subset) * w.width))
                for i in range(0, len(w.keys), take):
                    some = np.ascontiguousarray(hist[i:i + take])
                    found.update(zip(w.keys[i:i + take], zip(best_splits(some, w.params), some[:, 0].sum(axis=1))))
        return found, points

    def advance(self, ended: dict[tuple[int, int], Tree], keep: bool) -> None:
        bins = self.row["bins"].reshape(-1, self.row["n"])
        for (_, place), tree in ended.items():
            tree = tree.arrays()
            self.row["margins"][place] += tree[5][walk(tree, bins)]

    def close(self) -> None:
        pass


def _apart(state, models, jobs, at, usable, widths, cutoff, relative, strict, patience) -> list[tuple[int, int, float | None]]:
    """``_boost`` by tasks that each train whole models; with ``patience`` those of a group stay together, as they stop together."""
    groups: dict = {}
    for m, j in enumerate(jobs):
        groups.setdefault(m if patience is None else j.group, []).append(m)
    work = {g: sum(jobs[m].params.rounds * jobs[m].params.colsample * len(usable[m]) for m in some) for g, some in groups.items()}
    tasks = min(len(groups), state.sparkSession.sparkContext.defaultParallelism)
    load = [(0.0, t) for t in range(tasks)]
    dealt: list[dict[int, list[list[tuple]]]] = [{} for _ in range(tasks)]  # of a task: table -> groups of models
    for g in sorted(groups, key=lambda g: -work[g]):
        so_far, t = heapq.heappop(load)
        heapq.heappush(load, (so_far + work[g], t))
        dealt[t].setdefault(at[groups[g][0]][0], []).append(
            [(m, replace(jobs[m], features=None), usable[m], widths[m], models[m].base) for m in groups[g]])

    def copies(batches):
        for row in _rows(batches):
            for t in range(tasks):
                if row["table"] in dealt[t]:
                    yield pa.RecordBatch.from_pylist([{**row, "task": t}], copy_schema)

    def blocks_of(batches):  # rows come by table, then place
        held: list[dict] = []
        for row in _rows(batches):
            if held and held[0]["table"] != row["table"]:
                yield held
                held = []
            held.append(row)
        if held:
            yield held

    def train(batches):
        for held in blocks_of(batches):
            n = sum(b["n"] for b in held)
            whole = {c: np.ascontiguousarray(np.concatenate([np.frombuffer(b[c], kind).reshape(-1, b["n"]) for b in held], axis=1))
                     for c, kind in (("bins", np.uint8), ("y", np.int8), ("fold", "<i4"))}
            for some in dealt[held[0]["task"]][held[0]["table"]]:
                run = _Whole({**whole, "table": held[0]["table"], "n": n}, [base for *_, base in some])
                trees, log = _grown(run, [j for _, j, *_ in some], [(held[0]["table"], i) for i in range(len(some))],
                                    [u for _, _, u, *_ in some], [w for *_, w, _ in some], cutoff, relative, strict, patience)
                for i, (m, *_) in enumerate(some):
                    own = np.array([(k, math.nan if v is None else v) for i_, k, v in log if i_ == i], float)
                    yield pa.RecordBatch.from_pylist([{"model": m, "trees": _packed(trees[i]), "log": own.tobytes()}], model_schema)

    copy_schema = pa.schema([(c, pa.int32()) for c in ("task", "table", "n")] + [("at", pa.int64())] + [(c, pa.binary()) for c in ("bins", "y", "fold")])
    model_schema = pa.schema([("model", pa.int32()), ("trees", pa.binary()), ("log", pa.binary())])
    sent = state.select("table", "n", F.monotonically_increasing_id().alias("at"), "bins", "y", "fold").mapInArrow(copies, _COPY)
    done = (sent.repartitionById(tasks, F.col("task")).sortWithinPartitions("table", "at").mapInArrow(train, _MODEL).checkpoint(eager=True))
    logs: dict[int, np.ndarray] = {}
    for r in done.toLocalIterator():  # one task's models at a time
        models[r["model"]].trees += _unpacked(bytes(r["trees"]))
        logs[r["model"]] = np.frombuffer(bytes(r["log"]), float).reshape(-1, 2)
    return [(m, int(k), None if math.isnan(v) else float(v)) for m in sorted(logs) for k, v in logs[m].tolist()]


def _grown(run: _Passes | _Whole, jobs, at, usable, widths, cutoff, relative, strict, patience) -> tuple[list[list[Tree]], list[tuple[int, int, float | None]]]:
    """The trees of each model, and the log."""
    done: list[list[Tree]] = [[] for _ in jobs]
    log: list[tuple[int, int, float | None]] = []
    curves: dict = {}
    active = [m for m, j in enumerate(jobs) if j.params.rounds > 0]
    done_at = {m: jobs[m].params.rounds for m in range(len(jobs))}
    k = 0
    while active:
        growing = [m for m in active if k < done_at[m]]
        subsets, trees, opened = {}, {}, {}
        for m in growing:
            n_features = len(usable[m])
            rng = np.random.default_rng([jobs[m].params.seed & 0xFFFFFFFF, k])
            take = max(1, round(jobs[m].params.colsample * n_features))
            subsets[m] = usable[m][np.sort(rng.choice(n_features, take, replace=False))]
            trees[m], opened[m] = Tree(), [0]
        level = 0
        while True:
            asked = [m for m in growing if opened.get(m)]
            works, spot = [], 0
            for m in active if level == 0 else asked:
                score = level == 0 and k > 0 and jobs[m].held is not None
                base = _Work(m, *at[m], jobs[m].held, jobs[m].column)
                if score:
                    works.append(replace(base, score=True))
                if m in asked:
                    tree, p = trees[m], jobs[m].params
                    most = max(1, MODEL_BYTES // (24 * len(subsets[m]) * widths[m]))
                    for i in range(0, len(opened[m]), most):
                        some = opened[m][i:i + most]
                        slots = np.full(len(tree.feature), -1)
                        slots[some] = np.arange(len(some))
                        works.append(replace(base, tree=tree.arrays(), slots=slots, subset=subsets[m], width=widths[m], params=p,
                                             keys=list(range(spot, spot + len(some)))))
                        spot += len(some)
            if not works:
                break
            found, points = run.passed(works, cutoff, strict)
            keys = {m: {} for m in asked}
            for w in works:
                for node, slot in enumerate(w.slots.tolist() if w.tree is not None else []):
                    if slot >= 0:
                        keys[w.model][node] = w.keys[slot]
            if level == 0:
                for m, (pts, n, miss) in sorted(points.items()):
                    value = None if miss or not n else float(pts) / float(n) if relative else float(pts)
                    log.append((m, k, value))
                stopped = _stopped(jobs, points, log, curves, k, patience)
                asked = [m for m in asked if jobs[m].group not in stopped]
                growing = [m for m in growing if jobs[m].group not in stopped]
                for m in active:
                    if jobs[m].group in stopped:
                        done_at[m] = k
                active = [m for m in active if k < done_at[m] and jobs[m].group not in stopped]
            for m in asked:
                opened[m] = _level(trees[m], opened[m], [found.get(keys[m][i], _NONE) for i in opened[m]], subsets[m], jobs[m].params)
            level += 1
        for m in growing:
            trees[m].close(jobs[m].params)
            done[m].append(trees[m])
        k += 1
        active = [m for m in active if k < done_at[m] or (k == done_at[m] and jobs[m].held is not None)]
        if active:
            run.advance({at[m]: trees[m] for m in active if m in trees}, k % KEEP == 0)
    run.close()
    return done, log


def _batches(works: list[_Work]) -> list[list[_Work]]:
    """Works in order, cut where their histograms would exceed ``MODEL_BYTES``."""
    out: list[list[_Work]] = [[]]
    size = 0
    for w in works:
        need = 24 * len(w.subset) * len(w.keys) * w.width if w.tree is not None else 0
        if out[-1] and need and size + need > MODEL_BYTES and size:
            out.append([])
            size = 0
        out[-1].append(w)
        size += need
    return out


_NONE = None, np.zeros(3)  # of a table without rows


def _level(tree: Tree, opened: list[int], found: list[tuple], subset: np.ndarray, p: Params) -> list[int]:
    """Split the open nodes, of which ``found`` has the best split and the sums; returns the nodes to open next."""
    if opened == [0]:
        tree.sums[0] = found[0][1]
    tree.grow(opened, [best for best, _ in found], subset, p)
    chosen = tree.chosen(p.max_leaves)
    return [child for i in opened if i in chosen and tree.depth[i] + 1 < p.max_depth for child in (tree.left[i], tree.right[i])]


def _stopped(jobs, points, log, curves, k, patience) -> set[int]:
    """Groups whose mean profit has not risen for ``patience`` rounds; ``curves`` keeps the means."""
    out = set()
    if patience is None or not points:
        return out
    for group in {jobs[m].group for m in points}:
        values = [v for m, r, v in log if r == k and jobs[m].group == group]
        curve = curves.setdefault(group, [])
        curve.append(-math.inf if any(v is None for v in values) else sum(values) / len(values))
        if len(curve) - 1 - int(np.argmax(curve)) >= patience:
            out.add(group)
    return out


def fit(df: DataFrame, features: Sequence[str], params: Params, label: str = "clase01") -> Boosted:
    """One model trained on all rows."""
    return train(df, features, [Job(params)], label)[0][0]
