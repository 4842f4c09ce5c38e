"""Leaf-wise boosting on binned features: histograms as partial sums of tasks, the best leaf first.

A leaf's best split depends on its own rows only. So a tree is grown level by level, one job for all leaves of a level,
and afterwards the splits are taken best first until the wanted number of leaves: the same tree as one grown leaf by
leaf, in as many jobs as it has levels. Rows are packed into blocks of bin numbers once; the driver holds edges and trees.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..scratch import Scratch

#: Bytes of sums that a task gathers before it hands them on.
HELD_BYTES = 1 << 26


@dataclass(frozen=True)
class Settings:
    """Of the trees; cat_smooth and cat_l2 for the order of categories and their splits."""

    leaves: int = 127
    depth: int = 8
    rate: float = 0.03
    least_rows: int = 35
    l1: float = 0.15
    l2: float = 0.2
    least_gain: float = 0.01
    least_curvature: float = 1e-3
    columns: float = 0.85
    bins: int = 255
    cat_smooth: float = 10.0
    cat_l2: float = 10.0
    cat_most: int = 32
    focal: tuple[float, float] | None = None  # alpha and gamma; else the logistic loss
    seed: int = 42


@dataclass
class Bins:
    """Bin numbers of columns: 0 for missing values, from 1 on between edges or by category."""

    numeric: dict[str, np.ndarray]
    categories: dict[str, list[str]]

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.categories]

    @property
    def width(self) -> int:
        return 2 + max([len(v) for v in (*self.numeric.values(), *self.categories.values())], default=0)

    def encode(self, frame: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(frame), len(self.names)), np.uint8)
        for j, (name, edges) in enumerate(self.numeric.items()):
            x = frame[name].to_numpy("f8", na_value=np.nan)
            out[:, j] = np.where(np.isnan(x), 0, 1 + np.searchsorted(edges, x, "left"))
        for j, (name, values) in enumerate(self.categories.items(), len(self.numeric)):
            out[:, j] = frame[name].map({v: i for i, v in enumerate(values, 1)}).fillna(0).to_numpy("u1")
        return out


@dataclass
class Tree:
    """Arrays by node; feature is -1 for a leaf. left_bins are the bins that go left; rows is how many fitted rows passed."""

    feature: list[int] = field(default_factory=lambda: [-1])
    left_bins: list[np.ndarray | None] = field(default_factory=lambda: [None])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, left_bins: np.ndarray, gain: float, sides: list[tuple[float, int]]) -> tuple[int, int]:
        self.feature[node], self.left_bins[node], self.gain[node] = feature, left_bins, gain
        kids = len(self.feature), len(self.feature) + 1
        self.left[node], self.right[node] = kids
        for value, rows in sides:
            for column, x in ((self.feature, -1), (self.left_bins, None), (self.left, -1), (self.right, -1), (self.value, value), (self.rows, rows), (self.gain, 0.0)):
                column.append(x)
        return kids

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of bin numbers."""
        at, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            at[rows] = node
            if self.feature[node] >= 0 and len(rows):
                goes = self.left_bins[node][x[rows, self.feature[node]]]
                todo += (self.left[node], rows[goes]), (self.right[node], rows[~goes])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.place(x)]

    def pruned(self, leaves: int) -> Tree:
        """The splits of largest gain that hang together from the root, first ones first."""
        out, queue = Tree(value=[self.value[0]], rows=[self.rows[0]]), []
        push = lambda old, new: self.feature[old] >= 0 and heapq.heappush(queue, (-self.gain[old], old, new))
        push(0, 0)
        while queue and leaves > 1:
            _, old, new = heapq.heappop(queue)
            sides = [(self.value[k], self.rows[k]) for k in (self.left[old], self.right[old])]
            kids = out.split(new, self.feature[old], self.left_bins[old], self.gain[old], sides)
            push(self.left[old], kids[0]), push(self.right[old], kids[1])
            leaves -= 1
        return out


@dataclass
class Boosted:
    bins: Bins
    start: float
    trees: list[Tree]

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def first(self, rounds: int) -> Boosted:
        return replace(self, trees=self.trees[:rounds])


def quantile_bins(df: DataFrame, numeric: list[str], categorical: list[str], bins: int) -> Bins:
    """Edges between approximate quantiles, at most bins - 1 a column; the most frequent categories, rarer ones count as missing."""
    cuts = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    row = df.agg(*[F.percentile_approx(number(c), cuts, F.lit(100 * bins)).alias(f"q{i}") for i, c in enumerate(numeric)]).first() if numeric else ()
    edges = {c: np.unique(np.array(q if q is not None else [], "f8")) for c, q in zip(numeric, row)}
    most = lambda c: df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(bins - 1).collect()
    return Bins(edges, {c: [r["v"] for r in most(c)] for c in categorical})


BLOCK = "x binary, y binary, w binary, held binary, margin binary"
_BLOCK = pa.schema([(c.split()[0], pa.binary()) for c in BLOCK.split(", ")])


#: Rows that a task goes through, at least.
TASK_ROWS = 100_000


def packed(df: DataFrame, bins: Bins, label: str, weight: Column, held: Column, start: float) -> DataFrame:
    """Rows as blocks of bin numbers, labels, weights and margins; a null weight or a held-out row isn't fitted on."""
    tasks = df.count() // TASK_ROWS + 1
    rows = df.coalesce(tasks).select(*inputs(bins), F.col(label).cast("double").alias("__y"), weight.cast("double").alias("__w"), F.coalesce(held, F.lit(False)).alias("__held"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                f = b.to_pandas()
                data = (bins.encode(f), f["__y"].to_numpy("f8"), f["__w"].to_numpy("f8", na_value=np.nan), f["__held"].to_numpy("u1"), np.full(len(f), start))
                yield pa.RecordBatch.from_pylist([dict(zip(_BLOCK.names, (np.ascontiguousarray(a).tobytes() for a in data)))], _BLOCK)

    return rows.mapInArrow(pack, BLOCK)


def _unpacked(b: pa.RecordBatch, columns: int) -> Iterator[tuple[np.ndarray, ...]]:
    for r in b.to_pylist():
        x = np.frombuffer(r["x"], np.uint8).reshape(-1, columns)
        yield x, np.frombuffer(r["y"]), np.frombuffer(r["w"]), np.frombuffer(r["held"], np.uint8).astype(bool), np.frombuffer(r["margin"])


def slopes(y: np.ndarray, margin: np.ndarray, focal: tuple[float, float] | None) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the logistic loss, or of the focal loss -a (1 - q)^gamma log q; curvatures stay above 0."""
    p = 1 / (1 + np.exp(-margin))
    if focal is None:
        return p - y, np.maximum(p * (1 - p), 1e-16)
    alpha, gamma = focal
    p = np.clip(p, 1e-6, 1 - 1e-6)
    q = np.where(y == 1, p, 1 - p)  # the chance given to what happened
    a, log_q = np.where(y == 1, alpha, 1 - alpha), np.log(q)
    inner = gamma * q * log_q - (1 - q)
    bend = (1 - q) ** gamma * (gamma * (log_q + 1) + 1) - gamma * (1 - q) ** (gamma - 1) * inner
    return a * (1 - q) ** gamma * inner * np.where(y == 1, 1, -1), np.maximum(a * bend * q * (1 - q), 1e-6)


def _shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def leaf_value(g: float, h: float, s: Settings, more_l2: float = 0.0) -> float:
    return float(-_shrunk(g, s.l1) / (h + s.l2 + more_l2) * s.rate)


def best_split(sums: np.ndarray, category: bool, s: Settings) -> tuple[float, np.ndarray] | None:
    """(gain, bins that go left) of one leaf and feature; sums holds gradient, curvature and rows by bin, missing first.

    Numbers part at an edge, missing ones on the better side. Categories are put in order of gradient over curvature; a
    few of either end go left, missing and unseen ones never do.
    """
    total, l2 = sums.sum(0), s.l2 + (s.cat_l2 if category else 0.0)
    score = lambda x: _shrunk(x[..., 0], s.l1) ** 2 / (x[..., 1] + l2)
    parent = _shrunk(total[0], s.l1) ** 2 / (total[1] + s.l2)
    choices = []
    if category:
        known = 1 + np.flatnonzero(sums[1:, 2] > 0)
        known = known[np.argsort(sums[known, 0] / (sums[known, 1] + s.cat_smooth), kind="stable")]
        for order in (known, known[::-1]):
            choices.append((np.cumsum(sums[order[: s.cat_most]], 0), lambda k, o=order: o[: k + 1]))
    else:
        steps = np.cumsum(sums[1:], 0)
        choices.append((steps, lambda k: np.arange(1, k + 2)))
        if sums[0, 2]:
            choices.append((steps + sums[0], lambda k: np.arange(k + 2)))
    best = None
    for left, bins_of in choices:
        right = total - left
        ok = np.ones(len(left), bool)
        for side in (left, right):
            ok &= (side[:, 2] >= s.least_rows) & (side[:, 1] >= s.least_curvature)
        if not ok.any():
            continue
        gain = np.where(ok, score(left) + score(right) - parent, -np.inf)
        k = int(np.argmax(gain))
        if gain[k] > s.least_gain and (best is None or gain[k] > best[0]):
            goes = np.zeros(len(sums), bool)
            goes[bins_of(k)] = True
            best = float(gain[k]), goes
    return best


SUMS = "node int, feature int, sums binary"
SPLIT = "node int, feature int, gain double, goes binary, sides binary"
_SUMS = pa.schema([("node", pa.int32()), ("feature", pa.int32()), ("sums", pa.binary())])
_SPLIT = pa.schema([("node", pa.int32()), ("feature", pa.int32()), ("gain", pa.float64()), ("goes", pa.binary()), ("sides", pa.binary())])


def level_splits(blocks: DataFrame, bins: Bins, trees: list[Tree], tree: Tree, open_: list[int], columns: list[int], s: Settings) -> list:
    """The best split of each open leaf of the tree: one pass over the blocks and sums by leaf and feature.

    What comes back is a row for each leaf and feature that can split it, bounded by the tree, not by the rows.
    """
    width, count = bins.width, len(bins.names)
    where = np.full(len(tree.feature), -1)
    where[open_] = np.arange(len(open_))
    size = len(open_) * len(columns) * width * 3

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, seen = np.zeros((len(open_), len(columns), width, 3)), False

        def out() -> pa.RecordBatch:
            rows = [{"node": open_[i], "feature": f, "sums": acc[i, j].tobytes()} for i in range(len(open_)) if acc[i, 0, :, 2].any() for j, f in enumerate(columns)]
            return pa.RecordBatch.from_pylist(rows, _SUMS)

        for b in batches:
            for x, y, w, held, margin in _unpacked(b, count):
                leaf = where[tree.place(x)]
                use = np.flatnonzero((leaf >= 0) & ~held & ~np.isnan(w))
                x, leaf, w = x[use], leaf[use], w[use]
                g, h = slopes(y[use], margin[use] + sum((t.predict(x) for t in trees), np.zeros(len(use))), s.focal)
                for j, f in enumerate(columns):
                    key = leaf * width + x[:, f]
                    for k, v in enumerate((g * w, h * w, None)):
                        acc[:, j, :, k] += np.bincount(key, v, len(open_) * width).reshape(len(open_), width)
                seen = True
            if seen and size * 8 > HELD_BYTES:  # too much to keep beside the next block
                yield out()
                acc[:], seen = 0, False
        if seen:
            yield out()

    kinds = [i >= len(bins.numeric) for i in range(count)]

    def choose(t: pa.Table) -> pa.Table:
        node, feature = t.column("node")[0].as_py(), t.column("feature")[0].as_py()
        sums = sum(np.frombuffer(x.as_py()).reshape(width, 3) for x in t.column("sums"))
        found = best_split(sums, kinds[feature], s)
        left = sums[found[1]].sum(0) if found else sums.sum(0)
        sides = np.array([left, sums.sum(0) - left])
        row = (node, feature, found[0] if found else -1.0, found[1].tobytes() if found else b"", sides.tobytes())
        return pa.Table.from_pylist([dict(zip(_SPLIT.names, row))] if found or feature == columns[0] else [], _SPLIT)

    best: dict = {}
    for r in blocks.mapInArrow(gather, SUMS).groupBy("node", "feature").applyInArrow(choose, SPLIT).collect():
        if r["node"] not in best or (-r["gain"], r["feature"]) < (-best[r["node"]]["gain"], best[r["node"]]["feature"]):
            best[r["node"]] = r
    return list(best.values())


def grow(blocks: DataFrame, bins: Bins, trees: list[Tree], columns: list[int], s: Settings) -> Tree:
    tree, open_ = Tree(), [0]
    for level in range(s.depth):
        nodes, more = level_splits(blocks, bins, trees, tree, open_, columns, s), []
        for r in sorted(nodes, key=lambda r: r["node"]):
            sides = np.frombuffer(r["sides"]).reshape(2, 3)
            if level == 0:
                total = sides.sum(0)
                tree.value[0], tree.rows[0] = leaf_value(total[0], total[1], s), int(total[2])
            if r["gain"] > s.least_gain:
                l2 = s.cat_l2 if r["feature"] >= len(bins.numeric) else 0.0
                more += tree.split(r["node"], r["feature"], np.frombuffer(r["goes"], bool), r["gain"], [(leaf_value(g, h, s, l2), int(n)) for g, h, n in sides])
        open_ = [k for k in more if tree.rows[k] >= 2 * s.least_rows]
        if not open_:
            break
    return tree.pruned(s.leaves)


def _advanced(blocks: DataFrame, columns: int, trees: list[Tree]) -> DataFrame:
    """Blocks whose margins hold the trees."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            margins = [(m + sum((t.predict(x) for t in trees), np.zeros(len(x)))).tobytes() for x, _, _, _, m in _unpacked(b, columns)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(margins, pa.binary())], schema=_BLOCK)

    return blocks.mapInArrow(add, BLOCK)


def _held_precision(blocks: DataFrame, columns: int, trees: list[Tree]) -> list[float]:
    """Average precision on the held-out rows after each further tree, all in one job."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y, _, held, m in _unpacked(b, columns):
                x, m, y = x[held], m[held], y[held].astype("i8")
                for i, t in enumerate(trees):
                    m = m + t.predict(x)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), i, "i4")), pa.array(m), pa.array(y)], ["round", "score", "event"])

    got = {r["round"]: r["ap"] for r in M.average_precision(blocks.mapInArrow(score, "round int, score double, event long"), ["round"]).collect()}
    return [got.get(i) or 0.0 for i in range(len(trees))]


#: Rounds after which margins are written anew and the held-out rows are scored.
EVERY = 10


def boost(
    df: DataFrame,
    numeric: list[str],
    categorical: list[str] = (),
    label: str = "event",
    weight: Column | None = None,
    held: Column | None = None,
    rounds: int = 350,
    patience: int = 50,
    settings: Settings = Settings(),
) -> Boosted:
    """A model of at most ``rounds`` trees; with held-out rows, of as many as give the best average precision on them.

    Stops when ``patience`` rounds bring no better precision (looked at every EVERY rounds, which changes no result). The
    logistic loss starts from the logit of the weighted rate, the focal one from 0. Rows with a null weight are not fitted on.
    """
    s = settings
    scratch = Scratch(df.sparkSession)
    weight, out_ = F.lit(1.0) if weight is None else weight, F.lit(False) if held is None else F.coalesce(held, F.lit(False))
    fitted = df.where(~out_ & weight.isNotNull())
    bins = quantile_bins(fitted, list(numeric), list(categorical), s.bins)
    up, all_ = fitted.agg(F.sum(weight * F.col(label)), F.sum(weight)).first()
    rate = min(max((up or 0) / (all_ or 1), 1e-12), 1 - 1e-12)
    model = Boosted(bins, 0.0 if s.focal else float(np.log(rate / (1 - rate))), [])
    blocks = scratch.cut(packed(df, bins, label, weight, out_, model.start))
    rng, names, pending = np.random.default_rng(s.seed), len(bins.names), []
    take = max(1, int(names * s.columns))
    best, best_at = -1.0, 0
    for i in range(rounds):
        columns = sorted(rng.choice(names, take, replace=False).tolist())
        pending.append(grow(blocks, bins, pending, columns, s))
        if len(pending) < EVERY and i + 1 < rounds:
            continue
        if held is not None:
            for k, ap in enumerate(_held_precision(blocks, names, pending), len(model.trees) + 1):
                if ap > best and k <= best_at + patience:
                    best, best_at = ap, k
        after = scratch.cut(_advanced(blocks, names, pending))
        scratch.drop(blocks)
        blocks, model.trees, pending = after, model.trees + pending, []
        if held is not None and len(model.trees) >= best_at + patience:
            break
    scratch.drop(blocks)
    return model.first(best_at) if held is not None else model


def boost_and_refit(df: DataFrame, numeric: list[str], categorical: list[str], held: Column, rounds: int = 1000, **more) -> Boosted:
    """Rounds chosen on the held-out rows, then a model of as many on all rows; 350 where no held-out row is an event."""
    label = more.get("label", "event")
    if df.where(held & (F.col(label) == 1)).limit(1).count():
        rounds = max(1, len(boost(df, numeric, categorical, held=held, rounds=rounds, **more).trees))
    else:
        rounds = min(rounds, 350)
    return boost(df, numeric, categorical, rounds=rounds, **more)


def predicted(model: Boosted, df: DataFrame, name: str = "pred") -> DataFrame:
    """df with the chance of an event, kept off 0 and 1 by a millionth."""

    @F.pandas_udf("double")
    def chance(frames: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for f in frames:
            yield pd.Series(np.clip(1 / (1 + np.exp(-model.margins(model.bins.encode(f)))), 1e-6, 1 - 1e-6))

    return df.withColumn(name, chance(F.struct(*inputs(model.bins))))


def inputs(bins: Bins) -> list[Column]:
    """The model's columns as Bins.encode takes them."""
    return [*[F.col(c).cast("double").alias(c) for c in bins.numeric], *[F.col(c).cast("string").alias(c) for c in bins.categories]]
