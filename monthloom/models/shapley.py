"""Exact Shapley values of boosted trees, by the paths to their leaves."""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, Tree, inputs


def paths(tree: Tree) -> Iterator[tuple[float, dict[int, tuple[float, np.ndarray]]]]:
    """(value, {feature: (share, bins)}) of each leaf.

    bins are those that stay on the path at all splits by the feature; share is the product of the shares of rows that
    these splits send along it, which stands for the feature where it is not known.
    """
    todo = [(0, {})]
    while todo:
        node, path = todo.pop()
        f = tree.feature[node]
        if f < 0:
            yield tree.value[node], path
            continue
        share, bins = path.get(f, (1.0, np.ones(len(tree.left_bins[node]), bool)))
        for kid, goes in ((tree.left[node], tree.left_bins[node]), (tree.right[node], ~tree.left_bins[node])):
            todo.append((kid, path | {f: (share * tree.rows[kid] / tree.rows[node], bins & goes)}))


def path_values(on: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of the game that pays the product of on (known features) and share (unknown ones).

    on: rows x m of 0 and 1. The payments to all coalitions of one size are the coefficients of the product of
    (share_j + on_j t) over the other features, so m products of m short polynomials give all values.
    """
    n, m = on.shape
    weight = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
    out = np.empty((n, m))
    for f in range(m):
        poly = np.zeros((n, m))
        poly[:, 0] = 1.0
        for j in range(m):
            if j != f:
                poly[:, 1:] = poly[:, 1:] * share[j] + poly[:, :-1] * on[:, [j]]
                poly[:, 0] *= share[j]
        out[:, f] = (poly @ weight) * (on[:, f] - share[f])
    return out


def shapley(model: Boosted, x: np.ndarray) -> tuple[float, np.ndarray]:
    """(base, rows x features): margins are base plus a row's sum. Rows that agree in what they meet on a path are worked out once."""
    out, base = np.zeros((len(x), len(model.bins.names))), model.start
    for tree in model.trees:
        for value, path in paths(tree):
            features = list(path)
            share = np.array([path[f][0] for f in features])
            base += value * float(np.prod(share))
            if not features or not len(x):
                continue
            on = np.stack([path[f][1][x[:, f]] for f in features], 1)
            kinds, which = np.unique(on, axis=0, return_inverse=True)
            out[:, features] += value * path_values(kinds.astype("f8"), share)[which.reshape(-1)]
    return base, out


def with_attributions(model: Boosted, df: DataFrame, name: str = "attributions") -> DataFrame:
    """df with an array of Shapley values in the order of the model's features, the base last; they add up to the margin."""

    @F.pandas_udf("array<double>")
    def values(frames: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for f in frames:
            base, v = shapley(model, model.bins.encode(f))
            yield pd.Series(list(np.column_stack([v, np.full(len(v), base)])))

    return df.withColumn(name, values(F.struct(*inputs(model.bins))))


SUMS = "feature string, total double, n long"
_SUMS = pa.schema([("feature", pa.string()), ("total", pa.float64()), ("n", pa.int64())])


def importance(model: Boosted, df: DataFrame) -> DataFrame:
    """(feature, mean_abs): mean size of each feature's Shapley values over all rows; a row for each feature leaves a task."""
    names = model.bins.names

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(names)), 0
        for b in batches:
            if b.num_rows:
                total += np.abs(shapley(model, model.bins.encode(b.to_pandas()))[1]).sum(0)
                n += b.num_rows
        yield pa.RecordBatch.from_pylist([{"feature": f, "total": float(v), "n": n} for f, v in zip(names, total)], _SUMS)

    return df.select(*inputs(model.bins)).mapInArrow(gather, SUMS).groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("mean_abs"))


def domains(features: DataFrame, family: Column) -> DataFrame:
    """(family, mean_abs): sums over the features of a family."""
    return features.groupBy(family.alias("family")).agg(F.sum("mean_abs").alias("mean_abs"))
