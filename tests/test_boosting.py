"""Boosted trees against a plain single-process version, Shapley values against enumeration, samples against sorting."""

import heapq
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthloom.models import boosting as B
from monthloom.models import hazard, sampling, shapley


def table(n, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, c = r.random(), r.choice([None, r.gauss(0, 1)]), r.choice(["a", "b", "c", "d", None])
        p = 0.1 + 0.5 * (x > 0.6) + 0.2 * (c in ("a", "d")) + (0.15 if y is None else 0)
        rows.append((i, x, y, float(r.randrange(4)), c, int(r.random() < p)))
    return rows


SCHEMA = "id int, x double, y double, z double, c string, event int"
SMALL = B.Settings(leaves=6, depth=4, rate=0.3, least_rows=15, columns=1.0, bins=32, l1=0.1, l2=0.5)


def plain_tree(x, g, h, kinds, s):
    """Leaf by leaf, the best first, each split by trying every cut of every feature."""

    def gain_of(rows, extra):
        a = max(abs(g[rows].sum()) - s.l1, 0)
        return a * a / (h[rows].sum() + s.l2 + extra)

    def value(rows, extra):
        t = g[rows].sum()
        return -math.copysign(max(abs(t) - s.l1, 0), t) / (h[rows].sum() + s.l2 + extra) * s.rate

    def best(rows):
        found = None
        for f, category in enumerate(kinds):
            b, extra = x[rows, f], s.cat_l2 if category else 0.0
            if category:
                known = [v for v in range(1, 256) if (b == v).any()]
                known.sort(key=lambda v: g[rows][b == v].sum() / (h[rows][b == v].sum() + s.cat_smooth))
                sets = [set(o[: k + 1]) for o in (known, known[::-1]) for k in range(min(len(o), s.cat_most))]
            else:
                sets = [set(range(1, k + 1)) for k in range(1, 40)]
                sets += [q | {0} for q in sets] if (b == 0).any() else []
            for goes in sets:
                left, right = rows[np.isin(b, list(goes))], rows[~np.isin(b, list(goes))]
                if min(len(left), len(right)) < s.least_rows or min(h[left].sum(), h[right].sum()) < s.least_curvature:
                    continue
                gain = gain_of(left, extra) + gain_of(right, extra) - gain_of(rows, 0.0)
                if gain > s.least_gain and (found is None or gain > found[0] + 1e-9):
                    found = gain, f, left, right, extra
        return found

    leaves, order, queue = {}, itertools.count(), []
    everyone = np.arange(len(x))

    def add(rows, depth, extra):
        leaves[rows.tobytes()] = (rows, value(rows, extra))
        b = best(rows) if depth < s.depth and len(rows) >= 2 * s.least_rows else None
        if b:
            heapq.heappush(queue, (-b[0], next(order), rows, b, depth))

    add(everyone, 0, 0.0)
    used = []
    while queue and len(leaves) < s.leaves:
        _, _, rows, (_, f, left, right, extra), depth = heapq.heappop(queue)
        del leaves[rows.tobytes()]
        used.append(f)
        add(left, depth + 1, extra), add(right, depth + 1, extra)
    out = np.zeros(len(x))
    for rows, v in leaves.values():
        out[rows] = v
    return out, used


@pytest.mark.parametrize("focal", [None, (0.7, 2.0)])
def test_trees_equal_plain_version(spark, focal):
    from dataclasses import replace

    s = replace(SMALL, focal=focal)
    rows = table(500)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    w = 1 + (F.col("id") % 3)
    model = B.boost(df, ["x", "y", "z"], ["c"], weight=w, rounds=3, settings=s)
    import pandas as pd

    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    x, y = model.bins.encode(frame), frame["event"].to_numpy("f8")
    weight = 1.0 + frame["id"].to_numpy() % 3
    margin = np.full(len(x), model.start)
    if focal is None:
        assert model.start == pytest.approx(math.log((weight * y).sum() / (weight * (1 - y)).sum()))
    for tree in model.trees:
        g, h = B.slopes(y, margin, focal)
        step, used = plain_tree(x, g * weight, h * weight, [False, False, False, True], s)
        assert np.allclose(step, tree.predict(x), atol=1e-9)
        assert sorted(used) == sorted(f for f in tree.feature if f >= 0) and len(used) <= s.leaves - 1
        margin += step
    got = {r["id"]: r["pred"] for r in B.predicted(model, df).collect()}
    assert np.allclose([got[i] for i in range(len(x))], 1 / (1 + np.exp(-margin)))


def test_focal_slopes_are_derivatives():
    def loss(y, m):
        q = np.where(y == 1, 1 / (1 + np.exp(-m)), 1 / (1 + np.exp(m)))
        return -np.where(y == 1, 0.8, 0.2) * (1 - q) ** 2.5 * np.log(q)

    y, m, e = np.array([1, 1, 0, 0.0]), np.array([-1.0, 0.3, -0.4, 1.2]), 1e-4
    g, h = B.slopes(y, m, (0.8, 2.5))
    assert np.allclose(g, (loss(y, m + e) - loss(y, m - e)) / (2 * e), atol=1e-6)
    assert np.allclose(np.maximum((loss(y, m + e) - 2 * loss(y, m) + loss(y, m - e)) / e**2, 1e-6), h, atol=1e-4)


def test_stops_on_average_precision_and_refits(spark, monkeypatch):
    df = spark.createDataFrame(table(400), SCHEMA)
    held, seen = F.col("id") % 4 == 0, []
    inner = B._held_precision
    monkeypatch.setattr(B, "_held_precision", lambda *a: seen.append(inner(*a)) or seen[-1])
    monkeypatch.setattr(B, "EVERY", 3)
    model = B.boost(df, ["x", "y"], ["c"], held=held, rounds=12, patience=4, settings=SMALL)
    aps = [a for part in seen for a in part]
    best, at = -1.0, 0
    for k, ap in enumerate(aps, 1):
        if ap > best and k <= at + 4:
            best, at = ap, k
    assert len(model.trees) == at and (len(aps) == 12 or len(aps) >= at + 4)
    fitted = df.where(~held)
    same = B.boost(fitted, ["x", "y"], ["c"], rounds=at, settings=SMALL)
    assert [t.feature for t in same.trees] == [t.feature for t in model.trees]  # held-out rows are not fitted on
    whole = B.boost_and_refit(df, ["x", "y"], ["c"], held, rounds=12, patience=4, settings=SMALL)
    assert len(whole.trees) == at and whole.trees[0].rows[0] == 400


def test_empty_and_one_class(spark):
    df = spark.createDataFrame(table(50), SCHEMA)
    none = B.boost(df.where("event = 1"), ["x"], rounds=2, settings=SMALL)
    assert all(r["pred"] > 0.99 for r in B.predicted(none, df).collect())
    assert B.predicted(none, df.limit(0)).count() == 0


def test_shapley_equals_enumeration(spark):
    """Over all subsets of five features; unknown features are averaged over by the fitted rows' shares at each split."""
    rows = [(*r[:5], r[0] % 7 * 1.0, r[5]) for r in table(500, 5)]
    df = spark.createDataFrame(rows, "id int, x double, y double, z double, c string, v double, event int")
    model = B.boost(df, ["x", "y", "z", "v"], ["c"], rounds=4, settings=SMALL)
    names = model.bins.names
    frame = df.orderBy("id").limit(25).toPandas()
    x = model.bins.encode(frame)

    def expected(tree, node, row, known):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        kids = tree.left[node], tree.right[node]
        if f in known:
            return expected(tree, kids[0] if tree.left_bins[node][row[f]] else kids[1], row, known)
        return sum(tree.rows[k] / tree.rows[node] * expected(tree, k, row, known) for k in kids)

    m = len(names)
    base, got = shapley.shapley(model, x)
    for row, phi in zip(x, got):
        pay = {k: sum(expected(t, 0, row, set(k)) for t in model.trees) for n in range(m + 1) for k in itertools.combinations(range(m), n)}
        assert base == pytest.approx(model.start + pay[()])
        for f in range(m):
            want = sum(
                math.factorial(len(k)) * math.factorial(m - 1 - len(k)) / math.factorial(m) * (pay[tuple(sorted((*k, f)))] - pay[k]) for k in pay if f not in k
            )
            assert phi[f] == pytest.approx(want, abs=1e-9)
    assert np.allclose(base + got.sum(1), model.margins(x))
    out = shapley.with_attributions(model, df).collect()
    margins = model.margins(model.bins.encode(df.toPandas()))
    assert np.allclose(sorted(sum(r["attributions"]) for r in out), sorted(margins))
    mean = {r["feature"]: r["mean_abs"] for r in shapley.importance(model, df.repartition(3)).collect()}
    every = np.abs(shapley.shapley(model, model.bins.encode(df.toPandas()))[1]).mean(0)
    assert np.allclose([mean[f] for f in names], every)
    fam = shapley.domains(shapley.importance(model, df), F.when(F.col("feature") == "c", "kind").otherwise("number"))
    assert {r["family"]: round(r["mean_abs"], 9) for r in fam.collect()}["kind"] == round(mean["c"], 9)


def test_least_equals_sorting(spark, monkeypatch):
    monkeypatch.setattr(sampling, "ORDERED", 20)
    monkeypatch.setattr(sampling, "SLOTS", 8)
    r = random.Random(2)
    for values in ([r.random() ** 8 for _ in range(600)], [float(i % 5) for i in range(600)], [1.0] * 300):
        df = spark.createDataFrame(list(enumerate(values)), "id int, k double")
        order = sorted(range(len(values)), key=lambda i: (values[i], i))
        for k in (0, 1, 17, 250, len(values) + 5):
            assert sorted(x["id"] for x in sampling.least(df, "k", k, ["id"]).collect()) == sorted(order[:k])


def test_weighted_sample(spark):
    df = spark.range(4000).select(F.col("id").alias("i"), F.when(F.col("id") % 4 == 0, 9.0).otherwise(1.0).alias("w"))
    some = [r["i"] for r in sampling.weighted_sample(df, 1000, F.col("w"), ["i"]).collect()]
    assert len(some) == len(set(some)) == 1000
    heavy = sum(i % 4 == 0 for i in some)
    # rate t with 1000 exp(-9 t) + 3000 exp(-t) = 3000 rows left: 1000 (1 - exp(-9 t)) heavy ones
    t = next(k / 1e4 for k in range(10_000) if 1000 * math.exp(-9 * k / 1e4) + 3000 * math.exp(-k / 1e4) <= 3000)
    assert abs(heavy - 1000 * (1 - math.exp(-9 * t))) < 45
    got = {r["m"]: r["w"] for r in spark.range(-3, 60).select(F.col("id").alias("m"), sampling.recency(F.col("id")).alias("w")).collect()}
    assert got[-3] == got[0] == 1 and got[12] == pytest.approx(0.5) and got[24] == 0.35


def test_backtest_windows(spark):
    df = spark.createDataFrame([(g, m, int((g + m) % 5 == 0)) for g in range(30) for m in range(60)], "g int, ym int, event int")
    known = sampling.observable(df, 50)
    assert known.agg(F.min("ym"), F.max("ym")).first()[:] == (9, 44)
    assert sampling.recent_block(known, "event") == 39  # six months of six events suffice
    assert sampling.recent_block(known, "event", events=10_000) is None
    seen = []

    def fit(train, held):
        seen.append((train.agg(F.max("ym")).first()[0], held.agg(F.min("ym")).first()[0], train.count(), train.where("event = 1").count()))
        return lambda test: test.withColumn("score", F.col("g") / 30)

    out = sampling.backtest(df, {"m": (fit, 250)}, [49, 50], "event", F.lit(1.0), ["g"])
    assert seen == [(37, 38, 250, 180), (38, 39, 250, 180)] and out.count() == 60
    got = sampling.backtest_metrics(out, "g", k=10).first()
    assert got["monthly_precision"] == pytest.approx(0.2) and got["monthly_recall"] == pytest.approx(2 / 6)


def test_test_starts_after_block():
    assert hazard.test_start(10, None) == 10 and hazard.test_start(10, 12) == 13 and hazard.test_start(20, 12) == 20
