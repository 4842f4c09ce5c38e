"""Models and samplers on small synthetic rows."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from monthloom.models import hazard
from monthloom.operators.metrics import auroc
from monthloom.plans.survival import FEATURES


def test_focal_and_case_control(spark):
    r = random.Random(5)
    rows = [(i, x, int(r.random() < (0.6 if x > 0.8 else 0.03))) for i in range(400) for x in [r.random()]]
    df = spark.createDataFrame(rows, "id int, x double, event int")
    pred = hazard.focal_boost(df, ["x"], 3).select(F.lit(1).alias("g"), "event", F.col("pred").alias("score"))
    assert auroc(pred, ["g"]).first()["auroc"] > 0.8
    sample = hazard.case_control(df, ["id"], 2)
    w = sample.groupBy("event").agg(F.sum("__w").alias("w")).collect()
    assert {x["event"]: round(x["w"], 6) for x in w} == {e: df.where(f"event = {e}").count() for e in (0, 1)}


def test_permutation_of_all_features_on_later_rows(spark, monkeypatch):
    seen, whole = {}, hazard.permutation_importance
    fit = hazard.logistic

    class Watched:
        def __init__(self, *args):
            self.inner = fit(*args)

        def fit(self, df):
            seen["fitted"] = df.agg(F.max("ym")).first()[0]
            return self.inner.fit(df)

    def watch(model, df, features):
        seen["scored"] = df.agg(F.min("ym")).first()[0]
        return whole(model, df, features)

    monkeypatch.setattr(hazard, "logistic", Watched)
    monkeypatch.setattr(hazard, "permutation_importance", watch)
    got = entry.queries()["ml11_permutation"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["feature"] for r in got) == sorted(FEATURES)
    assert seen["fitted"] < seen["scored"]


def test_logistic_is_the_penalised_optimum(spark):
    """Against Newton steps on the same columns: mean-filled, divided by their largest value, penalty 1 / (c n)."""
    import numpy as np

    r = random.Random(8)
    rows = [(i, r.choice([None, r.gauss(0, 2)]), r.random() * 50, r.choice("abz"), int(r.random() < 0.4)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x double, y double, c string, event int")
    model = hazard.logistic(["x", "y"], 0.7, 200, ["c"]).fit(df)
    got = {r["id"]: r["pred"] for r in hazard.scored(model, df, ["id"]).collect()}
    x = np.array([[np.nan if a is None else a, b, *[float(c == k) for k in "abz"]] for _, a, b, c, _ in rows])
    x[:, 0] = np.where(np.isnan(x[:, 0]), np.nanmean(x[:, 0]), x[:, 0])
    x = np.column_stack([x / np.abs(x).max(0), np.ones(200)])
    y, b, penalty = np.array([row[-1] for row in rows]), np.zeros(6), np.array([1 / 0.7] * 5 + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve(x.T * (p * (1 - p)) @ x + np.diag(penalty + 1e-12), x.T @ (p - y) + penalty * b)
    assert np.allclose([got[i] for i in range(200)], 1 / (1 + np.exp(-x @ b)), atol=2e-4)


def test_platt_is_the_fitted_line(spark):
    import numpy as np

    r = random.Random(3)
    rows = [(s, int(r.random() < s**2)) for s in (0.02 + 0.96 * r.random() for _ in range(300))]
    df = spark.createDataFrame(rows, "score double, event int")
    s = np.array([a for a, _ in rows])
    x, y, b = np.column_stack([np.log(s / (1 - s)), np.ones(300)]), np.array([e for _, e in rows]), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve(x.T * (p * (1 - p)) @ x, x.T @ (p - y))
    got = {round(r["score"], 12): r["calibrated"] for r in hazard.platt(df, df).collect()}
    assert np.allclose([got[round(v, 12)] for v in s], 1 / (1 + np.exp(-x @ b)), atol=1e-3)
    few = df.where("event = 0").unionByName(df.where("event = 1").limit(9))
    assert all(r["score"] == r["calibrated"] for r in hazard.platt(few, df).collect())


def test_walk_forward_sees_earlier_months_only(spark, monkeypatch):
    r = random.Random(1)
    df = spark.createDataFrame([(g, m, r.random(), int(r.random() < 0.5)) for g in range(20) for m in range(12)], "g int, ym int, x double, event int")
    seen, fit = [], hazard.logistic

    class Watched:
        def __init__(self, *args):
            self.inner = fit(*args)

        def fit(self, d):
            seen.append(d.agg(F.max("ym")).first()[0])
            return self.inner.fit(d)

    monkeypatch.setattr(hazard, "logistic", Watched)
    out = hazard.walk_forward(df, ["x"], [6, 7, 8, 9, 10], 3, ["g", "ym"])
    assert seen == [5, 8] and sorted({r["ym"] for r in out.collect()}) == [6, 7, 8, 9, 10]
    seen.clear()
    tuned = hazard.tuned_walk_forward(df, ["x"], [0.1, 1.0], (4, 6), 5, 3, ["g", "ym"])
    assert seen[-2:] == [6, 9] and {r["start"] for r in tuned.collect()} == {7} and tuned.agg(F.min("ym")).first()[0] == 7
