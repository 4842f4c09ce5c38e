"""Metrics in many ranges, exact quantiles and bootstrap draws against plain versions."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthloom.operators import metrics as M


def plain_auroc(y, p):
    pos, neg = [a for a, b in zip(p, y) if b], [a for a, b in zip(p, y) if not b]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


def plain_ap(y, p):
    out, total = 0.0, sum(y)
    for s in sorted(set(p), reverse=True):
        top = [b for a, b in zip(p, y) if a >= s]
        out += sum(b for a, b in zip(p, y) if a == s) / total * sum(top) / len(top)
    return out


def plain_ece(y, p):
    """With places of quantiles in whole numbers: rounded ones can put an edge a hair beside the score it is."""
    y, p = np.array(y, float), np.array(p)
    place = np.arange(11) * (len(p) - 1)
    low, high = np.sort(p)[place // 10], np.sort(p)[(place + 9) // 10]
    edges = np.unique(low + (high - low) * (place % 10) / 10)
    at = np.sum(p[:, None] >= edges[None, 1:-1], 1)
    return sum(abs(y[at == b].mean() - p[at == b].mean()) * (at == b).sum() for b in set(at)) / len(p)


def plain_top(rows, k):
    """rows: (month, score, id, event)"""
    seen = hits = 0
    for m in {r[0] for r in rows}:
        top = sorted((r for r in rows if r[0] == m), key=lambda r: (-r[1], r[2]))[:k]
        seen, hits = seen + len(top), hits + sum(r[3] for r in top)
    return hits / seen


def scores(seed, n, kinds):
    r = random.Random(seed)
    return [(r.choice("uvw"), r.randrange(40), i, r.randrange(4), int(r.random() < 0.3), r.randrange(kinds) / kinds) for i in range(n)]


COLUMNS = "g string, c int, id int, ym int, event int, score double"


@pytest.mark.parametrize("cells_a_range", [250_000, 12])
def test_ranking_in_ranges(spark, monkeypatch, cells_a_range):
    monkeypatch.setattr(M, "RANGE_CELLS", cells_a_range)
    rows = scores(1, 500, 128) + [(None, 0, 900 + i, 0, i % 2, i / 8) for i in range(4)]
    df = spark.createDataFrame(rows, COLUMNS)
    got = {r["g"]: r for r in M.ranking(M.ranked(M.cells(df, ["g"]), ["g"]), ["g"]).collect()}
    ece = {r["g"]: r["ece"] for r in M.ece_of(M.ranked(M.cells(df, ["g"]), ["g"]), ["g"]).collect()}
    assert set(got) == set(ece) == {"u", "v", "w", None}
    for g, r in got.items():
        y, p = [x[4] for x in rows if x[0] == g], [x[5] for x in rows if x[0] == g]
        assert r["auroc"] == pytest.approx(plain_auroc(y, p)) and r["ap"] == pytest.approx(plain_ap(y, p))
        assert r["brier"] == pytest.approx(np.mean((np.array(p) - np.array(y)) ** 2)) and ece[g] == pytest.approx(plain_ece(y, p))
        assert r["lift"] == pytest.approx(r["ap"] / np.mean(y))


@pytest.mark.parametrize("n", [1, 2, 3, 9, 11, 100, 101])
def test_quantiles_are_exact(spark, n):
    r = random.Random(n)
    p = [r.random() if r.random() < 0.5 else 0.25 for _ in range(n)]
    df = spark.createDataFrame([(x, 0) for x in p], "score double, event int")
    got = M.quantile_edges(M.ranked(M.cells(df, []), []), [], 10).first()["edges"]
    assert np.allclose(got, np.unique(np.quantile(p, np.linspace(0, 1, 11))), atol=1e-12) or np.allclose(np.unique(np.round(got, 12)), np.unique(np.round(np.quantile(p, np.linspace(0, 1, 11)), 12)))
    assert M.ece(df).first()["ece"] >= 0


def test_bootstrap_equals_drawing_rows(spark, monkeypatch):
    """Weights are what drawing clusters one by one gives, and every metric is that of the rows so drawn."""
    rows = scores(4, 160, 16)
    df = spark.createDataFrame(rows, COLUMNS).select("c", "ym", "id", "event", F.col("score").alias("a"), (1 - F.col("score")).alias("b"))
    clusters = sorted({r[1] for r in rows}, key=lambda c: (hashlib.md5(str(c).encode()).hexdigest(), c))
    drawn = {i: collections.Counter(clusters[int(hashlib.md5(f"7/{i}/{j}".encode()).hexdigest()[:15], 16) % len(clusters)] for j in range(len(clusters))) for i in range(6)}
    got = {}
    for r in M.draws(df, "c", 6, 7).collect():
        got.setdefault(r["replicate"], {})[r["c"]] = r["w"]
    assert got == drawn and all(sum(d.values()) == len(clusters) for d in drawn.values())
    for k in (3, 100):  # 3: months of over 12 rows, some of which draw too few of the first
        boot = {(r["replicate"], r["model"]): r for r in M.bootstrap(df, "c", "ym", "id", ["a", "b"], 6, 7, k).collect()}
        assert len(boot) == 12
        for (i, m), r in boot.items():
            some = [(x[3], x[5] if m == "a" else 1 - x[5], x[2], x[4]) for x in rows for _ in range(drawn[i][x[1]])]
            y, p = [x[3] for x in some], [x[1] for x in some]
            assert r["auroc"] == pytest.approx(plain_auroc(y, p)) and r["ap"] == pytest.approx(plain_ap(y, p))
            assert r["ece"] == pytest.approx(plain_ece(y, p)) and r["precision_at_k"] == pytest.approx(plain_top(some, k))
        point = M.points(df, "c", "ym", "id", ["a"], k).first()
        assert point["precision_at_k"] == pytest.approx(plain_top([(x[3], x[5], x[2], x[4]) for x in rows], k))


def test_months_that_draw_too_few(spark):
    """A month whose first rows all belong to a cluster that is not drawn is gone through whole."""
    rows = [(0, 1, i, 0, 1.0 - i / 100) for i in range(8)] + [(1, 1, 50 + i, 1, 0.5 - i / 100) for i in range(3)]
    df = spark.createDataFrame(rows, "c int, ym int, id int, event int, score double").withColumn("model", F.lit("m"))
    weights = spark.createDataFrame([(0, 1, 2), (1, 0, 1), (2, 0, 1), (2, 1, 1)], "replicate long, c int, w long")
    got = {r["replicate"]: r["precision_at_k"] for r in M.monthly_precision(df, weights, "c", "ym", "id", 2).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: 0.0}


def test_harrell_equals_pairs(spark):
    r = random.Random(3)
    rows = [(r.randrange(1, 9), int(r.random() < 0.4), r.randrange(6) / 6) for _ in range(120)]
    got = M.harrell_c(spark.createDataFrame(rows, "t int, e int, r double"), "t", "e", "r").first()
    pairs = [(a[2] > b[2]) + 0.5 * (a[2] == b[2]) for a in rows for b in rows if a[1] and a[0] < b[0]]
    assert got["pairs"] == len(pairs) and got["c_index"] == pytest.approx(sum(pairs) / len(pairs))
