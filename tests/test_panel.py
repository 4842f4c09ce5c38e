"""Window, join, scalar and metric operators on hand-made rows."""

import zipfile

import pytest
from pyspark.sql import functions as F

from monthloom.functions import codes, names, numeric
from monthloom.functions.fuzzy import lcs
from monthloom.operators import joins, metrics, spine, tables, windows
from monthloom.sources import readers


def column(df, name):
    return [r[name] for r in df.orderBy("ym").collect()]


def one(spark, values, name="x"):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], f"e int, ym int, {name} int")


def test_codes_and_company(spark):
    df = spark.createDataFrame([("0378-8700-06",), ("378-8700-6",), ("Tablet (NDC 0378-8700-06)",), (None,), ("1234",)], "s string")
    got = [tuple(r) for r in df.select(codes.package_code(F.col("s")), codes.code_in_text(F.col("s"))).collect()]
    assert got == [("00378-8700-06", None)] * 2 + [("00378-8700-06", "0378-8700-06"), (None, None), (None, None)]
    name = "Teva Pharmaceutical Industries, Inc."
    assert spark.range(1).select(names.company(F.lit(name)), names.company(F.lit(None).cast("string"))).first()[:] == ("teva industries", "")
    assert spark.range(1).select(codes.application_number(F.lit("ANDA076432")), codes.application_type(F.lit("ANDA076432"))).first()[:] == ("076432", "ANDA")


def test_trailing_and_recency(spark):
    df, w = one(spark, [1, 0, 0, 1, 0, 0, 1, 0]), windows.rows(["e"], ["ym"])
    assert column(df.withColumn("m", windows.trailing(F.max, "x", 3, w)), "m") == [None, 1, 1, 1, 1, 1, 1, 1]
    strict = windows.with_recency(df, F.col("x") > 0, ["e"], ["ym"], "r", 999, False)
    assert column(strict, "r") == [999, 1, 2, 3, 1, 2, 3, 1]
    inclusive = windows.with_recency(df, F.col("x") > 0, ["e"], ["ym"], "r", -1, True)
    assert column(inclusive, "r") == [0, 1, 2, 0, 1, 2, 0, 1]


def test_spells(spark):
    m = windows.with_spell_memory(one(spark, [0, 1, 1, 0, 0, 1, 0, 1, 1]), "x", ["e"], ["ym"])
    assert column(m, "spell_last") == [0, 0, 0, 0, 2, 2, 2, 1, 1]
    assert column(m, "spell_max") == [0, 0, 0, 0, 2, 2, 2, 2, 2]


def test_pct_change_and_fill(spark):
    df = spark.createDataFrame([(0, 5), (0, 0), (4, 2), (1, 50), (None, 1)], "a int, b int")
    assert [r[0] for r in df.select(numeric.pct_change(F.col("b"), F.col("a"))).collect()] == [10.0, None, -0.5, 10.0, None]
    filled = one(spark, [7] + [None] * 8).withColumn("f", windows.fill_forward("x", windows.rows(["e"], ["ym"]), 6))
    assert column(filled, "f") == [7] * 7 + [None] * 2


def test_no_look_ahead(spark):
    w = windows.rows(["e"], ["ym"])
    full = one(spark, [3, 1, 4, 1, 5, 9, 2, 6])
    feature = lambda d: column(d.withColumn("s", windows.trailing(F.sum, "x", 3, w)), "s")
    assert feature(full)[:5] == feature(full.where("ym < 5"))


def test_event_window_equals_range(spark):
    grid = spark.range(0, 20).select(F.lit(1).alias("e"), F.col("id").cast("int").alias("ym"))
    events = spark.createDataFrame([(1, 2), (1, 2), (1, 9)], "e int, ym int")
    got = column(joins.event_windows(grid, events, ["e"], {"n": 3}), "n")
    assert got == [sum(m - 3 <= e < m for e in (2, 2, 9)) for m in range(20)]


def test_resolution_and_fuzzy(spark):
    assert lcs("abcde", "acxe") == 3
    left = spark.createDataFrame([("blue red",), ("zzz",)], "name string")
    right = spark.createDataFrame([("red blue",), ("red green",)], "choice string")
    got = {r["name"]: r["choice"] for r in joins.fuzzy_best(left, right, "name", "choice", 85).collect()}
    assert got == {"blue red": "red blue", "zzz": None}


def test_metrics(spark):
    rows = [(1, s, e) for s, e in [(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1), (0.2, 0)]]
    df = spark.createDataFrame(rows, "g int, score double, event int")
    assert metrics.auroc(df, ["g"]).first()["auroc"] == pytest.approx(5.5 / 6)
    flipped = df.withColumn("score", 1 - F.col("score"))
    assert metrics.auroc(flipped, ["g"]).first()["auroc"] == pytest.approx(0.5 / 6)
    assert metrics.auroc(df.where("event = 0"), ["g"]).first()["auroc"] is None
    assert metrics.average_precision(df, ["g"]).first()["ap"] == pytest.approx((1 + 2 / 3) / 2)


def test_gates_and_spine(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    with pytest.raises(Exception, match="repeated"):
        tables.require_unique(df, ["a"]).collect()
    far = spark.createDataFrame([(1, 5), (2, 50)], "e int, ym int")
    assert spine.densify(far, ["e"], first=F.lit(0), last=F.lit(9)).count() == 1


def test_zipped_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "jan-2021.zip", "w") as z:
        z.writestr("price file.csv", "notes\nHCPCS Code,Payment Limit\nA1,2.5\nB2\n")
    df = readers.zipped_csv(spark, str(tmp_path), ["hcpcs_code", "payment_limit"], ["price"], "HCPCS")
    assert sorted(map(tuple, df.collect())) == [("A1", "2.5"), ("B2", None)]
