"""Discrete-time hazards: risk sets, logistic and boosted models, walk-forward, calibration, permutation."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, MaxAbsScaler, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import clipped_logit
from ..operators.metrics import auroc, average_precision
from ..operators.windows import START, rows, with_spells
from ..scratch import cut
from .boosting import Settings, boost, predicted
from .sampling import least


def onset_risk(df: DataFrame, state: str, by: list[str], month: str = "ym") -> DataFrame:
    """Rows before an entity's first state 1 whose next row is the next month; event is its state, clock counts from the first month of all."""
    w = rows(by, [month])
    out = df.withColumns(
        {"event": F.lead(state).over(w), "__next": F.lead(month).over(w), "__ever": F.max(state).over(w.rowsBetween(START, 0))}
    ).where((F.col("__ever") == 0) & (F.col("__next") == F.col(month) + 1))
    first = df.agg(F.min(month).alias("__first"))
    return out.join(F.broadcast(first), F.lit(True)).withColumn("clock", F.col(month) - F.col("__first")).drop("__next", "__ever", "__first")


def offset_risk(df: DataFrame, state: str, by: list[str], month: str = "ym", exclude: Column | None = None) -> DataFrame:
    """Rows in state 1 whose next row is the next month; event is its leaving, clock counts from the spell's first month.

    Spells with any excluded row are left out whole.
    """
    s = with_spells(df, state, by, [month])
    w = rows(by, [month])
    s = s.withColumns({"event": 1 - F.lead(state).over(w), "__next": F.lead(month).over(w)}).where(F.col(state) == 1)
    spell = Window.partitionBy(*by, "spell")
    s = s.withColumn("clock", F.col(month) - F.min(month).over(spell))
    if exclude is not None:
        s = s.withColumn("__x", F.max(exclude.cast("int")).over(spell)).where("__x = 0").drop("__x")
    return s.where(F.col("__next") == F.col(month) + 1).drop("__next", "rn", "starts")


def logistic(features: list[str], c: float, n: int, categories: list[str] = ()) -> Pipeline:
    """Imputed, max-scaled, L2 penalty 1 / (c n) on unstandardised coefficients; categories one-hot, unseen ones as one more."""
    filled, codes, hot = [f"{f}__i" for f in features], [f"{f}__c" for f in categories], [f"{f}__h" for f in categories]
    coded = [StringIndexer(inputCols=list(categories), outputCols=codes, handleInvalid="keep"), OneHotEncoder(inputCols=codes, outputCols=hot, dropLast=False)]
    return Pipeline(
        stages=[
            Imputer(inputCols=features, outputCols=filled),
            *(coded if categories else []),
            VectorAssembler(inputCols=[*filled, *hot], outputCol="__raw"),
            MaxAbsScaler(inputCol="__raw", outputCol="__x"),
            LogisticRegression(featuresCol="__x", labelCol="event", regParam=1 / (c * max(n, 1)), standardization=False, maxIter=100),
        ]
    )


def positive_weight(df: DataFrame, cap: float) -> DataFrame:
    rate = df.agg(F.avg("event").alias("__p"))
    w = F.least(F.greatest((1 - F.col("__p")) / F.greatest("__p", F.lit(1e-9)), F.lit(1.0)), F.lit(cap))
    return df.join(F.broadcast(rate), F.lit(True)).withColumn("__w", F.when(F.col("event") == 1, w).otherwise(1.0)).drop("__p")


def case_control(df: DataFrame, ident: list[str], per_case: int, seed: int = 42) -> DataFrame:
    """All events and per_case controls for each, the first by MD5 of their idents, weighted back to all controls.

    Controls are counted by the first digits of the hash, more digits where more rows share them; only those of the
    digits in which the wanted number is reached are ordered.
    """
    key = F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.col(c).cast("string") for c in ident]))
    n = df.agg(F.sum("event").cast("long").alias("p"), F.sum(1 - F.col("event")).cast("long").alias("q")).first()
    p, q = n["p"] or 0, n["q"] or 0
    want = min(p * per_case, q)
    picked = least(df.where("event = 0").withColumn("__key", F.conv(F.substring(key, 1, 13), 16, 10).cast("double")), "__key", want, ident) if want < q else df.where("event = 0")
    out = df.where("event = 1").withColumn("__w", F.lit(1.0))
    return out.unionByName(picked.drop("__key").withColumn("__w", F.lit(q / max(want, 1))))


def scored(model, df: DataFrame, keep: list[str]) -> DataFrame:
    out = model.transform(df)
    return out.select(*keep, vector_to_array("probability")[1].alias("pred"))


def walk_forward(df: DataFrame, features: list[str], origins: list[int], every: int, keep: list[str], month: str = "ym", c: float = 1.0) -> DataFrame | None:
    """Predictions of each origin by a model refitted every so many origins on all months before the refit."""
    out = None
    for i in range(0, len(origins), every):
        block = origins[i : i + every]
        train = df.where(F.col(month) < block[0])
        n = train.agg(F.count("*"), F.sum("event")).first()
        if not n[1] or n[0] == n[1]:
            continue
        part = scored(logistic(features, c, n[0]).fit(train), df.where(F.col(month).isin(block)), keep)
        out = part if out is None else out.unionByName(part)
    return out


def platt(cal: DataFrame, test: DataFrame, score: str = "score") -> DataFrame:
    """Sigmoid of a line in the logit, fitted on cal; the score itself with fewer than ten events."""
    if (cal.agg(F.sum("event")).first()[0] or 0) < 10:
        return test.withColumn("calibrated", F.col(score))
    x = VectorAssembler(inputCols=["__l"], outputCol="__x")
    made = lambda d: x.transform(d.withColumn("__l", clipped_logit(F.col(score))))
    model = LogisticRegression(featuresCol="__x", labelCol="event", regParam=0.0).fit(made(cal))
    return scored(model, made(test), test.columns).withColumnRenamed("pred", "calibrated")


#: Rows among which a feature's values are exchanged.
EXCHANGED = 10_000


def permutation_importance(model, df: DataFrame, features: list[str], seed: int = 42) -> DataFrame:
    """AUROC lost when a feature's values are dealt to other rows by a join on shuffled rank.

    Rows are first dealt at random to groups of about EXCHANGED, within which values change places, so no task
    orders all rows.
    """
    one = F.lit(1).alias("__g")
    score = lambda d: auroc(scored(model, d.select("*", one), ["__g", "event"]).withColumnRenamed("pred", "score"), ["__g"]).first()["auroc"]
    groups = max(1, df.count() // EXCHANGED)
    rows_ = df.withColumn("__id", F.xxhash64(*df.columns))

    def rank(d: DataFrame, s: int) -> DataFrame:
        d = d.withColumn("__b", F.pmod(F.xxhash64("__id", F.lit(f"group {s % 1000}")), F.lit(groups)))
        return d.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(F.xxhash64("__id", F.lit(s)))))

    base, lost = score(df), []
    for i, f in enumerate(features):
        b = rank(rows_.select("__id", F.col(f).alias("__v")), seed + 1000 * (i + 1)).select("__b", "__r", "__v")
        mixed = rank(rows_, seed).join(b, ["__b", "__r"]).withColumn(f, F.col("__v")).drop("__v", "__r", "__b", "__id")
        lost.append((f, base - score(mixed)))
    return df.sparkSession.createDataFrame(lost, "feature string, auroc_drop double")


def tune(train: DataFrame, valid: DataFrame, features: list[str], grid: list[float]) -> DataFrame:
    """(c, ap): average precision on the later block of a logistic model for each penalty, best first, ties to the smaller c."""
    n, out = train.count(), []
    for c in grid:
        pred = scored(logistic(features, c, n).fit(train), valid.withColumn("__g", F.lit(1)), ["__g", "event"])
        out.append((c, average_precision(pred.withColumnRenamed("pred", "score"), ["__g"]).first()["ap"]))
    return train.sparkSession.createDataFrame(out, "c double, ap double").orderBy(F.desc("ap"), "c")


def focal_boost(
    df: DataFrame, features: list[str], rounds: int = 5, gamma: float = 2.0, alpha: float = 0.5, rate: float = 0.3, weight: str | None = None
) -> DataFrame:
    """df with pred after boosting small trees on the focal loss. weight: a column of sample weights; rows where it is null are scored, not fitted on."""
    settings = Settings(leaves=8, depth=3, rate=rate, least_rows=1, l1=0.0, l2=0.0, columns=1.0, focal=(alpha, gamma))
    model = boost(df, features, weight=F.col(weight) if weight else None, rounds=rounds, settings=settings)
    return predicted(model, df)


def test_start(rolling_start: int, block_end: int | None) -> int:
    """First month to test on: never in or before the block that settings were chosen on."""
    return rolling_start if block_end is None else max(rolling_start, block_end + 1)


def tuned_walk_forward(
    df: DataFrame, features: list[str], grid: list[float], block: tuple[int, int], rolling_start: int, every: int, keep: list[str], month: str = "ym"
) -> DataFrame | None:
    """walk_forward from test_start on, with the penalty that is best on a block of months when fitted on those before it; c and start tell what was chosen.

    The default of 1 stands where the block or what lies before it has no event.
    """
    df = cut(df)
    train, valid = df.where(F.col(month) < block[0]), df.where(F.col(month).between(*block))
    has = lambda d: d.where("event = 1").limit(1).count() > 0
    c = tune(train, valid, features, grid).first()["c"] if has(train) and has(valid) else 1.0
    start = test_start(rolling_start, block[1])
    origins = sorted(r[0] for r in df.where(F.col(month) >= start).select(month).distinct().collect())  # months
    out = walk_forward(df, features, origins, every, keep, month, c)
    return out if out is None else out.withColumns({"c": F.lit(c), "start": F.lit(start)})
