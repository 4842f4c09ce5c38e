"""Weighted sampling without replacement, recency weights, and the rolling backtest built on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import metrics as M
from ..scratch import Scratch, cut

#: What raises a control's chance to be sampled, added to 1, each times its column (null: 0).
RISK_WEIGHTS = {
    "same_ingredient_in_shortage": 4.0,
    "sole_source": 3.5,
    "is_injectable": 2.5,
    "few_manufacturers": 2.0,
    "quality_signal_any": 1.5,
    "ingredient_pressure": 1.5,
    "therapeutic_class_peer_onset_rate_6m": 1.2,
}
#: Months in which recency halves, its floor, and the least weight of all.
HALF_LIFE, FLOOR, LEAST = 12, 0.35, 1e-6


def recency(months_ago: Column, half_life: float = HALF_LIFE, floor: float = FLOOR) -> Column:
    """Halves every half_life months and ends at a floor; months ahead count as now."""
    return F.greatest(F.lit(floor), F.exp(-F.log(F.lit(2.0)) * F.greatest(months_ago, F.lit(0)) / F.greatest(F.lit(float(half_life)), F.lit(1.0))))


def risk_weight(weights: dict[str, float] = RISK_WEIGHTS) -> Column:
    total = F.lit(1.0)
    for name, w in weights.items():
        total = total + w * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return total


def warning_weight(months_since: Column) -> Column:
    """What months since a warning add: 1.2 from two years on, less before, null counts as long ago."""
    return 1.2 * F.greatest(F.lit(0.0), F.least(F.coalesce(months_since.cast("double"), F.lit(999.0)), F.lit(24.0))) / 24.0


def exponential_key(weight: Column, ident: list[str], seed: int = 42) -> Column:
    """-log(u) / weight with u in (0, 1) from an MD5 of the row's idents: the k least keys are a weighted sample without replacement.

    (The same order as u^(1 / weight), largest first.)
    """
    digits = F.substring(M.digest(str(seed), *[F.col(c) for c in ident]), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.greatest(weight, F.lit(LEAST))


#: Slots of a count along the keys, and rows that one task may order.
SLOTS, ORDERED = 4096, 20_000


def least(df: DataFrame, key: str, k: int, ident: list[str]) -> DataFrame:
    """The k rows of least key, equal ones by ident; found by counting, so that only few rows around the last one are ordered."""
    df = cut(df)
    n, low, high = df.agg(F.count("*"), F.min(key), F.max(key)).first()
    if k >= n:
        return df
    inside, taken, held = F.lit(True), 0, n
    while held > ORDERED and low < high:
        step = (high - low) / SLOTS
        slot = F.least(F.floor((F.col(key) - low) / step), F.lit(SLOTS - 1))
        counts = df.where(inside).groupBy(slot.alias("s")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        for r in sorted(counts.collect(), key=lambda r: r["s"]):  # at most SLOTS rows
            if taken + r["n"] >= k:
                break
            taken += r["n"]
        if r["n"] == held:
            break
        held, low, high = r["n"], r["low"], r["high"]
        inside = F.col(key).between(low, high)
    place = F.row_number().over(Window.orderBy(key, *ident))
    edge = df.where(inside).withColumn("__r", place).where(F.col("__r") <= k - taken).drop("__r")
    return df.where(F.col(key) < low).unionByName(edge) if taken else edge


def weighted_sample(df: DataFrame, k: int, weight: Column, ident: list[str], seed: int = 42) -> DataFrame:
    """k rows without replacement with chances by weight (at least LEAST); all rows if there are no more."""
    keyed = df.withColumn("__key", exponential_key(weight, ident, seed))
    return least(keyed, "__key", k, ident).drop("__key")


def training_sample(df: DataFrame, k: int, label: str, months_ago: Column, risk: Column, ident: list[str], seed: int = 42) -> DataFrame:
    """At most k rows: all events and controls by risk and recency; with k events or more, events only, by recency."""
    df = cut(df)
    if df.count() <= k:
        return df
    events, controls = df.where(F.col(label) > 0), df.where(F.col(label) == 0)
    p = events.count()
    if p >= k:
        return weighted_sample(events, k, recency(months_ago), ident, seed)
    return events.unionByName(weighted_sample(controls, k - p, risk * recency(months_ago), ident, seed))


def observable(df: DataFrame, origin: int, month: str = "ym", horizon: int = 6, history: int = 36) -> DataFrame:
    """Rows whose labels are known at origin: the last ``history`` of the panel's months up to horizon before it."""
    months = sorted(r[0] for r in df.where(F.col(month) <= origin - horizon).select(month).distinct().collect())[-history:]
    return df.where(F.col(month).isin(months))


def recent_block(train: DataFrame, label: str, month: str = "ym", least_months: int = 6, most_months: int = 12, events: int = 25) -> int | None:
    """First month of the shortest recent block with enough events that leaves some before it; none if there is no such."""
    by = {r[0]: r[1] for r in train.groupBy(month).agg(F.sum(label)).collect()}  # months
    months = sorted(by)
    for k in range(least_months, min(most_months, len(months) - 1) + 1):
        if sum(by[m] for m in months[-k:]) >= events and sum(by[m] for m in months[:-k]) > 0:
            return months[-k]
    return None


Fit = Callable[[DataFrame, DataFrame | None], Callable[[DataFrame], DataFrame]]


def backtest(
    df: DataFrame, models: dict[str, tuple[Fit, int]], origins: list[int], label: str, risk: Column, ident: list[str], month: str = "ym", k: int = 100
) -> DataFrame:
    """(model, month, event, score, ident): predictions of each origin's rows by models fitted on a sample of what was known then.

    models: name -> (fit, rows). fit takes the sample and the recent block (or none) and returns a function that adds
    score. Origins without events are left out, as are those before which there is none.
    """
    scratch, out = Scratch(df.sparkSession), None
    df = cut(df)
    for origin in origins:
        test, train = df.where(F.col(month) == origin), observable(df, origin, month)
        if not test.where(F.col(label) > 0).limit(1).count() or not train.where(F.col(label) > 0).limit(1).count():
            continue
        first = recent_block(train, label, month)
        base, block = (train, None) if first is None else (train.where(F.col(month) < first), train.where(F.col(month) >= first))
        for name, (fit, rows) in models.items():
            sample = scratch.cut(training_sample(base, rows, label, origin - F.col(month), risk, ident))
            part = fit(sample, block)(test).select(F.lit(name).alias("model"), *dict.fromkeys([month, *ident]), F.col(label).alias("event"), "score")
            out = part if out is None else out.unionByName(part)
    return out


def backtest_metrics(pred: DataFrame, ident: str, month: str = "ym", k: int = 100) -> DataFrame:
    """(model, pooled and mean monthly average precision, AUROC, precision and recall of the first k)."""
    pred = cut(pred)
    by = lambda keys: M.ranking(M.ranked(M.cells(pred, keys), keys), keys)

    def top(keys: list[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), ident))
        hits = pred.withColumn("__r", place).where(F.col("__r") <= k).groupBy(*keys).agg(F.avg("event").alias("precision"), F.sum("event").alias("hits"))
        all_ = pred.groupBy(*keys).agg(F.greatest(F.sum("event"), F.lit(1)).alias("events"))
        return hits.join(all_, keys).select(*keys, "precision", (F.col("hits") / F.col("events")).alias("recall"))

    monthly = by(["model", month]).join(top(["model", month]), ["model", month]).groupBy("model")
    monthly = monthly.agg(F.avg("ap").alias("monthly_ap"), F.avg("precision").alias("monthly_precision"), F.avg("recall").alias("monthly_recall"))
    pooled = by(["model"]).join(top(["model"]), "model").select("model", F.col("ap").alias("pooled_ap"), F.col("auroc").alias("pooled_auroc"), F.col("precision").alias("pooled_precision"), F.col("recall").alias("pooled_recall"))
    return monthly.join(pooled, "model")
