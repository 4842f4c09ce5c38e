"""Exact ranking and calibration metrics.

Everything is reduced to (group, score) cells first, which are written once. Sums along the score run within ranges of
scores, which many tasks share, and over the ranges' totals, which are few; so no task orders all scores of a large group.
All metrics of a group come from one such pass: what lies above a score is the group's total without what lies below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import cut


def cells(df: DataFrame, by: list[str], score: str = "score", event: str = "event") -> DataFrame:
    return df.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(event).cast("long").alias("pos"))


#: Cells in a range of scores, about, and ranges at most.
RANGE_CELLS, MOST_RANGES = 250_000, 512


def running(c: DataFrame, by: list[str], values: list[str], score: str = "score") -> DataFrame:
    """c with below_x, the sum of x over cells of the group with a lower score, and all_x, the group's sum, for each value x."""
    c = cut(c)
    most = c.count() // RANGE_CELLS + 1
    before = Window.unboundedPreceding, -1
    zero = lambda x: F.coalesce(x, F.lit(0))
    if most == 1:
        w = Window.partitionBy(*by).orderBy(score).rowsBetween(*before)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return c.withColumns({f"below_{x}": zero(F.sum(x).over(w)) for x in values} | {f"all_{x}": F.sum(x).over(whole) for x in values})
    ranges = min(most, MOST_RANGES)
    edges = c.agg(F.percentile_approx(score, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(10 * ranges))).first()[0] or []
    place = F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))), lambda e: e < F.col(score)))  # equal scores are in one range
    c = c.withColumn("__range", place)
    w = Window.partitionBy(*by).orderBy("__range")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = c.groupBy(*by, "__range").agg(*[F.sum(x).alias(f"__{x}") for x in values])
    sums = {f"__b_{x}": zero(F.sum(f"__{x}").over(w.rowsBetween(*before))) for x in values} | {f"all_{x}": F.sum(f"__{x}").over(whole) for x in values}
    totals = totals.withColumns(sums).drop(*[f"__{x}" for x in values])
    w = Window.partitionBy(*by, "__range").orderBy(score).rowsBetween(*before)
    c = c.withColumns({f"below_{x}": zero(F.sum(x).over(w)) for x in values})
    same = [c[b].eqNullSafe(totals[b]) for b in (*by, "__range")]
    out = c.join(totals, same).drop(*[totals[b] for b in (*by, "__range")])
    return out.withColumns({f"below_{x}": F.col(f"below_{x}") + F.col(f"__b_{x}") for x in values}).drop("__range", *[f"__b_{x}" for x in values])


def ranked(c: DataFrame, by: list[str]) -> DataFrame:
    """Cells (by, score, n, pos) with what the metrics below need; n and pos may be weighted."""
    return running(c.withColumn("neg", F.col("n") - F.col("pos")), by, ["pos", "neg"])


def ranking(r: DataFrame, by: list[str]) -> DataFrame:
    """(by, positives, negatives, auroc, ap, lift, brier) of ranked cells.

    auroc counts ties half and is null for a single class; ap, the step-wise average precision, is null without
    positives; lift is ap over the rate of positives.
    """
    pos, neg = F.col("pos"), F.col("neg")
    at_least = lambda x: F.col(f"all_{x}") - F.col(f"below_{x}")
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    out = r.groupBy(*by).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(2 * pos * F.col("below_neg") + pos * neg).alias("__u2"),
        F.sum(F.when(pos > 0, pos * at_least("pos") / (at_least("pos") + at_least("neg"))).otherwise(0.0)).alias("__s"),
        F.sum(pos * (1 - s) * (1 - s) + neg * s * s).alias("__loss"),
    )
    p, q = F.col("positives"), F.col("negatives")
    ap = F.when(p > 0, F.col("__s") / p)
    auroc_ = F.when((p > 0) & (q > 0), F.col("__u2") / (2 * p * q))
    return out.select(*by, "positives", "negatives", auroc_.alias("auroc"), ap.alias("ap"), (ap / (p / (p + q))).alias("lift"), (F.col("__loss") / (p + q)).alias("brier"))


def auroc(df: DataFrame, by: list[str]) -> DataFrame:
    """Mid-rank AUROC per group, null for a single class."""
    return ranking(ranked(cells(df, by), by), by).select(*by, "auroc")


def average_precision(df: DataFrame, by: list[str]) -> DataFrame:
    """Step-wise average precision per group, null without positives."""
    return ranking(ranked(cells(df, by), by), by).select(*by, "ap")


def brier(by: list[str]) -> tuple[Column, ...]:
    e = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))) - F.col("event")
    return (F.avg(e * e).alias("brier"),)


def quantile_edges(r: DataFrame, by: list[str], bins: int) -> DataFrame:
    """(by, edges): the distinct quantiles i / bins of each group's scores, interpolated between neighbours, ascending.

    r: ranked cells with whole-numbered n. A quantile lies between the rows of two ranks; a cell says which of these it
    holds, so no more than two rows per quantile meet, and none but the ranked cells are read.
    """
    total = F.col("all_pos") + F.col("all_neg")
    below = F.col("below_pos") + F.col("below_neg")
    rank = lambda i: F.floor(((total - 1) * F.floor(i / 2) + i % 2 * (bins - 1)) / bins)
    here = lambda i: (rank(i) >= below) & (rank(i) < below + F.col("n"))
    hits = r.where("n > 0").withColumn("__i", F.explode(F.filter(F.sequence(F.lit(0), F.lit(2 * bins + 1)), here)))
    # entry 2 i is the value at the rank below quantile i, entry 2 i + 1 that at the rank above
    held = hits.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__i", "score"))).alias("__v"), F.max(total).alias("__n"))
    part = lambda i: ((F.col("__n") - 1) * i % bins) / bins
    value = lambda i: F.col("__v")[2 * i] + (F.col("__v")[2 * i + 1] - F.col("__v")[2 * i]) * part(i)
    return held.select(*by, F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(bins)), value))).alias("edges"))


def bin_of(edges: str, score: str = "score") -> Column:
    """Place of a score between edges, the last bin closed."""
    inner = F.filter(edges, lambda x: (x > F.element_at(edges, 1)) & (x < F.element_at(edges, -1)))
    return F.size(F.filter(inner, lambda x: x <= F.col(score))).cast("int")


def binned(r: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """(by, bin, n, mean_score, rate): quantile bins of ranked cells."""
    edges = quantile_edges(r, by, bins)
    same = F.lit(True)
    for b in by:
        same = same & r[b].eqNullSafe(edges[b])
    out = r.join(F.broadcast(edges) if not by else edges, same).drop(*[edges[b] for b in by])
    n = F.sum("n")
    return out.groupBy(*by, bin_of("edges").alias("bin")).agg(
        n.alias("n"), (F.sum(F.col("n") * F.col("score")) / n).alias("mean_score"), (F.sum("pos") / n).alias("rate")
    )


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    return binned(ranked(cells(df, []), []), [], bins)


def ece_of(r: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """(by, ece): mean distance of rate and mean score over quantile bins, by their rows."""
    gap = F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))
    return binned(r, by, bins).groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def ece(df: DataFrame, bins: int = 10) -> DataFrame:
    return ece_of(ranked(cells(df, []), []), [], bins)


def budget(df: DataFrame, by: list[str], ks: list[int], ident: str) -> DataFrame:
    """Precision and recall of the top k of each group, pooled over groups; only the top max(ks) are ordered."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), ident))
    top = df.select(*by, "score", ident, "event").withColumn("__r", rank).where(F.col("__r") <= max(ks))
    top = top.withColumn("k", F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k >= F.col("__r"))))
    hits = top.groupBy("k").agg(F.count("*").alias("reviewed"), F.sum("event").cast("long").alias("hits"))
    all_ = df.agg(F.sum("event").cast("long").alias("events"))
    return hits.join(F.broadcast(all_), F.lit(True))


def harrell_c(df: DataFrame, time: str, event: str, risk: str) -> DataFrame:
    """Concordance under censoring from (time, risk) cells: a pair counts if the earlier time is an event.

    Cells are dealt to the event times at or before their own, which are as few as there are periods; within a time,
    later subjects with less risk are a running sum.
    """
    c = cut(df.groupBy(F.col(time).alias("t"), F.col(risk).alias("score")).agg(F.count("*").alias("n"), F.sum(event).cast("long").alias("e")))
    times = [r[0] for r in c.where("e > 0").select("t").distinct().collect()]  # periods
    at = c.withColumn("at", F.explode(F.filter(F.array(*map(F.lit, sorted(times))) if times else F.array().cast("array<long>"), lambda x: x <= F.col("t"))))
    later = F.col("t") > F.col("at")
    at = at.groupBy("at", "score").agg(F.sum(F.when(later, F.col("n")).otherwise(0)).alias("later"), F.sum(F.when(later, 0).otherwise(F.col("e"))).alias("e"))
    x = running(at, ["at"], ["later"])
    won, pairs = F.col("e") * (2 * F.col("below_later") + F.col("later")), F.sum(F.col("e") * F.col("all_later"))
    return x.agg((F.sum(won) / (2 * pairs)).alias("c_index"), pairs.alias("pairs"))


def digest(*parts: Column | str) -> Column:
    """MD5 of values joined by slashes."""
    return F.md5(F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def numbered(df: DataFrame, key: str, name: str = "place") -> DataFrame:
    """(key, place) of the distinct keys, from 0 in the order of their MD5s.

    Keys are counted by the first three digits of the hash, at most 4096 numbers, and ordered within these.
    """
    d = cut(df.select(key).distinct().withColumn("__h", F.md5(F.col(key).cast("string"))).withColumn("__head", F.substring("__h", 1, 3)))
    before, n = [], 0
    for head, k in sorted(map(tuple, d.groupBy("__head").count().collect())):
        before.append((head, n))
        n += k
    start = F.broadcast(d.sparkSession.createDataFrame(before, "__head string, __n long"))
    place = F.row_number().over(Window.partitionBy("__head").orderBy("__h", key)) - 1
    return d.join(start, "__head").select(key, (F.col("__n") + place).cast("long").alias(name))


def draws(df: DataFrame, cluster: str, replicates: int, seed: int = 42) -> DataFrame:
    """(replicate, cluster, w): how often each replicate draws a cluster, as many draws as clusters, with replacement.

    Draw i of a replicate takes the cluster whose place is an MD5 of seed, replicate and i modulo their number, so the
    counts are multinomial and any engine can repeat them.
    """
    places = cut(numbered(df, cluster))
    n = places.count()
    made = df.sparkSession.range(replicates * n).select((F.col("id") % n).alias("__i"), F.expr(f"id div {max(n, 1)}").alias("replicate"))
    at = F.conv(F.substring(digest(str(seed), F.col("replicate"), F.col("__i")), 1, 15), 16, 10).cast("long") % n
    w = made.groupBy("replicate", at.alias("place")).agg(F.count("*").alias("w"))
    return w.join(places, "place").select("replicate", cluster, "w")


def stacked(df: DataFrame, keep: list[str], models: list[str]) -> DataFrame:
    """(keep, model, score): a row for each model's column."""
    one = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("score")) for m in models])
    return df.select(*keep, F.explode(one).alias("__x")).select(*keep, "__x.*")


METRICS = ("auroc", "ap", "brier", "ece", "precision_at_k")


def _five(c: DataFrame, top: DataFrame, by: list[str]) -> DataFrame:
    r = cut(ranked(c, by))
    return ranking(r, by).join(ece_of(r, by), by).join(top, by)


def monthly_precision(rows: DataFrame, weights: DataFrame, cluster: str, month: str, ident: str, k: int) -> DataFrame:
    """(replicate, model, precision_at_k): events among the first k of each month, over what is reviewed in all months.

    A row stands in a replicate as often as its cluster is drawn. The first 4 k rows of a month nearly always suffice;
    where the replicate draws too few of them, the month is gone through whole.
    """
    order = Window.partitionBy("model", month).orderBy(F.desc("score"), ident)
    rows = cut(rows.select(cluster, month, ident, "event", "model", "score"))
    first = cut(rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= 4 * k))
    by = ["replicate", "model", month]
    w = Window.partitionBy(*by).orderBy(F.desc("score"), ident).rowsBetween(Window.unboundedPreceding, -1)

    def taken(some: DataFrame) -> DataFrame:
        d = some.withColumn("__t", F.greatest(F.lit(0), F.least(F.col("w"), k - F.coalesce(F.sum("w").over(w), F.lit(0)))))
        return d.groupBy(*by).agg(F.sum("__t").alias("reviewed"), F.sum(F.col("__t") * F.col("event")).alias("hits"))

    got = cut(taken(first.join(weights, cluster)))
    long = rows.groupBy("model", month).count().where(F.col("count") > 4 * k).drop("count")
    full = got.where(F.col("reviewed") >= k)
    if long.limit(1).count():
        open_ = weights.select("replicate").distinct().join(F.broadcast(long), F.lit(True)).join(full, by, "left_anti")
        again = taken(rows.join(F.broadcast(long), ["model", month]).join(weights, cluster).join(open_, by))
        got = got.join(open_, by, "left_anti").unionByName(again)
    return got.groupBy("replicate", "model").agg((F.sum("hits") / F.sum("reviewed")).alias("precision_at_k"))


def points(df: DataFrame, cluster: str, month: str, ident: str, models: list[str], k: int = 100) -> DataFrame:
    """(model, METRICS) on all rows."""
    long = cut(stacked(df, [cluster, month, ident, "event"], models))
    order = Window.partitionBy("model", month).orderBy(F.desc("score"), ident)
    top = long.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k)
    return _five(cells(long, ["model"]), top.groupBy("model").agg(F.avg("event").alias("precision_at_k")), ["model"])


def bootstrap(df: DataFrame, cluster: str, month: str, ident: str, models: list[str], replicates: int = 1000, seed: int = 42, k: int = 100) -> DataFrame:
    """(replicate, model, METRICS) under draws of whole clusters, which are the same for all models; replicates of a single class are left out.

    Rows are reduced to (cluster, model, score) cells before they are repeated.
    """
    weights = cut(draws(df, cluster, replicates, seed))
    long = cut(stacked(df, [cluster, month, ident, "event"], models))
    by = ["replicate", "model"]
    reps = cells(long, [cluster, "model"]).join(weights, cluster)
    c = reps.groupBy(*by, "score").agg(F.sum(F.col("w") * F.col("n")).alias("n"), F.sum(F.col("w") * F.col("pos")).alias("pos"))
    out = _five(c, monthly_precision(long, weights, cluster, month, ident, k), by)
    return out.where("positives > 0 and negatives > 0").select(*by, *METRICS)


def intervals(boot: DataFrame, reference: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(model, metric, lo, hi, diff_lo, diff_hi): 2.5 % and 97.5 % points of the replicates and of paired differences to the reference."""
    cols = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("x")
    long = boot.select("replicate", "model", cols).select("replicate", "model", "x.*")
    base = long.where(F.col("model") == reference).select("replicate", "metric", F.col("v").alias("base"))
    q = lambda c, p: F.percentile(c, F.lit(p))  # noqa: E731  a number for each replicate
    d = F.col("v") - F.col("base")
    return long.join(base, ["replicate", "metric"]).groupBy("model", "metric").agg(
        q("v", 0.025).alias("lo"), q("v", 0.975).alias("hi"), q(d, 0.025).alias("diff_lo"), q(d, 0.975).alias("diff_hi")
    )
