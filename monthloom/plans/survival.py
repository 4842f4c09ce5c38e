"""Risk sets, metrics and models."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..models import boosting as B
from ..models import hazard as H
from ..models import sampling as P
from ..models import shapley as S
from ..operators import features
from ..operators import metrics as M
from ..operators import windows as W
from ..scratch import cut
from .base import query


@query("alg05_onset_risk", """select g, ym, event, (ym - (select min(ym) from gs))::bigint as clock from pp""")
def _(t):
    return H.onset_risk(t.group_state(), "state", ["g"]).select("g", "ym", "event", "clock")


_SPELL = """with a as (select *, sum(case when state = 1 and p = 0 then 1 else 0 end) over (partition by g order by ym)::bigint as spell, lead(state) over (partition by g order by ym) as nst, lead(ym) over (partition by g order by ym) as nx
from (select *, coalesce(lag(state) over (partition by g order by ym), 0) as p from gs)),
b as (select *, ym - min(ym) over (partition by g, spell) as clock from a where state = 1)"""


@query("alg05_offset_risk", _SPELL + " select g, spell, ym, (1 - nst)::bigint as event, clock::bigint as clock from b where nx = ym + 1")
def _(t):
    return H.offset_risk(t.group_state(), "state", ["g"]).select("g", "spell", "ym", "event", "clock")


@query("alg06_clock", """select g, ym, case when state = 1 then ym - last_value(case when state = 1 and p = 0 then ym end ignore nulls) over (partition by g order by ym rows between unbounded preceding and current row) else ym - (select min(ym) from gs) end::bigint as clock
from (select *, coalesce(lag(state) over (partition by g order by ym), 0) as p from gs)""")
def _(t):
    w = W.rows(["g"], ["ym"])
    s = W.with_spells(t.group_state(), "state", ["g"], ["ym"])
    start = F.last(F.when(F.col("starts") == 1, F.col("ym")), ignorenulls=True).over(w.rowsBetween(W.START, 0))
    first = s.agg(F.min("ym").alias("first"))
    s = s.join(F.broadcast(first), F.lit(True))
    return s.select("g", "ym", F.when(F.col("state") == 1, F.col("ym") - start).otherwise(F.col("ym") - F.col("first")).alias("clock"))


_AUROC = """with r as (select {0} event, score, sum(1 - event) over (partition by {1} order by score range between unbounded preceding and current row exclude group) as below, sum(1 - event) over (partition by {1}, score) as tied from {2})
select {0} case when sum(event) > 0 and sum(1 - event) > 0 then sum(case when event = 1 then 2 * coalesce(below, 0) + tied else 0 end)::double / (2 * sum(event) * sum(1 - event))::double end as auroc from r {3}"""


@query("met01_auroc", _AUROC.format("", "1", "sc", ""))
def _(t):
    return M.auroc(t.scored(), [])


@query("met02_average_precision", """with c as (select score, sum(event)::double as pos, count(*)::double as n from sc group by score), r as (select *, sum(pos) over w as cp, sum(n) over w as cn from c window w as (order by score desc))
select round(sum(pos * cp / cn) / sum(pos), 9) as ap from r""")
def _(t):
    return M.average_precision(t.scored(), []).select(F.round("ap", 9).alias("ap"))


@query("met03_brier", "select round(avg(pow(greatest(0.0, least(1.0, score)) - event, 2)), 9) as brier, count(*)::bigint as n from sc")
def _(t):
    return t.scored().agg(*M.brier([]), F.count("*").alias("n")).select(F.round("brier", 9).alias("brier"), "n")


_BINS = """with e as (select list_sort(list_distinct(quantile_cont(score, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) as e from sc),
b as (select score, event, len(list_filter(e[2:-2], lambda x: x <= score))::bigint as bin from sc, e),
c as (select bin, count(*)::bigint as n, avg(score) as mean_score, avg(event) as rate from b group by bin)"""


@query("met04_ece", _BINS + " select round(sum(n * abs(mean_score - rate)) / sum(n), 9) as ece from c")
def _(t):
    return M.ece(t.scored()).select(F.round("ece", 9).alias("ece"))


@query("met06_calibration", _BINS + " select bin, n, round(mean_score, 9) as mean_score, round(rate, 9) as rate from c")
def _(t):
    return M.calibration(t.scored()).select("bin", "n", F.round("mean_score", 9).alias("mean_score"), F.round("rate", 9).alias("rate"))


_BUDGET = """with r as (select event, row_number() over (partition by {0} order by score desc, id) as r from (select *, g || '/' || ym as id from sc)), k as (select unnest([25, 50, 100, 250, 500])::bigint as k)
select k, count(*) filter (r <= k)::bigint as reviewed, coalesce(sum(event) filter (r <= k), 0)::bigint as hits, sum(event)::bigint as events from r cross join k group by k"""
_KS = [25, 50, 100, 250, 500]


def _budget(t, by):
    s = t.scored().withColumns({"all": F.lit(1), "id": F.concat_ws("/", "g", F.col("ym").cast("string"))})
    return M.budget(s, [by], _KS, "id")


query("met05_precision_at_k", _BUDGET.format("1"))(lambda t: _budget(t, "all"))
query("met07_monthly_budget", _BUDGET.format("ym"))(lambda t: _budget(t, "ym"))


@query("met09_harrell", """with s as (select g, count(*)::bigint as t, max(event) as e, max(score) as r from sc group by g)
select sum(case when a.r > b.r then 2 when a.r = b.r then 1 else 0 end)::double / (2 * count(*))::double as c_index, count(*)::bigint as pairs from s a join s b on a.e = 1 and a.t < b.t""")
def _(t):
    s = t.scored().groupBy("g").agg(F.count("*").alias("t"), F.max("event").alias("e"), F.max("score").alias("r"))
    return M.harrell_c(s, "t", "e", "r")


@query("met10_horizon6", """with o as (select g, min(ym) as onset from sc where event = 1 group by g), l as (select max(ym) as last from gs)
select sc.g, sc.ym, (onset is not null and onset - sc.ym between 0 and 5)::bigint as within6 from sc cross join l left join o using (g) where sc.ym + 6 <= last""")
def _(t):
    s = t.scored()
    onset = s.where("event = 1").groupBy("g").agg(F.min("ym").alias("onset"))
    last = t.group_state().agg(F.max("ym").alias("last"))
    j = s.join(onset, "g", "left").join(F.broadcast(last), F.col("ym") + 6 <= F.col("last"))
    return j.select("g", "ym", F.coalesce((F.col("onset") - F.col("ym")).between(0, 5), F.lit(False)).cast("int").alias("within6"))


@query("met10_metrics", """with o as (select g, min(ym) as onset from sc where event = 1 group by g), l as (select max(ym) as last from gs), y as (select score, (onset is not null and onset - sc.ym between 0 and 5)::bigint as e from sc cross join l left join o using (g) where sc.ym + 6 <= last),
c as (select score, sum(e) as pos, count(*) as n from y group by score), x as (select *, coalesce(sum(n - pos) over (order by score rows between unbounded preceding and 1 preceding), 0) as below, sum(pos) over d as cp, sum(n) over d as cn from c window d as (order by score desc))
select round(sum(2 * pos * below + pos * (n - pos))::double / (2 * sum(pos) * sum(n - pos))::double, 9) as auroc, round((sum(pos * cp::double / cn) / sum(pos))::double, 9) as ap, round(((sum(pos * cp::double / cn) / sum(pos)) / (sum(pos)::double / sum(n)::double))::double, 6) as lift from x""")
def _(t):
    from .base import QUERIES

    label = QUERIES["met10_horizon6"](t.spark, t.dir).select("g", "ym", F.col("within6").alias("event"))
    s = t.scored().drop("event").join(label, ["g", "ym"])
    out = M.ranking(M.ranked(M.cells(s, []), []), [])
    return out.select(F.round("auroc", 9).alias("auroc"), F.round("ap", 9).alias("ap"), F.round("lift", 6).alias("lift"))


@query("met11_subgroup", _AUROC.format("brand,", "brand", "(select *, string_split(g, ' | ')[1] as brand from sc)", "group by brand"))
def _(t):
    return M.auroc(t.scored().withColumn("brand", F.split("g", r" \| ")[0]), ["brand"]).select("brand", "auroc")


@query("met12_f1_sweep", """with t as (select unnest(range(1, 50)) / 100.0::double as cut), x as (select cut, sum((score >= cut and event = 1)::int) as tp, sum((score >= cut)::int) as pp, sum(event) as p from sc cross join t group by cut)
select cut, round(case when pp + p > 0 then 2.0 * tp / (pp + p) end::double, 9) as f1 from x""")
def _(t):
    s = t.scored().withColumn("cut", F.explode(F.transform(F.sequence(F.lit(1), F.lit(49)), lambda i: i / F.lit(100.0))))
    over = F.col("score") >= F.col("cut")
    x = s.groupBy("cut").agg(F.sum((over & (F.col("event") == 1)).cast("int")).alias("tp"), F.sum(over.cast("int")).alias("pp"), F.sum("event").alias("p"))
    return x.select("cut", F.round(F.when(F.col("pp") + F.col("p") > 0, 2 * F.col("tp") / (F.col("pp") + F.col("p"))), 9).alias("f1"))


@query("rpt03_lift", """with c as (select score, sum(event)::double as pos, count(*)::double as n from sc group by score), r as (select *, sum(pos) over w as cp, sum(n) over w as cn from c window w as (order by score desc))
select round((sum(pos * cp / cn) / sum(pos)) / (sum(pos) / sum(n)), 6) as lift from r""")
def _(t):
    return M.ranking(M.ranked(M.cells(t.scored(), []), []), []).select(F.round("lift", 6).alias("lift"))


#: Two models' scores, the places of the groups by hash, and how often each of 1,000 replicates draws a group.
_DRAWN = """m as (select g, ym, g || '/' || ym as id, event, 'a' as model, score from sc union all select g, ym, g || '/' || ym, event, 'b', (1 + (round(score * 64)::bigint * 7) % 37)::double / 64 from sc),
pl as (select g, row_number() over (order by md5(g), g) - 1 as place from (select distinct g from sc)), nn as (select count(*) as n from pl),
wt as (select i, g, w from (select i, ('0x' || substr(md5('42/' || i || '/' || j), 1, 15))::bigint % n as place, count(*) as w from nn, (select unnest(range(1000)) as i), (select unnest(range((select n from nn))) as j) group by all) join pl using (place))"""
_FIVE = """s as (select {0}, score, sum(w) as n, sum(w * event) as pos from v group by all),
x as (select *, coalesce(sum(n - pos) over a, 0) as below, sum(pos) over d as cp, sum(n) over d as cn from s window a as (partition by {0} order by score rows between unbounded preceding and 1 preceding), d as (partition by {0} order by score desc rows between unbounded preceding and current row)),
k as (select {0}, sum(pos * (1 - score) * (1 - score) + (n - pos) * score * score)::double / sum(n)::double as brier, sum(2 * pos * below + pos * (n - pos))::double / (2 * sum(pos) * sum(n - pos))::double as auroc, sum(pos * cp::double / cn) / sum(pos) as ap from x group by {0} having sum(pos) > 0 and sum(n - pos) > 0),
l0 as (select {0}, list(score order by score) as l from (select {0}, score, unnest(range(n::bigint)) as u from s) group by {0}),
e0 as (select {0}, list_sort(list_distinct(list_transform(range(11), lambda q: l[(len(l) - 1) * q // 10 + 1] + (l[((len(l) - 1) * q + 9) // 10 + 1] - l[(len(l) - 1) * q // 10 + 1]) * ((len(l) - 1) * q % 10)::double / 10))) as e from l0),
b0 as (select {0}, len(list_filter(e[2:-2], lambda x: x <= score)) as bin, sum(n) as n, sum(n * score) / sum(n) as mean_score, sum(pos)::double / sum(n) as rate from s join e0 using ({0}) group by all),
e1 as (select {0}, sum(n * abs(mean_score - rate)) / sum(n) as ece from b0 group by {0}),
t0 as (select {0}, event, greatest(0, least(w, 100 - coalesce(sum(w) over (partition by {0}, ym order by score desc, id rows between unbounded preceding and 1 preceding), 0))) as t from v),
t1 as (select {0}, sum(t * event)::double / sum(t)::double as precision_at_k from t0 group by {0}),
l as (select {0}, unnest(['auroc', 'ap', 'brier', 'ece', 'precision_at_k']) as metric, unnest([auroc, ap, brier, ece, precision_at_k]) as v from k join e1 using ({0}) join t1 using ({0}))"""
_BOOT = f"with {_DRAWN}, v as (select m.*, i, w from m join wt using (g)), {_FIVE.format('i, model')}"


def _two_models(t):
    other = (1 + (F.round(F.col("score") * 64).cast("long") * 7) % 37).cast("double") / 64
    ident = F.concat_ws("/", "g", F.col("ym").cast("string"))
    return cut(t.scored().select("g", "ym", ident.alias("id"), "event", F.col("score").alias("a"), other.alias("b")))


@query("met08_bootstrap", _BOOT + """, j as (select l.*, l.v - o.v as d from l join l o on o.i = l.i and o.metric = l.metric and o.model = 'a')
select model, metric, round(quantile_cont(v, 0.025), 6) as lo, round(quantile_cont(v, 0.975), 6) as hi, round(quantile_cont(d, 0.025), 6) as diff_lo, round(quantile_cont(d, 0.975), 6) as diff_hi from j group by all""")
def _(t):
    out = M.intervals(M.bootstrap(_two_models(t), "g", "ym", "id", ["a", "b"]), "a")
    return out.select("model", "metric", *[F.round(c, 6).alias(c) for c in ("lo", "hi", "diff_lo", "diff_hi")])


@query("rpt01_performance_row", "with " + _BOOT[5:] + ", q as (select model, metric, quantile_cont(v, 0.025) as lo, quantile_cont(v, 0.975) as hi from l group by all), p as (with v as (select *, 1::bigint as w from m), " + _FIVE.format("model") + """ select * from l),
h as (select model, count(*)::bigint as n, sum(event)::bigint as events from m group by model)
select model, n, events, metric, printf('%.3f (%.3f-%.3f)', round(p.v, 3), round(lo, 3), round(hi, 3)) as cell from p join q using (model, metric) join h using (model)""")
def _(t):
    df = _two_models(t)
    ci = M.intervals(M.bootstrap(df, "g", "ym", "id", ["a", "b"]), "a")
    point = M.points(df, "g", "ym", "id", ["a", "b"])
    point = point.withColumns({"n": F.col("positives") + F.col("negatives"), "events": F.col("positives")})
    point = point.unpivot(["model", "n", "events"], list(M.METRICS), "metric", "v").join(ci, ["model", "metric"])
    return point.select("model", "n", "events", "metric", F.format_string("%.3f (%.3f-%.3f)", *[F.round(c, 3) for c in ("v", "lo", "hi")]).alias("cell"))


FEATURES = ["lag1", "mean6", "ret6", "since", "suppliers"]


def risk_features(t):
    """Offset risk set with a few trailing features."""
    w = W.rows(["g"], ["ym"])
    zero = F.lit(0.0)
    df = t.group_state().withColumns(
        {
            "lag1": W.lag0("qty", 1, w).cast("double"),
            "mean6": F.coalesce(W.trailing(F.avg, "qty", 6, w), zero),
            "ret6": F.coalesce(W.trailing(F.sum, "ret", 6, w), F.lit(0)).cast("double"),
            "suppliers": F.col("suppliers").cast("double"),
        }
    )
    df = W.with_recency(df, F.col("ret") > 2, ["g"], ["ym"], "since", 99, False)
    return H.offset_risk(df.withColumn("since", F.col("since").cast("double")), "state", ["g"])


@query("ml01_logistic_walkforward")
def _(t):
    df = cut(risk_features(t))
    last = df.agg(F.max("ym")).first()[0]
    out = H.walk_forward(df, FEATURES, list(range(last - 11, last + 1)), 6, ["g", "ym", "event"])
    return out.withColumn("pred", F.round("pred", 6))


@query("ml02_time_only")
def _(t):
    df = cut(risk_features(t).withColumn("clock", F.col("clock").cast("double")))
    last = df.agg(F.max("ym")).first()[0]
    return H.walk_forward(df, ["clock"], list(range(last - 5, last + 1)), 6, ["g", "ym", "event"]).withColumn("pred", F.round("pred", 6))


#: Of the boosted trees here, whose tables have some thousand rows; the defaults of Settings are for large ones.
SMALL = B.Settings(leaves=8, depth=3, rate=0.2, least_rows=10, bins=63)


def _positive_weight(df, cap):
    """Weight of the events: controls for each, from 1 to cap."""
    rate = max(df.agg(F.avg("event")).first()[0] or 0.0, 1e-6)
    return F.when(F.col("event") == 1, min(max((1 - rate) / rate, 1.0), cap)).otherwise(1.0)


def _before_last(df, test=0.8, held=0.65):
    """First months of the recent rows to choose rounds on and of the rows to test on."""
    return df.agg(F.percentile("ym", F.array(F.lit(held), F.lit(test)))).first()[0]


@query("ml03_gbt")
def _(t):
    """Leaf-wise trees with a native category; rounds by average precision on the last months before the test, then a refit on all rows before it."""
    df = cut(risk_features(t))
    held, first = _before_last(df)
    train = df.where(F.col("ym") < first)
    model = B.boost_and_refit(train, FEATURES, ["brand"], F.col("ym") >= held, rounds=25, patience=6, weight=_positive_weight(train, 20.0), settings=SMALL)
    return B.predicted(model, df.where(F.col("ym") >= first)).select("g", "ym", "event", F.round("pred", 6).alias("pred"), F.lit(len(model.trees)).alias("rounds"))


def _shown_model(t):
    df = cut(risk_features(t).withColumn("clock", F.col("clock").cast("double")))
    return df, B.boost(df, [*FEATURES, "clock"], ["brand"], weight=_positive_weight(df, 20.0), rounds=8, settings=SMALL)


@query("ml10_shapley_features")
def _(t):
    """Mean size of the Shapley values of a boosted model over all rows, by feature."""
    df, model = _shown_model(t)
    return S.importance(model, df).select("feature", F.round("mean_abs", 6).alias("mean_abs"))


@query("ml10_shapley_rows")
def _(t):
    """Each row's Shapley values, which add up to its margin."""
    df, model = _shown_model(t)
    out = S.with_attributions(model, B.predicted(model, df))
    names = [*model.bins.names, "base"]
    return out.select("g", "ym", "spell", F.round("pred", 6).alias("pred"), *[F.round(F.col("attributions")[i], 6).alias(f"phi_{n}") for i, n in enumerate(names)])


@query("ml10_shapley_domains")
def _(t):
    """The same by domain of the features' names."""
    df, model = _shown_model(t)
    named = {"lag1": "qty_lag_1", "mean6": "prescriptions_mean_6m", "ret6": "recall_count_6m", "since": "months_since_warning", "suppliers": "n_manufacturers", "clock": "time_index", "brand": "therapeutic_class"}
    family = F.create_map(*[F.lit(x) for f, n in named.items() for x in (f, features.feature_family(n))])[F.col("feature")]
    return S.domains(S.importance(model, df), family).select("family", F.round("mean_abs", 6).alias("mean_abs"))


@query("ml07_validation_block", """with m as (select ym, sum(event) as e from sc group by ym), c as (select ym, row_number() over w as months, sum(e) over w as events from m window w as (order by ym desc rows between unbounded preceding and current row))
select max(ym) as first, min(months)::bigint as months from c where months between 6 and 12 and (events >= 20 or months = 12)""")
def _(t):
    w = Window.orderBy(F.desc("ym")).rowsBetween(Window.unboundedPreceding, 0)
    c = t.scored().groupBy("ym").agg(F.sum("event").alias("e"))
    c = c.select("ym", F.row_number().over(Window.orderBy(F.desc("ym"))).alias("months"), F.sum("e").over(w).alias("events"))
    ok = F.col("months").between(6, 12) & ((F.col("events") >= 20) | (F.col("months") == 12))
    return c.where(ok).agg(F.max("ym").alias("first"), F.min("months").alias("months"))


@query("ml09_platt")
def _(t):
    s = cut(t.scored())
    first = s.agg(F.percentile("ym", F.lit(0.5))).first()[0]
    return H.platt(s.where(F.col("ym") < first), s.where(F.col("ym") >= first)).withColumn("calibrated", F.round("calibrated", 6))


@query("ml11_permutation")
def _(t):
    df = cut(risk_features(t).select("g", "ym", "event", *FEATURES))
    first = df.agg(F.percentile("ym", F.lit(0.7))).first()[0]
    train = df.where(F.col("ym") < first)
    model = H.logistic(FEATURES, 1.0, train.count()).fit(train)
    return H.permutation_importance(model, df.where(F.col("ym") >= first), FEATURES)


@query("ml12_case_control", """with n as (select sum(event)::bigint as p, sum(1 - event)::bigint as q from sc), w as (select q, least(2 * p, q) as want from n),
c as (select *, row_number() over (order by md5('42/' || g || '/' || ym), g, ym) as r from sc where event = 0)
select g, ym, event, 1.0::double as weight from sc where event = 1 union all select g, ym, event, (q / greatest(want, 1))::double from c, w where r <= want""")
def _(t):
    return H.case_control(t.scored(), ["g", "ym"], 2).select("g", "ym", "event", F.col("__w").alias("weight"))


@query("ml04_focal")
def _(t):
    """Focal loss on a case-control sample with inverse weights; rounds by the later rows' average precision, all rows scored."""
    df = cut(risk_features(t).select("g", "brand", "ym", "event", *FEATURES))
    held, _ = _before_last(df)
    sample = H.case_control(df.select("g", "ym", "event"), ["g", "ym"], 3).select("g", "ym", "__w")
    settings = replace(SMALL, focal=(0.95, 2.0))
    model = B.boost_and_refit(df.join(sample, ["g", "ym"], "left"), FEATURES, ["brand"], F.col("ym") >= held, rounds=20, patience=6, weight=F.col("__w"), settings=settings)
    return B.predicted(model, df).select("g", "ym", "event", F.round("pred", 6).alias("pred"))


@query("ml01_categories")
def _(t):
    """The logistic hazard with a one-hot category."""
    df = cut(risk_features(t))
    first = df.agg(F.percentile("ym", F.lit(0.8))).first()[0]
    train = df.where(F.col("ym") < first)
    model = H.logistic(FEATURES, 1.0, train.count(), ["brand"]).fit(train)
    return H.scored(model, df.where(F.col("ym") >= first), ["g", "ym", "event"]).withColumn("pred", F.round("pred", 6))


@query("top05_best_setting", """with t as (select unnest(range(1, 50)) / 100.0::double as cut), x as (select cut, sum((score >= cut and event = 1)::int) as tp, sum((score >= cut)::int) as pp, sum(event) as p from sc cross join t group by cut)
select cut, round(2.0 * tp / (pp + p)::double, 9) as f1 from x where pp + p > 0 order by round(2.0 * tp / (pp + p)::double, 9) desc, cut limit 1""")
def _(t):
    from .base import QUERIES

    return QUERIES["met12_f1_sweep"](t.spark, t.dir).where("f1 is not null").orderBy(F.desc("f1"), "cut").limit(1)  # at most 49 rows


@query("ml08_tuning")
def _(t):
    df = cut(risk_features(t).select("ym", "event", *FEATURES))
    first = df.agg(F.percentile("ym", F.lit(0.7))).first()[0]
    return H.tune(df.where(F.col("ym") < first), df.where(F.col("ym") >= first), FEATURES, [0.01, 0.1, 1.0])


@query("ml08_tuned_walkforward")
def _(t):
    """The best penalty of a block of six months, then tests that start after it though an earlier start is asked for."""
    df = cut(risk_features(t))
    first = int(df.agg(F.percentile("ym", F.lit(0.6))).first()[0])
    out = H.tuned_walk_forward(df, FEATURES, [0.1, 0.3, 0.7, 1.0, 3.0], (first, first + 5), first + 2, 6, ["g", "ym", "event"])
    return out.select("g", "ym", "event", F.round("pred", 6).alias("pred"), "c", "start")


def onset_features(t):
    """At-risk months with trailing features and whether an onset follows within six months."""
    from .base import QUERIES

    w = W.rows(["g"], ["ym"])
    label = QUERIES["met10_horizon6"](t.spark, t.dir).select("g", "ym", F.col("within6").cast("long").alias("event"))
    df = t.group_state().withColumns(
        {
            "lag1": W.lag0("qty", 1, w).cast("double"),
            "mean6": F.coalesce(W.trailing(F.avg, "qty", 6, w), F.lit(0.0)),
            "ret6": F.coalesce(W.trailing(F.sum, "ret", 6, w), F.lit(0)).cast("double"),
            "few": (F.col("suppliers") <= 3).cast("double"),
        }
    )
    return label.join(df.select("g", "brand", "ym", "lag1", "mean6", "ret6", "few"), ["g", "ym"])


_ONSET = ["lag1", "mean6", "ret6", "few"]
_RISK = {"few": 2.0, "ret6": 1.5}


@query("ml13_weighted_sample", """with o as (select g, min(ym) as onset from sc where event = 1 group by g), l as (select max(ym) as last from gs),
y as (select sc.g, sc.ym, (onset is not null and onset - sc.ym between 0 and 5)::bigint as event from sc cross join l left join o using (g) where sc.ym + 6 <= last),
f as (select g, ym, suppliers, coalesce(sum(ret) over (partition by g order by ym rows between 6 preceding and 1 preceding), 0)::double as ret6 from gs),
n as (select y.*, greatest(0.35::double, exp(-ln(2::double) * ((select max(ym) from y) - y.ym) / 12)) as recent, 1 + 2.0::double * (suppliers <= 3)::int + 1.5::double * ret6 as risk, (('0x' || substr(md5('42/' || g || '/' || y.ym), 1, 13))::bigint + 0.5::double) / 4503599627370496::double as u from y join f using (g, ym)),
k as (select count(*) * 4 // 5 as k, sum(event) as p from n),
s as (select *, row_number() over (partition by event order by -ln(u) / greatest(case when event = 1 then recent else risk * recent end, 1e-6), g, ym) as r from n)
select g, ym, event from s, k where case when event = 1 then p < k or r <= k else r <= k - p end""")
def _(t):
    """Four rows of five: all events and controls by risk and recency; if the events alone are more, some of them by recency."""
    df = cut(onset_features(t))
    last, n = df.agg(F.max("ym"), F.count("*")).first()
    return P.training_sample(df, n * 4 // 5, "event", F.lit(last) - F.col("ym"), P.risk_weight(_RISK), ["g", "ym"]).select("g", "ym", "event")


def _logistic_on(columns):
    def fit(train, _):
        model = H.logistic(columns, 1.0, train.count()).fit(train)
        return lambda test: H.scored(model, test, test.columns).withColumnRenamed("pred", "score")

    return fit


def _fit_boosted(train, held):
    both = train.withColumn("__held", F.lit(False))
    if held is not None:
        both = both.unionByName(held.withColumn("__held", F.lit(True)))
    model = B.boost(both, _ONSET, ["brand"], held=None if held is None else F.col("__held"), rounds=5, patience=5, settings=SMALL)
    return lambda test: B.predicted(model, test, "score")


def _backtest(t):
    df = cut(onset_features(t))
    last = df.agg(F.max("ym")).first()[0]
    models = {"logistic": (_logistic_on(_ONSET), 400), "boosted": (_fit_boosted, 400)}
    return P.backtest(df, models, list(range(last - 2, last + 1)), "event", P.risk_weight(_RISK), ["g"])


@query("ml13_backtest")
def _(t):
    """Predictions of the last months by models fitted on what was known six months before."""
    return _backtest(t).select("model", "g", "ym", "event", F.round("score", 6).alias("score"))


@query("ml13_backtest_summary")
def _(t):
    out = P.backtest_metrics(_backtest(t), "g")
    return out.select("model", *[F.round(c, 6).alias(c) for c in out.columns if c != "model"])


@query("ml13_ablation")
def _(t):
    """The backtest with and without the supplier columns: what they add to each measure."""
    df = cut(onset_features(t))
    last = df.agg(F.max("ym")).first()[0]
    models = {"all": (_logistic_on(_ONSET), 400), "without": (_logistic_on([c for c in _ONSET if c != "few"]), 400)}
    out = P.backtest_metrics(P.backtest(df, models, list(range(last - 5, last + 1)), "event", P.risk_weight(_RISK), ["g"]), "g")
    names = [c for c in out.columns if c != "model"]
    pick = lambda m: out.where(F.col("model") == m).select(*[F.col(c).alias(f"{c}_{m}") for c in names])
    both = pick("all").crossJoin(F.broadcast(pick("without")))  # a row each
    return both.select(*[F.round(F.col(f"{c}_all") - F.col(f"{c}_without"), 6).alias(f"{c}_gain") for c in names])
