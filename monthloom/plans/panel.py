"""Window, spine and join queries over the panel proxies."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import ratio
from ..operators import joins as J
from ..operators import spine as S
from ..operators import windows as W
from .base import query

P = (["part"], ["ym"])
G = (["g"], ["ym"])


@query("spn01_month_list", "select unnest(range(min(ym), max(ym) + 1))::bigint as ym from li")
def _(t):
    return S.months(t.lines())


@query("spn02_skeleton", "select part, unnest(range(min(ym), max(ym) + 1))::bigint as ym from pm group by part")
def _(t):
    return S.densify(t.part_month(), ["part"])


@query("alg01_skeleton_clipped", """select part, unnest(range(greatest(a, 23952), least(b, 24000) + 1))::bigint as ym
from (select part, min(ym) as a, max(ym) as b from pm group by part) where b >= 23952 and a <= 24000""")
def _(t):
    return S.densify(t.part_month(), ["part"], first=F.lit(23952), last=F.lit(24000))


@query("spn03_bounded_dense", "select part, ym, price, (price is not null)::bigint as observed from dn")
def _(t):
    return t.dense().select("part", "ym", "price", F.col("price").isNotNull().cast("int").alias("observed"))


@query("spn04_quarter_lag", """select q.part, (unnest([0, 1, 2]) + (q.quarter + 2) * 3)::bigint as ym, q.qty
from (select part, ym // 3 as quarter, sum(qty)::bigint as qty from pm group by all) q""")
def _(t):
    q = t.part_month().groupBy("part", F.floor(F.col("ym") / 3).cast("int").alias("quarter")).agg(F.sum("qty").alias("qty"))
    return S.quarter_to_months(q, "quarter", 2).select("part", "ym", "qty")


@query("spn05_year_lag", """select part, (unnest(range(0, 12)) + (yr + 1) * 12)::bigint as ym, qty
from (select part, ym // 12 as yr, sum(qty)::bigint as qty from pm group by all)""")
def _(t):
    y = t.part_month().groupBy("part", F.floor(F.col("ym") / 12).cast("int").alias("yr")).agg(F.sum("qty").alias("qty"))
    return S.year_to_months(y, "yr", 1).select("part", "ym", "qty")


@query("spn06_unpivot", """select o_orderpriority as priority, k as status, v::bigint as orders from
(select o_orderpriority, count(*) filter (o_orderstatus = 'O') as "O", count(*) filter (o_orderstatus = 'F') as "F",
 count(*) filter (o_orderstatus = 'P') as "P" from orders group by all) unpivot (v for k in ("O", "F", "P"))""")
def _(t):
    wide = t("orders").groupBy("o_orderpriority").agg(
        *[F.sum((F.col("o_orderstatus") == s).cast("long")).alias(s) for s in "OFP"]
    )
    return wide.unpivot("o_orderpriority", list("OFP"), "status", "orders").withColumnRenamed("o_orderpriority", "priority")


@query("spn07_explode_list", """select k, list_sum(a)::bigint as years, len(a)::bigint as n from (values
 (1, [2020, 2022]), (2, []), (3, [2019])) x(k, a)""")
def _(t):
    df = t.spark.createDataFrame([(1, "2019->2020; 2021->2022"), (2, "none"), (3, "2018 -> 2019")], "k int, s string")
    a = S.arrows(F.col("s"))
    total = F.when(F.size(a) > 0, F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y))
    return df.select("k", total.alias("years"), F.size(a).alias("n"))


@query("spn08_source_precedence", """with a as (select part, ym // 12 as yr, sum(qty)::bigint as v from pm where part % 2 = 0 group by all),
q as (select part, ym // 12 as yr, sum(n)::bigint as v from pm group by all)
select part, yr, v, 'annual' as src from a union all select part, yr, v, 'quarterly' from q anti join a using (part, yr)""")
def _(t):
    pm = t.part_month().withColumn("yr", F.floor(F.col("ym") / 12))
    a = pm.where("part % 2 = 0").groupBy("part", "yr").agg(F.sum("qty").alias("v"))
    q = pm.groupBy("part", "yr").agg(F.sum("n").alias("v"))
    return a.withColumn("src", F.lit("annual")).unionByName(J.without(q, a, ["part", "yr"]).withColumn("src", F.lit("quarterly")))


@query("spn09_zero_completion", """select n_name as nation, y as yr, coalesce(c, 0)::bigint as returns from nation cross join (select unnest(range(1995, 2002))::bigint as y) g
left join (select s_nationkey as nk, ym // 12 as yy, count(*) as c from li join supplier on s_suppkey = l_suppkey
where l_returnflag = 'R' group by all) e on nk = n_nationkey and yy = y""")
def _(t):
    e = t.lines().where("l_returnflag = 'R'").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    e = e.groupBy(F.col("s_nationkey").alias("n_nationkey"), F.floor(F.col("ym") / 12).alias("yr")).agg(F.count("*").alias("c"))
    grid = t("nation").select("n_nationkey", F.col("n_name").alias("nation"), F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("yr"))
    return grid.join(e, ["n_nationkey", "yr"], "left").select("nation", "yr", F.coalesce("c", F.lit(0)).alias("returns"))


@query("spn11_group_impute", """with m as (select p_brand as brand, ym, median(price) as med from dn join part on p_partkey = part
where price is not null group by all)
select part, ym, price, 0::bigint as imputed from dn where price is not null union all
select dn.part, dn.ym, round(m.med, 6), 1 from dn join part on p_partkey = part join m on m.brand = p_brand and m.ym = dn.ym where dn.price is null""")
def _(t):
    brand = t("part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"))
    dn = t.dense().join(brand, "part")
    seen = dn.where("price is not null")
    med = seen.groupBy("brand", "ym").agg(F.percentile("price", F.lit(0.5)).alias("med"))
    gaps = J.without(dn.select("part", "ym", "brand"), seen, ["part", "ym"]).join(med, ["brand", "ym"])
    return seen.select("part", "ym", "price", F.lit(0).alias("imputed")).unionByName(
        gaps.select("part", "ym", F.round("med", 6).alias("price"), F.lit(1).alias("imputed"))
    )


@query("spn10_backfill", """select dn.part, dn.ym, coalesce(price, p_retailprice) as price, coalesce(cents, 0)::bigint as cents, p_brand as brand from dn join part on p_partkey = dn.part""")
def _(t):
    p = t("part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("derived"))
    have = t.part_month().select("part", "ym", "cents", (F.col("cents") / F.col("qty")).alias("price"))
    spine = t.dense().select("part", "ym").join(p, "part")
    return S.backfill(spine.join(have, ["part", "ym"], "left"), {"price": F.col("derived"), "cents": F.lit(0)}).drop("derived")


@query("spn11_group_totals", """with x as (select dn.part, ym, qty, cents, p_brand as brand from dn join part on p_partkey = dn.part), m as (select brand, ym, max(qty) as top from x where cents is not null group by all)
select part, ym, (case when cents is null then 0 else qty end)::bigint as qty, coalesce(m.top, qty)::bigint as group_qty, (cents is null)::bigint as imputed from x join m using (brand, ym)""")
def _(t):
    brand = t("part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"))
    x = t.dense().join(brand, "part")
    return S.group_totals(x, x.where("cents is not null"), ["brand", "ym"], "qty", F.col("cents").isNull()).select("part", "ym", "qty", "group_qty", "imputed")


@query("spn12_missing_flags", """select part, ym, coalesce(cents, 0) as cents, coalesce(price, -1) as price,
(cents is null)::bigint as cents_missing, (price is null)::bigint as price_missing from dn""")
def _(t):
    return S.fill_missing(t.dense().select("part", "ym", "cents", "price"), {"cents": 0, "price": -1.0})


@query("win01_lag_zero", """select part, ym, coalesce(lag(qty) over w, 0)::bigint as lag1, coalesce(lag(qty, 3) over w, 0)::bigint as lag3,
coalesce(lag(qty, 6) over w, 0)::bigint as lag6, (qty - coalesce(lag(qty, 3) over w, 0))::bigint as delta3 from dn window w as (partition by part order by ym)""")
def _(t):
    w = W.rows(*P)
    return t.dense().select(
        "part", "ym", *[W.lag0("qty", k, w).alias(f"lag{k}") for k in (1, 3, 6)], (F.col("qty") - W.lag0("qty", 3, w)).alias("delta3")
    )


_TRAIL = """select part, ym, coalesce(sum(qty) over a, 0)::bigint as sum12, coalesce(max(qty) over a, 0)::bigint as max12,
coalesce(avg(qty) over b, 0)::double as mean6 from dn
window a as (partition by part order by ym rows between {0} preceding and {1} preceding), b as (partition by part order by ym rows between {2} preceding and {1} preceding)"""


def _trail(t, lag):
    w, zero = W.rows(*P), F.lit(0)
    return t.dense().select(
        "part",
        "ym",
        F.coalesce(W.trailing(F.sum, "qty", 12, w, lag), zero).alias("sum12"),
        F.coalesce(W.trailing(F.max, "qty", 12, w, lag), zero).alias("max12"),
        F.coalesce(W.trailing(F.avg, "qty", 6, w, lag), F.lit(0.0)).alias("mean6"),
    )


query("win_trailing_lag1", _TRAIL.format(12, 1, 6))(lambda t: _trail(t, 1))
query("win04_trailing_lag3", _TRAIL.format(14, 3, 8))(lambda t: _trail(t, 3))


@query("win05_pct_change", """with x as (select part, ym, qty, lag(qty, 3) over w as b3, lag(qty, 12) over w as b12 from dn window w as (partition by part order by ym))
select part, ym, case when b3 is null then null when b3 = 0 and qty = 0 then null when b3 = 0 then 10.0 else greatest(-10.0, least(10.0, qty / b3 - 1)) end::double as pct3,
case when b12 is null then null when b12 = 0 and qty = 0 then null when b12 = 0 then 10.0 else greatest(-10.0, least(10.0, qty / b12 - 1)) end::double as pct12 from x""")
def _(t):
    w = W.rows(*P)
    return t.dense().select("part", "ym", *[W.change("qty", k, w).alias(f"pct{k}") for k in (3, 12)])


@query("win06_relative_change", """select part, ym, (a - b)::double / greatest(abs(b), 1) as rel from (select part, ym, lag(qty, 1) over w as a, lag(qty, 7) over w as b
from dn window w as (partition by part order by ym))""")
def _(t):
    return t.dense().select("part", "ym", W.relative_change("qty", 1, 7, W.rows(*P)).alias("rel"))


@query("win07_rolling_cv", """select part, quarter, round(case when count(*) over w >= 2 and avg(qty) over w > 0 then stddev_samp(qty) over w / avg(qty) over w end, 6) as cv
from (select part, ym // 3 as quarter, sum(qty)::bigint as qty from dn group by all) window w as (partition by part order by quarter rows between 3 preceding and current row)""")
def _(t):
    q = t.dense().groupBy("part", F.floor(F.col("ym") / 3).alias("quarter")).agg(F.sum("qty").alias("qty"))
    return q.select("part", "quarter", F.round(W.rolling_cv("qty", 4, W.rows(["part"], ["quarter"])), 6).alias("cv"))


@query("win08_ffill_limit", """select part, ym, last_value(price ignore nulls) over (partition by part order by ym rows between 6 preceding and current row) as filled,
(price is not null)::bigint as observed, (price is null and last_value(price ignore nulls) over (partition by part order by ym rows between 6 preceding and current row) is not null)::bigint as ffill from dn""")
def _(t):
    f = W.fill_forward("price", W.rows(*P), 6)
    return t.dense().select("part", "ym", f.alias("filled"), F.col("price").isNotNull().cast("int").alias("observed"), (F.col("price").isNull() & f.isNotNull()).cast("int").alias("ffill"))


@query("win09_ffill_spell_start", """select g, ym, last_value(case when state = 1 and p = 0 then ym end ignore nulls) over (partition by g order by ym rows between unbounded preceding and current row) as spell_start
from (select *, coalesce(lag(state) over (partition by g order by ym), 0) as p from gs)""")
def _(t):
    w = W.rows(*G)
    s = t.group_state().withColumn("at", F.when((F.col("state") == 1) & (W.lag0("state", 1, w) == 0), F.col("ym")))
    return s.select("g", "ym", W.fill_forward("at", w).alias("spell_start"))


@query("win10_ever_before", "select g, ym, coalesce(max(state) over (partition by g order by ym rows between unbounded preceding and 1 preceding), 0)::bigint as ever from gs")
def _(t):
    w = W.rows(*G).rowsBetween(W.START, -1)
    return t.group_state().select("g", "ym", F.coalesce(F.max("state").over(w), F.lit(0)).alias("ever"))


_SINCE = """select part, ym, coalesce(rn - max(case when ret > 0 then rn end) over (partition by part order by ym rows between unbounded preceding and {1}), {0})::bigint as since
from (select *, row_number() over (partition by part order by ym) as rn from dn)"""


@query("win11_recency_strict", _SINCE.format(999, "1 preceding"))
def _(t):
    return W.with_recency(t.dense(), F.col("ret") > 0, *P, "since", 999, False).select("part", "ym", "since")


@query("win12_recency_inclusive", _SINCE.format(-1, "current row"))
def _(t):
    return W.with_recency(t.dense(), F.col("ret") > 0, *P, "since", -1, True).select("part", "ym", "since")


_MEMORY = """with a as (select *, row_number() over w as rn, coalesce(lag(state) over w, 0) as p from gs window w as (partition by g order by ym)),
b as (select *, case when state = 0 and p = 1 then rn - max(case when state = 1 and p = 0 then rn end) over (partition by g order by ym rows between unbounded preceding and 1 preceding) end as ended from a)
select g, ym, coalesce(last_value(ended ignore nulls) over w, 0)::bigint as spell_last, round(coalesce(avg(ended) over w, 0), 9) as spell_mean, coalesce(max(ended) over w, 0)::bigint as spell_max,
coalesce(rn - max(case when state = 1 and p = 0 then rn end) over w, 999)::bigint as since_onset, coalesce(rn - max(case when ended is not null then rn end) over w, 999)::bigint as since_resolution,
case when max(case when ended is not null then rn end) over w is null then 0 else greatest(0, 6 - (rn - max(case when ended is not null then rn end) over w)) end::bigint as rebound
from b window w as (partition by g order by ym rows between unbounded preceding and 1 preceding)"""


@query("win13_spell_memory", _MEMORY)
def _(t):
    m = W.with_spell_memory(t.group_state(), "state", *G)
    return m.select("g", "ym", "spell_last", F.round("spell_mean", 9).alias("spell_mean"), "spell_max", "since_onset", "since_resolution", "rebound")


@query("win14_spell_id", """select g, spell::bigint as spell, count(*)::bigint as months, min(ym) as first from (select *, sum(case when state = 1 and p = 0 then 1 else 0 end) over (partition by g order by ym) as spell
from (select *, coalesce(lag(state) over (partition by g order by ym), 0) as p from gs)) where state = 1 group by all""")
def _(t):
    s = W.with_spells(t.group_state(), "state", *G).where("state = 1")
    return s.groupBy("g", "spell").agg(F.count("*").alias("months"), F.min("ym").alias("first"))


@query("win15_lead_adjacent", "select part, ym, case when lead(ym) over w = ym + 1 then lead(qty) over w end as next_qty from pm window w as (partition by part order by ym)")
def _(t):
    w = W.rows(*P)
    return t.part_month().select("part", "ym", F.when(F.lead("ym").over(w) == F.col("ym") + 1, F.lead("qty").over(w)).alias("next_qty"))


@query("win16_horizon_any6", """select g, ym, case when lead(state, 6) over (partition by g order by ym) is not null then
(max(state) over (partition by g order by ym rows between 1 following and 6 following) > 0)::bigint end as any6 from gs""")
def _(t):
    return t.group_state().select("g", "ym", W.horizon_any("state", 6, W.rows(*G)).alias("any6"))


@query("win17_leave_one_out", "select g, ym, (sum(qty) over (partition by brand, ym) - qty)::bigint as others from gs")
def _(t):
    return t.group_state().select("g", "ym", W.leave_one_out("qty", ["brand", "ym"]).alias("others"))


@query("win18_distinct_broadcast", """select l_suppkey as supplier, l_partkey as part, ym, count(distinct l_partkey) over (partition by l_suppkey, ym)::bigint as products
from (select distinct l_suppkey, l_partkey, ym from li)""")
def _(t):
    rows_ = t.lines().select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"), "ym").distinct()
    return W.with_distinct(rows_, "part", ["supplier", "ym"], "products").select("supplier", "part", "ym", "products")


@query("win19_median_ratio", """select part, ym, round(price / median(price) over (partition by p_brand, ym), 6) as rel,
(price <= quantile_cont(price, 0.25) over (partition by p_brand, ym))::bigint as low from dn join part on p_partkey = part where price is not null""")
def _(t):
    brand = t("part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"))
    w = Window.partitionBy("brand", "ym")
    df = t.dense().where("price is not null").join(brand, "part")
    q = lambda p: F.percentile("price", F.lit(p)).over(w)
    return df.select("part", "ym", F.round(ratio(F.col("price"), q(0.5)), 6).alias("rel"), (F.col("price") <= q(0.25)).cast("int").alias("low"))


@query("win20_diff12", "select g, ym, (suppliers - lag(suppliers, 12) over (partition by g order by ym))::bigint as net12 from gs")
def _(t):
    return t.group_state().select("g", "ym", (F.col("suppliers") - F.lag("suppliers", 12).over(W.rows(*G))).alias("net12"))


@query("win21_peer_pressure", """with s as (select brand, ym, sum(case when state = 1 and p = 0 then 1 else 0 end)::bigint as onsets, sum(state)::bigint as burden, count(*)::bigint as groups
from (select *, coalesce(lag(state) over (partition by g order by ym), 0) as p from gs) group by all)
select brand, ym, coalesce(sum(onsets) over a / greatest(avg(groups) over a, 1), 0)::double as onset6, coalesce(avg(burden) over b / greatest(avg(groups) over b, 1), 0)::double as burden3
from s window a as (partition by brand order by ym rows between 6 preceding and 1 preceding), b as (partition by brand order by ym rows between 3 preceding and 1 preceding)""")
def _(t):
    s = W.with_spells(t.group_state(), "state", *G)
    s = s.groupBy("brand", "ym").agg(F.sum("starts").alias("onsets"), F.sum("state").alias("burden"), F.count("*").alias("groups"))
    w, zero = W.rows(["brand"], ["ym"]), F.lit(0.0)
    peer = lambda top, agg, n: F.coalesce(W.trailing(agg, top, n, w) / F.greatest(W.trailing(F.avg, "groups", n, w), F.lit(1.0)), zero)
    return s.select("brand", "ym", peer("onsets", F.sum, 6).alias("onset6"), peer("burden", F.avg, 3).alias("burden3"))


@query("win22_snapshot_entry_exit", """with y as (select g, ym // 12 as yr, max(suppliers) as k from gs group by all), d as (select *, k - lag(k) over (partition by g order by yr) as dk from y)
select a.g, a.yr, coalesce(max((b.dk > 0)::int), 0)::bigint as entry2, coalesce(max((b.dk < 0)::int), 0)::bigint as exit2 from d a left join d b on a.g = b.g and b.yr between a.yr - 2 and a.yr - 1 group by all""")
def _(t):
    y = t.group_state().groupBy("g", F.floor(F.col("ym") / 12).alias("yr")).agg(F.max("suppliers").alias("k"))
    w = W.rows(["g"], ["yr"])
    y = y.withColumn("dk", F.col("k") - F.lag("k").over(w))
    back = w.rangeBetween(-2, -1)
    return y.select(
        "g",
        "yr",
        F.coalesce(F.max((F.col("dk") > 0).cast("int")).over(back), F.lit(0)).alias("entry2"),
        F.coalesce(F.max((F.col("dk") < 0).cast("int")).over(back), F.lit(0)).alias("exit2"),
    )


@query("win24_rank_budget", "select g, ym, row_number() over (partition by ym order by score desc, g)::bigint as rank from sc")
def _(t):
    return t.scored().select("g", "ym", F.row_number().over(Window.partitionBy("ym").orderBy(F.desc("score"), "g")).alias("rank"))


@query("win25_lookback", """select g, ym, count(*) over w::bigint as seen, (36 - count(*) over w)::bigint as pad, array_to_string(list(qty) over w, ',') as series
from gs window w as (partition by g order by ym range between 35 preceding and current row)""")
def _(t):
    w = W.rows(*G).rangeBetween(-35, 0)
    seq = F.transform(F.sort_array(F.collect_list(F.struct("ym", "qty")).over(w)), lambda x: x["qty"].cast("string"))
    return t.group_state().select("g", "ym", F.count("*").over(w).alias("seen"), (36 - F.count("*").over(w)).alias("pad"), F.array_join(seq, ",").alias("series"))


@query("join01_product_package", "select p_partkey as part, p_name as name, l_suppkey as supplier, count(*)::bigint as n from part left join lineitem on l_partkey = p_partkey group by all")
def _(t):
    j = t("part").join(t("lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left")
    return j.groupBy(F.col("p_partkey").alias("part"), F.col("p_name").alias("name"), F.col("l_suppkey").alias("supplier")).agg(F.count("*").alias("n"))


@query("join02_star_assemble", """with f as (select l_partkey as part, ym, min(l_suppkey) as supplier from li group by all),
sup as (select s_suppkey as supplier, s_nationkey::bigint as nation from supplier)
select dn.part, dn.ym, dn.qty, dn.ret, coalesce(price, 0) as price, (price is null)::bigint as price_missing, coalesce(nation, -1) as nation, (nation is null)::bigint as nation_missing, p_brand as brand
from dn left join f using (part, ym) left join sup using (supplier) left join part on p_partkey = dn.part""")
def _(t):
    first = t.lines().groupBy(F.col("l_partkey").alias("part"), "ym").agg(F.min("l_suppkey").alias("supplier"))
    sup = t("supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").cast("long").alias("nation"))
    brand = t("part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"))
    j = J.star_left(t.dense().drop("cents"), (first, ["part", "ym"]), (sup, ["supplier"]), (brand, ["part"]))
    j = S.fill_missing(j, {"price": 0.0, "nation": -1})
    return j.select("part", "ym", "qty", "ret", "price", "price_missing", "nation", "nation_missing", "brand")


@query("join03_inner", "select s_name as supplier, n_name as nation, r_name as region from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def _(t):
    j = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("s_name").alias("supplier"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("join04_full_outer", """with a as (select c_nationkey as k, count(*)::bigint as customers from customer where c_acctbal > 9000 group by all), b as (select s_nationkey as k, count(*)::bigint as suppliers from supplier where s_acctbal > 5000 group by all)
select k::bigint as k, customers, suppliers from a full join b using (k)""")
def _(t):
    a = t("customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = t("supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full")


@query("join05_dictionary_map", "select o_orderkey as k, case o_orderstatus when 'O' then 'open' when 'F' then 'filled' end as status from orders")
def _(t):
    names = F.create_map(*[F.lit(x) for x in ("O", "open", "F", "filled")])
    return t("orders").select(F.col("o_orderkey").alias("k"), F.try_element_at(names, F.col("o_orderstatus")).alias("status"))


@query("join06_cascade_lookup", """with s as (select l_partkey as part, ym // 12 as yr, max(cents) as v from li group by all), f as (select part, v, yr, row_number() over (partition by part order by yr desc) as r from s where yr <= 1997)
select p_partkey as part, v, yr from part left join f on part = p_partkey and r = 1""")
def _(t):
    s = t.lines().groupBy(F.col("l_partkey").alias("part"), F.floor(F.col("ym") / 12).alias("yr")).agg(F.max("cents").alias("v"))
    keys = t("part").select(F.col("p_partkey").alias("part"))
    return J.cascade(keys, s.where("yr <= 1997"), ["part"], F.desc("yr"), "v").select("part", "v", "yr")


@query("join07_two_tier_crosswalk", """with l as (select p_partkey as part, case when p_partkey % 3 = 0 then upper(p_name) when p_partkey % 3 = 1 then p_name else p_name || ' x' end as name from part),
r as (select p_name as name, min(p_size)::bigint as size from part group by all), n as (select lower(name) as name, min(size) as size from r group by all)
select part, coalesce(r.size, n.size)::bigint as size, case when r.name is not null then 'exact' when n.name is not null then 'normalised' end as tier from l left join r on l.name = r.name left join n on lower(l.name) = n.name""")
def _(t):
    n, k = F.col("p_name"), F.col("p_partkey") % 3
    left = t("part").select(F.col("p_partkey").alias("part"), F.when(k == 0, F.upper(n)).when(k == 1, n).otherwise(F.concat(n, F.lit(" x"))).alias("name"))
    right = t("part").select(n.alias("name"), F.lower(n).alias("loose"), F.col("p_size").alias("size"))
    return J.two_tier(left.withColumn("loose", F.lower("name")), right, "name", "loose", "size").select("part", "size", "tier")


@query("join08_anti_composite", "select part, ym from dn anti join (select part, ym from pm) using (part, ym)")
def _(t):
    return J.without(t.dense(), t.part_month(), ["part", "ym"]).select("part", "ym")


@query("join09_event_window", """with e as (select l_partkey as part, ym from li where l_returnflag = 'R')
select dn.part, dn.ym, count(*) filter (e.ym >= dn.ym - 3)::bigint as n3, count(*) filter (e.ym >= dn.ym - 12)::bigint as n12, count(e.ym)::bigint as n24
from dn left join e on e.part = dn.part and e.ym >= dn.ym - 24 and e.ym < dn.ym group by all""")
def _(t):
    e = t.lines().where("l_returnflag = 'R'").select(F.col("l_partkey").alias("part"), "ym")
    return J.event_windows(t.dense().select("part", "ym"), e, ["part"], {f"n{n}": n for n in (3, 12, 24)})


@query("join10_expiry_lists", """with x as (select distinct l_partkey as part, (year(o_orderdate) * 12 + month(o_orderdate) - 1 + 24)::bigint as e from li join orders on o_orderkey = l_orderkey)
select dn.part, dn.ym, count(x.e) filter (x.e > dn.ym)::bigint as active, coalesce(min(x.e) filter (x.e > dn.ym) - dn.ym, -1)::bigint as next_in, coalesce(max((x.e <= dn.ym and x.e >= dn.ym - 12)::int), 0)::bigint as recent from dn left join x on x.part = dn.part group by dn.part, dn.ym""")
def _(t):
    from ..functions.dates import month_index

    o = t("orders").select("o_orderkey", (month_index(F.to_date("o_orderdate")) + 24).alias("e"))
    x = t.lines().join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_partkey").alias("part")).agg(F.sort_array(F.collect_set("e")).alias("es"))
    j = t.dense().select("part", "ym").join(x, "part", "left").withColumn("es", F.coalesce("es", F.array().cast("array<int>")))
    live = F.filter("es", lambda e: e > F.col("ym"))
    return j.select(
        "part",
        "ym",
        F.size(live).alias("active"),
        F.coalesce(F.array_min(live) - F.col("ym"), F.lit(-1)).alias("next_in"),
        F.exists("es", lambda e: (e <= F.col("ym")) & (e >= F.col("ym") - 12)).cast("int").alias("recent"),
    )


@query("join11_interval_expand", """with o as (select l_partkey as part, l_orderkey as k, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::bigint as s, ym as e from li join orders on o_orderkey = l_orderkey),
x as (select distinct part, k, s, e from o where e >= s and e <= s + 24), m as (select *, unnest(range(s, e + 1))::bigint as mm from x)
select dn.part, dn.ym, q.k, q.s as start from dn join (select *, row_number() over (partition by part, mm order by s, k, e) as r from m) q on q.part = dn.part and q.mm = dn.ym and q.r = 1""")
def _(t):
    from ..functions.dates import month_index

    o = t("orders").select("o_orderkey", month_index(F.to_date("o_orderdate")).alias("start"))
    x = t.lines().join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("k"), "start", F.col("ym").alias("end"))
    x = x.where((F.col("end") >= F.col("start")) & (F.col("end") <= F.col("start") + 24)).distinct()
    return J.interval_months(t.dense().select("part", "ym"), x, ["part"], [F.col("start"), F.col("k"), F.col("end")]).select("part", "ym", "k", "start")


@query("join12_asof_prior_year", """with s as (select g, ym // 12 as snap, max(suppliers) as k from gs group by all), y as (select distinct ym // 12 as yr from gs), m as (select yr, coalesce(max(snap) filter (snap < yr), min(snap)) as snap from y cross join (select distinct snap from s) group by yr)
select gs.g, gs.ym, s.k from gs join m on m.yr = ym // 12 left join s on s.g = gs.g and s.snap = m.snap""")
def _(t):
    gs = t.group_state().withColumn("year", F.floor(F.col("ym") / 12))
    snaps = gs.groupBy("g", F.col("year").alias("snap")).agg(F.max("suppliers").alias("k"))
    m = J.asof_prior(gs.select("year"), snaps)
    return gs.join(F.broadcast(m), "year").join(snaps, ["g", "snap"], "left").select("g", "ym", "k")


@query("join13_asof_gated_hhi", """with f as (select l_partkey as part, s_nationkey as nk, l_suppkey, min(ym) as ym from li join supplier on s_suppkey = l_suppkey group by all),
c as (select d.part, d.ym, f.nk, count(*) as k from dn d join f on f.part = d.part and f.ym <= d.ym group by all)
select part, ym, sum(k)::bigint as suppliers, sum(k * k)::double / (sum(k) * sum(k))::double as hhi from c group by all""")
def _(t):
    sup = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nk"))
    f = t.lines().join(sup, "l_suppkey").groupBy(F.col("l_partkey").alias("part"), "nk", "l_suppkey").agg(F.min("ym").alias("ym"))
    new = f.groupBy("part", "nk", "ym").agg(F.count("*").alias("k"))
    # k more suppliers in a nation of c add k to the sum and 2ck + k^2 to the sum of squares
    c = F.coalesce(F.sum("k").over(W.rows(["part", "nk"], ["ym"]).rowsBetween(W.START, -1)), F.lit(0))
    step = new.select("part", "ym", "k", (2 * c * F.col("k") + F.col("k") * F.col("k")).alias("q"))
    step = step.groupBy("part", "ym").agg(F.sum("k").alias("k"), F.sum("q").alias("q"))
    w = W.rows(*P).rowsBetween(W.START, 0)
    run = t.dense().select("part", "ym").join(step, ["part", "ym"], "left").withColumns({"k": F.sum("k").over(w), "q": F.sum("q").over(w)})
    return run.where("k > 0").select("part", "ym", F.col("k").alias("suppliers"), (F.col("q").cast("double") / (F.col("k") * F.col("k")).cast("double")).alias("hhi"))


@query("join14_asof_carry", """with q as (select distinct ym // 3 as qtr from li), x as (select qtr, last_value(case when qtr % 3 <> 1 then qtr end ignore nulls) over (order by qtr rows between unbounded preceding and current row) as ref from q)
select x.qtr, x.ref, count(l.ym)::bigint as n from x left join li l on l.ym // 3 = x.ref group by all""")
def _(t):
    q = t.lines().select(F.floor(F.col("ym") / 3).alias("qtr"))
    x = q.distinct().withColumn("have", F.when(F.col("qtr") % 3 != 1, F.col("qtr")))
    x = x.select("qtr", F.last("have", ignorenulls=True).over(Window.orderBy("qtr").rowsBetween(W.START, 0)).alias("ref"))
    n = q.groupBy(F.col("qtr").alias("ref")).agg(F.count("*").alias("n"))
    return x.join(n, "ref", "left").select("qtr", "ref", F.coalesce("n", F.lit(0)).alias("n"))


@query("join15_grid", "select s_suppkey as supplier, unnest(range(24000, 24012))::bigint as ym from supplier")
def _(t):
    return t("supplier").select(F.col("s_suppkey").alias("supplier"), F.explode(F.sequence(F.lit(24000), F.lit(24011))).alias("ym"))


@query("join18_hint_filter", """select p_partkey as part, p_type as type from (select *, max((p_size > 25)::int) over (partition by p_name) as any_hit from part) where any_hit = 0 or p_size > 25""")
def _(t):
    return J.keep_hits(t("part"), ["p_name"], F.col("p_size") > 25).select(F.col("p_partkey").alias("part"), F.col("p_type").alias("type"))


@query("join20_align", """select a.g, a.ym, a.score as s1, 1 - a.score as s2 from sc a join (select g, ym from sc where score > 0.1) b using (g, ym)""")
def _(t):
    s = t.scored()
    two = s.withColumn("score", 1 - F.col("score")).where("score < 0.9")
    long = s.select("g", "ym", F.lit("a").alias("m"), "score").unionByName(two.select("g", "ym", F.lit("b").alias("m"), "score"))
    wide = long.groupBy("g", "ym").pivot("m", ["a", "b"]).agg(F.max("score"))
    return wide.where("a is not null and b is not null").select("g", "ym", F.col("a").alias("s1"), F.col("b").alias("s2"))


@query("join23_group_to_member", "select p_partkey as part, sc.ym, sc.score from part join sc on sc.g = p_brand || ' | ' || p_type")
def _(t):
    m = t("part").select(F.col("p_partkey").alias("part"), F.concat_ws(" | ", "p_brand", "p_type").alias("g"))
    return m.join(t.scored(), "g").select("part", "ym", "score")
