"""Filters, aggregates, deduplication, sets, top-k, reports and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import tables as A
from ..operators import windows as W
from .base import query


def _year():
    return F.floor(F.col("ym") / 12)


@query("flt01_whitelist", "select c_custkey as k from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def _(t):
    return t("customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("k"))


@query("flt02_null_safe_exclusion", "select l_orderkey as k, count(*)::bigint as n from li where coalesce(nullif(l_returnflag, 'A'), 'N') <> 'R' group by all")
def _(t):
    flag = F.coalesce(F.nullif("l_returnflag", F.lit("A")), F.lit("N"))
    return t.lines().where(flag != "R").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))


@query("flt03_keep_nulls", "select l_partkey as part, count(*)::bigint as n from li where nullif(l_returnflag, 'N') is distinct from 'R' group by all")
def _(t):
    keep = ~F.nullif("l_returnflag", F.lit("N")).eqNullSafe(F.lit("R"))
    return t.lines().where(keep).groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("n"))


@query("flt04_regex_contains", "select p_partkey as part from part where regexp_matches(p_name, '(?i)(red|blue|green)')")
def _(t):
    return t("part").where(F.coalesce(F.col("p_name").rlike("(?i)(red|blue|green)"), F.lit(False))).select(F.col("p_partkey").alias("part"))


@query("flt05_date_range", "select l_orderkey as k, l_linenumber::bigint as line, l_partkey as part from li where d between date '1997-01-15' and date '1997-03-31'")
def _(t):
    r = t.lines().where(F.col("d").between(F.lit("1997-01-15").cast("date"), F.lit("1997-03-31").cast("date")))
    return r.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))


@query("flt06_interval_overlap", "select part, min(ym) as s, max(ym) as e from pm group by part having min(ym) <= 23976 and max(ym) >= 23960")
def _(t):
    w = t.part_month().groupBy("part").agg(F.min("ym").alias("s"), F.max("ym").alias("e"))
    return w.where("s <= 23976 and e >= 23960")


@query("flt07_anti_filter", "select p_partkey as k from part where p_partkey not in (select l_partkey from lineitem where l_quantity = 1)")
def _(t):
    """Parts that were never sold singly."""
    single = t("lineitem").where("l_quantity = 1").select(F.col("l_partkey").alias("p_partkey"))
    return J.without(t("part").select("p_partkey"), single, ["p_partkey"]).withColumnRenamed("p_partkey", "k")


@query("flt08_active_only", "select part, ym, ret from dn where part in (select part from pm group by part having max(ret) > 1)")
def _(t):
    from pyspark.sql.window import Window

    any_ = F.max("ret").over(Window.partitionBy("part"))
    return t.dense().withColumn("m", any_).where("m > 1").select("part", "ym", "ret")


@query("flt09_keyword_any", "select p_partkey as part, (p_type ilike '%steel%' or p_type ilike '%brass%' or p_name ilike '%red%')::bigint as hit from part")
def _(t):
    hit = F.exists(F.array(F.lit("steel"), F.lit("brass")), lambda x: F.lower("p_type").contains(x)) | F.lower("p_name").contains("red")
    return t("part").select(F.col("p_partkey").alias("part"), hit.cast("int").alias("hit"))


@query("flt10_full_match", "select s_suppkey as k, regexp_full_match(s_name, 'Supplier#\\d{9}')::bigint as ok from supplier")
def _(t):
    return t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").rlike(r"^Supplier#\d{9}$").cast("int").alias("ok"))


@query("flt11_column_screen", """select name from (select unnest(['qty', 'ret', 'price']) as name, unnest([avg((qty is not null)::int), avg((ret is not null)::int), avg((price is not null)::int)]) as share from dn where ym < 24000) where share > 0.9""")
def _(t):
    names = ["qty", "ret", "price"]
    p = A.null_profile(t.dense().where("ym < 24000"), names)
    return p.where("1 - rate > 0.9").select("name")


@query("flt13_suffix_collision", "select n_nationkey::bigint as key_left, r_regionkey::bigint as key_right, n_name as name, r_name as name_right from nation join region on n_regionkey = r_regionkey")
def _(t):
    a = t("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("rk")).alias("a")
    b = t("region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")).alias("b")
    return a.join(b, F.col("a.rk") == F.col("b.key")).select(
        F.col("a.key").alias("key_left"), F.col("b.key").alias("key_right"), F.col("a.name").alias("name"), F.col("b.name").alias("name_right")
    )


@query("flt14_first_entities", "select part, ym, qty from pm where part in (select distinct part from pm order by part limit 50)")
def _(t):
    pm = t.part_month()
    return J.only_in(pm, pm.select("part").distinct().orderBy("part").limit(50), ["part"]).select("part", "ym", "qty")


@query("agg01_min_max", "select part, min(ym) as a, max(ym) as b from pm group by part")
def _(t):
    return t.part_month().groupBy("part").agg(F.min("ym").alias("a"), F.max("ym").alias("b"))


@query("agg02_count_distinct", "select l_partkey as part, ym // 12 as yr, count(distinct l_suppkey)::bigint as suppliers from li group by all")
def _(t):
    return t.lines().groupBy(F.col("l_partkey").alias("part"), _year().alias("yr")).agg(F.countDistinct("l_suppkey").alias("suppliers"))


@query("agg03_collect", "select l_partkey as part, array_to_string(list(distinct l_suppkey order by l_suppkey), ',') as suppliers from li group by all")
def _(t):
    s = F.transform(F.sort_array(F.collect_set("l_suppkey")), lambda x: x.cast("string"))
    return t.lines().groupBy(F.col("l_partkey").alias("part")).agg(F.array_join(s, ",").alias("suppliers"))


@query("agg04_any_flag", "select l_partkey as part, max((l_returnflag = 'R')::int)::bigint as any_r, bool_or(qty > 49) as big from li group by all")
def _(t):
    return t.lines().groupBy(F.col("l_partkey").alias("part")).agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("any_r"), F.bool_or(F.col("qty") > 49).alias("big"))


@query("agg05_sum_ratio", "select ym, sum(cents)::bigint as cents, sum(qty)::bigint as qty, sum(cents) / nullif(sum(qty), 0)::double as unit from li group by all")
def _(t):
    c, q = F.sum("cents"), F.sum("qty")
    return t.lines().groupBy("ym").agg(c.alias("cents"), q.alias("qty"), (c / F.nullif(q, F.lit(0))).alias("unit"))


@query("agg06_last_in_month", """select l_partkey as part, ym, arg_max(cents, (d, l_orderkey, l_linenumber, l_suppkey, cents)) filter (l_returnflag <> 'R') as cents from li group by all""")
def _(t):
    df = t.lines().withColumn("v", F.when(F.col("l_returnflag") != "R", F.col("cents")))
    return df.groupBy(F.col("l_partkey").alias("part"), "ym").agg(A.last_value("v", "d", "l_orderkey", "l_linenumber", "l_suppkey", "cents").alias("cents"))


@query("agg07_median_quantile", "select p_brand as brand, round(median(p_retailprice), 6) as med, round(quantile_cont(p_retailprice, 0.25), 6) as q25 from part group by all")
def _(t):
    p = lambda x: F.round(F.percentile("p_retailprice", F.lit(x)), 6)
    return t("part").groupBy(F.col("p_brand").alias("brand")).agg(p(0.5).alias("med"), p(0.25).alias("q25"))


@query("agg08_group_rollup", """select p_brand as brand, p_type as type, ym, count(distinct dn.part)::bigint as parts, max(ret)::bigint as state, sum(qty)::bigint as qty, round(median(price), 6) as price, arg_min(p_name, dn.part) as name from dn join part on p_partkey = dn.part group by all""")
def _(t):
    p = t("part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_name").alias("name"))
    rules = {
        "parts": F.count("*"),  # the grid has one row per part and month
        "state": F.max("ret"),
        "qty": F.sum("qty"),
        "price": F.round(F.percentile("price", F.lit(0.5)), 6),
        "name": F.min_by("name", "part"),
    }
    return A.roll_up(t.dense().join(p, "part"), ["brand", "type", "ym"], rules)


@query("agg09_composition", """select p_brand as brand, ym, count(distinct l_suppkey)::bigint as suppliers, avg((l_returnflag = 'R')::int) as share_r, round(coalesce(stddev_samp(qty), 0), 6) as std_qty from li join part on p_partkey = l_partkey group by all""")
def _(t):
    df = t.lines().join(t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand")), "l_partkey")
    return df.groupBy("brand", "ym").agg(
        F.countDistinct("l_suppkey").alias("suppliers"),
        F.avg((F.col("l_returnflag") == "R").cast("int")).alias("share_r"),
        F.round(F.coalesce(F.stddev_samp("qty"), F.lit(0.0)), 6).alias("std_qty"),
    )


@query("agg10_dominance", """with a as (select p_brand as brand, l_suppkey, count(distinct l_partkey) as k from li join part on p_partkey = l_partkey group by all), b as (select p_brand as brand, count(distinct l_partkey) as total from li join part on p_partkey = l_partkey group by all)
select brand, max(k) / any_value(total) as dominance from a join b using (brand) group by brand""")
def _(t):
    df = t.lines().join(t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand")), "l_partkey")
    return A.dominance(df, ["brand"], "l_suppkey", "l_partkey")


@query("agg11_fragmentation", "select g, ym, (parts / greatest(suppliers, 1))::double as fragmentation from gm")
def _(t):
    return t.group_month().select("g", "ym", (F.col("parts") / F.greatest("suppliers", F.lit(1))).alias("fragmentation"))


@query("agg12_shares_hhi", """with c as (select l_partkey as part, s_nationkey as nk, count(*) as k from li join supplier on s_suppkey = l_suppkey group by all)
select part, sum(k)::bigint as n, max(k)::double / sum(k)::double as top_share, sum(k * k)::double / (sum(k) * sum(k))::double as hhi from c group by all""")
def _(t):
    c = t.lines().join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_partkey").alias("part"), "s_nationkey").agg(F.count("*").alias("k"))
    n, sq = F.sum("k"), F.sum(F.col("k") * F.col("k"))
    return c.groupBy("part").agg(n.alias("n"), (F.max("k").cast("double") / n.cast("double")).alias("top_share"), (sq.cast("double") / (n * n).cast("double")).alias("hhi"))


@query("agg13_weighted_exposure", """with c as (select l_partkey as part, s_nationkey as nk, count(*) as k from li join supplier on s_suppkey = l_suppkey group by all), e as (select s_nationkey as nk, ym // 12 as yr, count(*) as r from li join supplier on s_suppkey = l_suppkey where l_returnflag = 'R' group by all), s as (select *, sum(k) over (partition by part) as n from c)
select part, yr, round(sum(k * r)::double / any_value(n)::double, 4) as exposure, max((r >= 60)::int)::bigint as major from s join e using (nk) group by part, yr""")
def _(t):
    from pyspark.sql.window import Window

    df = t.lines().join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nk")), "l_suppkey")
    c = df.groupBy(F.col("l_partkey").alias("part"), "nk").agg(F.count("*").alias("k"))
    c = c.withColumn("n", F.sum("k").over(Window.partitionBy("part")))
    e = df.where("l_returnflag = 'R'").groupBy("nk", _year().alias("yr")).agg(F.count("*").alias("r"))
    x = c.join(e, "nk").groupBy("part", "yr")
    return x.agg(
        F.round(F.sum(F.col("k") * F.col("r")).cast("double") / F.max("n").cast("double"), 4).alias("exposure"),
        F.max((F.col("r") >= 60).cast("int")).alias("major"),
    )


@query("agg14_peer_counts", "select brand, ym, sum(state)::bigint as burden, count(distinct g)::bigint as groups, sum(ret)::bigint as ret from gs group by all")
def _(t):
    return t.group_state().groupBy("brand", "ym").agg(F.sum("state").alias("burden"), F.countDistinct("g").alias("groups"), F.sum("ret").alias("ret"))


@query("agg15_coverage", "select ym, count(*)::bigint as n, count(distinct l_partkey)::bigint as parts, min(qty) as low, max(qty) as high from li group by all")
def _(t):
    return t.lines().groupBy("ym").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts"), F.min("qty").alias("low"), F.max("qty").alias("high"))


@query("agg16_value_counts", "select p_brand as brand, count(*)::bigint as n from part group by all order by n desc, brand limit 10")
def _(t):
    return t("part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "brand").limit(10)


@query("agg17_describe", """select count(qty)::bigint as n, avg(qty) as mean, round(stddev_samp(qty), 6) as std, min(qty) as low, max(qty) as high, quantile_cont(qty, 0.25)::double as q25, quantile_cont(qty, 0.5)::double as q50, quantile_cont(qty, 0.75)::double as q75 from dn""")
def _(t):
    return A.describe(t.dense(), "qty").withColumn("std", F.round("std", 6))


@query("agg18_binned_rate", """select bin::bigint as bin, count(*)::bigint as n, avg(state) as rate from (select state, case when suppliers > 0 and suppliers <= 1 then 0 when suppliers > 1 and suppliers <= 2 then 1 when suppliers > 2 and suppliers <= 5 then 2 when suppliers > 5 and suppliers <= 10 then 3 end as bin from gs) group by bin""")
def _(t):
    b = A.binned("suppliers", [0, 1, 2, 5, 10])
    return t.group_state().groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("state").alias("rate"))


@query("agg19_null_profile", """select unnest(['cents', 'price', 'qty']) as name, unnest([sum((cents is null)::int), sum((price is null)::int), sum((qty is null)::int)])::bigint as nulls,
unnest([sum((cents is null)::int), sum((price is null)::int), sum((qty is null)::int)])::double / count(*)::double as rate from dn""")
def _(t):
    return A.null_profile(t.dense(), ["cents", "price", "qty"])


@query("agg20_event_frequency", "select ym, sum(state)::bigint as events, count(*)::bigint as n from gs group by all")
def _(t):
    return t.group_state().groupBy("ym").agg(F.sum("state").alias("events"), F.count("*").alias("n"))


@query("agg21_duplicate_keys", "select l_orderkey as k, l_linenumber::bigint as line, count(*)::bigint as n from li group by all having count(*) > 1")
def _(t):
    d = A.duplicate_keys(t.lines(), ["l_orderkey", "l_linenumber"])
    return d.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("count").alias("n"))


@query("agg21_unique_gate", "select part, ym, qty from pm")
def _(t):
    return A.require_unique(t.part_month(), ["part", "ym"]).select("part", "ym", "qty")


@query("agg22_fold_stability", """with y as (select brand, ym // 12 as yr, avg(state) as rate from gs group by all)
select brand, round(avg(rate), 9) as mean, round(stddev_samp(rate), 9) as std, count(*)::bigint as folds from y group by all""")
def _(t):
    y = t.group_state().groupBy("brand", _year().alias("yr")).agg(F.avg("state").alias("rate"))
    return y.groupBy("brand").agg(F.round(F.avg("rate"), 9).alias("mean"), F.round(F.stddev_samp("rate"), 9).alias("std"), F.count("*").alias("folds"))


@query("agg23_domain_rollup", """with c as (select p_brand as brand, part, avg((price is not null)::int) as share from dn join part on p_partkey = dn.part group by all)
select brand, count(*)::bigint as n, round(sum(share), 6) as total, round(median(share), 6) as med, min(share) as low from c group by all""")
def _(t):
    p = t("part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"))
    c = t.dense().join(p, "part").groupBy("brand", "part").agg(F.avg(F.col("price").isNotNull().cast("int")).alias("share"))
    return c.groupBy("brand").agg(F.count("*").alias("n"), F.round(F.sum("share"), 6).alias("total"), F.round(F.percentile("share", F.lit(0.5)), 6).alias("med"), F.min("share").alias("low"))


_TIE = "l_orderkey, l_linenumber, l_suppkey, cents"


def _first(t, by, *order):
    return W.first_by(t.lines(), by, *order, *[F.col(c) for c in _TIE.split(", ")]).select(
        *by, F.col("l_orderkey").alias("k"), F.col("cents").alias("v")
    )


def _first_sql(by, order):
    return f"select {by}, l_orderkey as k, cents as v from li qualify row_number() over (partition by {by} order by {order}, {_TIE}) = 1"


query("ddp01_keep_last_by_date", _first_sql("l_partkey", "d desc"))(lambda t: _first(t, ["l_partkey"], F.desc("d")))
query("ddp02_keep_first", _first_sql("l_partkey", "d"))(lambda t: _first(t, ["l_partkey"], F.asc("d")))
query("ddp03_earliest_start", _first_sql("l_partkey, ym", "d"))(lambda t: _first(t, ["l_partkey", "ym"], F.asc("d")))
query("ddp04_argmin", _first_sql("l_partkey, ym", "cents"))(lambda t: _first(t, ["l_partkey", "ym"], F.asc("cents")))
query("ddp05_prefer_observed", _first_sql("l_suppkey, ym", "(case when l_returnflag = 'N' then 0 else 1 end)"))(
    lambda t: _first(t, ["l_suppkey", "ym"], F.when(F.col("l_returnflag") == "N", 0).otherwise(1))
)
query("ddp06_last_per_date", _first_sql("l_partkey, d", "l_orderkey desc"))(lambda t: _first(t, ["l_partkey", "d"], F.desc("l_orderkey")))


@query("ddp07_keep_blank_ids", """with x as (select case when p_size % 2 = 0 then p_name else '' end as name, p_partkey as part from part)
select name, part from x where name = '' union all select name, min(part) from x where name <> '' group by name""")
def _(t):
    x = t("part").select(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("").alias("name"), F.col("p_partkey").alias("part"))
    return A.dedup_keep_blank(x, "name", F.asc("part")).select("name", "part")


@query("ddp08_distinct_events", "select distinct l_partkey as part, d::varchar as day from li where l_returnflag = 'R'")
def _(t):
    return t.lines().where("l_returnflag = 'R'").select(F.col("l_partkey").alias("part"), F.col("d").cast("string").alias("day")).distinct()


@query("set01_union_by_name", "select p_partkey as k, p_name as name, null::bigint as nation from part union all select s_suppkey, null, s_nationkey from supplier")
def _(t):
    return A.union_all(
        t("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name")),
        t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("long").alias("nation")),
    ).select("k", "name", "nation")


_A, _B = "select distinct part from pm where ym // 12 = 1996", "select distinct part from pm where ym // 12 = 1999"


def _keys(t, yr):
    return t.part_month().where(_year() == yr).select("part").distinct()


query("set02_intersect", f"select * from (({_A}) intersect ({_B}))")(lambda t: _keys(t, 1996).intersect(_keys(t, 1999)))
query("set03_except", f"select * from (({_A}) except ({_B}))")(lambda t: _keys(t, 1996).subtract(_keys(t, 1999)))
query("set04_union_distinct", f"select * from (({_A}) union ({_B}))")(lambda t: _keys(t, 1996).union(_keys(t, 1999)).distinct())


@query("src18_overlap", f"""with a as ({_A}), b as ({_B}), j as (select a.part as x, b.part as y from a full join b on a.part = b.part)
select count(x)::bigint as in_a, count(y)::bigint as in_b, count(*) filter (x is not null and y is not null)::bigint as both, count(*) filter (y is null)::bigint as only_a, count(*) filter (x is null)::bigint as only_b from j""")
def _(t):
    return A.overlap(_keys(t, 1996), _keys(t, 1999), "part")


@query("top01_latest_k", "select g, ym, score from sc where ym = (select max(ym) from sc) order by score desc, g limit 20")
def _(t):
    s = t.scored()
    last = s.agg(F.max("ym").alias("ym"))
    return s.join(F.broadcast(last), "ym").orderBy(F.desc("score"), "g").limit(20).select("g", "ym", "score")


@query("top03_top_classes", "select brand, sum(state)::bigint as events from gs where brand <> 'Brand#11' group by all order by events desc, brand limit 5")
def _(t):
    return t.group_state().where("brand <> 'Brand#11'").groupBy("brand").agg(F.sum("state").alias("events")).orderBy(F.desc("events"), "brand").limit(5)


@query("top04_by_variance", """select name from (select unnest(['qty', 'ret', 'suppliers', 'parts']) as name, unnest([var_samp(qty), var_samp(ret), var_samp(suppliers), var_samp(parts)]) as v from gs) order by v desc, name limit 2""")
def _(t):
    c = ["qty", "ret", "suppliers", "parts"]
    v = t.group_state().agg(F.lit(1).alias("i"), *[F.var_samp(x).alias(x) for x in c])
    return v.unpivot("i", c, "name", "v").orderBy(F.desc("v"), "name").limit(2).select("name")


@query("val01_panel_gate", """with g as (select count(*)::bigint as n, count(distinct (part, ym))::bigint as k, avg((ret > 0)::int) as prevalence, count(distinct part)::bigint as entities, count(distinct ym)::bigint as months from dn)
select n - k as repeated, prevalence, entities, months, ((n > k)::int + (prevalence > 0.5 or prevalence = 0)::int + (entities < 150)::int + (months < 60)::int)::bigint as issues from g""")
def _(t):
    dn = t.dense().withColumn("hit", (F.col("ret") > 0).cast("int"))
    out = A.panel_gate(dn, ["part"], "ym", "hit", 150, 60)
    return out.select("repeated", "prevalence", "entities", "months", F.size("issues").alias("issues"))


@query("val02_lookahead_zero", """with w as (select part, ym, row_number() over w as rn, coalesce(sum(qty) over (partition by part order by ym rows between 12 preceding and 1 preceding), 0) as s, coalesce(lag(qty) over w, 0) as l from dn window w as (partition by part order by ym))
select sum((s > 0)::int)::bigint as trailing_violations, sum((l <> 0)::int)::bigint as lag_violations, count(*)::bigint as n from w where rn = 1""")
def _(t):
    w = W.rows(["part"], ["ym"])
    x = t.dense().select(F.row_number().over(w).alias("rn"), F.coalesce(W.trailing(F.sum, "qty", 12, w), F.lit(0)).alias("s"), W.lag0("qty", 1, w).alias("l"))
    return x.where("rn = 1").agg(
        F.sum((F.col("s") > 0).cast("int")).alias("trailing_violations"), F.sum((F.col("l") != 0).cast("int")).alias("lag_violations"), F.count("*").alias("n")
    )


@query("val03_month_completeness", """with e as (select unnest(range(23940, 24024))::bigint as e), k as (select part, ym, cents, lpad(part::varchar, case when part % 50 = 0 then 10 else 11 end, '0') as code from pm)
select (select count(*) from e where e not in (select ym from k))::bigint as missing_months, min(ym) as first_month, max(ym) as last_month, count(distinct ym)::bigint as months, count(*)::bigint as n, (count(*) - count(distinct (part, ym)))::bigint as repeated,
sum((not regexp_full_match(code, '\\d{11}'))::int)::bigint as bad_keys, sum((nullif(cents, 0) is null)::int)::bigint as cents_missing, count(distinct part) filter (part % 3 > 0)::bigint as in_panel, count(distinct part) filter (part % 3 = 0)::bigint as not_in_panel,
(select count(*) from part where p_partkey % 3 > 0 and p_partkey not in (select part from k))::bigint as panel_only from k""")
def _(t):
    code = F.lpad(F.col("part").cast("string"), F.when(F.col("part") % 50 == 0, 10).otherwise(11), F.lit("0"))
    k = t.part_month().select("part", "ym", F.nullif("cents", F.lit(0)).alias("cents"), code.alias("code"))
    panel = t("part").where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("part"))
    return A.completeness(k, panel, "part", "ym", "code", r"^\d{11}$", ["cents"], 23940, 24023)
