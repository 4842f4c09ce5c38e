"""Feature families and episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import month_index
from ..operators import features as X
from ..operators import windows as W
from .base import query

DYNAMIC = ["qty", "ret", "suppliers", "parts"]


def _history_sql() -> str:
    cells = []
    for c in DYNAMIC:
        cells += [f"coalesce(lag({c}, {k}) over w, 0)::bigint as {c}_lag{k}" for k in (3, 6)]
        cells += [f"({c} - coalesce(lag({c}, {k}) over w, 0))::bigint as {c}_delta{k}" for k in (3, 6)]
        cells += [f"coalesce(max({c}) over r, 0)::bigint as {c}_rollmax6", f"coalesce(avg({c}) over r, 0)::double as {c}_rollmean6"]
    return f"""select g, ym, {", ".join(cells)} from gs window w as (partition by g order by ym), r as (partition by g order by ym rows between 6 preceding and 1 preceding)"""


@query("feat_history", _history_sql())
def _(t):
    return t.group_state().select("g", "ym", *X.history(DYNAMIC, ["g"], ["ym"]))


@query("feat_state_memory", """with s as (select *, case when state = 1 and coalesce(lag(state) over (partition by g order by ym), 0) = 0 then 1 else 0 end as st from gs),
m as (select g, ym, coalesce(sum(state) over a, 0)::bigint as months12, coalesce(sum(state) over b, 0)::bigint as months24, coalesce(sum(st) over b, 0)::bigint as starts24, coalesce(max(state) over (partition by g order by ym rows between unbounded preceding and 1 preceding), 0)::bigint as ever from s
window a as (partition by g order by ym rows between 12 preceding and 1 preceding), b as (partition by g order by ym rows between 24 preceding and 1 preceding))
select *, months24 / 24 as burden24, (starts24 >= 2)::bigint as repeat24, ((starts24 >= 2)::int * (1 + months24 / 24))::double as recurrence from m""")
def _(t):
    return X.state_memory(t.group_state(), "state", ["g"], ["ym"]).select("g", "ym", "months12", "months24", "starts24", "ever", "burden24", "repeat24", "recurrence")


@query("feat_usage_lags", """select g, ym, lag(nullif(ret, 0), 6) over w as lag6, round(nullif(ret, 0) / greatest(avg(nullif(ret, 0)) over (partition by g order by ym rows between 14 preceding and 3 preceding), 1), 9) as ratio from gs window w as (partition by g order by ym)""")
def _(t):
    w = W.rows(["g"], ["ym"])
    s = t.group_state().withColumn("u", F.nullif("ret", F.lit(0)))
    mean = W.trailing(F.avg, "u", 12, w, 3)
    # greatest skips nulls, so a missing mean counts as the floor of 1
    return s.select("g", "ym", F.lag("u", 6).over(w).alias("lag6"), F.round(F.col("u") / F.greatest(mean, F.lit(1.0)), 9).alias("ratio"))


@query("alg02_episodes", """with e as (select l_partkey as part, o_orderkey as k, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::bigint as s, max(ym) as e, o_orderstatus as st from li join orders on o_orderkey = l_orderkey group by all),
f as (select part, k, s, case st when 'O' then 24000 when 'P' then s else greatest(s, e) end as stop, (st <> 'F')::bigint as censored, (st = 'P')::bigint as imputed from e),
m as (select *, unnest(range(greatest(s, 23952), least(stop, 24000) + 1))::bigint as ym from f where s <= 24000 and stop >= 23952)
select part, ym, k, (ym = s)::bigint as started, (censored = 0 and ym = stop)::bigint as ended, (stop - s + 1)::bigint as duration, (case when censored = 0 then stop - ym end)::bigint as remaining, censored, imputed
from m qualify row_number() over (partition by part, ym order by s, k) = 1""")
def _(t):
    o = t("orders").select("o_orderkey", month_index(F.to_date("o_orderdate")).alias("start"), F.col("o_orderstatus").alias("st"))
    e = t.lines().join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    e = e.groupBy(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("k"), "start", "st").agg(F.max("ym").alias("last"))
    status = F.when(F.col("st") == "O", "active").otherwise("resolved")
    e = e.withColumns({"status": status, "end": F.when(F.col("st") == "F", F.col("last"))})
    out = X.episode_months(e, ["part"], 23952, 24000, ["k"])
    return out.select("part", "ym", "k", "started", "ended", "duration", "remaining", "censored", "imputed")


#: Stand-ins for the columns that composites, flags and interactions read: expressions over a part's number k and size z.
PROXIES = {
    "n_manufacturers": "k % 5", "n_api_suppliers": "k % 4", "sole_source": "k % 2", "is_injectable": "k % 3 % 2", "warning_letter_12m": "k % 7 % 3",
    "oai_inspection_12m": "z % 3", "vai_inspection_12m": "z % 2", "recall_count_12m": "k % 11 - 5", "class1_recall_12m": "z % 13 - 9", "months_to_nearest_expiry": "k % 40 - 8",
    "months_to_exclusivity_end": "z - 20", "disaster_count_12m": "k % 6", "api_disaster_exposure_12m": "z % 5", "api_major_disaster_12m": "k % 17 % 2",
    "nadac_pct_change_3m": "(k % 21 - 10) / 16.0", "nadac_pct_change_12m": "(z % 17 - 8) / 8.0", "api_country_hhi": "(k % 9) / 8.0", "api_india_china_share": "(z % 9) / 8.0",
    "same_ingredient_in_shortage": "z % 4 % 2", "recent_manufacturer_exit": "k % 3", "net_manufacturer_change_12m": "k % 9 - 4", "has_inspection_data": "k % 2",
    "ae_trend_12m": "(k % 15 - 7) / 4.0", "n_repackagers": "z % 6", "labeler_shortage_burden": "k % 4", "medicaid_rx_trend_4q": "(z % 11 - 5) / 4.0", "medicaid_rx_cv_4q": "(k % 8) / 8.0",
    "major_disaster_12m": "z % 7 % 2", "therapeutic_class_peer_onset_rate_6m": "(k % 16) / 16.0", "share_low_competition_ndcs": "(z % 8) / 8.0", "route_peer_shortage_burden_3m": "(k % 32) / 32.0",
    "share_quality_signal_ndcs": "(z % 4) / 4.0", "recurrence_pressure": "(k % 3) / 2.0", "dosage_form_peer_onset_rate_6m": "(z % 16) / 8.0", "dominant_labeler_share_ndcs": "(k % 8) / 8.0",
    "dominant_application_share_ndcs": "(z % 8) / 8.0", "share_api_concentrated_ndcs": "(k % 4) / 4.0", "recent_resolution_rebound": "k % 7", "episode_duration_memory": "z % 25",
}


def _proxied(t):
    """Each column is missing on every so many parts, by its place in the list."""
    p = t("part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    return p.select("k", *[F.expr(f"case when k % {23 + i} <> 0 then cast({e} as double) end").alias(c) for i, (c, e) in enumerate(PROXIES.items())])


_PROXY_SQL = "x as (select k, " + ", ".join(f"case when k % {23 + i} <> 0 then ({e})::double end as {c}" for i, (c, e) in enumerate(PROXIES.items())) + " from (select p_partkey as k, p_size::bigint as z from part))"
_Z = "z as (select k, months_to_nearest_expiry, months_to_exclusivity_end, " + ", ".join(f"coalesce({c}, 0) as {c}" for c in PROXIES if not c.startswith("months_to")) + " from x)"
_ONE = lambda c: f"least(greatest({c}, 0), 1)"
_COUNT = " + ".join(map(_ONE, ("warning_letter_12m", "oai_inspection_12m", "vai_inspection_12m", "recall_count_12m", "class1_recall_12m")))
_FEW, _API = "(n_manufacturers <= 2)::int", "(n_api_suppliers <= 2)::int"


def _rounded(columns):
    return [F.round(c.cast("double"), 9).alias(n) for n, c in columns.items()]


_COMPOSITES_SQL = {
    "few_manufacturers": _FEW, "few_api_suppliers": _API, "market_vulnerability": f"sole_source + {_FEW} + is_injectable", "quality_signal_any": f"({_COUNT} > 0)::int", "quality_signal_count": _COUNT,
    "disruption_signal": "ln(1 + disaster_count_12m) + ln(1 + api_disaster_exposure_12m) + api_major_disaster_12m", "price_shock": "abs(nadac_pct_change_3m) + abs(nadac_pct_change_12m) / 2",
    "supply_chain_risk": "api_country_hhi + api_india_china_share + api_major_disaster_12m", "ingredient_pressure": f"same_ingredient_in_shortage * (1 + {_FEW} + {_API})",
    "manufacturer_exit_pressure": f"{_ONE('recent_manufacturer_exit')} + greatest(-net_manufacturer_change_12m, 0)", "patent_cliff_12m": "(coalesce(months_to_nearest_expiry, 999) between 0 and 12)::int",
    "exclusivity_loss_12m": "(coalesce(months_to_exclusivity_end, 999) between 0 and 12)::int", "injectable_sole_source": "is_injectable * sole_source",
    "quality_stack": f"1.3::double * ({_COUNT}) + 0.8::double * has_inspection_data + 0.6::double * greatest(ae_trend_12m, 0)",
    "capacity_stress": "6 - least(n_manufacturers, 3) - least(n_api_suppliers, 3) + ln(1 + n_repackagers)", "contagion_stress": "1.5::double * same_ingredient_in_shortage + labeler_shortage_burden",
    "commercial_risk": "abs(nadac_pct_change_12m) + greatest(-medicaid_rx_trend_4q, 0) + greatest(medicaid_rx_cv_4q, 0)",
}


@query("fn_composites", f"""with {_PROXY_SQL}, {_Z} select k, {", ".join(f"round(({e})::double, 9) as {c}" for c, e in _COMPOSITES_SQL.items())} from z""")
def _(t):
    return _proxied(t).select("k", *_rounded(X.composites()))


_FLAGS_SQL = {
    "quality_signal": "warning_letter_12m > 0 or recall_count_12m > 0 or class1_recall_12m > 0 or oai_inspection_12m > 0 or vai_inspection_12m > 0", "low_api": "n_api_suppliers <= 2",
    "api_concentrated": "api_country_hhi >= 0.6", "india_china_exposed": "api_india_china_share >= 0.8", "low_competition": "sole_source > 0 or n_manufacturers <= 2",
    "price_shock": "abs(nadac_pct_change_12m) >= 0.25", "ae_spike": "ae_trend_12m > 0.25", "disaster_risk": "major_disaster_12m > 0 or api_major_disaster_12m > 0",
}


@query("fn_row_flags", f"""with {_PROXY_SQL}, {_Z} select k, {", ".join(f"({e})::bigint as {c}" for c, e in _FLAGS_SQL.items())} from z""")
def _(t):
    return _proxied(t).select("k", *[c.alias(n) for n, c in X.row_flags().items()])


_INTERACTIONS_SQL = {
    "peer_vulnerability_interaction": f"therapeutic_class_peer_onset_rate_6m * (1 + sole_source + {_FEW} + is_injectable + share_low_competition_ndcs)",
    "quality_peer_interaction": f"route_peer_shortage_burden_3m * (1 + {_COUNT} + share_quality_signal_ndcs)",
    "recurrence_x_peer_pressure": "recurrence_pressure * (1 + dosage_form_peer_onset_rate_6m)",
    "supplier_concentration_risk": "dominant_labeler_share_ndcs + dominant_application_share_ndcs + share_api_concentrated_ndcs",
    "rebound_risk": "recent_resolution_rebound * (1 + episode_duration_memory / 12)",
}


@query("feat_interactions", f"""with {_PROXY_SQL}, {_Z} select k, {", ".join(f"round(({e})::double, 9) as {c}" for c, e in _INTERACTIONS_SQL.items())} from z""")
def _(t):
    made = X.composites()
    df = _proxied(t).withColumns({c: made[c] for c in ("market_vulnerability", "quality_signal_count")})
    return df.select("k", *_rounded(X.interactions()))


@query("alg07_group_panel", f"""with h as ({_history_sql()}), s as (select *, case when state = 1 and coalesce(lag(state) over (partition by g order by ym), 0) = 0 then 1 else 0 end as st from gs),
m as (select g, brand, ym, st, coalesce(sum(state) over b, 0)::bigint as months24, coalesce(sum(st) over b, 0)::bigint as starts24, coalesce(max(st) over (partition by g order by ym rows between 1 following and 6 following), 0)::bigint as onset_within from s window b as (partition by g order by ym rows between 24 preceding and 1 preceding)),
p as (select brand, ym, sum(st) as s, count(*) as n from m group by all), q as (select brand, ym, coalesce(sum(s) over w, 0)::double / greatest(coalesce(avg(n) over w, 0), 1)::double as rate from p window w as (partition by brand order by ym rows between 6 preceding and 1 preceding))
select h.*, brand, months24, starts24, onset_within, round(rate, 9) as peer_onset_rate, round((starts24 >= 2)::int * (1 + months24 / 24.0::double) * (1 + rate), 9) as recurrence_x_peers from h join m using (g, ym) join q using (brand, ym)""")
def _(t):
    x = X.group_panel(t.group_state(), DYNAMIC, "state", "brand")
    kept = [c for c in x.columns if any(c.startswith(f"{d}_") for d in DYNAMIC)]
    return x.select("g", "ym", "brand", *kept, "months24", "starts24", "onset_within", *[F.round(c, 9).alias(c) for c in ("peer_onset_rate", "recurrence_x_peers")])


#: Of the stand-ins, those that a group's chain makes itself; the others are its members' columns.
_MADE = ("therapeutic_class_peer_onset_rate_6m", "share_low_competition_ndcs", "route_peer_shortage_burden_3m", "share_quality_signal_ndcs", "recurrence_pressure", "dosage_form_peer_onset_rate_6m",
         "dominant_labeler_share_ndcs", "dominant_application_share_ndcs", "share_api_concentrated_ndcs", "recent_resolution_rebound", "episode_duration_memory")
_GIVEN = [c for c in PROXIES if c not in _MADE]
_CLASSES = ["therapeutic_class", "route", "dosage_form"]
_LOOKED_BACK_ON = ["n_manufacturers", "price_shock", "quality_signal_count", "qty"]


def _chain_sql() -> str:
    plain = lambda c: c if c.startswith("months_to") else f"coalesce({c}, 0) as {c}"
    flags = ", ".join(f"avg(({e})::int) as share_{c}_ndcs" for c, e in _FLAGS_SQL.items())
    peers = lambda c: f"""k_{c} as (select {c}, ym, coalesce(sum(o) over a / greatest(avg(n) over a, 1), 0)::double as {c}_peer_onset_rate_6m, coalesce(avg(b) over s / greatest(avg(n) over s, 1), 0)::double as {c}_peer_shortage_burden_3m
from (select {c}, ym, sum(st) as o, sum(state) as b, count(*) as n from h group by all) window a as (partition by {c} order by ym rows between 6 preceding and 1 preceding), s as (partition by {c} order by ym rows between 3 preceding and 1 preceding))"""  # noqa: E731
    back = []
    for c in _LOOKED_BACK_ON:
        back += [f"coalesce(lag({c}, {k}) over w, 0)::double as {c}_lag{k}, ({c} - coalesce(lag({c}, {k}) over w, 0))::double as {c}_delta{k}" for k in (3, 6)]
        back += [f"coalesce(max({c}) over r6, 0)::double as {c}_rollmax6, coalesce(avg({c}) over r6, 0)::double as {c}_rollmean6"]
    shares = ", ".join([*[f"share_{c}_ndcs" for c in _FLAGS_SQL], "dominant_labeler_share_ndcs", "dominant_application_share_ndcs"])
    doubles = [*_COMPOSITES_SQL, *shares.split(", "), "price", "mean_api_country_hhi_group", "std_api_suppliers_group", "mean_group_episode_duration", "episode_duration_memory", "recurrence_pressure"]
    doubles += [x for c in _LOOKED_BACK_ON for x in (f"{c}_lag3", f"{c}_delta3", f"{c}_lag6", f"{c}_delta6", f"{c}_rollmax6", f"{c}_rollmean6")]
    doubles += [f"{c}_peer_{x}" for c in _CLASSES for x in ("onset_rate_6m", "shortage_burden_3m")] + list(_INTERACTIONS_SQL)
    longs = ["n_ndcs", "state", "qty", "n_labelers_group", "n_application_numbers_group", "months24", "starts24", "last_group_episode_duration", "months_since_group_onset", "recent_resolution_rebound", *[f"onset_t{i}" for i in range(1, 7)], "onset_any6"]
    return f"""with {_PROXY_SQL},
mb as (select p_brand || ' | ' || p_type as g, p_brand as therapeutic_class, p_type as route, left(p_type, 1) as dosage_form, part, ym, qty, (ret > 1)::int as state, price, part % 7 as labeler, case when part % 13 <> 0 then part % 11 end as application, x.* exclude (k) from dn join part on p_partkey = part join x on k = part),
mz as (select g, ym, part, labeler, application, {", ".join(map(plain, _GIVEN))} from mb),
cp as (select g, ym, {flags}, count(distinct labeler) as n_labelers_group, count(distinct coalesce(application::varchar, 'UNKNOWN')) as n_application_numbers_group, count(distinct part) as members from mz group by all),
c2 as (select g, ym, avg(api_country_hhi) as mean_api_country_hhi_group, stddev_samp(n_api_suppliers) as std_api_suppliers_group from mb group by all),
dl as (select g, ym, max(c) as c from (select g, ym, labeler, count(distinct part) as c from mz group by all) group by all), da as (select g, ym, max(c) as c from (select g, ym, application, count(distinct part) as c from mz group by all) group by all),
ru as (select g, ym, count(distinct part) as n_ndcs, max(state) as state, sum(qty)::bigint as qty, median(price) as price, any_value(therapeutic_class) as therapeutic_class, any_value(route) as route, any_value(dosage_form) as dosage_form, {", ".join(f"max({c}) as {c}" for c in _GIVEN)} from mb group by all),
z0 as (select g, ym, n_ndcs, state, qty, price, therapeutic_class, route, dosage_form, {", ".join(map(plain, _GIVEN))} from ru),
en as (select z0.*, {", ".join(f"({e})::double as {c}" for c, e in _COMPOSITES_SQL.items())}, cp.* exclude (g, ym, members), c2.* exclude (g, ym), dl.c::double / members as dominant_labeler_share_ndcs, da.c::double / members as dominant_application_share_ndcs from z0 join cp using (g, ym) join c2 using (g, ym) join dl using (g, ym) join da using (g, ym)),
s0 as (select *, row_number() over w as rn, case when state = 1 and coalesce(lag(state) over w, 0) = 0 then 1 else 0 end as st, state = 0 and coalesce(lag(state) over w, 0) = 1 as fin from en window w as (partition by g order by ym)),
s1 as (select *, max(case when st = 1 then rn end) over (partition by g order by ym rows between unbounded preceding and 1 preceding) as f from s0),
s2 as (select *, case when fin then rn - f end as e from s1),
h as (select *, coalesce(last_value(e ignore nulls) over b, 0) as last_group_episode_duration, coalesce(avg(e) over b, 0)::double as mean_group_episode_duration, coalesce(rn - max(case when st = 1 then rn end) over b, 999) as months_since_group_onset,
  coalesce(greatest(0, 6 - (rn - max(case when fin then rn end) over b)), 0) as recent_resolution_rebound, 0.6::double * coalesce(last_value(e ignore nulls) over b, 0) + 0.4::double * coalesce(avg(e) over b, 0) as episode_duration_memory,
  coalesce(sum(state) over y, 0) as months24, coalesce(sum(st) over y, 0) as starts24, ((coalesce(sum(st) over y, 0) >= 2)::int * (1 + coalesce(sum(state) over y, 0) / 24.0::double))::double as recurrence_pressure, {", ".join(back)},
  {", ".join(f"lead(st, {i}) over w as onset_t{i}" for i in range(1, 7))}, case when lead(st, 6) over w is not null then (max(st) over (partition by g order by ym rows between 1 following and 6 following) > 0)::int end as onset_any6
  from s2 window w as (partition by g order by ym), b as (partition by g order by ym rows between unbounded preceding and 1 preceding), y as (partition by g order by ym rows between 24 preceding and 1 preceding), r6 as (partition by g order by ym rows between 6 preceding and 1 preceding)),
{", ".join(map(peers, _CLASSES))},
j as (select * from h {" ".join(f"join k_{c} using ({c}, ym)" for c in _CLASSES)}),
o as (select *, {", ".join(f"({e})::double as {c}" for c, e in _INTERACTIONS_SQL.items())} from j)
select g, ym, {", ".join(f"{c}::bigint as {c}" for c in longs)}, {", ".join(f"round({c}, 6) as {c}" for c in doubles)} from o""", longs, doubles


_CHAIN, _LONGS, _DOUBLES = _chain_sql()


@query("alg07_group_chain", _CHAIN)
def _(t):
    """The whole chain over parts as members: roll-up, composition, composites, history, peers, interactions and leads."""
    p, k = t("part"), F.col("p_partkey")
    kinds = p.select(k.alias("part"), F.concat_ws(" | ", "p_brand", "p_type").alias("g"), F.col("p_brand").alias("therapeutic_class"), F.col("p_type").alias("route"), F.left("p_type", F.lit(1)).alias("dosage_form"),
                     (k % 7).alias("labeler"), F.when(k % 13 != 0, k % 11).alias("application"))
    members = t.dense().withColumn("state", (F.col("ret") > 1).cast("int")).join(kinds, "part").join(_proxied(t).select(F.col("k").alias("part"), *_GIVEN), "part")
    x = X.build_groups(members, "g", "ym", "part", "labeler", "application", "state", ["qty"], ["price"], _GIVEN, _CLASSES, _LOOKED_BACK_ON)
    x = x.withColumnsRenamed({"shortage_months_past_24m": "months24", "shortage_starts_past_24m": "starts24"})
    return x.select("g", "ym", *[F.col(c).cast("long").alias(c) for c in _LONGS], *[F.round(F.col(c).cast("double"), 6).alias(c) for c in _DOUBLES])


@query("join24_optional_families", """select gs.g, gs.ym, b.n as brand_parts, m.qty as month_qty from gs left join (select p_brand as brand, count(*)::bigint as n from part where p_size > 10 group by 1) b using (brand)
left join (select ym, sum(qty)::bigint as qty from li where l_returnflag = 'R' group by ym) m using (ym)""")
def _(t):
    parts = t("part").where("p_size > 10").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("brand_parts"))
    months = t.lines().where("l_returnflag = 'R'").groupBy("ym").agg(F.sum("qty").alias("month_qty"))
    families = {"parts": (parts, ["brand"]), "months": (months, ["ym"]), "unused": (months, ["ym"])}
    return X.optional_families(t.group_state(), families, ["parts", "months"]).select("g", "ym", "brand_parts", "month_qty")
