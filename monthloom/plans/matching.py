"""Names, codes and what is resolved by them, over names made from the tables' own."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import dates as D
from ..functions import names as N
from ..operators import features as X
from ..operators import joins as J
from .base import query

#: What stands around a name, dealt by its number.
FIRMS = (
    ", Inc.", " & Sons Pharmaceuticals LLC", " d/b/a Acme Labs", " Laboratories, L.L.C.", " f/k/a Old Pharma Co.", " (formerly known as X-Pharm PLLC)",
    " GmbH", " plc aka Limited", "  Incorporated", "-Coated Corp",
)
DRUGS = (
    " Tablets", " (Brand) Injection", " 5 mg/mL Solution", " Hydrochloride", " and", ", 250 mL bags with", " 0.5% Cream 15gram Tube", " C-II Extended-Release Capsules",
    " sodium and  Potassium", " Oral Suspension", " / Sodium Succinate", " 325", "", " ODT for", " Hydrobromide IV; 10 vials", " 20 units pens",
)
REASON_TEXTS = (
    "Discontinued by maker", "Market WITHDRAWAL withdrawn", "Increased demand", "Manufacturing delay", "Shortage of raw material", "API supply",
    "Regulatory delay", "GMP issues", "Shipping delays", "Hurricane", "Recall of lots", "Sterility", "Business decision", "Capacity", "Other cause",
    "Not available", " Unknown reason ", "rapid response", "capacity and quality", "",
)
CODES = (
    "0378-8700", "378-8700-06", "Tablet (NDC 0378-8700-06)", "1234", "none", "ndc 12–345—6 vial", "NDC 00378 8700 06, 30", "NDC12345-1234-12", "00378870006", "0037887000",
    "003788700", "1-2-3-4", "a-b", "12345-678", "ndc: 1-1-1", "NDC 123456-12-1",
)
HOLDERS = (
    "Cipla Ltd", "Acme Pvt Ltd Pune", "Zhejiang Huahai", "ANGELINI PHARMA SPA", "SPA SPRINGS USA", "Olon S.p.A.", "Boehringer GmbH", "Siegfried AG", "Acme Inc", "Teva Tech",
    "Osaka Synth", "Seoul Chem", "DSM BV", "Sanofi Paris", "Espana Quimica", "Macfarlan plc", "Sunrise Ltd", "Sunrise Co Ltd", "Plain name", "Divi’s", "Taizhou S.R.L.", "Goa Foods",
)
BASES = ("INJECTION", "TABLET, FILM COATED", "CAPSULE, EXTENDED RELEASE", "ORAL SOLUTION", "CREAM", "POWDER, FOR SUSPENSION")


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _dealt(words, key: str):
    return F.element_at(F.array(*map(F.lit, words)), (F.col(key) % len(words) + 1).cast("int"))


def _sql_dealt(words, key: str) -> str:
    return f"{_list(words)}[(({key}) % {len(words)})::int + 1]"


def _rx(words) -> str:
    return N.any_of(words).replace("'", "''")


_GAP = r"\s+"
_COMPANY = rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(x), '&', ' and '), '{_rx(N.OTHER_NAMES)}', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\b({"|".join(N.COMPANY_WORDS)})\b', ' ', 'g'), '{_GAP}', ' ', 'g'))"""


@query("fn_company", f"""select k, {_COMPANY} as name from (select s_suppkey as k, s_name || {_sql_dealt(FIRMS, "s_suppkey")} as x from supplier)""")
def _(t):
    return t("supplier").select(F.col("s_suppkey").alias("k"), N.company(F.concat("s_name", _dealt(FIRMS, "s_suppkey"))).alias("name"))


_DRUG = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(upper(x)), '\bHYDROCHLORIDE\b', 'HCL', 'g'), '\bHYDROBROMIDE\b', 'HBR', 'g'), '\bSODIUM\b', 'SOD', 'g'), '\bPOTASSIUM\b', 'POT', 'g'), '\bSUCCINATE\b', 'SUCC', 'g'), '\b AND \b', '/', 'g'), '\s+', ' ', 'g'))"""


@query("fn_drug_name", f"""select k, {_DRUG} as name from (select p_partkey as k, p_name || {_sql_dealt(DRUGS, "p_partkey")} as x from part)""")
def _(t):
    return t("part").select(F.col("p_partkey").alias("k"), N.drug(F.concat("p_name", _dealt(DRUGS, "p_partkey"))).alias("name"))


def _base_sql(source: str) -> str:
    """CTEs b1 to b5 over rows (name) of ``source``: base names as ``base``."""
    strip = r"regexp_replace({0}, '^[,/;-]+|[,/;-]+$', '', 'g')"
    gone = [r"\d+\.?\d*\s*(?:mg|mcg|g|ml|meq|units?|iu|gram|grams|mcg/ml|mg/ml|mg/g|mcg/hr|mg/hr)\b", r"\d+\.?\d*\s*%", r"\d+\.?\d*\s*(?:oz|ml|cc|l|gram|grams|tube|bottles?|ampules?|pk)\b", r"\bc-(?:ii|iii|iv|v)\b", r"\b\d+\.?\d*\b"]
    x = "y"
    for g in gone:
        x = f"regexp_replace({x}, '{g}', '', 'g')"
    return rf"""b1 as (select name, trim(lower(name)) as low, trim(regexp_replace(trim(lower(name)), '\([^)]*\)', '', 'g')) as x from {source}),
b2 as (select *, regexp_extract(x, '^(\d+\.?\d*%)\s+', 1) as lead, regexp_replace(x, '^\d+\.?\d*%\s+', '') as y from b1),
b3 as (select *, list_filter(regexp_split_to_array(trim({x}), '\s+'), lambda w: {strip.format("w")} <> '' and not list_contains({_list(N.FORM_WORDS)}, {strip.format("w")})) as ws from b2),
b4 as (select *, list_max(list_transform(range(1, len(ws) + 1), lambda i: case when list_contains(['and', 'or', 'with', 'for', 'in'], trim(ws[i], ',-')) then 0 else i end)) as upto from b3),
b5 as (select name, low, case when z = '' then low else z end as base from (select *, trim(regexp_replace(case when lead <> '' then lead || ' ' else '' end || trim(array_to_string(ws[1:coalesce(upto, 0)], ' '), ' ,;-/'), '\s+', ' ', 'g')) as z from b4))"""


@query("fn_base_name", f"""with i as (select p_partkey as k, (case when p_partkey % 7 = 0 then '0.9% ' else '' end) || p_name || {_sql_dealt(DRUGS, "p_partkey")} as name from part), {_base_sql("(select distinct name from i)")} select k, base as name from i join b5 using (name)""")
def _(t):
    lead = F.when(F.col("p_partkey") % 7 == 0, "0.9% ").otherwise("")
    return t("part").select(F.col("p_partkey").alias("k"), N.base_name(F.concat(lead, F.col("p_name"), _dealt(DRUGS, "p_partkey"))).alias("name"))


_REASON = f"""case when trim(lower(x)) in {tuple(N.UNKNOWN_REASONS)} then 'Unknown' {" ".join("when " + " or ".join(f"contains(lower(x), '{w}')" for w in words) + f" then '{name}'" for words, name in N.REASONS)} else 'Other' end"""


@query("fn_reason", f"""select k, {_REASON} as reason from (select p_partkey as k, {_sql_dealt(REASON_TEXTS, "p_partkey")} as x from part)""")
def _(t):
    return t("part").select(F.col("p_partkey").alias("k"), N.reason(_dealt(REASON_TEXTS, "p_partkey")).alias("reason"))


#: Code, product, package, labeler, in a text, strict package, strict product: as the rules give them.
CODE_ROWS = (
    ("0378-8700", "00378-8700", "00378-8700-00", "00378", None, "00378-8700-00", "00378-8700"),
    ("378-8700-06", "00378-8700", "00378-8700-06", "00378", None, "00378-8700-06", "00378-8700"),
    ("Tablet (NDC 0378-8700-06)", "00378-8700", "00378-8700-06", "Tablet (NDC 0378", "0378-8700-06", "00378-8700-06", "00378-8700"),
    ("1234", None, None, "01234", None, None, None),
    ("none", None, None, "0none", None, None, None),
    ("ndc 12–345—6 vial", "00012-0345", "00012-0345-06", "ndc 12–345—6 vial", "12-345-6", None, None),
    ("NDC 00378 8700 06, 30", "00378-8700", "00378-8700-06", "NDC 00378 8700 06, 30", "00378-8700-06", None, "00378-8700"),
    ("NDC12345-1234-12", "12345-1234", "12345-1234-12", "NDC12345", "12345-1234-12", "12345-1234-12", "12345-1234"),
    ("00378870006", "0037887-0006", "00378-8700-06", "00378870006", None, "00378-8700-06", "00378-8700"),
    ("0037887000", "003788-7000", "00037-8870-00", "0037887000", None, "00378-8700-00", "00378-8700"),
    ("003788700", "00378-8700", "00003-7887-00", "003788700", None, None, "00378-8700"),
    ("1-2-3-4", "00001-0002", "00001-0002-03", "00001", None, None, "00001-0002"),
    ("12345-678", "12345-0678", "12345-0678-00", "12345", None, "12345-0678-00", "12345-0678"),
    ("ndc: 1-1-1", "00001-0001", "00001-0001-01", "ndc: 1", None, "00001-0001-01", "00001-0001"),
    ("NDC 123456-12-1", "123456-0012", "123456-0012-01", "NDC 123456", None, "123456-0012-01", "123456-0012"),
)


def _literal(rows, names: str) -> str:
    cell = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) x({names})"


_PADDED = "case when length({0}) >= {1} then {0} else lpad({0}, {1}, '0') end"
#: The same shapes around the digits of a part: its number on four places and more, its size on four, a digit of it.
CODE_SHAPES = (
    "{k}-{s}", "{k}-{s}-0{d}", "Tablet (NDC {k}-{s}-0{d})", "123{d}", "none", "ndc 1{d}–{s}—{d} vial", "NDC 0{k} {s} 0{d}, 30", "NDC{k}-{s}-1{d}", "{k}{s}00{d}", "{k}{s}0{d}", "{k}{s}{d}",
    "{d}-2-3-4", "{k}-67{d}", "ndc: {d}-1-1", "NDC 12{k}-1{d}-1",
)
_CODE_DIGITS = {"k": "right('000' || p_partkey, greatest(4, length(p_partkey::varchar)))", "s": "right('000' || p_size, greatest(4, length(p_size::varchar)))", "d": "(p_partkey % 10)::varchar"}
_CODE_PARTS = [re.split(r"[{}]", shape) for shape in CODE_SHAPES]  # texts and, at odd places, digits by name


def _code_cases_sql() -> str:
    pad = lambda x, n: _PADDED.format(x, n)
    shapes = " ".join(f"when {i} then " + " || ".join(_CODE_DIGITS[x] if j % 2 else f"'{x}'" for j, x in enumerate(parts)) for i, parts in enumerate(_CODE_PARTS))
    rule = r"(?i)ndc\s*([0-9]{1,5})[\-\x{2010}-\x{2015}\s]+([0-9]{1,4})[\-\x{2010}-\x{2015}\s]+([0-9]{1,2})"
    found = " || '-' || ".join(f"regexp_extract(plain, '{rule}', {i})" for i in (1, 2, 3))
    three = lambda a, b, c: f"{pad(a, 5)} || '-' || {pad(b, 4)} || '-' || {pad(c, 2)}"
    whole = "substr(p[1], 1, 5)", "substr(p[1], 6, 4)", "substr(p[1], 10, 2)"
    return f"""with x as (select p_partkey as k, case p_partkey % {len(CODE_SHAPES)} {shapes} end as s from part),
e as (select *, regexp_extract_all(s, '[0-9]+') as g, regexp_replace(s, '[\u2013\u2014\u2212]', '-', 'g') as plain, string_split(nullif(regexp_replace(s, '[^0-9-]', '', 'g'), ''), '-') as p from x)
select k, s, case when len(g) >= 2 then {pad("g[1]", 5)} || '-' || {pad("g[2]", 4)} when len(g) = 1 and length(g[1]) >= 5 then {pad("left(g[1], length(g[1]) - 4)", 5)} || '-' || right(g[1], 4) end as product,
case when len(g) >= 3 then {three("g[1]", "g[2]", "g[3]")} when len(g) = 2 then {pad("g[1]", 5)} || '-' || {pad("g[2]", 4)} || '-00'
  when len(g) = 1 and length(g[1]) >= 7 then {pad("left(g[1], length(g[1]) - 6)", 5)} || '-' || right(left(g[1], length(g[1]) - 2), 4) || '-' || right(g[1], 2) end as package,
{pad("string_split(s, '-')[1]", 5)} as labeler, case when regexp_matches(plain, '{rule}') then {found} end as in_text,
case len(p) when 3 then {three("p[1]", "p[2]", "p[3]")} when 2 then {pad("p[1]", 5)} || '-' || {pad("p[2]", 4)} || '-00' when 1 then case when length(p[1]) in (10, 11) then {three(*whole)} end end as strict_package,
case when len(p) >= 2 then {pad("p[1]", 5)} || '-' || {pad("p[2]", 4)} when len(p) = 1 and length(p[1]) >= 9 then {whole[0]} || '-' || {whole[1]} end as strict_product from e"""


def code_rules(df, s):
    """df with what each rule for codes finds in its column s."""
    return df.select(
        "*", C.product_code(s).alias("product"), C.package_code(s).alias("package"), C.labeler(s).alias("labeler"), C.code_in_text(s).alias("in_text"),
        C.strict_package_code(s).alias("strict_package"), C.strict_product_code(s).alias("strict_product"),
    )


@query("fn_code_cases", _code_cases_sql())
def _(t):
    k = F.col("p_partkey")
    digits = {"k": C.pad(k.cast("string"), 4), "s": C.pad(F.col("p_size").cast("string"), 4), "d": (k % 10).cast("string")}
    texts = [F.concat(*[digits[x] if j % 2 else F.lit(x) for j, x in enumerate(parts)]) for parts in _CODE_PARTS]
    cases = t("part").select(k.alias("k"), F.element_at(F.array(*texts), (k % len(texts) + 1).cast("int")).alias("s"))
    return code_rules(cases, F.col("s"))


_GRADED = (" USP", " NF Micronized", " Drug Substance", " (non-sterile) Sterile Bulk Drug", " anhydrous  usp", " USPX", " EP/JP", "")


@query("fn_ingredient", rf"""select k, trim(regexp_replace(regexp_replace(trim(upper(x)), '\s+({_rx(N.GRADES)})\b', '', 'g'), '\s+', ' ', 'g')) as name,
trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(y), '\(.*?\)', '', 'g'), '\b[dl],?[dl]?-', '', 'g'), '[^a-z ]', ' ', 'g'), '\s+', ' ', 'g')) as plain
from (select p_partkey as k, p_name || {_sql_dealt(_GRADED, "p_partkey")} as x, {_sql_dealt(("d-", "dl-", "d,l-", "L-", "mid-l-"), "p_partkey")} || p_name || ' (salt) 5' as y from part)""")
def _(t):
    y = F.concat(_dealt(("d-", "dl-", "d,l-", "L-", "mid-l-"), "p_partkey"), F.col("p_name"), F.lit(" (salt) 5"))
    return t("part").select(F.col("p_partkey").alias("k"), N.ingredient(F.concat("p_name", _dealt(_GRADED, "p_partkey"))).alias("name"), N.plain_ingredient(y).alias("plain"))


def _country_sql() -> str:
    rules = lambda pairs: " ".join("when " + " or ".join(f"contains(h, '{w}')" for w in ws) + f" then '{c}'" for c, ws in pairs)
    return rf"""case when h is null then 'UNKNOWN' {rules(N.HOLDERS)} when regexp_matches(h, '\bS\.?P\.?A\.?\s*$') and not contains(h, 'USA') then 'ITALY' {rules(N.LATER_HOLDERS)}
when h like '% LTD' and not regexp_matches(h, 'CO LTD|BV|SA|AG') then 'INDIA' else 'OTHER' end"""


@query("fn_holder_country", f"""with c as (select k, {_country_sql()} as country from (select s_suppkey as k, case when s_suppkey % 23 <> 0 then upper(trim({_sql_dealt(HOLDERS, "s_suppkey")})) end as h from supplier))
select k, country, case country {" ".join(f"when '{a}' then '{b}'" for a, b in N.COUNTRY_CODES.items())} end as code from c""")
def _(t):
    h = F.when(F.col("s_suppkey") % 23 != 0, _dealt(HOLDERS, "s_suppkey"))
    c = t("supplier").select(F.col("s_suppkey").alias("k"), N.holder_country(h).alias("country"))
    return c.withColumn("code", N.country_code(F.col("country")))


def _hints_sql(low: str) -> str:
    def part(table) -> str:
        cells = []
        for w, forms in table.items():
            held = rf"regexp_matches({low}, '\b{w}\b')" if len(w) <= 3 else f"contains({low}, '{w}')"
            cells.append(f"case when {held} then {_list(forms)} else []::varchar[] end")
        return f"flatten([{', '.join(cells)}])"

    return f"list_sort(list_distinct(case when len({part(N.FORM_HINTS)}) > 0 then {part(N.FORM_HINTS)} else {part(N.BROAD_HINTS)} end))"


@query("fn_form_hints", f"""select k, array_to_string({_hints_sql("x")}, ';') as hints from (select p_partkey as k, lower(p_name || {_sql_dealt(DRUGS, "p_partkey")}) as x from part)""")
def _(t):
    low = F.lower(F.concat("p_name", _dealt(DRUGS, "p_partkey")))
    return t("part").select(F.col("p_partkey").alias("k"), F.array_join(N.form_hints(low), ";").alias("hints"))


@query("fn_date_repair", """select k, case when a < date '1990-01-01' then make_date(y, 1, 1) else a end::varchar as noted, case when b >= date '1990-01-01' then b end::varchar as resolved, coalesce(try_cast(m as double)::int, 6)::bigint as month
from (select o_orderkey as k, year(o_orderdate)::bigint as y, case when o_orderkey % 5 = 0 then date '1900-01-02' when o_orderkey % 7 <> 0 then o_orderdate::date end as a, case when o_orderkey % 4 = 0 then date '1970-01-01' when o_orderkey % 9 <> 0 then o_orderdate::date end as b,
case o_orderkey % 3 when 0 then '' when 1 then month(o_orderdate)::varchar end as m from orders)""")
def _(t):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    a = F.when(k % 5 == 0, F.lit("1900-01-02").cast("date")).when(k % 7 != 0, d)
    b = F.when(k % 4 == 0, F.lit("1970-01-01").cast("date")).when(k % 9 != 0, d)
    m = F.when(k % 3 == 0, "").when(k % 3 == 1, F.month(d).cast("string"))
    noted, resolved = D.repaired(a, b, F.year(d))
    return t("orders").select(k.alias("k"), noted.cast("string").alias("noted"), resolved.cast("string").alias("resolved"), D.month_or(m).alias("month"))


@query("fn_calendar", """select o_orderkey as k, year(d)::bigint as year, month(d)::bigint as month, ((month(d) - 1) // 3 + 1)::bigint as quarter, (strftime(d, '%Y-%m') between '2020-03' and '2021-06')::bigint as covid_period, (month(d) in (6, 7, 8, 9, 10, 11))::bigint as hurricane_season
from (select o_orderkey, (o_orderdate + interval 23 year)::date as d from orders)""")
def _(t):
    d = F.to_date(F.col("o_orderdate") + F.expr("interval 23 year"))
    return t("orders").select(F.col("o_orderkey").alias("k"), *[c.alias(n) for n, c in D.calendar(d).items()])


_FAMILY_ROWS = (
    ("time_index", "time_history", "0"), ("recall_count_missing", "missingness_indicator", "0"), ("shortage_months_past_12m", "shortage_history", "1"),
    ("route_peer_onset_rate_6m", "shortage_history", "1"), ("rebound_risk", "shortage_history", "1"), ("future_shortage", "outcome_target", "0"), ("route", "drug_characteristics", "0"),
    ("is_injectable", "drug_characteristics", "0"), ("nadac_pct_change_3m", "pricing", "0"), ("symphony_trx_count_lag1", "utilization", "0"), ("class1_recall_12m", "recalls", "0"),
    ("oai_inspection_12m", "regulatory_quality", "0"), ("api_country_hhi", "supply_chain_geography", "0"), ("n_manufacturers", "market_structure", "0"),
    ("peer_vulnerability_interaction", "market_structure", "1"), ("n_repackagers", "repackagers", "0"), ("months_to_exclusivity_end", "patents_exclusivity", "0"),
    ("disruption_signal", "geographic_disaster", "0"), ("years_on_market", "time_history", "0"), ("time_since_last_shortage", "time_history", "1"), ("odd_one", "other", "0"),
    ("is_in_shortage_now", "drug_characteristics", "1"),
)


#: Names of the parts' columns, as the code of a part stands in texts; what is asked of them are the rules above.
_CODE_TEXTS = """case p_partkey % 9 when 0 then 'NDC ' || p_partkey || '-' || p_size || '-1' when 1 then p_partkey || '-' || p_size when 2 then lpad(p_partkey::varchar, 11, '0') when 3 then lpad(p_partkey::varchar, 10, '0')
when 4 then p_name || ' (ndc ' || p_partkey || '\u2013' || p_size || ' 05)' when 5 then p_partkey::varchar when 6 then p_name when 7 then lpad(p_partkey::varchar, 9, '1') else p_partkey || '-' || p_size || '-' || p_size % 9 || '-7' end"""


def _code_sql() -> str:
    pad = lambda x, n: _PADDED.format(x, n)
    rule = r"(?i)ndc\s*([0-9]{1,5})[\-\x{2010}-\x{2015}\s]+([0-9]{1,4})[\-\x{2010}-\x{2015}\s]+([0-9]{1,2})"
    found = " || '-' || ".join(f"regexp_extract(plain, '{rule}', {i})" for i in (1, 2, 3))
    whole = "substr(p[1], 1, 5)", "substr(p[1], 6, 4)", "substr(p[1], 10, 2)"
    three = lambda a, b, c: f"{pad(a, 5)} || '-' || {pad(b, 4)} || '-' || {pad(c, 2)}"
    return f"""with s as (select p_partkey as k, {_CODE_TEXTS} as s from part),
e as (select *, regexp_replace(s, '[\u2013\u2014\u2212]', '-', 'g') as plain, string_split(nullif(regexp_replace(s, '[^\\d\\-]', '', 'g'), ''), '-') as p from s)
select k, case when regexp_matches(plain, '{rule}') then {found} end as in_text, case len(p) when 3 then {three("p[1]", "p[2]", "p[3]")} when 2 then {pad("p[1]", 5)} || '-' || {pad("p[2]", 4)} || '-00' when 1 then case when length(p[1]) in (10, 11) then {three(*whole)} end end as strict_package,
case when len(p) >= 2 then {pad("p[1]", 5)} || '-' || {pad("p[2]", 4)} when len(p) = 1 and length(p[1]) >= 9 then {whole[0]} || '-' || {whole[1]} end as strict_product, {pad("string_split(s, '-')[1]", 5)} as labeler from e"""


@query("fn_codes_of_parts", _code_sql())
def _(t):
    """Codes as they stand in texts: found after the letters, by the strict rules, and their labeler."""
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    texts = [F.concat(F.lit("NDC "), k, F.lit("-"), size, F.lit("-1")), F.concat_ws("-", k, size), F.lpad(k, 11, "0"), F.lpad(k, 10, "0"), F.concat("p_name", F.lit(" (ndc "), k, F.lit("\u2013"), size, F.lit(" 05)")),
             k, F.col("p_name"), F.lpad(k, 9, "1"), F.concat_ws("-", k, size, (F.col("p_size") % 9).cast("string"), F.lit("7"))]
    s = F.element_at(F.array(*texts), (F.col("p_partkey") % 9 + 1).cast("int"))
    return t("part").select(F.col("p_partkey").alias("k"), C.code_in_text(s).alias("in_text"), C.strict_package_code(s).alias("strict_package"), C.strict_product_code(s).alias("strict_product"), C.labeler(s).alias("labeler"))


_NAMED_SQL = f"select f, family, h, p_partkey, p_size from part join (select *, row_number() over () - 1 as i from ({_literal(_FAMILY_ROWS, 'f, family, h')})) on i = p_partkey % {len(_FAMILY_ROWS)}"


def _named(t):
    """A long table of features: a name and a value for each part."""
    return t("part").select(F.element_at(F.array(*[F.lit(r[0]) for r in _FAMILY_ROWS]), (F.col("p_partkey") % len(_FAMILY_ROWS) + 1).cast("int")).alias("f"), "p_partkey", "p_size")


def _families(df):
    """(f, family, h): domain of each distinct name of a long table, and whether it is history; the rules run once for each."""
    return df.select("f").distinct().select("f", F.udf(X.feature_family, "string")("f").alias("family"), F.udf(lambda f: int(X.is_history(f)), "int")("f").alias("h"))


@query("fn_feature_family", f"select f, family, h::bigint as history, count(*)::bigint as n from ({_NAMED_SQL}) group by all")
def _(t):
    df = _named(t)
    return df.join(_families(df), "f").groupBy("f", "family", F.col("h").alias("history")).agg(F.count("*").alias("n"))


@query("flt12_feature_scenario", f"select distinct f from ({_NAMED_SQL}) where h = '0' and not contains(f, 'symphony')")
def _(t):
    """Of the names that a long table holds, those that a scenario keeps."""
    names = _named(t).select("f").distinct()
    kept = X.scenario_features([r[0] for r in names.collect()], "without_licensed_prescription_or_shortage_history")  # a table's columns
    return names.where(F.col("f").isin(kept))


@query("fn_family_totals", f"select family, count(distinct f)::bigint as features, count(*)::bigint as n, sum(p_size)::bigint as total, max(h::bigint) as history from ({_NAMED_SQL}) group by family")
def _(t):
    """Values by the domain of their feature's name; the rules run once for each distinct name."""
    df = _named(t)
    return df.join(_families(df), "f").groupBy("family").agg(F.countDistinct("f").alias("features"), F.count("*").alias("n"), F.sum("p_size").alias("total"), F.max("h").alias("history"))


@query("flt12_scenario_values", f"select f, p_partkey as k, p_size as v from ({_NAMED_SQL}) where h = '0' and not contains(f, 'symphony')")
def _(t):
    """Values of the features that a scenario keeps, chosen among the names that the table holds."""
    df = _named(t)
    kept = X.scenario_features([r[0] for r in df.select("f").distinct().collect()], "without_licensed_prescription_or_shortage_history")  # a table's columns
    return df.where(F.col("f").isin(kept)).select("f", F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))


# --- resolution -----------------------------------------------------------------------------------------------

#: Panel names end in these, source names in those; both from the words of part names.
PANEL_TAILS = ("", " hydrochloride", " human", " and zinc", " sodium", "")
ALIASES = (("almond injction", "almond antique"), ("blush drug", "blush thistle"), ("nothing known", "no such target"))


def _panel_sql() -> str:
    return f"""n as (select distinct p_name from part), pn as (select p_name, row_number() over (order by p_name) as r from n),
panel as (select distinct p_name || {_sql_dealt(PANEL_TAILS, "r")} as target, f.form from pn, (select unnest({_list(BASES)}) as form, unnest(range({len(BASES)})) as j) f where (r + f.j) % 3 > 0),
src as (select distinct x as name from (select p_name || {_sql_dealt(DRUGS, "r * 5")} as x from pn union all select string_split(p_name, ' ')[1] || {_sql_dealt(DRUGS, "r + 2")} from pn union all select replace(p_name, ' ', '/') || ' tablets' from pn
union all select p_name || ' hydrochloride sodium acetate' from pn where r % 4 = 0 union all select 'Fine ' || p_name || ' (X) oral drops' from pn union all select unnest(['Almond injction 5 mg', 'BLUSH drug (B)', 'nothing known', 'zzz']) ) where x is not null)"""


_RESOLVE = rf"""with {_panel_sql()},
fm as (select lower(trim(target)) as key, target, form from panel), ks as (select distinct key from fm),
al as ({_literal(ALIASES, "alias, target")}),
{_base_sql(r"(select regexp_replace(trim(name), '\s+', ' ', 'g') as name, name as raw from src)")},
w as (select s.name as raw, b5.base, regexp_replace(lower(trim(s.name)), '\s+', ' ', 'g') as low from src s join (select distinct * from b5) b5 on b5.name = regexp_replace(trim(s.name), '\s+', ' ', 'g')),
q as (select *, trim(regexp_replace(regexp_replace(low, '\([^)]*\)', '', 'g'), '\s+', ' ', 'g')) as plain from w),
t1 as (select raw, coalesce(a1.target, a2.target, a3.target, a4.target) as key from q left join al a1 on a1.alias = low left join al a2 on a2.alias = plain
  left join al a3 on a3.alias = trim(regexp_replace(low, '\s+\d+\s*(mg|mcg|ml|%)\b.*$', '')) left join al a4 on a4.alias = trim(regexp_replace(plain, '\s+\d+\s*(mg|mcg|ml|%)\b.*$', ''))),
bare as (select *, trim(regexp_replace(base, '\s+({"|".join(N.SALT_TAILS)})\s*$', '')) as nosalt from q),
salted as (select raw, base, unnest({_list(N.ADDED_SALTS)}) as salt, unnest(range({len(N.ADDED_SALTS)})) as i from q),
own as (select raw, list_distinct(list_filter(list_transform(string_split(case when base <> '' then base else low end, ' '), lambda x: trim(x, ',-/()')), lambda x: length(x) > 2)) as ws from q),
theirs as (select key, list_distinct(list_filter(list_transform(string_split(key, ' '), lambda x: trim(x, ',()')), lambda x: length(x) > 2)) as ks from ks),
open as (select raw, ws, list_filter(ws, lambda x: not list_contains({_list(J.COMMON_WORDS)}, x)) as rare from own),
shared as (select raw, key, ws, len(list_intersect(ws, ks)) / greatest(len(ws), len(ks)) as share from open, theirs where len(list_intersect(ks, case when len(rare) > 0 then rare else ws end)) > 0),
f as (select raw, key, 1 as p from t1 join ks using (key) union all select raw, plain, 2 from q join ks on key = plain union all select raw, low, 3 from q join ks on key = low union all select raw, base, 4 from q join ks on key = base
union all select raw, key, 5 from q join ks on contains(base, '/') and key = regexp_replace(base, '\s*/\s*', ' and ', 'g')
union all select raw, key, 6 from q join ks on length(base) >= 4 and (key = base or starts_with(key, base || ' ')) and (contains(base, ' and ') or not contains(key, ' and '))
union all select raw, nosalt, 7 from bare join ks on key = nosalt where nosalt <> base
union all select raw, arg_min(key, i), 8 from salted join ks on key = base || ' ' || salt group by raw
union all select raw, key, 9 from (select *, max(share) over (partition by raw) as top from shared) where share = top and top >= case when len(ws) >= 2 then 0.67 else 1.0 end),
h as (select distinct raw, key, p from (select *, min(p) over (partition by raw) as first from f) where p = first),
c as (select h.raw, fm.target, fm.form, h.p, len(list_filter({_hints_sql("q.low")}, lambda x: contains(upper(fm.form), x))) > 0 as hit from h join fm using (key) join q on q.raw = h.raw)
select distinct raw as name, target, form, p::bigint as pass_no from (select *, max(hit::int) over (partition by raw) as anyhit from c) where hit or anyhit = 0"""


def _names_and_panel(t):
    from pyspark.sql.window import Window

    pn = t("part").select("p_name").distinct().withColumn("r", F.row_number().over(Window.orderBy("p_name")))  # a few hundred names
    forms = t.spark.createDataFrame(list(enumerate(BASES)), "j int, form string")
    panel = pn.join(F.broadcast(forms), (F.col("r") + F.col("j")) % 3 > 0).select(F.concat("p_name", _dealt(PANEL_TAILS, "r")).alias("target"), "form")
    first = F.element_at(F.split("p_name", " "), 1)
    r = F.col("r")
    made = [
        pn.withColumn("r", r * 5).select(F.concat("p_name", _dealt(DRUGS, "r")).alias("name")),
        pn.withColumn("r", r + 2).select(F.concat(first, _dealt(DRUGS, "r")).alias("name")),
        pn.select(F.concat(F.regexp_replace("p_name", " ", "/"), F.lit(" tablets")).alias("name")),
        pn.where(r % 4 == 0).select(F.concat("p_name", F.lit(" hydrochloride sodium acetate")).alias("name")),
        pn.select(F.concat(F.lit("Fine "), F.col("p_name"), F.lit(" (X) oral drops")).alias("name")),
        t.spark.createDataFrame([("Almond injction 5 mg",), ("BLUSH drug (B)",), ("nothing known",), ("zzz",)], "name string"),
    ]
    names = made[0]
    for m in made[1:]:
        names = names.unionByName(m)
    return names.distinct(), panel, t.spark.createDataFrame(ALIASES, "alias string, target string")


@query("join17_entity_resolution", _RESOLVE)
def _(t):
    return J.match_names(*_names_and_panel(t))


@query("alg03_unmatched", _RESOLVE[: _RESOLVE.index("select distinct raw as name")] + "select name from src where name not in (select raw from c)")
def _(t):
    names, panel, aliases = _names_and_panel(t)
    return names.join(J.match_names(names, panel, aliases), "name", "left_anti")


@query("join19_multi_ingredient", """with c as (select p_partkey as part, p_name as drug, case when p_partkey % 3 = 0 then replace(p_name, ' ', ' ; ') else p_name end as listed from part),
h as (select upper(x) as api, s_suppkey as holder from supplier, (select distinct unnest([p_name, string_split(p_name, ' ')[1]]) as x from part) n where hash(x) is not null and (length(x) + s_suppkey) % 11 = 0),
direct as (select part, holder from c join h on h.api = upper(trim(listed))), parts as (select part, upper(trim(unnest(string_split(listed, ';')))) as api from c where contains(listed, ';')),
multi as (select distinct part, holder from parts join h using (api))
select part, count(distinct holder)::bigint as holders, min(holder)::bigint as first_holder from (select part, holder from multi union all select part, holder from direct where part not in (select part from multi)) group by part""")
def _(t):
    listed = F.when(F.col("p_partkey") % 3 == 0, F.regexp_replace("p_name", " ", " ; ")).otherwise(F.col("p_name"))
    c = t("part").select(F.col("p_partkey").alias("part"), listed.alias("listed"))
    n = t("part").select(F.explode(F.array("p_name", F.element_at(F.split("p_name", " "), 1))).alias("x")).distinct()
    h = n.crossJoin(F.broadcast(t("supplier").select("s_suppkey"))).where((F.length("x") + F.col("s_suppkey")) % 11 == 0)
    h = h.select(F.upper("x").alias("api"), F.col("s_suppkey").alias("holder"))
    # parts whose lists are the same have the same holders: these are joined and counted once
    c = c.groupBy("part").agg(F.array_sort(F.collect_set("listed")).alias("lists"))
    lists = c.select("lists").distinct().select("lists", F.explode("lists").alias("listed"))
    held = J.held_by_parts(lists, h, "lists", "listed", "api", "holder")
    return c.join(held.groupBy("lists").agg(F.countDistinct("holder").alias("holders"), F.min("holder").alias("first_holder")), "lists").drop("lists")


def _typo(c):
    """The name with two neighbouring letters swapped, so that one-word names share no token with their own."""
    return F.concat(F.substring(c, 1, 2), F.substring(c, 4, 1), F.substring(c, 3, 1), F.substring(c, 5, 100))


def _best_sql(left: str, right: str) -> str:
    """CTEs up to best (name, choice, score): of all pairs of sorted tokens, by the common subsequence's table row for row."""
    tokens = "array_to_string(list_sort(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')), ' ')"
    return f"""recursive nm as ({left}), ch as ({right}), pairs as (select name, choice, {tokens.format("name")} as x, {tokens.format("choice")} as y from nm cross join ch),
steps as (select name, choice, x, y, 0 as i, list_transform(range(len(x) + 1), lambda j: 0) as held from pairs
union all select name, choice, x, y, i + 1, list_prepend(0, list_transform(range(1, len(cand) + 1), lambda j: list_max(cand[1:j]))) from (select *, list_transform(range(1, len(x) + 1), lambda j: greatest(held[j + 1], held[j] + (x[j] = y[i + 1])::int)) as cand from steps where i < len(y))),
scored as (select name, choice, 200.0::double * held[len(x) + 1] / (len(x) + len(y)) as score from steps where i = len(y)),
best as (select name, choice, score from scored where score >= 85 qualify row_number() over (partition by name order by score desc, choice) = 1)"""


_TYPO_SQL = "substr({0}, 1, 2) || substr({0}, 4, 1) || substr({0}, 3, 1) || substr({0}, 5)"


@query("join16_fuzzy_top1", "with " + _best_sql("select " + _TYPO_SQL.format("r") + " as name from (select array_to_string(list_reverse(string_split(p_name, ' ')), ' ') as r from (select distinct p_name from part))", "select distinct p_name as choice from part") + " select name, choice, round(score, 6) as score from nm left join best using (name)")
def _(t):
    names = t("part").select(F.col("p_name").alias("choice")).distinct()
    dirty = names.select(_typo(F.concat_ws(" ", F.reverse(F.split("choice", " ")))).alias("name"))
    return J.fuzzy_best(dirty, names, "name", "choice", 85.0).select("name", "choice", F.round("score", 6).alias("score"))


@query("join16_token_set_top1", """with n as (select distinct p_name as choice from part) select a.choice || ' extra words' as name, min(b.choice) as choice, 100.0::double as score from n a join n b on list_has_all(string_split(a.choice || ' extra words', ' '), string_split(b.choice, ' ')) group by a.choice""")
def _(t):
    names = t("part").select(F.col("p_name").alias("choice")).distinct()
    dirty = names.select(F.concat("choice", F.lit(" extra words")).alias("name"))
    return J.fuzzy_best(dirty, names, "name", "choice", 85.0, "set").select("name", "choice", "score")


@query("alg04_firm_matching", """select s_suppkey as k, s_name as name, round(200.0 * length(trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g'))) / (2 * length(trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g'))) + 1), 6)::double as score from supplier""")
def _(t):
    firms = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name"), N.company(F.col("s_name")).alias("choice"))
    dirty = firms.select("k", N.company(F.concat("s_name", F.lit("z, Inc."))).alias("name"))
    best = J.fuzzy_best(dirty, firms.select("choice"), "name", "choice", 85.0)
    return best.join(firms.groupBy("choice").agg(F.min("s_name").alias("s_name")), "choice").select("k", F.col("s_name").alias("name"), F.round("score", 6).alias("score"))


@query("alg04_first_labelers", "with " + _best_sql("select distinct " + _TYPO_SQL.format("p_name") + " as name from part", "select distinct p_name as choice from (select p_name from part qualify row_number() over (partition by p_partkey % 1000 order by p_partkey) = 1)") + """,
codes as (select p_name as choice, min(code) as code from (select p_name, p_partkey % 1000 as code from part qualify row_number() over (partition by p_partkey % 1000 order by p_partkey) = 1) group by 1),
firms as (select distinct p_partkey % 500 as recall, """ + _TYPO_SQL.format("p_name") + """ as name from part)
select recall, code, count(*)::bigint as names from firms join best using (name) join codes using (choice) group by all""")
def _(t):
    """Recalling firms matched to the first labeler of each code, by their normalised names."""
    firms = t("part").select((F.col("p_partkey") % 500).alias("recall"), N.company(F.concat(_typo(F.col("p_name")), F.lit(" Corporation"))).alias("firm")).distinct()
    labels = t("part").select((F.col("p_partkey") % 1000).alias("code"), "p_partkey", N.company(F.concat("p_name", F.lit(", Inc."))).alias("labeler"))
    return J.match_firms(firms, labels, "firm", "labeler", "code", F.col("p_partkey")).groupBy("recall", "code").agg(F.count("*").alias("names"))


_BOOKS = """b as (select j as rank, 2024 - j as year, p_partkey % 300 as application, case when p_partkey % 300 % 7 = j then null else upper(trim(p_brand)) || '|' || upper(p_type) end as key, p_partkey as maker from part, (select unnest(range(3)) as j) where p_partkey % 5 <> j)"""
_KEYED = """k as (select application, arg_min(key, (rank, key)) as key from b where key is not null group by application),
i as (select p_partkey as item, case when p_partkey % 4 = 0 then null else p_partkey % 400 end as application, case when p_partkey % 9 = 0 then '|;' else upper(p_name) || '|' || upper(p_type) || ';' || p_size % 3 end as fall from part),
m as (select item, coalesce(key, fall) as product_key from i left join k using (application) where coalesce(key, fall) <> '|;')"""


def _books(t):
    b = t("part").withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(2)))).where(F.col("p_partkey") % 5 != F.col("rank"))
    a = F.col("p_partkey") % 300
    key = F.when(a % 7 != F.col("rank"), F.concat_ws("|", F.upper(F.trim("p_brand")), F.upper("p_type")))
    return b.select("rank", (2024 - F.col("rank")).alias("year"), a.alias("application"), key.alias("key"), F.col("p_partkey").alias("maker"))


def _product_keys(t):
    k = F.col("p_partkey")
    text = F.concat(F.upper("p_name"), F.lit("|"), F.upper("p_type"), F.lit(";"), (F.col("p_size") % 3).cast("string"))
    items = t("part").select(k.alias("item"), F.when(k % 4 != 0, k % 400).alias("application"), F.when(k % 9 == 0, "|;").otherwise(text).alias("fall"))
    return J.product_keys(items, _books(t).where("key is not null"), fallback=F.col("fall"))


@query("alg08_product_keys", f"with {_BOOKS}, {_KEYED} select item, product_key from m")
def _(t):
    return _product_keys(t)


@query("alg08_market_structure", f"""with {_BOOKS}, {_KEYED}, s as (select key as product_key, year, count(distinct maker)::bigint as makers, count(distinct application)::bigint as applications from b where key is not null group by all),
p as (select product_key, count(distinct item % 50)::bigint as makers from m where product_key not in (select product_key from s) group by all)
select product_key, year::bigint as year, makers, applications from s union all select product_key, year::bigint, makers, makers from p cross join (select distinct year from s)""")
def _(t):
    b = _books(t).where("key is not null")
    shares = b.groupBy(F.col("key").alias("product_key"), "year").agg(F.countDistinct("maker").alias("makers"), F.countDistinct("application").alias("applications"))
    return J.makers_by_key(_product_keys(t), shares, F.col("item") % 50)
