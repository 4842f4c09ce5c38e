"""Every SQL form against its query on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
PICK = ["win_trailing_lag1", "win13_spell_memory", "join09_event_window", "join11_interval_expand", "agg08_group_rollup", "set03_except", "met01_auroc", "src01_delimited", "alg05_offset_risk",
        "fn_company", "fn_base_name", "fn_code_cases", "fn_form_hints", "fn_holder_country", "fn_composites", "src03_encodings", "src05_spreadsheet", "join13_asof_gated_hhi", "join16_token_set_top1",
        "join17_entity_resolution", "join19_multi_ingredient", "alg07_group_panel", "alg08_market_structure", "met05_precision_at_k", "met09_harrell", "rpt01_performance_row", "ml12_case_control", "val03_month_completeness",
        "met04_ece", "met08_bootstrap", "met10_metrics", "ml13_weighted_sample", "alg04_first_labelers", "fn_codes_of_parts", "fn_family_totals", "join16_fuzzy_top1", "snk05_fresh_by_inputs", "src17_event_versions", "flt07_anti_filter"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    a, b = ({tuple(map(str, r)): 0 for r in x[names].astype(object).where(x[names].notna(), None).itertuples(index=False)} for x in (a, b))
    assert a == b


@pytest.mark.parametrize("name", PICK)
def test_sql_form(spark, con, name):
    got = entry.queries()[name](spark, DIR).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    assert len(got) == len(want)
    same(got, want)


def test_group_chain(spark, con):
    """As above, but for columns of whole numbers with nulls, which come as floats from the one and not from the other."""
    plain = lambda x: x.astype(object).where(x.notna(), None).map(lambda v: float(v) if isinstance(v, int) else v)
    got, want = entry.queries()["alg07_group_chain"](spark, DIR).toPandas(), con.sql(entry.oracle_sql()["alg07_group_chain"]).df()
    assert len(got) == len(want) > 0
    same(plain(got), plain(want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
