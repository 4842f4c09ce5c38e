"""Rules that once ran on rows of their own: the queries read a table, and the rules still give those rows' results."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from monthloom.functions import codes as C
from monthloom.functions import names as N
from monthloom.plans import matching

from .test_entry import DIR, same

READS = {
    "flt12_feature_scenario": "part",
    "fn_feature_family": "part",
    "fn_application": "part",
    "fn_first_class": "part",
    "snk06_empty_typed": "orders",
    "spn01_month_list": "lineitem",
    "fn_code_cases": "part",
}


@pytest.mark.parametrize("name", READS)
def test_reads_a_table(spark, name):
    """Spark scans it for the query, whose rows are those of its SQL form."""
    con, table = duckdb.connect(), READS[name]
    con.execute(f"create view {table} as select * from '{DIR}/{table}.parquet'")
    df = entry.queries()[name](spark, DIR)
    assert [f.rsplit("/", 1)[-1] for f in df.inputFiles()] == [f"{table}.parquet"]
    got, want = df.toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert len(got) == len(want) > 0
    same(got, want)


def test_application_cases(spark):
    rows = [("ANDA076432", "076432", "ANDA"), ("nda 21", "000021", "NDA"), ("BLA1234567", "234567", "BLA"), ("part", None, None)]
    got = spark.createDataFrame([(r[0],) for r in rows], "s string").select("s", C.application_number(F.col("s")), C.application_type(F.col("s")))
    assert [tuple(r) for r in got.collect()] == rows


def test_first_class_cases(spark):
    rows = [("A [MoA], B [EPC], C [EPC]", "B [EPC]"), ("A [X], B [MoA]", "B [MoA]"), ("A, B", "A"), ("", None)]
    got = spark.createDataFrame([(r[0],) for r in rows], "s string").select("s", N.first_class(F.col("s"), "[EPC]", "[MoA]"))
    assert [tuple(r) for r in got.collect()] == rows


def test_code_cases(spark):
    rows = spark.createDataFrame([(r[0],) for r in matching.CODE_ROWS], "s string")
    assert [tuple(r) for r in matching.code_rules(rows, F.col("s")).collect()] == [tuple(r) for r in matching.CODE_ROWS]
