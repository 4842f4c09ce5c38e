"""What queries do on tables that have grown: copies of the smallest ones with shifted keys."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from monthloom.functions.fuzzy import ratio
from monthloom.operators import features as X
from monthloom.operators import joins as J

from .test_entry import DIR, same


def compared(spark, folder, name):
    """The query's rows, after comparing them with those of its SQL over the folder's tables."""
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    got, want = entry.queries()[name](spark, str(folder)).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert len(got) == len(want) > 0
    same(got, want)
    return got


def made(folder, **tables):
    for name, sql in tables.items():
        duckdb.connect().execute(f"copy ({sql}) to '{folder}/{name}.parquet' (format parquet)")
    return folder


@pytest.mark.parametrize("step", [1000, 7])
def test_lists_are_joined_once(spark, tmp_path, monkeypatch, step):
    """Parts with the same lists are joined to holders once; with a small step keys repeat, so parts have several lists."""
    made(tmp_path, supplier=f"from '{DIR}/supplier.parquet'", part=f"select p.* replace ((p_partkey + i * {step})::bigint as p_partkey) from '{DIR}/part.parquet' p, range(4) r(i)")
    seen, plain = [], J.held_by_parts
    monkeypatch.setattr(J, "held_by_parts", lambda listed, *a, **k: seen.append(listed) or plain(listed, *a, **k))
    compared(spark, tmp_path, "join19_multi_ingredient")
    ways = duckdb.sql(f"select count(distinct (p_partkey % 3 = 0, p_name)) from '{tmp_path}/part.parquet'").fetchall()[0][0]
    assert step < 1000 or seen[0].count() == ways


def test_long_keys(spark, tmp_path):
    """Part keys of six digits and more, of which a package code keeps five, as its SQL form does."""
    made(tmp_path, part=f"select * replace (p_partkey + 999 * (p_partkey % 3) * (p_partkey % 1000) as p_partkey) from '{DIR}/part.parquet'")
    assert compared(spark, tmp_path, "fn_package_code")["k"].max() >= 100_000


def test_firms_one_letter_apart(spark, tmp_path, monkeypatch):
    """Names that share their word and most digits: those with a firm one letter away are not compared with all others; two suppliers have each name."""
    made(tmp_path, supplier=f"select p.* replace ((s_suppkey + i * 1000)::bigint as s_suppkey, 'Supplier#' || lpad((s_suppkey + i // 2 * 1000)::varchar, 9, '0') as s_name) from '{DIR}/supplier.parquet' p, range(4) r(i)")
    seen, plain = [], J.similar_pairs
    monkeypatch.setattr(J, "similar_pairs", lambda a, *rest: seen.append(a) or plain(a, *rest))
    compared(spark, tmp_path, "alg04_firm_matching")
    assert seen[0].count() == 0


def test_best_is_not_always_the_nearest(spark):
    """One letter away leaves a short name open, as a longer choice two letters away may be as good."""
    df = lambda words, c: spark.createDataFrame([(w,) for w in words], f"{c} string")
    left, right = ["abcdefgh", "abcdefghi", "ab", "zz", "", None], ["abcdefgh", "abcdefg", "bcdefghij", "abcdefghixy", "a", "abcd", "", None, "ABCDEFG"]
    got = {r["name"]: (r["choice"], r["score"]) for r in J.fuzzy_best(df(left, "name"), df(right, "choice"), "name", "choice", 60.0).collect()}
    want = {}
    for x in left:
        all_ = [(-ratio(x, y.lower()), y) for y in right if x and y and ratio(x, y.lower()) >= 60.0]
        want[x] = (min(all_)[1], -min(all_)[0]) if all_ else (None, None)
    assert got == want


def test_members_are_made_once(spark, monkeypatch):
    """A group's members, many rows for each of its months, are worked out once for all that the chain takes from them."""
    made_rows, plain = spark.sparkContext.accumulator(0), X.build_groups
    rows = []

    def counted(frames):
        for x in frames:
            made_rows.add(len(x))
            yield x

    def build(members, *rest):
        rows.append(members.count())
        return plain(members.mapInPandas(counted, members.schema), *rest)

    monkeypatch.setattr(X, "build_groups", build)
    assert entry.queries()["alg07_group_chain"](spark, DIR).count() > 0
    assert made_rows.value == rows[0] > 0
