"""Proxy tables of the panel, as DataFrames and as SQL, and the query registry."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import month_index
from ..operators.windows import rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its DuckDB form. Integers leave as 64 bits."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir))
            return out.select(*[F.col(c).cast("long") if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in out.dtypes])

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = _with(sql)
        return f

    return add


#: Shared steps of the SQL forms, each built on those before it.
CTES = {
    "li": """li as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, cast(l_quantity as bigint) as qty,
  cast(round(l_extendedprice * 100) as bigint) as cents, cast(l_shipdate as date) as d,
  (year(l_shipdate) * 12 + month(l_shipdate) - 1)::bigint as ym from lineitem)""",
    "pm": """pm as (select l_partkey as part, ym, sum(qty)::bigint as qty, sum(cents)::bigint as cents,
  sum((l_returnflag = 'R')::int)::bigint as ret, count(*)::bigint as n from li group by all)""",
    "dn": """dn as (select s.part, s.ym, coalesce(qty, 0) as qty, coalesce(ret, 0) as ret, cents, cents / qty as price
  from (select part, unnest(range(min(ym), max(ym) + 1))::bigint as ym from pm group by part) s left join pm using (part, ym))""",
    "gm": """gm as (select p_brand || ' | ' || p_type as g, p_brand as brand, ym, sum(qty)::bigint as qty,
  sum((l_returnflag = 'R')::int)::bigint as ret, count(distinct l_suppkey)::bigint as suppliers, count(distinct l_partkey)::bigint as parts
  from li join part on p_partkey = l_partkey where ym < 24019 group by all)""",
    "gs": """gs as (select g, brand, ym, qty, ret, suppliers, parts, case when c >= 2 and s - c * qty > 0
  and (s - c * qty) * (s - c * qty) * (c - 1) > c * (c * q - s * s) then 1 else 0 end::bigint as state
  from (select *, count(*) over w as c, sum(qty) over w as s, sum(qty * qty) over w as q from gm
    window w as (partition by g order by ym rows between 6 preceding and 1 preceding)))""",
    "pp": """pp as (select g, ym, y as event, state, coalesce(r6, 0) as r6 from (select *, lead(state) over w as y, lead(ym) over w as nx,
  coalesce(max(state) over (partition by g order by ym rows between unbounded preceding and current row), 0) as ever,
  sum(ret) over (partition by g order by ym rows between 6 preceding and 1 preceding)::bigint as r6
  from gs window w as (partition by g order by ym)) where ever = 0 and nx = ym + 1),
sc as (select g, ym, event, (1 + r6 % 37)::double / 64 as score from pp)""",
}
_BUILT_ON = {"li": (), "pm": ("li",), "dn": ("li", "pm"), "gm": ("li",), "gs": ("li", "gm"), "pp": ("li", "gm", "gs")}


def _with(sql: str) -> str:
    used = {k for k in CTES if re.search(rf"\b{k}\b", sql)} | ({"pp"} if re.search(r"\bsc\b", sql) else set())
    used |= {b for k in used for b in _BUILT_ON[k]}
    if not used:
        return sql
    head = ", ".join(v for k, v in CTES.items() if k in used)
    body = sql.strip()
    return f"with {head}, {body[5:]}" if body.lower().startswith("with ") else f"with {head} {body}"


class Tables:
    """Parquet tables of one folder and the panel's proxies on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def lines(self) -> DataFrame:
        d = F.to_date("l_shipdate")
        return self("lineitem").select(
            "l_orderkey",
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
            "l_returnflag",
            F.col("l_quantity").cast("long").alias("qty"),
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
            d.alias("d"),
            month_index(d).alias("ym"),
        )

    def part_month(self) -> DataFrame:
        """Sparse entity-month sums."""
        return self.lines().groupBy(F.col("l_partkey").alias("part"), "ym").agg(
            F.sum("qty").alias("qty"),
            F.sum("cents").alias("cents"),
            F.sum((F.col("l_returnflag") == "R").cast("int")).alias("ret"),
            F.count("*").alias("n"),
        )

    def dense(self) -> DataFrame:
        """All months of each part between its first and last, with sums filled by 0 and prices left null.

        Each month with lines also makes the empty ones up to the next, so the lines are read once and the rows
        leave partitioned by part.
        """
        pm = self.part_month().withColumn("__next", F.lead("ym").over(rows(["part"], ["ym"])))
        x = pm.select("*", F.explode(F.sequence("ym", F.coalesce(F.col("__next") - 1, F.col("ym")))).alias("__m"))
        here = lambda c: F.when(F.col("__m") == F.col("ym"), F.col(c))
        x = x.select("part", F.col("__m").alias("ym"), *[here(c).alias(c) for c in ("qty", "ret", "cents")])
        price = (F.col("cents") / F.col("qty")).alias("price")
        return x.select("part", "ym", F.coalesce("qty", F.lit(0)).alias("qty"), F.coalesce("ret", F.lit(0)).alias("ret"), "cents", price)

    def group_month(self) -> DataFrame:
        """Brand-and-type months before the last, partial ones."""
        parts = self("part").select("p_partkey", "p_brand", "p_type")
        g = F.concat_ws(" | ", "p_brand", "p_type")
        return (
            self.lines()
            .where("ym < 24019")
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(g.alias("g"), F.col("p_brand").alias("brand"), "ym")
            .agg(
                F.sum("qty").alias("qty"),
                F.sum((F.col("l_returnflag") == "R").cast("int")).alias("ret"),
                F.countDistinct("l_suppkey").alias("suppliers"),
                F.countDistinct("l_partkey").alias("parts"),
            )
        )

    def group_state(self) -> DataFrame:
        """group_month with state 1 where qty lies over a deviation below the mean of the six rows before.

        Compared in whole numbers, so that no rounding decides.
        """
        w = rows(["g"], ["ym"]).rowsBetween(-6, -1)
        q = F.col("qty")
        df = self.group_month().withColumns({"c": F.count("*").over(w), "s": F.sum("qty").over(w), "q": F.sum(q * q).over(w)})
        gap = F.col("s") - F.col("c") * q
        low = (F.col("c") >= 2) & (gap > 0) & (gap * gap * (F.col("c") - 1) > F.col("c") * (F.col("c") * F.col("q") - F.col("s") * F.col("s")))
        return df.withColumn("state", F.coalesce(low, F.lit(False)).cast("int")).drop("c", "s", "q")

    def scored(self) -> DataFrame:
        """At-risk group-months (never in state 1 so far, next month observed) with next state and a fixed score."""
        w = rows(["g"], ["ym"])
        df = self.group_state().select(
            "g",
            "ym",
            "state",
            F.lead("state").over(w).alias("event"),
            F.lead("ym").over(w).alias("nx"),
            F.max("state").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("ever"),
            F.coalesce(F.sum("ret").over(w.rowsBetween(-6, -1)), F.lit(0)).alias("r6"),
        )
        df = df.where((F.col("ever") == 0) & (F.col("nx") == F.col("ym") + 1))
        return df.select("g", "ym", "event", ((1 + F.col("r6") % 37).cast("double") / 64).alias("score"))
