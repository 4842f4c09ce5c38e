"""Sources, sinks and the stream extension over the driver's tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import functions as F

from ..sources import flatten, readers, sheets, sinks
from ..streaming import events as E
from .base import query


def _folder(t) -> str:
    """A place that driver and executors share; a temporary folder only where none is named and all run on one machine."""
    base = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.sparkContext.getCheckpointDir()
    if not base:
        if not t.spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="panel-scratch-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@query("src01_delimited", "select p_partkey::varchar as k, p_name as name, case when length(p_size::varchar) >= 6 then p_size::varchar else lpad(p_size::varchar, 6, '0') end as number from part")
def _(t):
    path = _folder(t)
    p = t("part").select(F.col("p_partkey").alias("k"), F.concat("p_name", F.lit("  ")).alias("name"), F.col("p_size").alias("Appl_No"))
    p.write.csv(path, sep="~", header=True)
    return readers.application_table(t.spark, path).withColumnRenamed("Appl_No", "number")


@query("src02_csv_variant", "select p_partkey::varchar as k, p_name as name, case when length(p_size::varchar) >= 6 then p_size::varchar else lpad(p_size::varchar, 6, '0') end as number from part")
def _(t):
    path = _folder(t) + ".csv"
    t("part").select(F.col("p_partkey").alias("Key"), F.col("p_name").alias("Trade Name"), F.col("p_size").alias("Number")).write.csv(path, header=True)
    return readers.application_table(t.spark, path, "number", {"Key": "k", "Trade Name": "name", "Number": "number"})


@query("src03_encodings", "select n_nationkey::varchar as k, n_name || ' é “€' as name, 'cp1252' as encoding from nation")
def _(t):
    path = _folder(t)
    # Latin-1 writes the control characters that stand for these signs in code page 1252
    t("nation").select(F.col("n_nationkey").alias("k"), F.concat("n_name", F.lit(" é \x93\x80")).alias("name")).write.csv(path, sep="\t", header=True, encoding="ISO-8859-1")
    found = readers.detect_encoding(t.spark, f"{path}/*.csv")
    return readers.delimited(t.spark, path, "\t", found).withColumn("encoding", F.lit(found))


@query("src12_quarter_of_file", "select 2021::bigint as year, 3::bigint as quarter, count(*)::bigint as n from region union all select 2020, 1, count(*) from nation")
def _(t):
    base = _folder(t)
    t("region").write.csv(f"{base}/2021q3.csv")
    t("nation").write.csv(f"{base}/jan-2020.csv")
    files = t.spark.read.text([f"{base}/2021q3.csv", f"{base}/jan-2020.csv"])
    return files.select(*readers.quarter_of_file(-2)).groupBy("year", "quarter").agg(F.count("*").alias("n"))


@query("snk03_run_metadata", "select count(*)::bigint as n, 'onset' as task from orders")
def _(t):
    path = _folder(t)
    sinks.metadata(t.spark, {"n": t("orders").count(), "task": "onset"}, path)
    return flatten.parsed(t.spark.read.text(path), "value", "n long, task string").select("j.n", "j.task")


@query("snk05_cached_table", "select count(*)::bigint as n, true as kept from region")
def _(t):
    path = _folder(t)
    first = sinks.cached(t.spark, path, lambda: t("region"), "1").count()
    kept = sinks.cached(t.spark, path, lambda: t("nation"), "1").count() == first  # the same stamp: not built anew
    new = sinks.cached(t.spark, path, lambda: t("nation"), "2").count() == t("nation").count()
    return t.spark.createDataFrame([(first, kept and new)], "n long, kept boolean")


@query("snk05_fresh_by_inputs", "select count(*)::bigint as n, count(distinct l_orderkey)::bigint as orders from li")
def _(t):
    """Orders summed from a copy of the lines: kept while the copy is as it was, built anew after it has grown."""
    lines, path = _folder(t), _folder(t)
    half = F.col("l_linenumber") <= 2
    build = lambda: t.spark.read.parquet(lines).groupBy("l_orderkey").agg(F.count("*").alias("n"))
    t.lines().where(half).select("l_orderkey").write.parquet(lines)
    first = sinks.cached_from(t.spark, path, build, [lines]).agg(F.sum("n")).first()[0]
    kept = sinks.cached_from(t.spark, path, lambda: build().where("n < 0"), [lines]).agg(F.sum("n")).first()[0]
    t.lines().where(~half).select("l_orderkey").write.mode("append").parquet(lines)
    if first != kept:
        raise ValueError("built anew though no input changed")
    return sinks.cached_from(t.spark, path, build, [lines]).agg(F.sum("n").alias("n"), F.count("*").alias("orders"))


@query("src11_newest_file", "select n_nationkey as k, n_name as name from nation")
def _(t):
    """The first candidate that is there, else the newest file of a pattern."""
    base = _folder(t)
    t("region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")).coalesce(1).write.parquet(f"{base}/a")
    t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).coalesce(1).write.parquet(f"{base}/b")
    return t.spark.read.parquet(readers.found(t.spark, [f"{base}/c/part-*.parquet"], f"{base}/*/part-*.parquet"))


@query("src17_event_versions", """with e as (select user_id as k, event_type as version, count(*)::bigint as n, list(distinct (json_extract(props, '$.k')::bigint % 5)::varchar order by (json_extract(props, '$.k')::bigint % 5)::varchar) as items from events group by all)
select k, version, array_to_string(items, ' | ') as items, items[1] as first, n::varchar as value from e""")
def _(t):
    """Objects of users with an array and a map of versions, made from the events, written as JSON lines and flattened."""
    path = _folder(t)
    each = t("events").groupBy(F.col("user_id").alias("k"), "event_type").agg(F.count("*").alias("n"), F.array_sort(F.collect_set((F.get_json_object("props", "$.k").cast("long") % 5).cast("string"))).alias("items"))
    whole = each.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("n", "items")))).alias("v"))
    whole.select(F.to_json(F.struct("k", "v")).alias("value")).write.text(path)
    df = flatten.parsed(t.spark.read.text(path), "value", "k long, v map<string, struct<n: long, items: array<string>>>").select("j.k", "j.v")
    df = df.select("k", F.explode("v").alias("version", "x"))
    return df.select("k", "version", flatten.joined(F.col("x.items")).alias("items"), flatten.first(F.col("x.items")).alias("first"), F.col("x.n").cast("string").alias("value"))


@query("src04_drifting_headers", "select n_nationkey::varchar as code, n_name as name from nation union all select r_regionkey::varchar, r_name from region")
def _(t):
    a, b = _folder(t), _folder(t)
    t("nation").select(F.col("n_nationkey").alias("The Code"), F.col("n_name").alias("NAME")).write.csv(a, header=True)
    t("region").select(F.col("r_name").alias("Name"), F.col("r_regionkey").alias("code")).write.csv(b, header=True)
    return readers.drifting(t.spark, [a, b], {"code": ["the code"], "name": []})


@query("src05_spreadsheet", "select n_name || ' & <co>' as name, n_nationkey::varchar as k, ('1899-12-30'::date + (n_nationkey + 40000)::int)::varchar as day from nation where n_nationkey > 1")
def _(t):
    path = _folder(t) + ".xlsx"
    rows = t("nation").orderBy("n_nationkey").select(F.concat("n_name", F.lit(" & <co>")).alias("name"), F.col("n_nationkey").alias("k"), (F.col("n_nationkey") + 40000).alias("day"))
    sheets.write_sheet(rows, path)
    df = sheets.spreadsheet(t.spark, path, ["name", "k", "day"], skip=3)  # the header and two rows
    return df.withColumn("day", sheets.from_serial(F.col("day")).cast("string"))


@query("snk04_formatted_sheet", "select r_name as \"Name\", r_regionkey::varchar as \"Key\", null::varchar as \"Other\" from region")
def _(t):
    path = _folder(t) + ".xlsx"
    sheets.write_sheet(t("region").select(F.col("r_regionkey").alias("Key"), F.col("r_name").alias("Name")), path)
    return sheets.spreadsheet(t.spark, path, ["Name", "Key", "Other"], header=True)


@query("src08_ragged", "select n_name as name, n_nationkey::varchar as k from nation where n_nationkey % 5 <> 0")
def _(t):
    path = _folder(t)
    line = F.when(F.col("n_nationkey") % 5 == 0, F.col("n_name")).otherwise(F.concat_ws("\t", "n_name", "n_nationkey", F.lit("")))
    t("nation").select(line.alias("value")).write.text(path)
    return readers.ragged(t.spark, path, ["name", "k"])


@query("src09_pruned_scan", "select o_custkey as k, count(*)::bigint as n from orders where o_totalprice > 100000 group by all")
def _(t):
    return t("orders").where("o_totalprice > 100000").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))


@query("src10_footer_schema", """select * from (values ('l_orderkey', 'bigint'), ('l_partkey', 'bigint'), ('l_suppkey', 'bigint'), ('l_linenumber', 'int'), ('l_quantity', 'double'), ('l_extendedprice', 'double'), ('l_discount', 'double'),
('l_tax', 'double'), ('l_returnflag', 'string'), ('l_linestatus', 'string'), ('l_shipdate', 'timestamp_ntz')) x(name, type)""")
def _(t):
    s = readers.table_schema(t.spark, f"{t.dir}/lineitem.parquet")
    return t.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in s], "name string, type string")


@query("src17_json_flatten", "select event_id as k, json_extract(props, '$.k')::bigint as v from events")
def _(t):
    return flatten.parsed(t("events"), "props", "k long").select(F.col("event_id").alias("k"), F.col("j.k").alias("v"))


@query("src17_arrays_and_versions", "select * from (values (1, 'a | b', 'a', '1', 'x', '1970-01-01 00:00:01'), (1, 'a | b', 'a', '2', 'y', '1970-01-01 00:00:01'), (2, '', null, '1', 'z', null)) v(k, items, first, version, value, stamp)")
def _(t):
    df = t.spark.createDataFrame(
        [(1, '{"items": ["a", "b"], "v": {"1": "x", "2": "y"}, "ms": 1000}'), (2, '{"items": [], "v": {"1": "z"}}')], "k int, s string"
    )
    df = flatten.parsed(df, "s", "items array<string>, v map<string,string>, ms long")
    df = df.select("k", flatten.joined(F.col("j.items")).alias("items"), flatten.first(F.col("j.items")).alias("first"), F.col("j.v").alias("v"), F.date_format(flatten.from_epoch_ms(F.col("j.ms")), "yyyy-MM-dd HH:mm:ss").alias("stamp"))
    return flatten.versions(df, "v", "k", "items", "first", "stamp")


@query("snk01_parquet_round_trip", "select part, ym, qty from pm")
def _(t):
    path = _folder(t)
    sinks.table(t.part_month().select("part", "ym", "qty"), path)
    return t.spark.read.parquet(path)


@query("snk02_csv_report", "select r_regionkey::varchar as k, r_name as name from region")
def _(t):
    path = _folder(t)
    sinks.report(t("region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), path)
    return t.spark.read.csv(path, header=True)


@query("snk06_empty_typed", "select o_orderkey as k, null::varchar as note, null::bigint as n from orders")
def _(t):
    """A family whose source is missing: its typed columns beside the orders, all null."""
    from pyspark.sql import types as T

    none = readers.empty(t.spark, T.StructType([T.StructField("k", T.LongType()), T.StructField("note", T.StringType()), T.StructField("n", T.LongType())]))
    return t("orders").select(F.col("o_orderkey").alias("k")).join(none, "k", "left")


@query("ext_stream_windows", "select date_trunc('day', ts)::timestamp as start, event_type, count(*)::bigint as n, sum(round(value * 100)::bigint)::bigint as cents from events group by all")
def _(t):
    return E.windowed_counts(t("events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
