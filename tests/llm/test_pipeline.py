"""The pipeline against brute force on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline as p
from monthloom.llm.op01_mix import OP1_SQL
from monthloom.llm.op02_lines import OP2_SQL
from monthloom.llm.op05_quality import op5_quality
from tests.llm.test_operators import brute_near

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    out.append(docs)
    for i, (_, stage) in enumerate(p.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages(spark, stages):
    raw, good, lines, near, mixed, packed = stages
    for d in (good, lines, near, mixed):
        assert d.dtypes == raw.dtypes
    accepted = {r["doc_id"] for r in op5_quality(spark, DIR).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in good.collect()} == accepted
    documents = good.toPandas()  # noqa: F841
    want = Counter((r[0], r[3]) for r in duckdb.sql(OP2_SQL).fetchall())
    assert Counter((r["doc_id"], r["n_chars"]) for r in lines.collect()) == want
    rows = [(r["doc_id"], r["text"]) for r in lines.collect()]
    kept = {i for i, _, _, keep in brute_near(rows, p.NEAR_PERCENT) if keep}
    assert {r["doc_id"] for r in near.collect()} == kept
    documents = near.toPandas()  # noqa: F841
    want = {r[0]: r[4] // r[1] for r in duckdb.sql(OP1_SQL).fetchall() if r[4]}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(want)
    first = packed.where("piece = 0").groupBy("doc_id").count().collect()
    assert Counter({r["doc_id"]: r["count"] for r in first}) == Counter(want)
    full = packed.groupBy("sequence_id").agg({"length": "sum"}).toPandas()["sum(length)"]
    assert full.max() <= 2048


def test_run(spark, stages):
    assert Counter(map(tuple, p.run(spark, DIR).select("doc_id", "piece", "length", "ids_crc32").collect())) == Counter(
        map(tuple, stages[-1].select("doc_id", "piece", "length", "ids_crc32").collect())
    )
