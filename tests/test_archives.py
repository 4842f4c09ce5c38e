"""Archive members as streamed partitions, the fallback of the paged source, links, and tables kept by their inputs."""

import io
import json
import threading
import time
import tracemalloc
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from monthloom.sources import archives, rest, sinks

RECORDS = [{"id": i, "text": 'a "quoted\\ [brace}' * (i % 3), "more": [{"results": [i]}]} for i in range(300)]


def zipped(members: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


BULK = zipped({"notes.txt": "x", "part-1.json": json.dumps({"meta": {"results": {"total": 300}}, "results": RECORDS[:200]}), "part-2.json": json.dumps(RECORDS[200:], indent=1)})


class Service(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def do_GET(self):
        if "broken" in self.path and "skip=0" not in self.path:
            return self.send_error(500)
        body = BULK if "bulk" in self.path else json.dumps({"results": RECORDS[:10] if "broken" in self.path or "good" in self.path and "skip=0" in self.path else []}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)


@pytest.fixture(scope="module")
def url():
    s = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def ids(df):
    return sorted(json.loads(r["record"])["id"] for r in df.collect())


def test_fallback_to_archive(spark, url):
    page = {"limit": "10", "wait": "0"}
    bulk = {"path": f"{url}/bulk.zip", "members": ".json"}
    read = lambda kind: archives.paged_or_archive(spark, page | {"url": url + f"/{kind}?skip={{skip}}&limit={{limit}}"}, bulk)
    assert ids(read("good")) == list(range(10))
    assert ids(read("broken")) == list(range(300))  # not the ten of the first page and the archive's
    assert ids(read("empty")) == list(range(300))
    assert spark.read.format("archived_json").options(**bulk).load().rdd.getNumPartitions() == 2
    with pytest.raises(Exception, match="no member"):
        spark.read.format("archived_json").options(path=bulk["path"], members="csv", first="true").load().collect()


@pytest.mark.parametrize("text,key,want", [
    (json.dumps({"a": {"results": [{"n": 1}]}, "results": RECORDS, "z": [{"n": 2}]}), "results", RECORDS),
    (json.dumps(RECORDS), "results", RECORDS),
    (json.dumps({"drugs": RECORDS[:3], "results": [{}]}), "drugs", RECORDS[:3]),
    ("{}", "results", []), ("", "results", []), ('{"results": [1, "x", [{"n": 3}], {"n": 4}]}', "results", [{"n": 4}]),
])
def test_records_of_arrays(text, key, want):
    for step in (1, 3, 1000, 10**7):
        got = archives.json_records((text.encode()[i : i + step] for i in range(0, len(text.encode()), step)), key)
        assert [json.loads(x) for x in got] == want


def test_members_are_streamed(tmp_path):
    """A member of 60 MB passes through a few MB of memory."""
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("big.json", "w", force_zip64=True) as f:
        f.write(b'{"results": [')
        for i in range(6000):
            f.write((b"," if i else b"") + json.dumps({"id": i, "text": "x" * 10_000}).encode())
        f.write(b"]}")
    reader = archives.JsonReader({"path": str(tmp_path / "big.zip")})
    (member,) = reader.partitions()
    tracemalloc.start()
    n = sum(1 for _ in reader.read(member))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 6000 and peak < 5_000_000


def test_ragged_members(spark, tmp_path):
    lines = ["Firm Name \tCity\tFEI", "Café “A”\tRome\t1\t", "short\tline", "B\tOslo\t2\textra\t", "\t\t", "C\t\t3"]
    (tmp_path / "places.zip").write_bytes(zipped({"readme.doc": "x", "list.txt": "\r\n".join(lines).encode("cp1252")}))
    archives.register(spark)
    df = spark.read.format("archived_lines").schema("fei string, firm_name string, phone string").options(path=str(tmp_path / "places.zip"), members=".txt", first="true").load()
    assert sorted(map(tuple, df.collect()), key=str) == [("1", "Café “A”", None), ("2", "B", None), ("3", "C", None)]


def test_links():
    at = "http://x/a?ids=1,2,3"
    for link in (f'<{at}>; rel="next"', f'<http://x/0>; rel="prev", <{at}>; title="a, <b>"; rel="last next"', f"<http://x/p>;rel=prev,<{at}>; rel=next", f"<{at}>; rel='next'"):
        assert rest.next_page(link) == at
    for link in (None, "", '<http://x>; rel="prev"', '<http://x>; title="next"', "nonsense"):
        assert rest.next_page(link) is None


def test_kept_by_inputs(spark, tmp_path):
    inputs, path, built = str(tmp_path / "in"), str(tmp_path / "out"), []
    spark.range(5).write.parquet(inputs)

    def build():
        built.append(1)
        return spark.read.parquet(inputs)

    read = lambda: sinks.cached_from(spark, path, build, [inputs, str(tmp_path / "none*")]).count()
    assert read() == 5 and read() == 5 and len(built) == 1
    spark.range(3).write.mode("append").parquet(inputs)
    assert read() == 8 and len(built) == 2
    time.sleep(1.1)
    part = next(p for p in (tmp_path / "in").glob("part-*"))
    part.touch()  # as long as before, but newer
    for crc in (tmp_path / "in").glob(".*.crc"):
        crc.touch()
    assert read() == 8 and len(built) == 3 and read() == 8 and len(built) == 3
    assert spark.read.parquet(path).agg(F.max("id")).first()[0] == 4
