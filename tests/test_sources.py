"""Web sources against a server on this machine, zipped exports, fuzzy matching against brute force, gates."""

import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from monthloom.functions import fuzzy
from monthloom.operators import joins as J
from monthloom.operators import tables as A
from monthloom.sources import readers, rest

DAYS = [f"202101{d:02d}" for d in range(1, 31)]
RECORDS = [{"id": i, "day": DAYS[i % 30]} for i in range(95)]


class Service(BaseHTTPRequestHandler):
    busy = set()

    def log_message(self, *args):
        pass

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        if self.path not in Service.busy and "flaky" in self.path:
            Service.busy.add(self.path)
            return self.send_error(503)
        if "missing" in self.path:
            return self.send_error(404)
        link, body = None, {}
        if "count" in self.path:
            body = {"results": [{"term": "x", "count": int(q["start"][4:6])}]}
        else:
            rows = [r for r in RECORDS if q.get("start", "") <= r["day"] <= q.get("end", "9")]
            skip, limit = int(q.get("skip", 0)), int(q["limit"])
            body = {"meta": {"results": {"total": len(rows)}}, "results": rows[skip : skip + limit]}
            if skip + limit < len(rows):
                link = f'<http://127.0.0.1:{self.server.server_port}/c?limit={limit}&skip={skip + limit}>; rel="next"'
        self.send_response(200)
        if link:
            self.send_header("Link", link)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())


@pytest.fixture(scope="module")
def url():
    s = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def _ids(df):
    return sorted(json.loads(r["record"])["id"] for r in df.collect())


def test_paged(spark, url):
    spark.dataSource.register(rest.PagedSource)
    read = lambda **o: spark.read.format("paged_json").options(**{k: str(v) for k, v in o.items()}).load()
    page = "?start={start}&end={end}&skip={skip}&limit={limit}"
    spans = "20210101:20210110,20210111:20210130"
    assert _ids(read(url=f"{url}/p{page}", spans=spans, limit=10)) == list(range(95))
    assert _ids(read(url=f"{url}/flaky{page}", spans=spans, limit=10, most=7, wait=0)) == list(range(95))  # halves
    assert _ids(read(url=url + "/c?limit={limit}", cursor="true", limit=10)) == list(range(95))
    assert _ids(read(url=f"{url}/missing{page}", spans=spans)) == []
    with pytest.raises(Exception, match="records in one range"):
        read(url=f"{url}/p{page}", spans=spans, limit=10, most=2).collect()


def test_counted(spark, url):
    spark.dataSource.register(rest.CountedSource)
    df = spark.read.format("counted_json").options(url=url + "/count?start={start}&end={end}", first="2020-Q4", last="2021-Q2").load()
    assert sorted((str(r["month"]), r["term"], r["n"]) for r in df.collect()) == [("2020-11-01", "x", 10), ("2021-02-01", "x", 1), ("2021-05-01", "x", 4)]


def test_measured_export(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.csv", "Month,NDC 11,TRx Count,,Secret\n 2020-01 ,378-870006,12,x,1\n2020-02,00378870006,n/a,,2\n")
    df = readers.measured_export(spark, str(tmp_path / "a.zip"), "NDC 11", "Month", ["TRx Count", "", "Secret"], ["secret"])
    assert df.columns == ["year_month", "code_11", "code", "trx_count"]
    assert sorted(map(tuple, df.collect())) == [("2020-01", "00378870006", "00378-8700-06", 12.0), ("2020-02", "00378870006", "00378-8700-06", None)]
    assert readers.found(spark, [str(tmp_path / "no.zip"), str(tmp_path / "a.zip")], "") .endswith("a.zip")
    assert readers.found(spark, [], str(tmp_path / "*.zip")).endswith("a.zip") and readers.newest(spark, str(tmp_path / "*.xls")) is None


@pytest.mark.parametrize("scorer", ["sort", "set"])
def test_fuzzy_against_all_pairs(spark, scorer):
    import random

    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(40)]
    choices = sorted({" ".join(r.sample(words, r.randint(1, 3))) for _ in range(60)})
    names = set()
    for c in choices:
        x = list(c)
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(x))
            x[k : k + 1] = r.choice([[], ["z"], [x[k], "y"]]) or []
        names.add("".join(x))
    key = lambda s: " ".join(sorted(s.split()))
    score = fuzzy.set_ratio if scorer == "set" else fuzzy.ratio
    want = {}
    for n in names:
        best = max(((score(key(n), key(c)), c) for c in choices), key=lambda x: (x[0], [-ord(z) for z in x[1]] + [0]))
        want[n] = round(best[0], 6) if best[0] >= 85 else None
    df = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = {x["name"]: x["score"] and round(x["score"], 6) for x in J.fuzzy_best(df(names, "name"), df(choices, "choice"), "name", "choice", 85.0, scorer).collect()}
    assert got == want


def test_gate_fails(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 1, 1)], "k int, ym int, s int")
    with pytest.raises(ValueError, match="repeated keys.*too few months"):
        A.require_panel(df, ["k"], "ym", "s", least_entities=1)
