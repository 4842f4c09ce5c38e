"""Periodic runs, archives and hard negatives against brute force, and their edges."""

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthloom.llm import op12_warc as W
from monthloom.llm.common import Scratch
from monthloom.llm.op11_periodic import collapse, op11_periodic, periodic_runs, runs_of, stretch_runs
from monthloom.llm.op13_negatives import hard_negatives

DIR = "/root/testdata/sf0.001"


def brute_runs(words, least=12):
    """By the definition: each period by itself, smallest periods first."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        i = 0
        while i < len(same):
            j = i
            while same[j]:
                j += 1
            if j - i >= q and j - i + q >= least:
                s, e = i, j + q
                if not any(q % p == 0 and a <= s and e <= a + m for a, m, p in out):
                    out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        words = [rng.choice("ab" if seed < 3 else "abcdefgh").encode() for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):
            at, q = rng.randrange(len(words) + 1), rng.randrange(1, 12)
            words[at:at] = [rng.choice("abcdefgh").encode() for _ in range(q)] * rng.randrange(2, 6)
        for least in (2, 5, 12):
            want = brute_runs(words, least)
            assert runs_of(words, least) == want
            got = [(s, e - s, q) for s, e, q in stretch_runs([w[0] for w in words], least)]
            assert sorted(got, key=lambda r: (r[0], r[2])) == want  # without leaving out any stretch first
        assert collapse(words, brute_runs(words)).decode() == brute_collapse([w.decode() for w in words], brute_runs(words))


def test_runs_of_large_texts():
    assert runs_of([b"x"] * 30_000) == [(0, 30_000, 1)]
    fib = [b"a"], [b"a", b"b"]
    while len(fib[1]) < 1500:
        fib = fib[1], fib[1] + fib[0]
    assert runs_of(fib[1]) == brute_runs(fib[1])
    line = [str(i).encode() for i in range(20)]
    far = [w for i in range(40) for w in [*line, *(f"{i}-{j}".encode() for j in range(30))]]
    assert runs_of(far) == []  # repeated lines far apart are no run


def test_periodic_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op11_periodic(spark, DIR).collect()}
    assert set(got) == set(docs)
    some = 0
    for i, text in docs.items():
        words = text.encode().split() if text else []
        n, h = len(words), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        if len(words) > 1500:
            runs = runs_of(words)
            some += 1
        else:
            runs = brute_runs(words)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        r = got[i]
        assert r["n_runs"] == len(runs) and (r["start"], r["length"], r["period"]) == top
        assert r["exponent_milli"] == (top[1] * 1000 // top[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(brute_collapse([w.decode() for w in words], runs).encode()).hexdigest()
    assert some < len(docs) / 10


def test_periodic_edges(spark):
    rows = [(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "  a\n" * 7, None), (3, "a b " * 6 + "c", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r["doc_id"], r["runs"], r["periodic"]) for r in periodic_runs(df).collect()), key=lambda r: str(r[0]))
    assert [g[1] for g in got].count("x") == 4
    empty = [g[2] for g in got if g[0] in (None, 1)]
    assert all((e["n_words"], e["runs"], e["collapsed"]) == (0, [], "") for e in empty) and len(empty) == 3
    assert [tuple(r) for r in got[2][2]["runs"]] == [(0, 14, 2)] and got[2][2]["collapsed"] == "  a"  # a no-break space is a word
    assert [tuple(r) for r in got[3][2]["runs"]] if len(got) == 4 else True
    assert got[-2][2]["collapsed"] == "a b c" or got[3][2]["collapsed"] == "a b c"
    assert periodic_runs(df.limit(0)).count() == 0


def pages(spark):
    big = "".join(chr(97 + i % 26) + ("\r\n" if i % 1000 == 7 else "") for i in range(200_000))
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (5, None, "same"), (3, "u\r\nX: y", None), (4, "http://c", ""), (6, "http://d", big),
            (7, "http://e", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (8, "f", "ü" * 50_000), (None, "g", "same"), (9, "h", "\n"), (None, "i", "alone")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def archive(spark, df, segment_bytes):
    scratch = Scratch(spark)
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    path = scratch.path()
    marked = W.with_revisits(df, "page_id", "html", scratch)
    W.write_warc(W.warc_rows(marked, name("page_id"), "html", F.col("url"), name("refers_to"), F.lit("2024-01-01T00:00:00Z"), segment_bytes), path)
    return path, scratch


@pytest.mark.parametrize("segment_bytes", [100, 1 << 16])
def test_archives_round_trip(spark, segment_bytes):
    df = pages(spark)
    path, scratch = archive(spark, df, segment_bytes)
    chunks = W.read_chunks(spark, path, chunk_bytes=50_000).cache()
    html = {f"urn:page:{r[0] if r[0] is not None else ''}|{r[1]}": (r[2] or "").encode() for r in df.select("page_id", F.regexp_replace("url", r"[\r\n]+", " "), "html").collect()}
    whole = {}
    for r in sorted(chunks.collect(), key=lambda r: r["chunk_no"]):
        key = f"{r['record_id']}|{r['uri']}"
        whole[key] = whole.get(key, b"") + r["chunk"]
        assert r["bytes_so_far"] == len(whole[key]) and r["digest_so_far"] == base64.b32encode(hashlib.sha1(whole[key]).digest()).decode()
        assert r["complete"] == r["last"] or not r["last"]
    revisits = {k for k in html if html[k] == b"same" and "urn:page:5|" not in k} | {k for k in html if "urn:page:3|" in k}
    assert whole == {k: b"" if k in revisits else v for k, v in html.items()}
    assert chunks.where("chunk_no > 2").count() > 0  # the long payload came in pieces
    got = {(r["record_id"], r["uri"]): r for r in W.records(chunks, scratch).collect()}
    assert len(got) == df.count()
    for (i, u), r in got.items():
        v = html[f"{i}|{u}"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(v), base64.b32encode(hashlib.sha1(v).digest()).decode())
        assert r["complete"] and (r["record_type"] == "revisit") == (f"{i}|{u}" in revisits)
    assert {r["refers_to"] for r in got.values()} == {None, "urn:page:5", "urn:page:4"}


def test_archives_are_warc(spark, tmp_path):
    """Read by a plain parser of the format: lengths lead from record to record."""
    path, _ = archive(spark, pages(spark).coalesce(1), 100_000)
    import glob

    kinds = []
    for f in glob.glob(f"{path}/*.gz"):
        data = gzip.open(f).read()
        while data:
            head, data = data.split(b"\r\n\r\n", 1)
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            n = int(fields["Content-Length"])
            assert data[n : n + 4] == b"\r\n\r\n"
            kinds.append((fields["WARC-Type"], fields.get("WARC-Segment-Number"), "WARC-Segment-Total-Length" in fields))
            data = data[n + 4 :]
    assert kinds.count(("response", "1", False)) == 2 and kinds.count(("continuation", "3", True)) == 1 and kinds.count(("continuation", "2", True)) == 1
    assert sum(k[0] == "revisit" for k in kinds) == 4


def test_foreign_and_broken_archives(spark, tmp_path):
    body = bytes(range(256)) * 3
    rec = lambda t, i, block, extra=b"": b"WARC/1.0\r\nWARC-Type: " + t + b"\r\nWARC-Record-ID: <" + i + b">\r\n" + extra + b"Content-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    data = rec(b"warcinfo", b"urn:1", b"software: x\r\n") + rec(b"resource", b"urn:2", body) + rec(b"revisit", b"urn:3", b"", b"WARC-Refers-To: <urn:gone>\r\nWARC-Payload-Digest: sha1:ABC\r\n")
    data += rec(b"resource", b"urn:4", b"y" * 100)[:-60]
    with open(tmp_path / "x.warc.gz", "wb") as f:
        f.write(gzip.compress(data[:500]) + gzip.compress(data[500:]))  # members of their own
    scratch = Scratch(spark)
    chunks = W.read_chunks(spark, str(tmp_path), chunk_bytes=300)
    rows = {}
    for r in sorted(chunks.collect(), key=lambda r: r["chunk_no"]):
        rows[r["record_id"]] = rows.get(r["record_id"], b"") + r["chunk"]
    assert rows["urn:1"] == b"software: x\r\n" and rows["urn:2"] == body
    got = {r["record_id"]: r for r in W.records(chunks, scratch).collect()}
    assert got["urn:3"]["payload_bytes"] is None and got["urn:3"]["payload_digest"] == "ABC"
    assert not got["urn:4"]["complete"] and got["urn:2"]["complete"]


def test_archive_edges(spark):
    none = pages(spark).limit(0)
    path, scratch = archive(spark, none, 100)
    assert W.records(W.read_chunks(spark, path), scratch).count() == 0
    twice = spark.createDataFrame([(1, "a", "p", 7), (1, "a", "p", 8)], "page_id long, url string, html string, refers_to int")
    assert [r["record_type"] for r in W.with_revisits(twice, "page_id", "html", scratch).collect()] == ["response"] * 2
    small = W.with_revisits(pages(spark), "page_id", "html", scratch, least_bytes=5)
    assert small.where("record_type = 'revisit'").count() == 0


def brute_negatives(rows, is_anchor, k=5):
    q = {i: ([int(np.floor(float(x) * 256)) for x in v], lab) for i, v, lab in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a in filter(is_anchor, q):
        s = {b: dot(q[a][0], q[b][0]) for b in q if b != a}
        for p in sorted((b for b in s if q[b][1] == q[a][1]), key=lambda b: (-s[b], b))[:k]:
            negs = [b for b in s if q[b][1] != q[a][1] and 80 * s[p] <= 100 * s[b] <= 100 * s[p]]
            for r, b in enumerate(sorted(negs, key=lambda b: (-s[b], b))[:k], 1):
                out.add((a, p, r, b, s[p], s[b]))
    return out


def vectors(seed, n, scale, spread, labels=3):
    rng = np.random.default_rng(seed)
    norm = np.exp(rng.normal(0, spread, n)) * scale
    v = rng.normal(size=(n, 6)) + 1.0
    v = v / np.linalg.norm(v, axis=1, keepdims=True) * norm[:, None]
    rows = [(i, [float(x) for x in np.float32(v[i])], int(rng.integers(labels))) for i in range(n)]
    return rows + [(n + i, rows[3][1], i % 2) for i in range(40)]  # many equal vectors


@pytest.mark.parametrize("scale,spread", [(1, 0.0), (1, 1.0), (1e5, 0.5)])
def test_negatives_equal_brute_force(spark, monkeypatch, scale, spread):
    from monthloom.llm import op13_negatives as N

    rows = vectors(1, 400, scale, spread)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute_negatives(rows, lambda i: i % 20 == 0)
    assert len(want) > 100
    assert {tuple(r) for r in hard_negatives(df, lambda i: i % 20 == 0).collect()} == want
    # with blocks of anchors, several buckets of norms and small parts
    monkeypatch.setattr(N, "ANCHORS", 7)
    monkeypatch.setattr(N, "CELLS", 100)
    monkeypatch.setattr(N, "PART_NUMBERS", 1)
    monkeypatch.setattr(N, "ROWS_A_BUCKET", 30)
    assert {tuple(r) for r in hard_negatives(df, lambda i: i % 20 == 0).collect()} == want


def test_negative_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, score string, rank int"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.4], 1), (2, [0.9, 0.5], 2), (3, [nan, 1.0], 2), (4, [inf, 1.0], 2), (5, None, 2), (6, [1.0, None], 2), (7, [0.9, 0.5], None), (None, [0.9, 0.5], 2),
            (8, [0.9, 0.5], 2), (8, [0.9, 0.5], 3), (9, [0.95], 2), (10, [], 2), (11, [1e30, 1e30], 2), (12, [-1.0, -1.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    good = [r for r in rows if r[0] in (0, 1, 2, 9, 12)] + [(8, [0.9, 0.5], 2), (10, [], 2)]
    pad = [(i, (v + [0.0, 0.0])[:2], lab) for i, v, lab in good]
    got = {tuple(r) for r in hard_negatives(df, lambda i: i % 100 == 0).collect()}
    assert got == brute_negatives(pad, lambda i: i == 0) and got
    assert hard_negatives(df.limit(0), lambda i: i % 100 == 0).count() == 0
    assert hard_negatives(df, lambda i: i < 0).count() == 0
    assert hard_negatives(df.where("vec_id = 0"), lambda i: i == 0).count() == 0


def clustered(seed, clusters, size, inside, planted, d=64):
    """Vectors around cluster centres with this mutual cosine, and pairs at 0.935 to 0.95 among them."""
    r = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(r.standard_normal((clusters, d)))
    x = unit(np.sqrt(inside) * np.repeat(centre, size, 0) + np.sqrt(1 - inside) * unit(r.standard_normal((clusters * size, d))))
    pairs = r.choice(len(x), planted, replace=False)
    cosine = r.uniform(0.935, 0.95, planted)[:, None]
    side = r.standard_normal((planted, d))
    side = unit(side - (side * x[pairs]).sum(1, keepdims=True) * x[pairs])
    twin = cosine * x[pairs] + np.sqrt(1 - cosine**2) * side
    return np.concatenate([x, twin]), [(int(p), len(x) + i) for i, p in enumerate(pairs)]


@pytest.mark.parametrize("clusters,size,inside", [(4, 2500, 0.85), (20, 400, 0.9)])
def test_recall_in_clusters(spark, clusters, size, inside):
    from monthloom.llm.op03_vectors import near_vectors

    x, pairs = clustered(clusters, clusters, size, inside, 300)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    found = {r["vec_id"]: r["component_id"] for r in near_vectors(df).collect()}
    assert sum(found[a] == found[b] for a, b in pairs) / len(pairs) >= 0.95


def test_whole_labels_equal_brute_force(spark, monkeypatch):
    """A label that asks for too many orders is compared whole: no link is lost at all."""
    from monthloom.llm import op03_vectors as o3

    monkeypatch.setattr(o3, "MANY_PASSES", 0)
    monkeypatch.setattr(o3, "PART", 100)
    x, _ = clustered(5, 3, 150, 0.9, 60, 8)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in o3.near_vectors(spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    link = (x @ x.T >= 0.93) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2) & ~np.eye(len(x), dtype=bool)
    least = np.arange(len(x))
    while True:
        now = np.minimum(least, np.where(link, least[None, :], len(x)).min(1))
        if (now == least).all():
            break
        least = now
    assert got == {i: (int(link[i].sum()), int(least[i])) for i in range(len(x))} and link.sum() > 500


def test_near_copies_ask_for_no_more_orders():
    """A large group of near copies is dense, but its members meet anyway; only vectors that are not linked count."""
    import pandas as pd

    from monthloom.llm.op03_vectors import _first_keys, _needed_bits

    copies, _ = clustered(1, 1, 600, 0.99, 2)
    loose, _ = clustered(2, 1, 400, 0.85, 2)
    for x, dense in ((copies, False), (loose, True)):
        df = pd.DataFrame({"node": [str(i) for i in range(len(x))], "label": "a", "dim": x.shape[1], "vector": list(x)})
        keys = pd.concat(_first_keys(iter([df]))).sort_values("h", ignore_index=True)
        bits = pd.concat(_needed_bits(100, 0.93)(iter([keys])))
        each = np.repeat(bits["bits"], bits["n"])
        assert len(each) == len(x) - 100 and (np.quantile(each, 0.98) > 0) == dense
