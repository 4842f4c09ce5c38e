"""Faults that small tables show: rows that share an id, hot keys, labels and numbers at the edge, clashing columns."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as p
from monthloom.llm import common
from monthloom.llm import op03_vectors as o3
from monthloom.llm import op04_shard as o4
from monthloom.llm import op08_minhash as o8
from monthloom.llm import op09_fingerprint as o9
from monthloom.llm import op10_pack as o10
from tests.llm.test_operators import ROWS, SCHEMA, TEXTS, brute_near, near, words

A, B = words(80, 61), words(80, 62)


def test_one_row_of_each_group_stays(spark):
    rows = [(1, A, "x"), (3, A, "y"), (3, B, "z"), (None, B, "n"), (None, words(60, 63), "n1"), (None, words(60, 63), "n2"), (5, near(A, 40), "e")]
    rows += [(7, None, "0"), (7, "", "1"), (7, "", "2"), (9, words(70, 64), "r"), (9, words(70, 64), "r"), (8, words(70, 64), "s")]
    got = o8.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, `a.b` string"), 80).collect()
    assert Counter((r[0], r[2]) for r in got if r[2] not in ("n1", "n2")) == Counter([(1, "x"), (3, "z"), (7, "0"), (7, "1"), (7, "2"), (8, "s")])
    assert sum(r[2] in ("n1", "n2") for r in got) == 1
    again = [(4, A, "x")] * 5
    assert o8.drop_near_duplicates(spark.createDataFrame(again, "doc_id long, text string, k string")).count() == 1


def test_hot_keys_in_near_dedup(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 1)
    monkeypatch.setattr(common, "partitions", lambda spark: 1)
    got = o8.near_duplicates(spark.createDataFrame(ROWS, SCHEMA))
    assert Counter(map(tuple, got.collect())) == brute_near(ROWS, 85)


CLASH = ["size", "target", "taken", "source_size", "kept_text", "n_lines", "n_removed", "copy", "text_key", "stays", "a.b", "__c0", "__copy", "label"]


@pytest.mark.parametrize("stage", [k for k, _ in p.STAGES[:-1]])
def test_stage_carries_columns(spark, stage):
    """Nulls, empty and long texts, repeated rows and clashing names in each stage; then an empty table."""
    sf = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    rows = [(i, t, "en", f"s{i % 12}", len(t or ""), *[f"{c}{i}" for c in CLASH]) for i, t in enumerate(TEXTS)]
    rows += [rows[8], rows[8], (None, None, None, None, None, *[None] * len(CLASH)), (None, A, None, None, None, *[None] * len(CLASH))]
    docs = spark.createDataFrame(rows, schema)
    out = dict(p.STAGES)[stage](spark, docs, sf)
    assert out.columns == docs.columns
    known = {(r[0], *r[5:]) for r in rows}
    got = out.collect()
    assert got and all((r[0], *r[5:]) in known for r in got)
    if stage == "line dedup":
        assert len(got) == len(rows)
    if stage == "near dedup":
        want = brute_near([(r[0], r[1]) for r in rows], 80)
        assert {r[0] for r in got if r[0] is not None} == {k[0] for k in want if k[3] and k[0] is not None}
    if stage == "mix":
        assert all(r["text"] and r["text"].split() for r in got)
    empty = dict(p.STAGES)[stage](spark, docs.where("false"), sf)
    assert empty.columns == docs.columns and empty.count() == 0


def test_pack_stage_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (None, "a b"), (1, "")], "doc_id long, text string")
    assert sorted(r["length"] for r in p.pack(spark, docs, "").collect()) == [1, 1, 3]
    assert p.pack(spark, docs.where("false"), "").count() == 0


def brute_vectors(rows):
    """(id, links, component) of rows (id, vector, label), in double precision after scaling."""
    unit = []
    for _, v, _ in rows:
        x = np.array(v, "f8") / np.abs(v).max()
        unit.append(x / np.sqrt(x @ x))
    link = defaultdict(set)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j and a[2] == b[2] and len(a[1]) == len(b[1]) and unit[i] @ unit[j] >= 0.93:
                link[i].add(j)
    for i, x in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += [k for k in link[todo.pop()] if k not in seen and not seen.add(k)]
        yield x[0], len(link[i]), min(rows[k][0] for k in seen)


def test_vectors_at_the_edge(spark):
    rows = [(0, [1.0, 2.0], "x"), (1, [2.0], "x,1.0"), (2, [1e200, 1.01e200], "big"), (3, [1e200, 1e200], "big"), (4, [1e-200, 1e-200], "big"), (5, [5e-324, 0.0], "big"), (6, [1.0, 0.0], "big")]
    got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in o3.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == set(brute_vectors(rows))


def test_vectors_through_blocks_and_parts(spark, monkeypatch):
    """Windows and blocks of a few rows, components of several parts; the planted pairs of each order are found."""
    monkeypatch.setattr(o3, "WINDOW", 8)
    monkeypatch.setattr(o3, "BLOCK", 16)
    monkeypatch.setattr(o3, "PART", 5)
    monkeypatch.setattr(common, "HEAVY", 2)
    r = np.random.default_rng(5)
    base = r.standard_normal((100, 16))
    rows = [(i, list(map(float, x)), "a") for i, x in enumerate(base)]
    rows += [(200 + i, list(map(float, base[i % 10] + 0.1 * r.standard_normal(16))), "a") for i in range(120)]
    rows += [(400 + i, list(map(float, x)), "b") for i, x in enumerate(base[:20])]
    got = {(x["vec_id"], x["n_links"], x["component_id"]) for x in o3.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    want = set(brute_vectors(rows))
    assert len(got & want) >= 0.98 * len(want)


def test_recall_of_lone_pairs(spark):
    """4,000 vectors of one label with 150 pairs at cosine 0.93 to 0.95, isotropic and around one direction."""
    r = np.random.default_rng(6)
    for lean in (0.0, 1.0):
        x = r.standard_normal((4000, 24)) + lean
        y = x[:150] / np.linalg.norm(x[:150], axis=1, keepdims=True)
        z = r.standard_normal(y.shape)
        z -= (z * y).sum(1, keepdims=True) * y
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        c = r.uniform(0.931, 0.95, (150, 1))
        pairs = c * y + np.sqrt(1 - c * c) * z
        rows = [(i, list(map(float, v)), 0) for i, v in enumerate(np.concatenate([x, pairs]))]
        got = o3.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).where("vec_id >= 4000").collect()
        assert np.mean([r_["component_id"] <= r_["vec_id"] - 4000 for r_ in got]) >= 0.95


def brute_shards(rows, shards, place):
    """Shard of each row: whole groups of equal texts by their middle, or rows where a group is too large, in key order."""
    total = sum(s for *_, s in rows)
    share, out, at, i = total / shards, [], 0, 0
    rows = sorted(rows, key=place)
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][0] == rows[i][0]:
            j += 1
        size = sum(r[-1] for r in rows[i:j])
        for r in rows[i:j]:
            middle = at + size / 2 if size <= o4.GROUP_SHARE * share else None
            out.append((r, middle))
        at, i = at + size, j
    done, at = [], 0
    for r, middle in out:
        at += r[-1]
        done.append((*r[:2], min(shards - 1, int((middle if middle is not None else at - r[-1] / 2) // share))))
    return Counter(done)


def test_shards_against_brute_force(spark, monkeypatch):
    """Shards of all rows, with hot groups and ranges that must be divided."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(o4, "MIN_RANGES", 4)
    df = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot text' when id % 50 < 5 then concat('group ', id % 50) else repeat('y', cast(id % 83 as int)) || id end as text")
    text = F.coalesce("text", F.lit(""))
    keys = df.select("doc_id", F.xxhash64(text).alias("h"), F.xxhash64("doc_id", text, F.lit("id")).alias("d"), (F.octet_length(text) + 1).alias("s"))
    rows = [(r["h"], r["doc_id"], r["d"], r["s"]) for r in keys.collect()]
    hashes = {r[1]: r[0] for r in rows}
    got = Counter((hashes[r["doc_id"]], r["doc_id"], r["shard"]) for r in o4.shard_by_splitters(df, 16).collect())
    assert got == brute_shards(rows, 16, lambda r: (r[0], r[2]))


def test_fingerprint_ranges(spark, monkeypatch):
    """More than one range, also of string ids; next documents cross range edges."""
    import hashlib

    monkeypatch.setattr(o9, "ROWS_PER_RANGE", 4)
    texts = [words(30 + i, 800 + i) for i in range(40)] + ["", None, "short"]
    for name in (lambda i: i, lambda i: f"id{i:03d}"):
        rows = [(name(i), t) for i, t in enumerate(texts)]
        kind = "long" if isinstance(rows[0][0], int) else "string"
        got = o9.fingerprint_edits(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect()
        order = sorted(rows, key=lambda r: r[0], reverse=True)
        full = [t or "" for _, t in order]
        prints = o9.fingerprints([t.encode() for t in full])
        for i, (k, _) in enumerate(order):
            t, after = full[i], full[(i + 1) % len(full)]
            e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            r = next(x for x in got if x["doc_id"] == k)
            edited = o9.fingerprints([e.encode()])
            assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
            assert r["fingerprint"] == prints[i].astype(">u2").tobytes().hex() and r["edited_fingerprint"] == edited[0].astype(">u2").tobytes().hex()
            assert r["near_edited"] == o9.likeness(prints[i : i + 1], edited)[0]
            assert r["near_next"] == o9.likeness(prints[i : i + 1], prints[[(i + 1) % len(full)]])[0]


def test_pack_with_divided_lengths(spark, monkeypatch):
    monkeypatch.setattr(o10, "RANKED", 5)
    rows = [(i, "one two three" if i % 2 else words(i % 7, i)) for i in range(60)]
    out = o10.pack_best_fit(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert len(out) == 60
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == list(np.cumsum([0, *g["length"][:-1]])) and g["length"].sum() <= 2048
    assert out["sequence_id"].nunique() == -(-out["length"].sum() // 2048) and zlib.crc32(b"") == 0
