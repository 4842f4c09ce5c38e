"""The corpus operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from monthloom.llm import bwt, common, texthash
from monthloom.llm import op01_mix as o1
from monthloom.llm import op02_lines as o2
from monthloom.llm import op03_vectors as o3
from monthloom.llm import op04_shard as o4
from monthloom.llm import op05_quality as o5
from monthloom.llm import op06_suffix as o6
from monthloom.llm import op07_license as o7
from monthloom.llm import op08_minhash as o8
from monthloom.llm import op09_fingerprint as o9
from monthloom.llm import op10_pack as o10

random.seed(11)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeéfg") for _ in range(r.randint(2, 6))) for _ in range(n))


def near(text, k):
    w = text.split(" ")
    w[k % len(w)] = "changed"
    return " ".join(w)


LONG, BASE = words(5000, 1), words(120, 2)
TEXTS = [
    None, "", "   ", "one two", "One TWO", "a", LONG, LONG, BASE, BASE, near(BASE, 5), near(near(BASE, 50), 90), words(40, 3),
    "ab " * 400, "x" * 1200, words(30, 4) + "\n" + BASE[:500], "It's <|endoftext|> İ 日本 😀\n\n\nend", "MIT\nReleased under the MIT License.",
] + [f"shared line of boilerplate\n{words(25, 100 + i)}\n\n{words(20, 200 + i)}" for i in range(14)]
ROWS = [(i, t, "en", f"s{i % 12}", 1, 7, "k") for i, t in enumerate(TEXTS)]
ROWS += [(3, "one two", "en", None, 1, 7, "k"), (3, "one two", "en", None, 1, 7, "k"), (None, "no id here at all", None, None, None, None, None), (99, words(40, 3), "en", "s1", 1, 7, "k")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_sql(sql):
    documents = pd.DataFrame(ROWS, columns=[c.split()[0] for c in SCHEMA.split(", ")])  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    return Counter(duckdb.sql(sql).fetchall())


def test_mix(docs, none):
    out = o1.mix_to_weights(docs)
    assert set(docs.columns) <= set(out.columns)
    got = out.select("doc_id", "size", "source_size", "target", "taken").collect()
    assert Counter(map(tuple, got)) == by_sql(o1.OP1_SQL)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert o1.mix_to_weights(none).count() == 0


def test_lines(docs, none):
    got = o2.drop_boilerplate(docs)
    from pyspark.sql import functions as F

    rows = got.select("doc_id", "n_lines", "n_removed", F.char_length("kept_text").cast("long"), F.md5("kept_text")).collect()
    assert Counter(map(tuple, rows)) == by_sql(o2.OP2_SQL)
    assert sum(r["n_removed"] for r in rows) == 14
    assert o2.drop_boilerplate(none).count() == 0


@pytest.mark.parametrize("spare", [False, True])
def test_lines_of_short_pages(spark, spare):
    """Boilerplate goes from pages that hold little or nothing else; a copied text stays where that is asked for."""
    menu, foot = "home, contact, privacy and imprint " * 3, "all of this is the same on each page " * 3
    rows = [(i, f"{menu}\nbody {i}: {words(40, 700 + i)}\n{foot}", f"s{i}") for i in range(10)]
    rows += [(20 + i, "a story\n\nthat was copied", f"s{i}") for i in range(10)]
    rows += [(40, f"{menu}\nx\n\n{foot}", "s1"), (41, f"{menu}\n{foot}", "s1"), (42, f"{menu}\n{foot}", "s1"), (43, f"{menu}\na story", "s2"), (44, foot, None)]
    got = o2.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), spare_copies=spare).collect()
    boiler = {menu, foot, "a story", "that was copied"}
    for r in got:
        xs = r["text"].split("\n")
        kept = xs if spare and 20 <= r["doc_id"] < 30 else [x for x in xs if x not in boiler]
        assert r["kept_text"] == "\n".join(kept)
        assert r["n_lines"] == len([x for x in xs if x]) and r["n_removed"] == len([x for x in xs if x]) - len([x for x in kept if x])
    assert len(got) == len(rows)


def test_vectors(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((6, 8))
    rows = [(i, [float(x) for x in base[i % 6] + 0.05 * r.standard_normal(8)], i % 2, 1) for i in range(40)]
    rows += [(100, rows[0][1], 0, 1), (101, rows[0][1], 1, 1), (102, None, 0, 1), (103, [0.0] * 8, 0, 1), (104, [1.0, None] * 4, 0, 1)]
    rows += [(105, [float("nan")] * 8, 0, 1), (106, [float("inf")] * 8, 0, 1), (107, rows[0][1], None, 1), (108, [1.0, 2.0], 0, 1), (0, rows[0][1], 0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int")
    good = [i for i, x in enumerate(rows) if x[1] and x[2] is not None and all(v is not None and np.isfinite(v) for v in x[1]) and any(x[1])]
    link = defaultdict(set)
    for i in good:
        for j in good:
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                link[i].add(j)
    want = Counter()
    for i, x in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += [k for k in link[todo.pop()] if k not in seen and not seen.add(k)]
        c = min(rows[k][0] for k in seen)
        want[(x[0], len(link[i]), c, x[0] == c)] += 1
    assert Counter(map(tuple, o3.near_vectors(df).collect())) == want
    assert o3.near_vectors(df.where("false")).count() == 0


def test_shards(docs, none):
    out = o4.shard_by_splitters(docs).toPandas()
    assert len(out) == len(ROWS)
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert Counter(zip(out["size"], out["text_crc32"])) == Counter((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert o4.shard_by_splitters(none).count() == 0


def test_shards_near_equal(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'same text' else repeat('x', cast(id % 97 as int)) || id end as text")
    sizes = o4.shard_by_splitters(df).groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 200


def test_quality(spark, docs, none):
    r = random.Random(4)
    good = [(i, words(r.randint(0, 60), 500 + i), 1) for i in range(300)]
    bad = [(1000 + i, words(r.randint(5, 60), 900 + i).upper().replace(" ", "!! "), 0) for i in range(150)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = o5.fit_quality(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    from pyspark.sql import functions as F

    got = df.select("doc_id", "quality", "text", o5.quality_score(spark, model, F.col("text")).alias("s")).toPandas()
    held = got[[zlib.crc32(str(i).encode()) % 5 == 0 and bool(t) for i, t in zip(got["doc_id"], got["text"])]]
    assert ((held["s"] >= 0.3) == (held["quality"] == 1)).mean() > 0.97
    scores = docs.select(o5.quality_score(spark, model, F.col("text")).alias("s")).toPandas()["s"]
    assert scores.between(0, 1).all() and len(scores) == len(ROWS)
    assert o5.fit_quality(none, df.select("doc_id", "quality").where("false")) == 0.5
    assert o5.fit_quality(df, df.select("doc_id", "quality").where("quality = 1")) == 1.0


def test_repeats_in_transform():
    r = np.random.default_rng(1)
    for _ in range(60):
        ps = [bytes(r.integers(97, 97 + r.integers(1, 4), r.integers(0, 60)).astype("u1")) for _ in range(r.integers(1, 6))]
        n = int(r.integers(1, 9))
        c = Counter(p[i : i + n] for p in ps for i in range(len(p) - n + 1))
        arrays, owners = [np.frombuffer(p, "u1") for p in ps], r.integers(0, 3, len(ps))
        for p, m in zip(ps, bwt.repeated_in(arrays, n)):
            assert m.tolist() == [i + n <= len(p) and c[p[i : i + n]] > 1 for i in range(len(p) + 1)]
        held = defaultdict(set)
        for p, o in zip(ps, owners):
            for i in range(len(p) - n + 1):
                held[p[i : i + n]].add(o)
        for p, m in zip(ps, bwt.repeated_in([a.astype("u8") << np.uint64(50) for a in arrays], n, owners)):
            assert m.tolist() == [i + n <= len(p) and len(held[p[i : i + n]]) > 1 for i in range(len(p) + 1)]


def brute_repeats(texts, n=400):
    c = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - n + 1):
            if c[t[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = np.frombuffer(t, np.uint8)[~gone[:-1]].tobytes()
        yield len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()


def brute_passages(texts, n=51):
    """Words of each text that stand in a run of n words which another text holds too."""
    texts = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t)) for t in texts]
    held = defaultdict(set)
    for k, w in enumerate(texts):
        for i in range(len(w) - n + 1):
            held[tuple(w[i : i + n])].add(k)
    for w in texts:
        covered = np.zeros(len(w), bool)
        for i in range(len(w) - n + 1):
            if len(held[tuple(w[i : i + n])]) > 1:
                covered[i : i + n] = True
        yield int(covered.sum())


@pytest.mark.parametrize("group,heavy", [(2000, 4000), (1, 1)])
def test_suffix(docs, none, group, heavy, monkeypatch):
    monkeypatch.setattr(o6, "GROUP", group)  # 1: every compared key is divided by offsets
    monkeypatch.setattr(common, "HEAVY", heavy)  # 1: all rows that several others meet are broadcast
    if heavy == 1:
        monkeypatch.setattr(common, "partitions", lambda spark: 1)
        monkeypatch.setattr(o6, "BROADCAST_KEYS", 0)
    from pyspark.sql import functions as F

    out = o6.remove_repeats(docs).select(
        "doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("starts"), F.sha2("kept", 256), "n_passage_words"
    )
    texts = [r[1] or "" for r in ROWS]
    want = Counter((r[0], *b, p) for r, b, p in zip(ROWS, brute_repeats([t.encode() for t in texts]), brute_passages(texts)))
    assert Counter(map(tuple, out.collect())) == want
    assert o6.remove_repeats(none).count() == 0


def contexts_of(texts, unit):
    """All contexts of texts, as a group that a transform gets."""
    of, key, context, lo, hi, off = o6.anchors(texts, unit)
    x, _, first = unit.symbols(texts)
    data = [x[first[t] + a : first[t] + b + unit.least].tobytes() for t, a, b in zip(of, lo, hi)]
    return pd.DataFrame({"key": key, "context": context, "off": off, "data": data, "owner": of})


@pytest.mark.parametrize("unit", [o6.BYTES, o6.WORDS])
def test_transform_holds_shared_symbols_once(unit, monkeypatch):
    """What all strings of a key share is one symbol in the transform; the ranges are those of whole contexts."""
    r, part = random.Random(5), words(260, 31)
    texts = [f"{words(r.randint(0, 90), 300 + i)} {part[(a := r.randint(0, 500)) : a + r.randint(380, 900)]} {words(r.randint(0, 90), 400 + i)}".encode() for i in range(12)]
    group, held, whole = contexts_of(texts, unit), [], bwt.repeated_starts
    monkeypatch.setattr(bwt, "repeated_starts", lambda text, *rest: held.append(len(text)) or whole(text, *rest))
    out = o6._transformed(unit, unit.bands)(group)
    starts = [len(d) // (8 if unit.words else 1) - unit.least + 1 for d in group["data"]]
    most = max(high - low for low, high in unit.bands)
    assert held == [sum(n + most + 1 for n in starts)]  # with the mark that ends each; whole contexts: n + least
    pieces = [np.frombuffer(d, np.uint64 if unit.words else np.uint8) for d in group["data"]]
    masks = bwt.repeated_in(pieces, unit.least, group["owner"].to_numpy() if unit.across else None)
    want = Counter((k, c, p) for k, c, m in zip(group["key"], group["context"], masks) for p in np.flatnonzero(m))
    got = Counter((k, c, p) for k, c, a, b in zip(*(out[x] for x in out)) for x, y in zip(a, b) for p in range(x, y + 1))
    assert got == want and len(want) > 100
    # a key is a hash: contexts that share it and all around its symbols, but not these, hold no equal strings
    one = group.iloc[[0, 0]].reset_index(drop=True)
    other = pieces[0].copy()
    other[one["off"][0] + 3] += 1
    one.loc[1, ["data", "owner"]] = [other.tobytes(), 99]
    assert len(o6._transformed(unit, unit.bands)(one)) == 0
    one.loc[1, "data"] = one["data"][0]
    assert [(a.tolist(), b.tolist()) for a, b in zip(*(o6._transformed(unit, unit.bands)(one)[x] for x in "ab"))] == [([0], [starts[0] - 1])] * 2


def test_removal_by_chunks(monkeypatch):
    """Texts of a batch are handled together, in chunks; null, no and several spans, empty texts, spans up to the end."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    texts = [b"", words(300, 41).encode(), b"short", words(200, 42).encode(), b"", words(250, 43).encode(), words(90, 44).encode()]
    n = [len(t) for t in texts]
    spans = [None, [(0, 3), (500, 520), (n[1] - 400, n[1] - 400)], [], [(7, 9), (8, 100)], None, [(0, n[5] - 400)], None]
    passages = [[], [(0, 2), (100, 110)], None, None, None, [(199, 199)], [(1, 1), (0, 0)]]
    lists = [pa.array([x and [{"a": a, "b": b} for a, b in x] for x in y], kind) for y in (spans, passages)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts), *lists], names=["doc_id", "text", "spans", "passages"])
    for limit in (1, 2000, 10**6):
        monkeypatch.setattr(o6, "chunks", lambda t: texthash.chunks(t, limit))
        got = [tuple(r.values()) for b in o6._removed(iter([batch, batch.slice(0, 0), batch.slice(2)])) for r in b.to_pylist()]
        want = []
        for i, t in enumerate(texts):
            gone, said = np.zeros(len(t) + 2, int), set()
            for a, b in spans[i] or ():
                gone[a + 1 : b + 401] = 1
            for a, b in passages[i] or ():
                said.update(range(a, b + 51))
            edge = np.diff(gone)
            want.append((i, np.frombuffer(t, np.uint8)[gone[1:-1] == 0].tobytes(), np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), len(said)))
        assert got == want + want[2:]


HEADS = {
    "ISC": "ISC License\n\nCopyright (c) 2020, A. Person\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "GPL-2.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.,",
    "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.",
    "LGPL-2.1": "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999",
    "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/",
    "GPL-2.0-or-later WITH Classpath-exception-2.0": "// SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0\nint main() {}",
    "CC-BY-4.0": "some text\nCC BY 4.0\nmore text of another kind",
    "AGPL-3.0": "a long line with many words of code and prose before it " + words(60, 71).replace("é", "e") + " licensed under the GNU Affero General Public License, version 3. " + words(30, 72).replace("é", "e"),
}


def test_license(spark):
    rows = [
        ("a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/x.py", "code"), ("a/b/c/y.py", "# Released under the MIT License.\n" + "code " * 30),
        ("a/b/z.py", None), ("q/w.py", ""), (None, "text"), ("a/x.py", "code"), ("a/b/COPYING", "All rights reserved."), ("r/s.py", "we license nothing in particular here"),
        ("t/u.txt", "Released under the MIT License.\nand a few words more of this and that"), ("t/v.txt", "no notice"),
    ]
    rows += [(f"heads/{k}/x", t) for k, t in HEADS.items()]
    got = {(r["path"]): (r["license"], r["origin"]) for r in o7.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a/LICENSE"] == ("Apache-2.0", "file") and got["a/x.py"] == ("Apache-2.0", "inherited")
    assert got["a/b/c/y.py"] == ("MIT", "header") and got["a/b/z.py"] == ("All-Rights-Reserved", "inherited")
    assert got["q/w.py"] == got[None] == got["r/s.py"] == got["t/v.txt"] == (None, None) and got["t/u.txt"] == ("MIT", "header")
    assert {k: got[f"heads/{k}/x"][0] for k in HEADS} == {k: k for k in HEADS}
    assert o7.scan_licenses(spark.createDataFrame([], "path string, text string")).count() == 0


def test_license_cosine(spark):
    """Every score against a cosine computed piece by piece, without markers."""
    import math

    texts = [words(12, i) + "\n" + h.replace(" a ", " one ") for i, h in enumerate(HEADS.values())] + [x for _, x in o7.TEMPLATES[::3]] + [words(30, 5)]
    rows = [(f"d{i}/f", t) for i, t in enumerate(texts)]
    got = {r["path"]: r["score"] for r in o7.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    df = Counter(t for x in texts for t in set(o7.terms(x)))
    vectors, idf, unseen = o7.template_weights(df, len(texts))
    for path, text in rows:
        if re.search(o7.TAG, text):
            assert got[path] == 1.0
            continue
        lines = text.split("\n")
        pieces = [text, *lines, *[x for x in re.split(r"\n\s*\n", text) if "\n" in x]]
        for x in lines:
            w = x.split()
            pieces += [" ".join(w[i : i + o7.WINDOW]) for i in range(0, max(len(w) - o7.WINDOW + o7.STEP, 1), o7.STEP)] if len(w) > o7.WINDOW else []
        best = 0.0
        for x in pieces:
            v = {t: k * idf.get(t, unseen) for t, k in Counter(o7.terms(x)).items()}
            norm = math.sqrt(sum(a * a for a in v.values()))
            dots = defaultdict(float)
            for i, _, t, weight in vectors:
                dots[i] += weight * v.get(t, 0.0)
            best = max(best, max(dots.values()) / norm if norm else 0.0)
        assert abs(best - got[path]) < 1e-6 if best >= o7.LEAST + 1e-6 else got[path] is None


def brute_near(rows, percent):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), r[1] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    least = {}
    for r, c in zip(rows, root):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    return Counter((r[0], len(s), least.get(c), r[0] == least.get(c)) for r, s, c in zip(rows, sets, root))


@pytest.mark.parametrize("cap,window", [(1024, 4), (3, 1)])
def test_minhash(spark, docs, none, cap, window, monkeypatch):
    monkeypatch.setattr(o8, "CAP", cap)
    monkeypatch.setattr(o8, "WINDOW", window)
    rows = ROWS + [(200 + i, near(near(near(BASE, 3 * i), 7 * i + 1), 40), "en", "s", 1, 1, "") for i in range(8)] if cap > 3 else ROWS
    df = spark.createDataFrame(rows, SCHEMA)
    assert Counter(map(tuple, o8.near_duplicates(df).collect())) == brute_near(rows, 85)
    if cap > 3:
        assert o8.near_duplicates(none).count() == 0


def star(seed, n, r, words_each=100, changed=1):
    """A text and n copies of it, each with other words changed."""
    base = words(words_each, seed).split(" ")
    out = [base]
    for _ in range(n):
        w = list(base)
        for k in r.sample(range(5, words_each - 5), changed):
            w[k] = f"edit{r.random()}"
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("cap,window", [(3, 1), (16, 2)])
def test_minhash_crowded(spark, cap, window, monkeypatch):
    """Stars, a chain, bridges between two groups and groups that are no copies, with all regions crowded."""
    monkeypatch.setattr(o8, "CAP", cap)
    monkeypatch.setattr(o8, "WINDOW", window)
    r = random.Random(9)
    texts = star(31, 60, r) + star(32, 30, r, 60) + star(33, 40, r, 100, 2)  # the third: edits of two words, 0.82 to the original
    chain = words(100, 34).split(" ")
    for k in range(20):
        texts.append(" ".join(chain))
        chain[5 * k % 100] = f"step{k}"
    left = star(35, 12, r)
    far = left[0].split(" ")
    far[20], far[70] = "far", "off"  # below the threshold to the first group's original
    half = left[0].split(" ")
    half[20] = "far"  # the bridge, near to both
    texts += left + [" ".join(far), " ".join(half)] + [" ".join(["more", *far[1:]])]
    rows = [(i, t) for i, t in enumerate(r.sample(texts, len(texts)))]
    got = o8.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == brute_near(rows, 85)


def test_minhash_near_group_in_crowd(spark, monkeypatch):
    """The eight near copies that test_minhash leaves out at the small cap."""
    monkeypatch.setattr(o8, "CAP", 3)
    monkeypatch.setattr(o8, "WINDOW", 1)
    rows = ROWS + [(200 + i, near(near(near(BASE, 3 * i), 7 * i + 1), 40), "en", "s", 1, 1, "") for i in range(8)]
    got = o8.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert Counter(map(tuple, got.collect())) == brute_near(rows, 85)


def test_fingerprints(docs, none):
    got = o9.fingerprint_edits(docs).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [r[1] or "" for r in order]
    want = Counter()
    for i, t in enumerate(texts):
        e = t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2]
        want[(order[i][0], len(t), hashlib.sha256(e.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    prints = defaultdict(set)
    for r in got:
        prints[(r["doc_id"], r["n_chars"])].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert prints[(6, len(LONG))] == prints[(7, len(LONG))] and all(len(p) == 1 for p in prints.values())
    long = next(r for r in got if r["doc_id"] == 6)
    assert long["near_edited"] == 1.0 or long["near_edited"] > 0.3
    assert o9.fingerprint_edits(none).count() == 0


def test_phrases_are_local():
    inner = words(300, 9).encode()
    a, b = (set(o9.phrases([x + inner + y])[0].tolist()) for x, y in ((b"", b""), (b"quite another start ", b" and end")))
    assert len(a & b) >= 0.9 * len(a)


def test_encoder():
    e = o10.Encoder(o10.tokenizer_path())
    r = random.Random(2)
    texts = [t or "" for t in TEXTS] + ["".join(r.choice("aA1 .'é×É\n\t!<|>ßÿÞ-") for _ in range(40)) for _ in range(300)]
    from tokenizers import Tokenizer

    got, want = e.encode(texts), Tokenizer.from_file(o10.tokenizer_path()).encode_batch(texts, add_special_tokens=False)
    assert all(g.tolist() == w.ids for g, w in zip(got, want))


def test_plan():
    r = random.Random(7)
    for _ in range(50):
        counts = {n: r.randint(1, 30) for n in r.sample(range(1, 33), r.randint(1, 20))}
        slots = defaultdict(list)
        steps = o10.plan(counts, 32)
        for length, k in counts.items():
            mine = sorted(s for s in steps if s[0] == length)
            for rank in range(k):
                s = max(x for x in mine if x[1] <= rank)
                j = rank - s[1]
                slots[s[3] + j // s[2]].append((s[4] + j % s[2] * length, length))
        for used in slots.values():
            used.sort()
            assert [o for o, _ in used] == list(np.cumsum([0] + [n for _, n in used[:-1]])) and sum(n for _, n in used) <= 32
        room = []  # best-fit decreasing, piece by piece
        for n in sorted((n for n, k in counts.items() for _ in range(k)), reverse=True):
            fits = [x for x in room if x >= n]
            if fits:
                room.remove(min(fits))
            room.append((min(fits) if fits else 32) - n)
        assert len(slots) == len(room)


def test_pack(docs, none):
    out = o10.pack_best_fit(docs, with_ids=True).toPandas()
    e = o10.Encoder(o10.tokenizer_path())
    want = Counter()
    for r in ROWS:
        ids = np.append(e.encode([r[1] or ""])[0], 0).astype("<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[(r[0], k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()))] += 1
    keys = out[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).where(out[["doc_id", "piece", "start", "length", "ids_crc32"]].notna(), None)
    assert Counter(keys.itertuples(index=False, name=None)) == want
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == list(np.cumsum([0, *g["length"][:-1]])) and g["length"].sum() <= 2048
    assert (out["ids"].str.len() == out["length"]).all()
    assert o10.pack_best_fit(none).count() == 0
