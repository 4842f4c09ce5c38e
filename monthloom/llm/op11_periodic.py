"""Periodic runs of words: Main and Lorentz's divide and conquer on interned word ids."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, bounded_batches, col

#: Words that a run has at least; twice its period is asked for besides.
MIN_WORDS = 12
_MIX = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 64, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def z_function(a: list[int]) -> list[int]:
    """For each place i > 0, how many ids from i on equal those from the start on."""
    n = len(a)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:  # nothing is known beyond right
            while i + k < n and a[k] == a[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def crossing(a: list[int], lo: int, mid: int, hi: int) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of stretches of a[lo:hi] that touch mid and repeat a period twice, periods ascending.

    A period that lies left of mid is compared with what follows mid, one that lies right of it with what stands before.
    """
    left, right = a[lo:mid], a[mid:hi]
    back, nl, nr = left[::-1], mid - lo, hi - mid
    behind = z_function(back)  # by q: equal ids before mid - q and before mid
    ahead = z_function([*right, -1, *left, *right])  # from nr + 1 on: equal ids from there and from mid on
    beyond = z_function(right)  # by q: equal ids from mid + q and from mid on
    before = z_function([*back, -1, *right[::-1], *back])  # from nl + 1 on, backwards: equal ids before there and before mid
    for q in range(1, max(nl, nr) + 1):
        if q <= nl:
            x, y = behind[q] if q < nl else 0, ahead[nr + 1 + nl - q]
            if x + y >= q:
                yield q, mid - q - x, mid + y
        if q <= nr:
            x, y = before[nl + 1 + nr - q], beyond[q] if q < nr else 0
            if x + y >= q:
                yield q, mid - x, mid + q + y


def stretch_runs(a: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs of a, in no order.

    Halves are taken level by level, so that a run is met first where most of it lies in one segment; it is extended once
    and later found by its period. Multiples of its period are known by lying inside it.
    """
    n, found, level = len(a), {}, [(0, len(a))]
    while level:
        halves = []
        for lo, hi in level:
            if hi - lo < min_words:
                continue
            mid = (lo + hi) // 2
            halves += (lo, mid), (mid, hi)
            here: list[tuple[int, int, int]] = []
            for q, s, e in crossing(a, lo, mid, hi):
                if any(q % p == 0 and x <= s and e <= y for p, x, y in here):
                    continue
                known = found.setdefault(q, [])
                at = bisect_right(known, (s, n)) - 1
                if at < 0 or known[at][1] < e:
                    while s and a[s - 1] == a[s - 1 + q]:
                        s -= 1
                    while e < n and a[e] == a[e - q]:
                        e += 1
                    insort(known, (s, e))
                    here.append((q, s, e))
                else:
                    here.append((q, *known[at]))
        level = halves
    return [(s, e, q) for q, known in found.items() for s, e in known if e - s >= min_words]


def repeated_stretches(ids: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Stretches of places that hold all runs.

    A run of period q repeats each of its windows of half of min_words words q places on, and these windows cover it. So
    places outside repeated windows are in no run, nor are windows whose nearest equal is over half their stretch away.
    """
    w, n = min_words // 2, len(ids)
    if n < min_words:
        return []
    key = np.zeros(n - w + 1, np.uint64)  # equal windows have equal sums; others may, which only makes stretches longer
    for j in range(w):
        key += ids[j : n - w + 1 + j].astype(np.uint64) * _MIX[j % 64] ** np.uint64(1 + j // 64)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    gap = np.full(n - w + 1, n, np.int64)
    step = order[1:] - order[:-1]
    np.minimum.at(gap, order[1:][same], step[same])
    np.minimum.at(gap, order[:-1][same], step[same])
    kept, size = gap < n, np.full(n, n)
    while True:
        kept &= gap <= size[: n - w + 1] // 2
        cover = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(kept)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + w, -1)
        edge = np.flatnonzero(np.diff((np.cumsum(cover[:-1]) > 0).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        starts, ends = edge[::2], edge[1::2]
        now = np.zeros(n, np.int64)
        for s, e in zip(starts.tolist(), ends.tolist()):
            now[s:e] = e - s
        if (now == size).all() or not len(at):
            return [(s, e) for s, e in zip(starts.tolist(), ends.tolist()) if e - s >= min_words]
        size = now


def runs_of(words: list[bytes], min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words, by start, then period."""
    interned: dict[bytes, int] = {}
    ids = [interned.setdefault(w, len(interned)) for w in words]
    out = []
    for lo, hi in repeated_stretches(np.array(ids, np.int64), min_words):
        out += [(lo + s, e - s, q) for s, e, q in stretch_runs(ids[lo:hi], min_words)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    inside = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        inside[s + q] += 1
        inside[s + length] -= 1
    gone = np.cumsum(inside) > 0
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def periodic_runs(df: DataFrame, text_col: str = "text", name: str = "periodic", min_words: int = MIN_WORDS) -> DataFrame:
    """df with name: struct<n_words, runs: array of (start, length, period), collapsed>.

    Words are maximal runs of characters other than the six ASCII white-space ones. A run is a maximal stretch of
    min_words words or more that repeats its smallest period at least twice; runs may overlap. collapsed holds the words
    that no run holds after its first period. Null text has no words: 0, no runs and an empty text. Rows are taken one by
    one, so null or repeated ids, ties and repeated rows change nothing; a very long text is worked on whole, in memory
    that grows with its words and time with words times their logarithm, only where it repeats itself. An empty table
    stays empty. A column called like name is replaced; all others stay.
    """

    @F.pandas_udf("n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string")
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for t in batch:
                words = t.encode().split() if t else []
                runs = runs_of(words, min_words)
                columns = [list(c) for c in zip(*runs)] or [[], [], []]
                rows.append((len(words), *columns, collapse(words, runs).decode()))
            yield pd.DataFrame(rows, columns=["n_words", "starts", "lengths", "periods", "collapsed"])

    bounded_batches(df.sparkSession)
    part = lambda c: col("__found")[c]
    runs = F.transform(part("starts"), lambda s, i: F.struct(s.alias("start"), part("lengths")[i].alias("length"), part("periods")[i].alias("period")))
    out = df.withColumn("__found", search(col(text_col)))
    return out.withColumn(name, F.struct(part("n_words").alias("n_words"), runs.alias("runs"), part("collapsed").alias("collapsed"))).drop("__found")


def planted(text: Column, doc_id: Column) -> Column:
    """The text as the query takes it: from some word on periodic, if the CRC of the id ends in 0."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, h = F.size(words), F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.concat_ws(" ", F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a))
    return F.when((h % 10 == 0) & (F.regexp_count(text, F.lit(WORD)) > 0), made).otherwise(text)


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    runs = F.col("periodic.runs")
    longest = F.element_at(F.array_sort(runs, lambda x, y: F.when(x["length"] != y["length"], F.when(x["length"] > y["length"], -1).otherwise(1))
        .when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
        .otherwise(F.when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0))), 1)
    longest = F.when(F.size(runs) > 0, longest)
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    out = periodic_runs(docs).select("doc_id", F.size(runs).cast("long").alias("n_runs"), longest.alias("top"), "periodic.collapsed", F.concat_ws("", lines).alias("lines"))
    return out.select(
        "doc_id",
        "n_runs",
        "top.start",
        "top.length",
        "top.period",
        F.floor(F.col("top.length") * 1000 / F.col("top.period")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
