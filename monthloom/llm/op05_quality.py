"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, col
from .texthash import chunks, mixed, powers, _BASE, _BASE_INV, _BYTE

#: Labelled documents of each class that the model is fitted on, at most.
SAMPLE_PER_CLASS = 3000
#: Buckets of word spellings, and dimensions and entries of an index vector.
SPELLINGS, DIM, ENTRIES = 1 << 14, 64, 4
#: A shape: classes of a word's first, second and last byte, its length, and whether it repeats the word before.
CLASSES, LENGTHS = 7, 4
SHAPES = CLASSES**3 * LENGTHS * 2
UNITS = SPELLINGS + SHAPES
HIDDEN, EPOCHS, RATE, DECAY = 32, 250, 0.01, 1e-3
THRESHOLD = 0.3

_CLASS = np.full(256, 5, np.uint16)  # other signs
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
_CLASS[[ord(c) for c in ".,;:'?-"]] = 4
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(5))
#: Sparse ternary index vectors: the dimensions and signs of each unit's entries.
_AT = _rng.integers(0, DIM, (UNITS, ENTRIES)).astype(np.int64)
_SIGN = _rng.choice(np.array([-1.0, 1.0], "f4"), (UNITS, ENTRIES))


def units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spelling bucket and shape unit of every word, and each text's first word (one entry more than texts)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    edge = np.flatnonzero(np.diff((~_SPACE[data]).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    if not len(start):
        return start, start, first
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_FOLD[data]] * powers(_BASE, len(data)), out=sums[1:])
    h = mixed((sums[end] - sums[start]) * powers(_BASE_INV, len(data) + 1)[start])
    again = np.zeros(len(h), np.int64)
    again[1:] = h[1:] == h[:-1]
    again[first[:-1][first[:-1] < len(h)]] = 0
    size = np.digitize(end - start, (3, 7, 13))
    shape = _CLASS[data[start]].astype(np.int64)
    for at in (np.minimum(start + 1, end - 1), end - 1):
        shape = shape * CLASSES + _CLASS[data[at]]
    shape = (shape * LENGTHS + size) * 2 + again
    return (h & np.uint64(SPELLINGS - 1)).astype(np.int64), SPELLINGS + shape, first


def contexts(texts: list[bytes]) -> np.ndarray:
    """Sum over all words of the index vectors around them, by unit (UNITS x DIM).

    A spelling gathers the shapes at and next to it and the spellings next to it; a shape gathers the
    shapes up to two words away. Neighbours do not cross texts.
    """
    out = np.zeros(UNITS * DIM)
    for a, b in chunks(texts):
        spelling, shape, first = units(texts[a:b])
        text = np.repeat(np.arange(b - a), np.diff(first))
        n = len(spelling)
        for of, around, steps in ((spelling, shape, (-1, 0, 1)), (spelling, spelling, (-1, 1)), (shape, shape, (-2, -1, 0, 1, 2))):
            for k in steps:
                i = np.arange(max(0, -k), min(n, n - k))
                i = i[text[i] == text[i + k]]
                at = of[i][:, None] * DIM + _AT[around[i + k]]
                out += np.bincount(at.ravel(), _SIGN[around[i + k]].ravel(), len(out))
    return out.reshape(UNITS, DIM)


def word_vectors(summed: np.ndarray) -> np.ndarray:
    """Unit-length context vectors; a unit without context keeps its own index vector."""
    v = summed.copy()
    bare = ~v.any(axis=1)
    rows = np.flatnonzero(bare)
    np.add.at(v, (np.repeat(rows, ENTRIES), _AT[rows].ravel()), _SIGN[rows].ravel())
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return (v / np.where(norm > 0, norm, 1)).astype("f4")


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean vectors of a text's spellings and shapes, their lengths, and the log of its word count."""
    out = np.zeros((len(texts), 2 * DIM + 3), "f4")
    for a, b in chunks(texts, 400_000):
        spelling, shape, first = units(texts[a:b])
        n = np.diff(first)
        has = np.flatnonzero(n)
        if not len(has):
            continue
        rows, many = a + has, n[has][:, None]
        for k, of in enumerate((spelling, shape)):
            mean = np.add.reduceat(vectors[of], first[has], axis=0) / many
            out[rows, k * DIM : (k + 1) * DIM] = mean
            out[rows, 2 * DIM + k] = np.sqrt((mean * mean).sum(axis=1))
        out[rows, -1] = np.log1p(many[:, 0])
    return out


@dataclass
class Network:
    """Standardised input, one tanh layer, one logit, divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -50, 50)))


def fit_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, calibrate: np.ndarray) -> Network:
    """Adam on weighted cross entropy over the rows outside ``calibrate``; the temperature is set on those inside."""
    rng = np.random.Generator(np.random.PCG64(55))
    t = ~calibrate
    mean, scale = x[t].mean(axis=0), x[t].std(axis=0) + 1e-4
    z, yt, wt = (x[t] - mean) / scale, y[t], weight[t] / weight[t].sum()
    p = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, EPOCHS + 1):
        hid = np.tanh(z @ p[0] + p[1])
        err = (1 / (1 + np.exp(-np.clip(hid @ p[2] + p[3], -50, 50))) - yt) * wt
        back = np.outer(err, p[2]) * (1 - hid * hid)
        grad = [z.T @ back + DECAY * p[0], back.sum(axis=0), hid.T @ err + DECAY * p[2], np.array([err.sum()])]
        for k, g in enumerate(grad):
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if calibrate.any():
        logit, yc, wc = net.logit(x[calibrate]), y[calibrate], weight[calibrate]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [(wc * np.logaddexp(0, np.where(yc > 0, -1, 1) * logit / g)).sum() for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def _fold(name) -> "F.Column":
    return F.crc32(name.cast("string").cast("binary")) % 5


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_PER_CLASS
) -> tuple[np.ndarray, Network] | float:
    """Word vectors and network, fitted on at most ``per_class`` labelled documents of either class.

    Rows with crc32(id as text) mod 5 = 0 are never used; those with remainder 1 set the temperature. The
    sample is the first of each class by hash of id, weighted back to the shares of all labels. Texts stay
    on the executors: they return context sums (of fixed size) and pooled vectors. With labels of one class
    only, or none, the result is a constant score; so it is with an empty table.

    Null and empty texts are texts without words. Long texts are read whole. Of repeated ids one text counts, the
    first by hash; an id that is labelled both ways counts on both sides. Null ids and labels are not learnt from. Ties in
    the sample's order go by id. Other columns are not used.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    known = labels.select(col("doc_id").alias("id"), col("quality").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(_fold(F.col("id")) != 0).dropDuplicates(["id", "y"])
    share = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(share) < 2:
        return float(sum(share)) if share else 0.5
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    sample = scratch.cut(
        docs.select(col(id_col).alias("id"), col(text_col).cast("binary").alias("text"))
        .join(F.broadcast(picked[0].unionByName(picked[1])), "id")  # 2 x per_class rows at most
        .groupBy("id", "y")
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        .withColumn("fold", _fold(F.col("id")))
        .orderBy("id", "y")
    )

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((UNITS, DIM))
        for batch in batches:
            total += contexts([t or b"" for t in batch.column(0).to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.astype("f4").tobytes(), 1)], "binary")], names=["x"])

    parts = sample.select("text").coalesce(6).mapInArrow(sums, "x binary").toLocalIterator()
    total = np.zeros((UNITS, DIM), "f4")
    for r in parts:
        total += np.frombuffer(zlib.decompress(r["x"]), "f4").reshape(UNITS, DIM)
    vectors = word_vectors(total)
    sent = spark.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled([t or b"" for t in batch.column(0).to_pylist()], sent.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in x], "binary"), batch.column(1), batch.column(2), batch.column(3)],
                names=["x", "y", "fold", "id"],
            )

    ids = dict(sample.dtypes)
    rows = sample.select("text", "y", "fold", "id").mapInArrow(pool, f"x binary, y {ids['y']}, fold bigint, id {ids['id']}").toPandas()
    rows = rows.sort_values(["id", "y"], kind="stable")
    y = rows["y"].to_numpy("f8")
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    x = np.frombuffer(b"".join(rows["x"]), "f4").reshape(len(rows), -1).astype("f8")
    weight = np.where(y > 0, share[1] / (y > 0).sum(), share[0] / (y == 0).sum())
    calibrate = (rows["fold"] == 1).to_numpy()
    if len(set(y[~calibrate])) < 2:
        calibrate[:] = False
    return vectors, fit_network(x, y, weight, calibrate)


def quality_score(spark: SparkSession, model, text):
    """Column of the scores of whole texts, 0 to 1; null text counts as empty."""
    if isinstance(model, float):
        return F.lit(model)
    sent = spark.sparkContext.broadcast(model)

    def score(texts: pd.Series) -> pd.Series:
        vectors, net = sent.value
        return pd.Series(net.probability(pooled([t or b"" for t in texts], vectors)))

    return F.pandas_udf(score, "double")(text.cast("binary"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select(
        "doc_id",
        (_fold(F.col("doc_id")) == 0).alias("held_out"),
        quality_score(spark, model, F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
