"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, col, partitions
from .texthash import _BYTE, _PLACE, chunks, mixed

#: Rounds of parsing; phrases grow about threefold each.
LEVELS = 3
#: Slots of a fingerprint, of 16 bits each.
SLOTS = 64
#: Documents a range of ids should hold, and the most ranges.
ROWS_PER_RANGE, MAX_RANGES = 500, 50_000
#: Bytes of text that a task should read.
TASK_BYTES = 32 << 20
_WEIGHT = np.concatenate([_PLACE, mixed(_PLACE.copy()) | np.uint64(1)])


def _coin_table(symbols: int) -> np.ndarray:
    """For symbols a (before) and b: twice the lowest bit where they differ, plus that bit of b."""
    a, b = np.meshgrid(np.arange(symbols), np.arange(symbols), indexing="ij")
    low = np.where(a == b, 1, (a ^ b) & -(a ^ b))
    return (2 * np.round(np.log2(low)) + ((b & low) > 0)).astype(np.uint8).ravel()


_COINS = {n: _coin_table(n) for n in (256, 128, 16, 8)}


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6, different for neighbours, that depend on a few symbols before each place.

    Neighbouring symbols must differ; the first symbol of a text is compared with itself but for bit 0.
    """

    def before(x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[first] = x[first] ^ x.dtype.type(1)
        return out

    if symbols.dtype == np.uint8:
        steps, x = (256, 16, 8), symbols
    else:
        differ = before(symbols) ^ symbols
        low = differ & (~differ + np.uint64(1))
        x = (np.bitwise_count(low - np.uint64(1)) << 1) | ((symbols & low) != 0).astype(np.uint8)
        steps = (128, 16, 8)
    for n in steps:
        x = _COINS[n][before(x).astype(np.uint16) * np.uint16(n) + x]
    return x


def phrases(texts: list[bytes], levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of all texts after ``levels`` rounds, and the text of each.

    Each round folds runs of one symbol, labels the symbols by deterministic coin tossing, begins a phrase
    at every local maximum of the labels (and at the text's start), and names each phrase by its symbols.
    A name depends on the phrase and a bounded neighbourhood, so equal substrings have equal interior names.
    """
    sizes = np.array([len(t) for t in texts], "i8")
    owner = np.flatnonzero(sizes)
    symbols = np.frombuffer(b"".join(texts), np.uint8)
    first = (np.cumsum(sizes) - sizes)[owner]
    if not len(symbols):
        return np.empty(0, np.uint64), np.empty(0, "i8")
    for _ in range(levels):
        new = np.ones(len(symbols), bool)
        np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
        new[first] = True
        starts = np.flatnonzero(new)
        run = np.diff(starts, append=len(symbols)).astype(np.uint64)
        symbols, first = symbols[starts], np.searchsorted(starts, first)
        names = _BYTE[symbols] if symbols.dtype == np.uint8 else symbols
        names = np.where(run > 1, mixed(names + run), names)
        label = _labels(symbols, first)
        top = np.zeros(len(label) + 1, np.int8)
        np.greater(label[1:], label[:-1], out=top[1:-1].view(bool))
        top[first] = 1
        last = np.append(first[1:], len(label)) - 1
        falls = np.ones(len(label), bool)
        np.greater(label[:-1], label[1:], out=falls[:-1])
        falls[last] = True
        top = top[:-1].astype(bool) & falls
        top[first] = True
        starts = np.flatnonzero(top)
        lengths = np.diff(starts, append=len(names))
        place = np.arange(len(names)) - np.repeat(starts, lengths)
        symbols = mixed(np.add.reduceat(names * _WEIGHT[place & 15], starts) + lengths.astype(np.uint64))
        first = np.searchsorted(starts, first)
    return symbols, np.repeat(owner, np.diff(first, append=len(symbols)))


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """One row of SLOTS numbers per text: the least phrase name that falls in each slot, 0 for none."""
    out = np.zeros((len(texts), SLOTS), np.uint16)
    for a, b in chunks(texts):
        names, owner = phrases(texts[a:b])
        order = np.argsort(names)[::-1]
        names, owner = names[order], owner[order]
        value = (mixed(names.copy()) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        out[a + owner, (names & np.uint64(SLOTS - 1)).astype("i8")] = value  # the least name is written last
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of common phrases, 2|A and B| / (|A| + |B|), as the slots estimate it; 1 for two empty texts."""
    same, used = ((a == b) & (a > 0)).sum(axis=1), ((a > 0) | (b > 0)).sum(axis=1)
    j = np.where(used > 0, same / np.maximum(used, 1), 1.0)
    return 2 * j / (1 + j)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (__range, __ahead, doc_id, text), dealt and sorted so that each row's next stands after it.

    Order: descending id, null ids last, equal ids by hash of text; after the last comes the first. Ids are
    cut into ranges at the ids of a hash sample; each range is followed by a copy of the next range's first
    row (__ahead = 1), so no row is looked for in another task.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(
        col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text")
    ).withColumn("__h", F.xxhash64("text"))
    ids = docs.select(col(id_col).alias("doc_id"))
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n, size = max(1, n), size or 0
    ranges = min(MAX_RANGES, n // ROWS_PER_RANGE + 1)
    dice = F.pmod(F.xxhash64("doc_id", F.lit("range")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    cuts = sorted(r[0] for r in ids.where(dice < ranges / n).where("doc_id is not null").distinct().collect())

    edges = np.array(cuts, dtype="i8" if cuts and isinstance(cuts[0], int) else None if not cuts else object)

    def at(x: pd.Series) -> pd.Series:
        out = np.full(len(x), len(edges) + 1)
        real = ~pd.isna(x).to_numpy()
        out[real] = len(edges) - np.searchsorted(edges, x.to_numpy()[real].astype(edges.dtype), "right") if len(edges) else 0
        return pd.Series(out)

    rows = rows.withColumn("__range", F.pandas_udf(at, "int")("doc_id"))
    heads = rows.groupBy("__range").agg(F.max(F.struct("doc_id", F.bitwise_not("__h"))).alias("x"))
    found = sorted(((r["__range"], r["x"][0], ~r["x"][1]) for r in heads.collect()), key=lambda f: f[0])
    schema = f"__range int, __id {rows.schema['doc_id'].dataType.simpleString()}, __k long, __to int"
    firsts = spark.createDataFrame([(*f, found[i - 1][0]) for i, f in enumerate(found)], schema)
    join = [
        rows["__range"] == firsts["__range"],
        rows["doc_id"].eqNullSafe(firsts["__id"]),
        rows["__h"] == firsts["__k"],
    ]
    copies = rows.join(F.broadcast(firsts), join, "left").select(
        F.explode(
            F.when(F.col("__to").isNull(), F.array(F.struct(rows["__range"], F.lit(0).alias("__ahead")))).otherwise(
                F.array(
                    F.struct(rows["__range"], F.lit(0).alias("__ahead")),
                    F.struct(F.col("__to").alias("__range"), F.lit(1).alias("__ahead")),
                )
            )
        ).alias("p"),
        "doc_id",
        "text",
        "__h",
    )
    copies = copies.select("p.__range", "p.__ahead", "doc_id", "text", "__h")
    tasks = int(min(ranges, max(partitions(spark), size // TASK_BYTES)))
    return copies.repartition(tasks, "__range").sortWithinPartitions("__range", "__ahead", F.col("doc_id").desc_nulls_last(), "__h")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, one row per input row.

    The edited text ends in the first half of the next document (see with_next) in place of its own
    last half. Columns: doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (hex),
    near_edited and near_next. Null text is empty; an empty text has an empty fingerprint of zeros, and
    two empty ones are alike (1). A single row is its own next. Long texts are parsed whole. Repeated rows follow one
    another, each the next of the one before. Other columns are not used. An empty table gives no rows.
    """
    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
            held = batch.slice(batch.num_rows - 1)
            held = held.take(pa.array([0]))
            ahead, texts = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            own = fingerprints([t.encode() for t in texts])
            real = [i for i in range(len(texts) - 1) if not ahead[i]]
            edited = []
            for i in real:
                n = len(texts[i])
                edited.append((texts[i][: n - n // 2] + texts[i + 1][: n // 2]).encode())
            other = fingerprints(edited)
            mine, after = own[real], own[[i + 1 for i in real]]
            hexed = lambda x: [r.tobytes().hex() for r in x.astype(">u2")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(2).take(pa.array(real, "int64")),
                    pa.array([len(texts[i]) for i in real], "int64"),
                    pa.array([hashlib.sha256(t).hexdigest() for t in edited], "string"),
                    pa.array(hexed(mine), "string"),
                    pa.array(hexed(other), "string"),
                    pa.array(likeness(mine, other), "float64"),
                    pa.array(likeness(mine, after), "float64"),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return with_next(docs, id_col, text_col).drop("__h").mapInArrow(run, schema)


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
