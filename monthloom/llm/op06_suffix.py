"""Removal of long repeated byte strings by expansion of suffix intervals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwt import numbered, repeated
from .common import Scratch, col, met
from .texthash import _BASE, _BASE_INV, _BYTE, chunks, mixed, powers, word_hashes

LEAST = 400
#: A passage is so many words that also stand in another document.
PASSAGE = 51
#: Contexts that one group may bring into a transform; larger groups are divided by where their strings start.
GROUP = 2000
#: Bytes of contexts that one transform should hold.
BATCH_BYTES = 1_000_000
#: Document keys (16 bytes each) up to so many are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 500_000
#: Bits of a packed anchor that hold its place; more in a text of over 256 MB.
PLACE_BITS = 28


@dataclass(frozen=True)
class Unit:
    """What strings are made of (bytes or words), their length, and that of an anchor.

    across: a string must also start in another document, not only elsewhere. halves: a group shares, besides
    the anchor, half of the rest of a string on one side.
    """

    words: bool
    least: int
    anchor: int
    across: bool
    halves: bool

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts' symbols, their 64-bit codes, and each text's first symbol (one entry more than texts)."""
        if self.words:
            h, first = word_hashes(texts)
            return h, h, first
        data = np.frombuffer(b"".join(texts), np.uint8)
        return data, _BYTE[data], np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    @property
    def bands(self) -> list[tuple[int, int]]:
        """Least and most symbols that a string may have before its anchor, by group."""
        most, half = self.least - self.anchor, (self.least - self.anchor) // 2
        return [(half, most), (0, half - 1)] if self.halves else [(0, most)]


BYTES = Unit(False, LEAST, 32, False, True)
WORDS = Unit(True, PASSAGE, 16, True, False)


def _sums(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(_BASE, len(codes)), out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end] from the running sums."""
    return mixed((sums[end] - sums[start]) * powers(_BASE_INV, len(sums))[start])


def _rows(sums: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, band: tuple[int, int], unit: Unit) -> tuple[np.ndarray, ...]:
    """(which, key, context, lo, hi, off) of the strings around each place ``at`` that have as many symbols before it as the band says.

    The key is made of what these strings share: all that lies in each of them wherever it starts.
    """
    low, high = band
    lo, hi = np.maximum(first, at - high), np.minimum(last, at - low)
    k = np.flatnonzero(lo <= hi)
    lo, hi, p = lo[k], hi[k], at[k]
    key = _hash(sums, p - low, p - high + unit.least)
    context = _hash(sums, lo, hi + unit.least) + (p - lo).astype(np.uint64) * np.uint64(4096) + (hi - lo).astype(np.uint64)
    return k, mixed(key + np.uint64(low * 1024 + high)).view("i8"), mixed(context).view("i8"), lo, hi, p - lo


def anchors(texts: list[bytes], unit: Unit = BYTES) -> tuple[np.ndarray, ...]:
    """(text, key, context, lo, hi, off): the strings of all texts, in groups; lo and hi are first and last start.

    Every string has one anchor, the leftmost of its ``anchor``-symbol substrings with the smallest hash, so
    equal strings have equal anchors at equal offsets. The strings of one anchor start in a row. Those of one
    band of offsets share a key. Equal strings have equal keys. The context is all that the row's strings
    cover; off is its symbols before the anchor.
    """
    _, codes, first = unit.symbols(texts)
    n, out = len(codes), [np.zeros(0, "i8") for _ in range(6)]
    if n < unit.least:
        return tuple(out)
    sums, span = _sums(codes), unit.least - unit.anchor + 1
    at, bits = np.arange(n - unit.anchor + 1), np.uint64(max(PLACE_BITS, n.bit_length()))
    low = _hash(sums, at, at + unit.anchor) >> bits << bits | at.astype(np.uint64)  # of equal ones, the leftmost is the least
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: n - unit.least + 1], low[span - width :])
    step = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(np.diff(first) >= unit.least)
    step[first[long]] += 1
    step[first[long + 1] - unit.least + 1] -= 1
    start = np.flatnonzero(np.cumsum(step[: len(low)], dtype=np.int8) > 0)  # strings that don't cross texts
    if not len(start):
        return tuple(out)
    place = (low[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype("i8")
    edge = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)))
    lo, hi, p = start[edge], start[np.append(edge[1:], len(start)) - 1], place[edge]
    owner = np.searchsorted(first, lo, "right") - 1
    found = [_rows(sums, p, lo, hi, band, unit) for band in unit.bands]
    k, key, context, lo, hi, off = (np.concatenate(x) for x in zip(*found))
    base = first[owner[k]]
    return owner[k], key, context, lo - base, hi - base, off


_ROW = "key long, context long, lo int, hi int, off int"


def _batch(ids: list, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    of = pa.array(found[0])
    return pa.RecordBatch.from_arrays(
        [*(c.take(of) for c in ids), pa.array(found[1]), pa.array(found[2]), *(pa.array(x.astype("i4")) for x in found[3:])],
        names=["ka", "kb", "key", "context", "lo", "hi", "off"],
    )


def _anchor_rows(docs: DataFrame, unit: Unit) -> DataFrame:
    """docs: (ka, kb, text). Rows (ka, kb, key, context, lo, hi, off) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in chunks(texts):
                yield _batch([batch.column(i).slice(a, b - a) for i in (0, 1)], anchors(texts[a:b], unit))

    return docs.select("ka", "kb", "text").mapInArrow(run, "ka long, kb long, " + _ROW)


def _parts(band: tuple[int, int]) -> list[tuple[int, int]]:
    """The band in four; none of a single offset."""
    low, high = band
    step = -(-(high - low + 1) // 4)
    return [(x, min(x + step - 1, high)) for x in range(low, high + 1, step)] if low < high else []


def _narrower(contexts: DataFrame, bands: list[tuple[int, int]], unit: Unit) -> DataFrame:
    """contexts: (ka, kb, text, off, copies, owner), text being symbols. Rows as of _anchor_rows, for narrower bands, with copies and owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [_symbols(d, unit) for d in batch.column(2).to_pylist()]
            if not pieces:
                continue
            first = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
            codes = np.concatenate(pieces)
            sums = _sums(codes if unit.words else _BYTE[codes])
            at = first[:-1] + batch.column(3).to_numpy()
            found = [_rows(sums, at, first[:-1], first[1:] - unit.least, band, unit) for band in bands]
            k, key, context, lo, hi, off = (np.concatenate(x) for x in zip(*found))
            of, rows = pa.array(k), _batch([batch.column(0), batch.column(1)], (k, key, context, lo - first[k], hi - first[k], off))
            yield rows.append_column("copies", batch.column(4).take(of)).append_column("owner", batch.column(5).take(of))

    return contexts.mapInArrow(run, "ka long, kb long, " + _ROW + ", copies long, owner long")


def _symbols(data: bytes, unit: Unit) -> np.ndarray:
    return np.frombuffer(data, np.uint64 if unit.words else np.uint8)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the mask's runs, and the places after their last."""
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


RANGES = "key long, context long, a array<int>, b array<int>"


def _shortened(pieces: list[np.ndarray], before: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """All pieces one after another as small numbers, and their sizes; of each, the ``shared`` symbols after
    ``before`` are one number, the same where these symbols are the same and no other symbol's."""
    known: dict[bytes, int] = {}
    marks = [known.setdefault(x[b : b + shared].tobytes(), len(known)) for x, b in zip(pieces, before)]
    flat = numbered(np.concatenate([half for x, b in zip(pieces, before) for half in (x[:b], x[b + shared - 1 :])])).astype(np.int64)
    sizes = np.array([len(x) - shared + 1 for x in pieces])
    flat[np.cumsum(sizes) - sizes + before] = np.array(marks) + flat.max() + 1
    return flat, sizes


def _transformed(unit: Unit, bands: list[tuple[int, int]]):
    """Ranges of starts of each context's repeated strings.

    All of a key's strings hold the symbols between the last start and the first end that the band allows, so these
    are compared once, then stand as one symbol in the transform, and strings are shorter by as many.
    """
    lows, most = np.array(sorted(low for low, _ in bands)), max(high - low for low, high in bands)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        off = group["off"].to_numpy()
        before = off - lows[np.searchsorted(lows, off, "right") - 1]
        flat, sizes = _shortened([_symbols(d, unit) for d in group["data"]], before, unit.least - most)
        owners = np.unique(group["owner"].to_numpy(), return_inverse=True)[1] if unit.across else None
        a, b = _runs(repeated(flat, sizes, most + 1, owners))  # none crosses the mark that ends a piece
        ends = np.cumsum(sizes + 1)
        of = np.searchsorted(ends, a, "right")
        held, first = np.unique(of, return_index=True)
        base = (ends - sizes - 1)[of]
        lists = [np.split((x - base).astype(np.int32), first[1:]) if len(of) else [] for x in (a, b - 1)]
        some = group.iloc[held]
        return pd.DataFrame({"key": some["key"].to_numpy(), "context": some["context"].to_numpy(), "a": lists[0], "b": lists[1]})

    return run


#: What goes with a context: where its anchor is, the different contexts of its key, documents that hold it, and whose it is.
_TAGS = {"key": "long", "context": "long", "off": "long", "contexts": "long", "copies": "long", "owner": "long"}


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The list that each struct is in, and the structs' fields."""
    flat = lists.flatten()
    names = [f.name for f in flat.type]
    of = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return of, dict(zip(names, flat.flatten()))


def _cut_contexts(unit: Unit, is_data: bool):
    """(text, wanted) -> (key, context, off, data): the wanted ranges of symbols; is_data: text is symbols already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts):
                if is_data:
                    pieces = [_symbols(t, unit) for t in texts[a:b]]
                    x, first = np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
                else:
                    x, _, first = unit.symbols(texts[a:b])
                of, wanted = _flat(batch.column(1).slice(a, b - a))
                lo, hi = (first[of] + wanted[c].to_numpy() for c in ("lo", "hi"))
                data = [x[s:e].tobytes() for s, e in zip(lo.tolist(), (hi + unit.least).tolist())]
                yield pa.RecordBatch.from_arrays([*(wanted[c].cast("int64") for c in _TAGS), pa.array(data, "binary")], names=[*_TAGS, "data"])

    return run


def _keyed(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of docs whose (ka, kb) is (left_semi) or is not (left_anti) in keys: (ka, kb, copies), a scratch table."""
    if keys.count() <= BROADCAST_KEYS:
        return docs.join(F.broadcast(keys), ["ka", "kb"], how)
    return met(docs, keys, ["ka", "kb"], "copies", how)


def _decided(docs: DataFrame, rows: DataFrame, unit: Unit, bands: list[tuple[int, int]], scratch: Scratch, is_data: bool) -> DataFrame:
    """(ka, kb, lo, a, b, copies): ranges lo + a to lo + b of starts of repeated strings, in a scratch table.

    docs: (ka, kb, text). rows: (ka, kb, key, context, lo, hi, off, copies, owner) of one row for each of a text's
    anchors; copies: documents that hold the text. A string can only repeat within its key. Contexts that are
    equal are one, and all their strings repeat; different ones of a key are compared on a transform. Keys of more than
    GROUP contexts are divided by bands of offsets, whose strings share more, until there is one offset a key: then
    its strings share all they have, so no such key has two contexts.
    """
    least_most = [F.min("owner").alias("o1"), F.max("owner").alias("o2"), F.max("copies").alias("most")]
    contexts = rows.groupBy("key", "context").agg(
        F.sum("copies").alias("times"), F.count("*").alias("places"), *least_most, F.min(F.struct("ka", "kb", "lo", "hi", "off")).alias("one")
    )
    several = (F.col("o1") < F.col("o2")) | (F.col("most") > 1) if unit.across else F.col("times") > 1
    contexts = scratch.cut(contexts.withColumn("whole", several))
    differ = scratch.cut(contexts.groupBy("key").agg(F.count("*").alias("contexts")).where("contexts > 1").withColumn("n", F.col("contexts")))
    wanted = scratch.cut(
        met(contexts, differ, ["key"], "n").select(
            "key", "context", "contexts", "one.*", F.when(F.col("whole"), 2).otherwise(1).alias("copies"),
            F.when(F.col("whole"), F.xxhash64("key", "context")).otherwise(F.col("o1")).alias("owner"),
        )
    )
    lists = scratch.cut(
        wanted.groupBy("ka", "kb").agg(F.collect_list(F.struct("lo", "hi", *_TAGS)).alias("wanted"), F.lit(1).alias("copies"))
    )
    texts = _keyed(docs, lists.select("ka", "kb", "copies"), "left_semi")
    if not is_data:  # copies of a text are cut once; those of a hot one meet as partial aggregates
        texts = texts.groupBy("ka", "kb").agg(F.first("text").alias("text"))
    cut = texts.join(lists, ["ka", "kb"]).select("text", "wanted").mapInArrow(
        _cut_contexts(unit, is_data), ", ".join(f"{c} {t}" for c, t in _TAGS.items()) + ", data binary"
    )
    cut = scratch.cut(cut)
    few, many = cut.where(F.col("contexts") <= GROUP), cut.where(F.col("contexts") > GROUP)
    size = few.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    batches = int(max(1, size // BATCH_BYTES))
    batch = F.pmod(F.xxhash64("key"), F.lit(batches)).alias("batch")
    dealt = few.select("key", "context", "off", "data", "owner", batch).repartition(min(batches, 20_000), "batch")
    found = scratch.cut(dealt.groupBy("batch").applyInPandas(_transformed(unit, bands), RANGES))
    parts = [found.select("key", "context", F.explode(F.arrays_zip("a", "b")).alias("r")).select("key", "context", "r.a", "r.b")]
    narrower = [part for band in bands for part in _parts(band)]
    if narrower and not many.isEmpty():
        some = scratch.cut(many.select(F.col("key").alias("ka"), F.col("context").alias("kb"), F.col("data").alias("text"), "off", "copies", "owner"))
        below = scratch.cut(_narrower(some, narrower, unit))
        deeper = _decided(some.select("ka", "kb", "text"), below, unit, narrower, scratch, True)
        at = [(F.col("lo") + F.col(c)).alias(c) for c in ("a", "b")]
        parts.append(deeper.select(F.col("ka").alias("key"), F.col("kb").alias("context"), *at))
    ranges = parts[0]
    for x in parts[1:]:
        ranges = ranges.unionByName(x)
    ranges = ranges.groupBy("key", "context").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    known = contexts.where(~F.col("whole")).join(ranges, ["key", "context"])
    width = F.array(F.struct(F.lit(0).alias("a"), (F.col("one.hi") - F.col("one.lo")).alias("b")))
    known = known.select("key", "context", "places", "ranges").unionByName(contexts.where("whole").select("key", "context", "places", width.alias("ranges")))
    known = scratch.cut(known)
    out = met(rows.select("ka", "kb", "key", "context", "lo", "copies"), known, ["key", "context"], "places")
    return scratch.cut(out.select("ka", "kb", "lo", "copies", F.explode("ranges").alias("r")).select("ka", "kb", "lo", "r.a", "r.b", "copies"))


def repeated_ranges(docs: DataFrame, unit: Unit, scratch: Scratch) -> DataFrame:
    """docs: (ka, kb, text), text binary and not null. (ka, kb, spans, copies): starts of repeated strings, first and last."""
    rows = scratch.cut(_anchor_rows(docs.where(F.octet_length("text") >= (2 * unit.least - 1 if unit.words else unit.least)), unit))
    keys = scratch.cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = met(rows, keys, ["key"], "n", "left_semi")
    places = scratch.cut(shared.groupBy("ka", "kb", "key", "context", "lo", "hi", "off").agg(F.count("*").alias("copies")))
    scratch.drop(rows, keys)
    places = places.withColumn("owner", F.xxhash64("ka", "kb"))
    found = _decided(docs, places, unit, unit.bands, scratch, False)
    return scratch.cut(
        found.groupBy("ka", "kb").agg(F.collect_list(F.struct((F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b"))).alias("spans"), F.max("copies").alias("copies"))
    )


def _covered(sizes: np.ndarray, of: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Mask of texts one after another, each with a place more at its end: what strings cover that start at a to b of text ``of``."""
    first = np.cumsum(sizes + 1) - sizes - 1
    step = np.zeros(int((sizes + 1).sum()), np.int32)
    np.add.at(step, first[of] + a, 1)
    np.add.at(step, first[of] + b + least, -1)
    return np.cumsum(step, dtype=np.int32) > 0


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype("i4")), pa.array(values.astype("i4")))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans, passages) -> (id, kept, removed spans, words in passages)."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for i, j in chunks(texts):
            sizes = np.array([len(t) for t in texts[i:j]])
            of, spans = _flat(batch.column(2).slice(i, j - i))
            gone = _covered(sizes, of, spans["a"].to_numpy(), spans["b"].to_numpy(), LEAST)
            ends = np.cumsum(sizes + 1)
            first = ends - sizes - 1
            a, b = _runs(gone)  # none crosses the place that ends a text
            owner = np.searchsorted(ends, a, "right")
            runs = np.bincount(owner, minlength=len(sizes))
            stay = ~gone
            stay[ends - 1] = False
            offsets = np.append(0, np.cumsum(np.add.reduceat(stay, first, dtype=np.int64))).astype("i4")
            data = np.frombuffer(b"\0".join([*texts[i:j], b""]), np.uint8)[stay]
            kept = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            of, passages = _flat(batch.column(3).slice(i, j - i))
            start, end = passages["a"].to_numpy(), passages["b"].to_numpy()
            reach = np.zeros(len(sizes), "i8")
            np.maximum.at(reach, of, end.astype("i8") + PASSAGE)
            words = np.add.reduceat(_covered(reach, of, start, end, PASSAGE), np.cumsum(reach + 1) - reach - 1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), kept, _lists(runs, a - first[owner]), _lists(runs, b - first[owner]), pa.array(words)],
                names=["doc_id", "kept", "starts", "ends", "n_passage_words"],
            )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, kept, starts, ends, n_passage_words), one row per input row.

    kept: the remaining bytes; starts, ends: the removed byte ranges. Every byte goes that a LEAST-byte string
    covers which also starts anywhere else in any text (UTF-8 bytes; strings don't cross texts).
    n_passage_words: words (lower-cased ASCII) covered by PASSAGE words in a row that another document holds
    too; nothing is removed for them, they are told where they are too short for LEAST bytes.

    Strings meet by anchor keys, of which only those held more than once go on; equal contexts of a key
    are one with a count. Contexts that differ within a key are compared by interval expansion on a
    Burrows-Wheeler transform (bwt.py), in batches of whole keys.

    Null text is empty. Texts under LEAST bytes stay whole. Repeated rows remove each other where long
    enough. Null or repeated ids are rows like others. An empty table gives no rows. Other columns, of whatever
    name, are not used.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("ka"), F.xxhash64(F.lit("repeat"), "text").alias("kb")
    )
    texts = rows.select("ka", "kb", "text")
    passages = repeated_ranges(texts, WORDS, scratch).withColumnsRenamed({"spans": "passages", "copies": "c"})
    spans = repeated_ranges(texts, BYTES, scratch).join(passages, ["ka", "kb"], "full")
    spans = scratch.cut(spans.withColumn("copies", F.coalesce(F.greatest("copies", "c"), "copies", "c")).drop("c"))
    keys = spans.select("ka", "kb", "copies")
    kind = rows.schema["doc_id"].dataType.simpleString()
    some = met(_keyed(rows, keys, "left_semi"), spans, ["ka", "kb"], "copies").select("doc_id", "text", "spans", "passages")
    some = some.mapInArrow(_removed, f"doc_id {kind}, kept binary, starts array<int>, ends array<int>, n_passage_words long")
    none = F.array().cast("array<int>")
    rest = _keyed(rows, keys, "left_anti").select(
        "doc_id", F.col("text").alias("kept"), none.alias("starts"), none.alias("ends"), F.lit(0).cast("long").alias("n_passage_words")
    )
    n = F.octet_length("kept") + F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0), lambda x, y: x + y)
    return some.unionByName(rest).select("doc_id", n.cast("long").alias("n_bytes"), "kept", "starts", "ends", "n_passage_words")


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        "n_passage_words",
    )
