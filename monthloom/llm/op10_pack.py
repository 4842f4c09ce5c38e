"""Best-fit packing of tokenised documents by planning over a histogram of lengths."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, col
from .texthash import _BASE, _BASE_INV, _BYTE, mixed, powers

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
#: Pieces of one length that one task ranks, about; a length with more is divided by salts.
RANKED = 50_000
#: Distinct words whose ids a worker keeps.
CACHE_WORDS = 500_000
#: Characters tokenised at once.
CHUNK_CHARS = 500_000

# Texts of these characters only (as Latin-1 bytes) are in NFC, lower-case character by character, and
# split where the class of character changes; all other texts go to the tokenizer whole.
_LETTERS = [*range(65, 91), *range(97, 123), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))]
_PLAIN = bytes([9, 10, 13, *(c for c in range(32, 127) if c != 39), *range(0xC0, 0x100)])
_KIND = np.full(256, 3, np.uint8)  # other signs
_KIND[[9, 10, 13, 32]], _KIND[_LETTERS], _KIND[48:58] = 0, 1, 2
_LOWER = bytes(range(256)).translate(
    bytes.maketrans(bytes(c for c in _LETTERS if c < 91 or 0xC0 <= c < 0xDF), bytes(c + 32 for c in _LETTERS if c < 91 or 0xC0 <= c < 0xDF))
)
#: The byte-level alphabet: bytes without a visible Latin-1 sign stand for themselves plus 256 and up, in order.
_HIDDEN = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or b >= 174)]
_SHOWN = {b: 256 + i for i, b in enumerate(_HIDDEN)}
_encoders: dict[str, "Encoder"] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Encoder:
    """Token ids of whole texts; equal to the tokenizer's own, with each distinct word tokenised once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]  # found in a text as one id
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}  # a word's hash: its number
        self.start, self.length, self.table = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "<u4")

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        self.known.update(zip(hashes, range(len(self.known), len(self.known) + len(hashes))))
        cut = self.tokenizer.model.tokenize
        ids = [np.array([t.id for t in cut(w.encode().decode("latin-1").translate(_SHOWN))], "<u4") for w in words]
        n = np.array([len(x) for x in ids], "i8")
        self.start = np.concatenate([self.start, len(self.table) + np.cumsum(n) - n])
        self.length = np.concatenate([self.length, n])
        self.table = np.concatenate([self.table, *ids])

    def _plain(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of plain texts in Latin-1: runs of letters, single digits, and runs of other signs are words."""
        joined = b"\n".join([*texts, b""]).translate(_LOWER)
        data = np.frombuffer(joined, np.uint8)
        kind = _KIND[data]
        edge = kind == 2
        edge[1:] |= kind[1:] != kind[:-1]
        edge[:1] = True
        start = np.flatnonzero(edge & (kind > 0))
        edge = kind == 2
        edge[:-1] |= kind[1:] != kind[:-1]
        end = np.flatnonzero(edge & (kind > 0)) + 1
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        first = np.searchsorted(start, offsets)
        if not len(start):
            return [self.table[:0]] * len(texts)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=sums[1:])
        h = mixed((sums[end] - sums[start]) * powers(_BASE_INV, len(data) + 1)[start] + (end - start).astype(np.uint64))
        seen, at, back = np.unique(h, return_index=True, return_inverse=True)
        seen = seen.tolist()
        if new := [i for i, x in enumerate(seen) if x not in self.known]:
            a, b = start[at[new]].tolist(), end[at[new]].tolist()
            self._learn([seen[i] for i in new], [joined[x:y].decode("latin-1") for x, y in zip(a, b)])
        word = np.fromiter(map(self.known.__getitem__, seen), "i8", len(seen))[back]
        n = self.length[word]
        ends = np.cumsum(n)
        ids = self.table[np.repeat(self.start[word] - (ends - n), n) + np.arange(ends[-1])]
        edges = np.concatenate([[0], ends])[first]
        return [ids[a:b] for a, b in zip(edges.tolist(), edges[1:].tolist())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHE_WORDS:
            self._clear()
        out: list = [None] * len(texts)
        plain, at = [], []
        for i, t in enumerate(texts):
            try:
                b = t.encode("latin-1")
            except UnicodeEncodeError:
                continue
            if not b.translate(None, _PLAIN) and not any(x in b for x in self.added):
                plain.append(b)
                at.append(i)
        for i, x in zip(at, self._plain(plain)):
            out[i] = x
        other = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(other, self.tokenizer.encode_batch([texts[i] for i in other], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4")
        return out


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters; a longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def tokenised_pieces(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int, ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): documents' ids with 0 at the end, cut at capacity."""
    kind = docs.select(col(id_col).alias("doc_id")).schema[0].dataType
    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)  # its words stay for the worker's next tasks
        encoder = _encoders[path]
        for batch in batches:
            names, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                rows, columns = [], ([], [], [], [], [])
                for i, x in zip(range(a, b), encoder.encode(texts[a:b])):
                    x = np.append(x, np.uint32(0)).astype("<u4")
                    for k, s in enumerate(range(0, len(x), capacity)):
                        part = x[s : s + capacity]
                        rows.append(i)
                        for c, v in zip(columns, (k, s, len(part), zlib.crc32(part.tobytes()), part)):
                            c.append(v)
                arrays = [names.take(pa.array(rows, "int64")), *(pa.array(c, t) for c, t in zip(columns, ("int32", "int64", "int64", "int64")))]
                if ids:
                    arrays.append(pa.array([p.astype("i4") for p in columns[4]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts of pieces by length.

    Returns steps (length, first rank, pieces per sequence, first sequence, offset of the first): the
    pieces of a length, by rank, fill consecutive sequences, so many in each. A length goes to the
    sequences with the least room that holds it, as many times as it fits, before those with more room;
    new sequences open when none has room. Alike sequences are handled together, so the work depends on
    the number of distinct lengths and fill levels, not on the number of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left: runs (first sequence, sequences)
    steps, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for r in sorted(x for x in room if x >= length):
            each, runs, kept = r // length, room.pop(r), []
            for first, many in runs:
                use = min(many, left // each)
                if use:
                    steps.append((length, rank, each, first, capacity - r))
                    rank, left = rank + use * each, left - use * each
                    room.setdefault(r - each * length, []).append((first, use))
                if use < many and left and left < each:
                    steps.append((length, rank, left, first + use, capacity - r))
                    room.setdefault(r - left * length, []).append((first + use, 1))
                    rank, left, use = rank + left, 0, use + 1
                if use < many:
                    kept.append((first + use, many - use))
            if kept:
                room.setdefault(r, []).extend(kept)
            if not left:
                break
        each = capacity // length
        for size, many in ((each, left // each), (left % each, 1)):
            if size and many and left:
                steps.append((length, rank, size, sequences, 0))
                room.setdefault(capacity - size * length, []).append((sequences, many))
                rank, left, sequences = rank + size * many, left - size * many, sequences + many
        room.pop(0, None)
    return steps


def pack_best_fit(
    docs: DataFrame,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]), one row per piece.

    Only documents of over ``capacity`` ids are cut. The driver holds the histogram of piece lengths (at
    most ``capacity`` numbers, and one per RANKED pieces) and the plan; a piece takes the slot of its rank within its
    length. Ranks are counted per length and salt, then offset, so no length meets in one task. Null text is empty: one
    piece of the closing 0. Null or repeated ids are documents like others. An empty table gives no rows.
    Columns other than id and text are not used.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    pieces = scratch.cut(tokenised_pieces(docs, id_col, text_col, tokenizer or tokenizer_path(), capacity, with_ids))
    many = {r[0]: r[1] // RANKED + 1 for r in pieces.groupBy("length").count().where(F.col("count") > RANKED).collect()}
    salt = F.lit(0)
    if many:  # at most capacity lengths
        salts = F.element_at(F.create_map([F.lit(x).cast("long") for kv in many.items() for x in kv]), F.col("length"))
        salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.coalesce(salts, F.lit(1))).cast("int")
    pieces = pieces.withColumn("__salt", salt)
    held = pieces.groupBy("length", "__salt").count()
    table = held.collect()  # at most capacity rows, and one per RANKED pieces
    counts: dict[int, int] = {}
    before = []
    for r in sorted(table):
        before.append((r["length"], r["__salt"], counts.get(r["length"], 0)))
        counts[r["length"]] = counts.get(r["length"], 0) + r["count"]
    steps = sorted(plan(counts, capacity))
    keys = np.array([s[0] << 44 | s[1] for s in steps], "i8")
    table_ = np.array(steps, "i8").reshape(-1, 5)

    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        s = table_[np.searchsorted(keys, length << 44 | rank, "right") - 1]
        j = rank - s[:, 1]
        return pd.DataFrame({"sequence_id": s[:, 3] + j // s[:, 2], "offset": s[:, 4] + j % s[:, 2] * length})

    before = spark.createDataFrame(before, "length long, __salt int, __before long")
    rank = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32"))
    placed = pieces.join(F.broadcast(before), ["length", "__salt"]).withColumn(
        "__slot", F.pandas_udf(slot, "sequence_id long, offset long")("length", F.col("__before") + rank - 1)
    )
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "__slot.sequence_id", "__slot.offset", *["ids"] * with_ids
    )


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
