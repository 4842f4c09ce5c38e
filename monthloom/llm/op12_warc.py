"""WARC archives: written as rows of a text table, read back as a table of chunks with running digests."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, col, met

#: A block of more bytes is written as a record and continuation records.
SEGMENT_BYTES = 1 << 16
#: Payload bytes of a row of the chunk table.
CHUNK_BYTES = 1 << 16
#: Chunk bytes that a task of the reader gathers before it hands them on.
HELD_BYTES = 1 << 22
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base 32, 40 bits at a time."""
    hex_ = F.sha1(data.cast("binary"))
    digits = [F.lpad(F.conv(F.substring(hex_, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(df: DataFrame, id_col: str, payload_col: str, scratch: Scratch, least_bytes: int = 0) -> DataFrame:
    """df with payload_bytes, payload_digest, record_type and refers_to.

    Of rows with equal payloads (length and SHA-1) of least_bytes or more, those of the largest id are responses and the
    others revisit it. Null payloads are empty. A null id revisits like others; where a payload has null ids only, all
    stay responses. Very common payloads are joined apart. Columns called like the four new ones are replaced.
    """
    data = F.coalesce(col(payload_col).cast("binary"), F.lit(b""))
    known = df.withColumns({"payload_bytes": F.octet_length(data).cast("long"), "payload_digest": base32_sha1(data)})
    on = ["payload_digest", "payload_bytes"]
    # the id of a null is no id, so a group of nulls has no leader and stays out
    leaders = known.where(F.col("payload_bytes") >= least_bytes).groupBy(*on).agg(F.max(col(id_col)).alias("__first"), F.count("*").alias("__n"))
    leaders = scratch.cut(leaders.where("__n > 1 and __first is not null"))
    out = met(known, leaders, on, "__n", "left")
    follows = F.col("__first").isNotNull() & ~F.col("__first").eqNullSafe(col(id_col))
    kind = F.when(follows, "revisit").otherwise("response")
    return out.withColumns({"record_type": kind, "refers_to": F.when(follows, F.col("__first"))}).drop("__first")


def _line(name: str, value: Column) -> Column:
    """A header line; none where the value is null. Line ends inside a value would end the header, so they become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit(EOL)), F.lit(""))


def warc_rows(
    df: DataFrame, record_id: Column, payload_col: str, uri: Column, refers_to: Column, date: Column, segment_bytes: int = SEGMENT_BYTES
) -> DataFrame:
    """(value): WARC records without their last line end, one row for each segment, from rows of with_revisits.

    A revisit has the HTTP header of its response and no payload. Segments of a record are neighbours, in order.
    """
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=UTF-8{EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(EOL * 2))
    body = F.when(revisit, F.lit(b"")).otherwise(F.coalesce(col(payload_col).cast("binary"), F.lit(b"")))
    rows = df.select(
        F.concat(F.lit("<"), record_id, F.lit(">")).alias("id"),
        F.concat(
            _line("WARC-Date", date),
            _line("WARC-Target-URI", uri),
            _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
            _line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<"), refers_to, F.lit(">")))),
            _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
            _line("Content-Type", F.lit("application/http; msgtype=response")),
        ).alias("head"),
        F.col("record_type").alias("kind"),
        F.concat(http.cast("binary"), body).alias("block"),
    )
    size = F.octet_length("block")
    rows = rows.withColumn("last", F.greatest(F.ceil(size / F.lit(segment_bytes)), F.lit(1)).cast("int"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("last"))))
    k, first, alone = F.col("k"), F.col("k") == 1, F.col("last") == 1
    part = F.substring("block", (k - 1) * segment_bytes + 1, F.lit(segment_bytes))
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        _line("WARC-Type", F.when(first, F.col("kind")).otherwise("continuation")),
        _line("WARC-Record-ID", F.when(first, F.col("id")).otherwise(F.concat(F.expr("left(id, length(id) - 1)"), F.lit(":segment:"), k.cast("string"), F.lit(">")))),
        F.when(first, F.col("head")).otherwise(F.concat(_line("WARC-Date", date_of("head")), _line("WARC-Segment-Origin-ID", F.col("id")))),
        _line("WARC-Segment-Number", F.when(~alone, k.cast("string"))),
        _line("WARC-Segment-Total-Length", F.when(~alone & (k == F.col("last")), size.cast("string"))),
        _line("Content-Length", F.octet_length(part).cast("string")),
        F.lit(EOL),
    )
    return rows.select(F.concat(head.cast("binary"), part, F.lit(EOL.encode())).cast("string").alias("value"))


def date_of(head: str) -> Column:
    return F.regexp_extract(head, r"WARC-Date: ([^\r]*)", 1)


def write_warc(rows: DataFrame, path: str) -> None:
    """Archives of warc_rows, a compressed file for each partition; Spark's commit keeps those of finished tasks only."""
    rows.write.option("lineSep", EOL).option("compression", "gzip").text(path)


CHUNKS = "record_id string, record_type string, uri string, refers_to string, declared_digest string, chunk_no long, chunk binary, bytes_so_far long, digest_so_far string, last boolean, complete boolean"
_FIELDS = [f.split()[0] for f in CHUNKS.split(", ")]
_SCHEMA = pa.schema([(f, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[t]) for f, t in (x.split() for x in CHUNKS.split(", "))])


class _Reader:
    """Lines of whole archives, in order, to rows of the chunk table; holds one chunk and one digest at a time.

    The rows of a record come before those of the next one. Segments that follow each other are one record.
    """

    def __init__(self, keep: bool, chunk_bytes: int):
        self.keep, self.chunk_bytes, self.rows, self.held = keep, chunk_bytes, [], 0
        self.record: dict | None = None
        self.header: dict[str, str] | None = None  # while a header is read
        self.left = 0  # bytes of the block still to come
        self.http = False  # while the block's own header is read
        self.block = False

    def open(self, header: dict[str, str]) -> None:
        again = header.get("warc-type") == "continuation" and self.record and header.get("warc-segment-origin-id") == self.record["id"]
        if not again:
            self.close()
            self.record = {"id": header.get("warc-record-id"), "header": header, "sha": hashlib.sha1(), "bytes": 0, "no": 0, "pieces": [], "size": 0, "whole": "warc-segment-number" not in header}
            self.http = header.get("content-type", "").startswith("application/http")
        elif "warc-segment-total-length" in header:
            self.record["whole"] = True
        self.left, self.block = int(header.get("content-length", 0)), True

    def add(self, piece: bytes) -> None:
        if self.http:
            self.http = piece not in (b"\r\n", b"\n")
            return
        r = self.record
        r["sha"].update(piece)
        r["bytes"] += len(piece)
        r["size"] += len(piece)
        if self.keep:
            r["pieces"].append(piece)
        if r["size"] >= self.chunk_bytes:
            self.emit(False)

    def emit(self, last: bool) -> None:
        r, bare = self.record, lambda x: x.strip().strip("<>") if x else None
        h = r["header"]
        digest = base64.b32encode(r["sha"].copy().digest()).decode()
        self.rows.append((bare(r["id"]), h.get("warc-type"), h.get("warc-target-uri"), bare(h.get("warc-refers-to")), (h.get("warc-payload-digest") or ":").split(":", 1)[1] or None,
                          r["no"], b"".join(r["pieces"]) if self.keep else None, r["bytes"], digest, last, r["whole"] and not self.left))
        self.held += r["size"] + 500
        r["no"], r["pieces"], r["size"] = r["no"] + 1, [], 0

    def close(self) -> None:
        if self.record:
            self.emit(True)
        self.record = None

    def line(self, x: bytes) -> None:
        if self.block and self.left:
            piece = x + b"\n"
            if len(piece) > self.left:  # the record's own line end follows
                piece = piece[: self.left]
            self.left -= len(piece)
            self.add(piece)
        elif self.header is not None:
            if x.strip():
                name, _, value = x.decode("utf-8", "replace").partition(":")
                self.header[name.strip().lower()] = value.strip()
            else:
                header, self.header = self.header, None
                self.open(header)
        elif x.startswith(b"WARC/"):
            self.header, self.block = {}, False

    def batches(self, all_: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (all_ or self.held >= HELD_BYTES or len(self.rows) >= 1000):
            yield pa.RecordBatch.from_pylist([dict(zip(_FIELDS, r)) for r in self.rows], _SCHEMA)
            self.rows, self.held = [], 0


def read_chunks(spark: SparkSession, path: str, keep_bytes: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The records of archives as rows (record_id, chunk_no), each with the bytes and the digest of the payload up to its end.

    A file is read from its start to its end by one task, line by line, so it must be compressed (which Spark doesn't split)
    or smaller than a split. No record is ever held whole: the task keeps the lines of a batch and one chunk. Payloads are
    bytes, of any encoding; an HTTP header at the start of a block is no payload. A record without payload has one row of
    no bytes. complete is false in the last row of a record whose block or segments end too early.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(keep_bytes, chunk_bytes)
        for b in batches:
            for x in b.column(0).to_pylist():
                reader.line(x)
                if reader.held >= HELD_BYTES:
                    yield from reader.batches()
            yield from reader.batches()
        reader.close()
        yield from reader.batches(True)

    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary")).mapInArrow(parse, CHUNKS)


def records(chunks: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per record: record_id, record_type, uri, refers_to, payload_bytes, payload_digest; a revisit has those of its response.

    A revisit whose response is not there keeps its declared digest and has null bytes. Of responses with one id any
    serves. A response that very many records revisit is joined apart.
    """
    ends = scratch.cut(chunks.where("last").drop("chunk", "chunk_no", "last"))
    own = ends.where("record_type <> 'revisit' or record_type is null")
    asked = ends.where("record_type = 'revisit'")
    wanted = asked.groupBy(F.col("refers_to").alias("__at")).agg(F.count("*").alias("__n"))
    found = own.groupBy(F.col("record_id").alias("__at")).agg(F.max(F.struct("bytes_so_far", "digest_so_far")).alias("__x"))
    found = scratch.cut(found.join(wanted, "__at").select("__at", "__n", F.col("__x.bytes_so_far").alias("payload_bytes"), F.col("__x.digest_so_far").alias("payload_digest")))
    keys = ["record_id", "record_type", "uri", "refers_to"]
    asked = met(asked.withColumn("__at", F.col("refers_to")), found, ["__at"], "__n", "left")
    asked = asked.select(*keys, "payload_bytes", F.coalesce("payload_digest", "declared_digest").alias("payload_digest"), "complete")
    return own.select(*keys, F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "complete").unionByName(asked)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    pages = with_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html", scratch)
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    path = scratch.path()
    write_warc(warc_rows(pages, name("page_id"), "html", F.col("url"), name("refers_to"), F.lit("2024-01-01T00:00:00Z")), path)
    number = lambda c: F.expr(f"try_cast(substring({c}, {len('urn:page:') + 1}) as bigint)")
    return records(read_chunks(spark, path), scratch).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


OP12_SQL = """with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, html, sha1(html) as h from p),
b as (select *, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  ((('0x' || substr(h, (k // 8) * 10 + 1, 10))::bigint >> (35 - 5 * (k % 8))::int) & 31)::int + 1, 1)), '') as payload_digest, max(page_id) over (partition by html) as first from d)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end::bigint as refers_to from b"""
