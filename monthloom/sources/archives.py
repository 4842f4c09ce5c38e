"""Members of zip archives as partitions, streamed: records of a JSON array, or ragged lines.

An archive is a file that executors can open, or an address: then the executor keeps a copy in a temporary file while it reads.
Neither an archive nor a member is ever held in memory whole.
"""

from __future__ import annotations

import io
import re
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.names import snake
from ..scratch import Scratch
from .rest import PagedSource

#: Bytes of a member that are read at once.
STEP = 1 << 18
_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*("?)|[{}\[\]]', re.S)


def json_records(pieces: Iterator[bytes], key: str = "results") -> Iterator[bytes]:
    """The objects of a JSON array, as they stand there: of the whole text, or of a key of the object that the text is.

    Holds a piece and the record that is being read.
    """
    held, at, depth, name, array, start = b"", 0, 0, b"", None, None
    want = f'"{key}"'.encode()
    for piece in pieces:
        held += piece
        for m in _TOKEN.finditer(held, at):
            token = m.group()
            if token.startswith(b'"') and not m.group(1):
                at = m.start()  # the string goes on in the next piece
                break
            at = m.end()
            if token.startswith(b'"'):
                name = token
            elif token in (b"{", b"["):
                if array is None and token == b"[" and (depth == 0 or depth == 1 and name == want):
                    array = depth + 1
                elif array == depth and token == b"{":
                    start = m.start()
                depth += 1
            else:
                depth -= 1
                if start is not None and depth == array:
                    yield held[start:at]
                    start = None
                elif array is not None and depth < array:
                    return
        done = at if start is None else start
        held, at, start = held[done:], at - done, None if start is None else 0


def _pieces(f) -> Iterator[bytes]:
    while piece := f.read(STEP):
        yield piece


@contextmanager
def opened(path: str):
    """A seekable file of the archive."""
    if re.match(r"https?://", path):
        with tempfile.TemporaryFile() as f, urlopen(path) as r:
            shutil.copyfileobj(r, f, STEP)
            f.seek(0)
            yield f
    else:
        with open(path.removeprefix("file://"), "rb") as f:
            yield f


class Member(InputPartition):
    def __init__(self, archive: str, name: str):
        self.archive, self.name = archive, name


class ArchiveReader(DataSourceReader):
    """Options: path (archives, by commas), members (words that a member's name holds, by commas), first (of those only one)."""

    def __init__(self, options: dict):
        self.paths = options["path"].split(",")
        self.words = [w.lower() for w in options.get("members", "").split(",") if w]
        self.first = options.get("first", "false") == "true"

    def partitions(self) -> list[Member]:
        out = []
        for path in self.paths:
            with opened(path) as f, zipfile.ZipFile(f) as z:
                names = [n for n in z.namelist() if not n.endswith("/") and all(w in n.lower() for w in self.words)]
            if self.first and not names:
                raise FileNotFoundError(f"{path}: no member of that name")
            out += [Member(path, n) for n in (names[:1] if self.first else names)]
        return out

    @contextmanager
    def member(self, partition: Member):
        with opened(partition.archive) as f, zipfile.ZipFile(f) as z, z.open(partition.name) as m:
            yield m


class JsonReader(ArchiveReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.key = options.get("key", "results")

    def read(self, partition: Member) -> Iterator[tuple]:
        with self.member(partition) as f:
            yield from ((r.decode("utf-8"),) for r in json_records(_pieces(f), self.key))


class ArchivedJson(DataSource):
    """Format archived_json: a row (record) for each object of an array; more options: key, the array's name."""

    @classmethod
    def name(cls) -> str:
        return "archived_json"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> JsonReader:
        return JsonReader(self.options)


class LinesReader(ArchiveReader):
    def __init__(self, options: dict, columns: list[str]):
        super().__init__(options)
        self.columns, self.sep, self.encoding = columns, options.get("sep", "\t"), options.get("encoding", "cp1252")

    def read(self, partition: Member) -> Iterator[tuple]:
        with self.member(partition) as f:
            lines = io.TextIOWrapper(f, self.encoding, errors="replace", newline=None)
            header = [snake(h.strip()) for h in next(lines, "").split(self.sep)]
            while header and not header[-1]:
                header.pop()
            at = [header.index(snake(c)) if snake(c) in header else None for c in self.columns]
            for line in lines:
                fields = [x.strip() for x in line.rstrip("\n").split(self.sep)][: len(header)]
                if len(fields) == len(header) and any(fields):
                    yield tuple(None if i is None else fields[i] for i in at)


class ArchivedLines(DataSource):
    """Format archived_lines: rows of delimited members under the reader's schema of strings, found by the first line's names.

    Fields beyond the header's are left out, lines of fewer fields dropped. More options: sep, encoding.
    """

    @classmethod
    def name(cls) -> str:
        return "archived_lines"

    def schema(self) -> str:
        raise ValueError("archived_lines needs a schema of the wanted columns")

    def reader(self, schema) -> LinesReader:
        return LinesReader(self.options, schema.fieldNames())


def register(spark: SparkSession) -> None:
    for source in (PagedSource, ArchivedJson, ArchivedLines):
        spark.dataSource.register(source)


def paged_or_archive(spark: SparkSession, paged: dict[str, str], archive: dict[str, str]) -> DataFrame:
    """(record): what the pages give, written once; if paging fails or gives nothing, the records of the archive instead.

    All ranges come from the same place: pages read before a failure are not mixed with the archive's records.
    """
    register(spark)
    try:
        out = Scratch(spark).cut(spark.read.format("paged_json").options(**paged).load())
        if not out.isEmpty():
            return out
    except Exception as e:  # noqa: BLE001
        if not any(x in str(e) for x in ("HTTPError", "URLError", "HTTP Error", "records in one range")):
            raise
    return spark.read.format("archived_json").options(**archive).load()
