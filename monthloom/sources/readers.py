"""Readers of dirty administrative files. All columns stay text; callers cast with try_cast."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import dashed_package, pad
from ..functions.names import snake


#: Signs that code page 1252 has where Latin-1 has control characters.
_LATIN = "".join(map(chr, range(0x80, 0xA0)))
_CP1252 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def delimited(spark: SparkSession, path: str, sep: str = "~", encoding: str = "UTF-8", rename: dict[str, str] | None = None) -> DataFrame:
    """Header and text columns, both trimmed of outer blanks. cp1252, which Spark doesn't read, is read as Latin-1 and mended."""
    page = encoding.lower() in ("cp1252", "windows-1252")
    charset = "ISO-8859-1" if page or encoding.lower() == "latin-1" else encoding
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, encoding=charset, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if page:
        mended = str.maketrans(_LATIN, _CP1252)
        df = df.select(*[F.translate(F.col("`" + c.replace("`", "``") + "`"), _LATIN, _CP1252).alias(c.translate(mended)) for c in df.columns])
    df = df.toDF(*[c.strip() for c in df.columns])
    return df.withColumnsRenamed(rename or {})


def application_table(spark: SparkSession, path: str, number: str = "Appl_No", rename: dict[str, str] | None = None) -> DataFrame:
    """Tilde text, or CSV by suffix, with application numbers padded to six digits."""
    df = delimited(spark, path, "," if path.lower().endswith(".csv") else "~", rename=rename)
    return df.withColumn(number, pad(F.col(number), 6))


def detect_encoding(spark: SparkSession, path: str, tries=("utf-8", "cp1252", "latin-1"), head: int = 1 << 20) -> str:
    """First encoding that decodes the head of the first file, read through Spark."""
    data = spark.read.format("binaryFile").load(path).orderBy("path").select(F.substring("content", 1, head).alias("c")).first()
    for e in tries:
        try:
            bytes(data["c"]).decode(e)
            return e
        except UnicodeDecodeError as x:
            if x.start >= len(data["c"]) - 4 and x.reason == "unexpected end of data":
                return e
    return tries[-1]


def drifting(spark: SparkSession, paths: list[str], names: dict[str, list[str]], sep: str = ",") -> DataFrame:
    """CSVs whose headers differ by vintage, under one set of names; absent columns are null."""

    def one(path: str) -> DataFrame:
        df = delimited(spark, path, sep)
        by_snake = {snake(c): c for c in df.columns}
        found = {n: next((by_snake[snake(o)] for o in [n, *olds] if snake(o) in by_snake), None) for n, olds in names.items()}
        return df.select(*[F.col(f"`{c}`").alias(n) if c else F.lit(None).cast("string").alias(n) for n, c in found.items()])

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(one, paths))


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema, in order, null where absent."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """What a missing source yields."""
    return spark.createDataFrame([], schema)


def _members(content: bytes, tokens: list[str]) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [n for n in z.namelist() if not n.endswith("/") and all(t.lower() in n.lower() for t in tokens)]


def zipped_csv(spark: SparkSession, path: str, columns: list[str], tokens: list[str] = (), header: str | None = None, exactly_one: bool = True, encoding: str = "utf-8", sep: str = ",") -> DataFrame:
    """Rows of the CSV in each zip; the member is chosen by tokens, the header by a pattern of its line.

    Archives are opened by the executors, one per row of the file list. With exactly_one, an archive with
    another number of members fails the read. Short rows are filled with nulls, long ones cut.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for name, content in zip(df["path"], df["content"]):
                found = _members(content, list(tokens))
                if exactly_one and len(found) != 1:
                    raise ValueError(f"{name}: {len(found)} members")
                if not found:
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    lines = z.read(found[0]).decode(encoding, "replace").splitlines()
                start = next((i for i, x in enumerate(lines) if header is None or re.search(header, x)), None)
                if start is None:
                    raise ValueError(f"{name}: no header")
                rows = list(csv.reader(lines[start:], delimiter=sep))
                at = {snake(c): i for i, c in enumerate(rows[0])}
                pick = [at.get(snake(c)) for c in columns]
                out = [[r[i] if i is not None and i < len(r) else None for i in pick] for r in rows[1:] if any(r)]
                yield pd.DataFrame(out, columns=columns, dtype="object")

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, ", ".join(f"`{c}` string" for c in columns))


def measured_export(spark: SparkSession, path: str, code: str, month: str, measures: list[str], excluded: list[str] = ()) -> DataFrame:
    """One-member zips of measures by month and code: months trimmed, codes as 11 digits, measures as numbers, null where none.

    Columns without a name, and excluded ones, are not read; a file without month or code fails.
    """
    kept = [m for m in measures if snake(m) and not snake(m).startswith("unnamed_") and snake(m) not in map(snake, excluded)]
    df = zipped_csv(spark, path, [month, code, *kept], header=rf"(?i){re.escape(code)}")
    digits = pad(F.regexp_replace(F.col(f"`{code}`"), r"\D", ""), 11)
    numbers = [F.col(f"`{m}`").try_cast("double").alias(snake(m)) for m in kept]
    return df.select(F.trim(F.col(f"`{month}`")).alias("year_month"), digits.alias("code_11"), dashed_package(digits).alias("code"), *numbers)


def found(spark: SparkSession, candidates: list[str], pattern: str) -> str | None:
    """The first candidate that exists, else the newest file of the pattern."""
    return next((c for c in candidates if newest(spark, c)), None) or newest(spark, pattern)


def ragged(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """Text with trailing separators: the first fields of each line that has enough."""
    parts = F.split("value", re.escape(sep), -1)
    n = len(columns)
    return spark.read.text(path).where(F.size(parts) >= n).select(*[F.trim(parts[i]).alias(c) for i, c in enumerate(columns)])


def table_schema(spark: SparkSession, path: str) -> T.StructType:
    """Schema from the Parquet footer."""
    return spark.read.parquet(path).schema


def quarter_of_file(part: int = -1) -> tuple:
    """(year, quarter) columns from a name such as jan-2021.zip or 2021q1.csv, a part of the path from its end."""
    name = F.lower(F.element_at(F.split(F.input_file_name(), "/"), part))
    year = F.regexp_extract(name, r"(20\d\d)", 1).cast("int")
    q = F.regexp_extract(name, r"q([1-4])", 1)
    month = F.regexp_extract(name, r"(jan|apr|jul|oct)", 1)
    by_month = F.when(month == "jan", 1).when(month == "apr", 2).when(month == "jul", 3).when(month == "oct", 4)
    return year.alias("year"), F.when(q != "", q.cast("int")).otherwise(by_month).alias("quarter")


def newest(spark: SparkSession, pattern: str) -> str | None:
    """Path of the file last modified among those that match."""
    try:
        df = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    r = df.orderBy(F.desc("modificationTime"), F.desc("path")).first()
    return r["path"] if r else None
