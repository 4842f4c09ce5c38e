"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, col, met
from .licences import TEMPLATES

TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Least cosine of a piece of text to a template, and of a whole text that makes its file a licence file.
LEAST, WHOLE = 0.6, 0.8
#: Words of a window in a line of over so many, and words from one window to the next.
WINDOW, STEP = 16, 4
#: Files under one of these names speak for their directory.
FILE_NAMES = r"(?i)^(un)?(licen[sc]e|copying|notice)"
#: A tag names the licence itself.
TAG = r"(?i)SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+(?:\s+(?:OR|AND|WITH)\s+[A-Za-z0-9.+-]+)*)"
BROADCAST_ROWS = 100_000


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def template_weights(df: dict[str, int], n: int) -> tuple[list[tuple], dict[str, float], float]:
    """Unit TF-IDF vectors of the templates as (number, name, term, weight); idf by term; idf of any other term."""
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for _, text in TEMPLATES for t in terms(text)}
    rows = []
    for i, (name, text) in enumerate(TEMPLATES):
        w = {t: k * idf[t] for t, k in Counter(terms(text)).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        rows += [(i, name, t, x / norm) for t, x in sorted(w.items())]
    return rows, idf, math.log(1 + n) + 1


def markers(rows: list[tuple], idf: dict[str, float], least: float) -> list[str]:
    """Terms of which a piece must hold one to reach the cosine ``least`` with any template.

    By Cauchy's inequality the cosine is at most the length of the template's part on common terms. So of each
    template the rarest terms are markers, until those left are together shorter than ``least``.
    """
    out = set()
    for i in {r[0] for r in rows}:
        left = 1.0
        for _, t, w in sorted(((idf[r[2]], r[2], r[3]) for r in rows if r[0] == i), reverse=True):
            if left < least * least - 1e-9:
                break
            out.add(t)
            left -= w * w
    return sorted(out)


def _pieces(text: Column) -> Column:
    """(kind, at, x): the whole text, its lines, its paragraphs of several lines, and windows of long lines."""
    made = lambda kind, xs: F.transform(xs, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x.alias("x")))
    lines, paragraphs = F.split(text, "\n"), F.split(text, r"\n\s*\n")
    words = lambda x: F.split(F.trim(x), r"\s+")
    starts = lambda x: F.sequence(F.lit(1), F.greatest(F.size(words(x)) - WINDOW + STEP, F.lit(1)), F.lit(STEP))
    cut = lambda x: F.transform(starts(x), lambda i: F.array_join(F.slice(words(x), i, F.lit(WINDOW)), " "))
    windows = F.flatten(F.transform(F.filter(lines, lambda x: F.size(words(x)) > WINDOW), cut))
    return F.concat(made("whole", F.array(text)), made("line", lines), made("paragraph", F.filter(paragraphs, lambda x: x.contains("\n"))), made("window", windows))


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(path, text_key, license, score, origin, n_lines, licence_file), one row per distinct (path, text).

    Pieces of a text are the text itself, its lines, its paragraphs of several lines, and windows of WINDOW words in
    longer lines. The TF-IDF vector of a piece (document frequencies over all texts; a term of no template counts as
    unseen) is compared with each template; pieces without a marker term, which can't reach ``least``, are left out.
    A file's licence is that of an SPDX tag (score 1), else of its best piece with a cosine of at least
    ``least``; ties go to the first template. A file with a licence is a licence file if its name says so or its whole
    text has a cosine of WHOLE; it also licenses its directory. A file without a licence of its own takes that of its
    nearest ancestor directory, the best licence file of a directory winning. origin: 'header', 'file', 'inherited' or null.

    Null or empty text has no pieces; a null path has no directories. Long texts are scanned whole. Repeated rows are one
    file. Other columns are not used. An empty table gives no rows.
    """
    spark = files.sparkSession
    scratch = Scratch(spark)
    vocabulary = sorted({t for _, text in TEMPLATES for t in terms(text)})
    text = F.coalesce(col(text_col), F.lit(""))
    base = files.select(col(path_col).alias("path"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))
    listed = F.array(*[F.lit(t) for t in vocabulary])
    counted = base.select(F.explode(F.array_append(F.array_intersect(words("text"), listed), "")).alias("t")).groupBy("t").count().collect()
    df = {r["t"]: r["count"] for r in counted}  # one row per template term; '' counts the texts
    rows, idf, unseen = template_weights(df, df.get("", 0))
    weights = F.broadcast(spark.createDataFrame(rows, "template int, name string, term string, weight double"))
    idfs = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    marked = F.array(*map(F.lit, markers(rows, idf, least)))
    tagged = F.regexp_extract("text", TAG, 1)
    few = base.select("path", "text_key", "text", words("text").alias("__w"), tagged.alias("tag"), F.element_at(F.split("path", "/"), -1).rlike(FILE_NAMES).alias("named"))
    few = scratch.cut(few.where(F.arrays_overlap("__w", marked) | (F.col("tag") != "")).select("path", "text_key", "text", "tag", "named").distinct())
    pieces = few.select("path", "text_key", F.explode(_pieces(F.col("text"))).alias("p")).select("path", "text_key", "p.*")
    pieces = pieces.withColumn("__w", words("x")).where(F.arrays_overlap("__w", marked))
    key = ["path", "text_key", "kind", "at"]
    tf = (
        pieces.select(*key, F.explode("__w").alias("term"))
        .groupBy(*key, "term")
        .count()
        .join(idfs, "term", "left")
        .withColumn("w", F.col("count") * F.coalesce("idf", F.lit(unseen)))
    )
    tf = scratch.cut(tf.select(*key, "term", "w"))
    norms = tf.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.join(weights, "term").groupBy(*key, "template", "name").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    same = [dots[k].eqNullSafe(norms[k]) for k in key]
    scored = dots.join(norms, same).select(*[dots[k] for k in key], "template", "name", F.round(F.col("dot") / F.col("norm"), 9).alias("score"))
    best = scored.where(F.col("score") >= least).groupBy(*key).agg(F.max(F.struct("score", -F.col("template"), "name")).alias("b"))
    whole = F.max(F.when(F.col("kind") == "whole", F.col("b.score")))
    own = best.groupBy("path", "text_key").agg(
        F.max("b").alias("b"), F.count(F.when(F.col("kind") == "line", 1)).alias("n_lines"), (whole >= WHOLE).alias("all")
    )
    match = [few["path"].eqNullSafe(own["path"]), few["text_key"] == own["text_key"]]
    has_tag = F.col("tag") != ""
    hits = few.join(own, match, "left").where(has_tag | F.col("b").isNotNull())
    hits = scratch.cut(
        hits.select(
            few["path"],
            few["text_key"],
            F.when(has_tag, F.col("tag")).otherwise(F.col("b.name")).alias("license"),
            F.when(has_tag, F.lit(1.0)).otherwise(F.col("b.score")).alias("score"),
            F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
            (F.coalesce("named", F.lit(False)) | F.coalesce("all", F.lit(False))).alias("licence_file"),
        )
    )
    every = base.select("path", "text_key").distinct()
    small = F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits
    found = every.join(small, [every["path"].eqNullSafe(hits["path"]), every["text_key"] == hits["text_key"]], "left")
    found = scratch.cut(
        found.select(
            every["path"], every["text_key"], "license", "score", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("licence_file", F.lit(False)).alias("licence_file")
        )
    )
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    speaking = (
        found.where("licence_file and path is not null")
        .select(F.element_at(above, -1).alias("dir"), "license", "score", "path")
        .groupBy("dir")
        .agg(F.max(F.struct("score", "license", "path")).alias("d"))
    )
    silent = found.where("license is null and path is not null").select("path", "text_key", F.posexplode(above).alias("depth", "dir"))
    # how many files a directory's licence meets: a directory may hold any share of all
    speaking = scratch.cut(silent.groupBy("dir").agg(F.count("*").alias("n")).join(speaking, "dir"))
    heirs = met(silent, speaking, ["dir"], "n").groupBy("path", "text_key").agg(F.max(F.struct("depth", "d.license", "d.score")).alias("h"))
    out = found.join(heirs, ["path", "text_key"], "left")
    return out.select(
        "path",
        "text_key",
        F.coalesce("license", "h.license").alias("license"),
        F.coalesce("score", "h.score").alias("score"),
        F.when(F.col("license").isNotNull(), F.when(F.col("licence_file"), "file").otherwise("header"))
        .when(F.col("h").isNotNull(), "inherited")
        .alias("origin"),
        "n_lines",
        "licence_file",
    )


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files source/lang/doc_id, which are distinct paths."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))
    out = scan_licenses(docs.select(path.alias("path"), "text"))
    return out.select(
        F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "path", "license", "score", "origin", "n_lines", "licence_file"
    )
