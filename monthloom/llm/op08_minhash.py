"""Near-duplicate documents by an LSH forest over MinHash signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, col, connected_components, met
from .texthash import shingle_sets

#: Sorted orders, and hashes in each order's key.
TREES, DEPTH = 16, 8
#: Keys that agree on the first of these are a region; for the order alone, regions with more rows than CAP go deeper.
DEPTHS = (4, 6, 8)
#: Rows of a region that are searched in one task; a larger region is searched in so many blocks as it takes.
CAP = 1024
#: Shingles of each side of such a block, about: 16 MB.
BLOCK_SHINGLES = 2_000_000
#: Neighbours on each side of a row in its region that are compared at once.
WINDOW = 4
#: Sets fetched by broadcast ids up to so many (16 bytes each); by shuffle beyond.
BROADCAST_IDS = 300_000

_RNG = np.random.Generator(np.random.PCG64(8))
_FLIP = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)[:, None]
_ODD = (_RNG.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) << np.uint32(1) | np.uint32(1))[:, None]


def signature(shingles: np.ndarray) -> bytes:
    """16 low bits of each MinHash (big end first), tree after tree."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(x), 4096):
        np.minimum(least, ((x[s : s + 4096] ^ _FLIP) * _ODD).min(axis=1), out=least)
    return least.astype(">u2").tobytes()


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signed(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_id, signature); set_id names the shingle set and is null for an empty one."""
    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            sizes, ids, signs = [], [], []
            for x in shingle_sets(texts, width):
                sizes.append(len(x))
                ids.append(_digest(x) if len(x) else None)
                signs.append(signature(x) if len(x) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, "int64"), pa.array(ids, "binary"), pa.array(signs, "binary")],
                names=["doc_id", "text_key", "n_shingles", "set_id", "signature"],
            )

    return docs.select(col(id_col).alias("doc_id"), col(text_col).cast("binary").alias("text"), row_key(id_col, text_col).alias("text_key")).mapInArrow(
        run, f"doc_id {kind}, text_key string, n_shingles long, set_id binary, signature binary"
    )


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits of id and text: what tells rows apart that share an id."""
    return F.md5(F.concat_ws("/", col(id_col).isNull().cast("string"), F.char_length(col(id_col).cast("string")).cast("string"), col(id_col).cast("string"), col(text_col)))


def _sets(docs: DataFrame, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """(set_id, shingles) of the wanted sets, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets([t or b"" for t in batch.column(1).to_pylist()], width))
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(x) for x in sets], "binary"), pa.array([x.view("i8") for x in sets], pa.list_(pa.int64()))],
                names=["set_id", "shingles"],
            )

    few = docs.join(wanted, docs["__id"].eqNullSafe(wanted["__want"]), "left_semi")
    return few.select("__id", col(text_col).cast("binary").alias("text")).mapInArrow(run, "set_id binary, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct (a, b) whose sets reach the similarity."""
    one = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("__a"))
    two = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("__b"))
    both = pairs.join(one, "a").join(two, "b").withColumn("__same", F.size(F.array_intersect("__a", "__b")))
    return both.where(F.col("__same") * 100 >= percent * (F.size("__a") + F.size("__b") - F.col("__same"))).select("a", "b")


def _between(percent: int):
    def links(block: pd.DataFrame) -> pd.DataFrame:
        """Links that join different components: members to probe with against the members to search.

        Sets as similar as asked share one of any |x| - ceil(percent * |x| / 100) + 1 shingles of x, so the rarest
        ones of a probe find all candidates; their intersections are counted on an index from shingles to members.
        A link is reported if it joins what no earlier one joined, so a block reports fewer links than it has
        members. A probe that has joined its region's largest component (null) needs no search: whatever else it
        is linked with is in that component too, or is a probe itself.
        """
        block = block.sort_values(["set_id", "probe"])
        ids, sets = block["set_id"].to_numpy(), block["shingles"].to_numpy()
        part = block["component"].factorize()[0]  # -1: the largest
        sizes = np.array([len(x) for x in sets])
        there = np.flatnonzero(block["searched"].to_numpy(bool))
        if not len(there):
            return pd.DataFrame([], columns=["a", "b"])
        flat, owner = np.concatenate(sets[there]), np.repeat(there, sizes[there])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]

        def owners(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
            return owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]

        out = []
        for i in np.flatnonzero(block["probe"].to_numpy(bool)):
            if part[i] == -1:
                continue
            lo = np.searchsorted(flat, sets[i], "left")
            n = np.searchsorted(flat, sets[i], "right") - lo
            rare = np.argsort(n, kind="stable")[: sizes[i] + (-percent * sizes[i]) // 100 + 1]
            if (part[owners(lo[rare], n[rare])] == part[i]).all():
                continue
            same = np.bincount(owners(lo, n), minlength=len(sets))
            for j in np.flatnonzero((same > 0) & (100 * same >= percent * (sizes + sizes[i] - same)) & (part != part[i])):
                if part[j] != part[i]:
                    into, gone = min(part[i], part[j]), max(part[i], part[j])
                    part[part == gone] = into
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pd.DataFrame(out, columns=["a", "b"])

    return links


def _blocks(region: DataFrame, parts: DataFrame) -> DataFrame:
    """(tree, near, x, y, set_id, component, probe, searched): what is left to search in regions of several components.

    Members outside a region's largest component are searched for among all its members. Where they don't fit
    one block, the former are dealt into x, all into y, and each x meets each y.
    """
    placed = region.join(parts, F.col("set_id") == F.col("node"), "left")
    placed = placed.select("tree", "near", "set_id", "size", F.coalesce("component", "set_id").alias("component"))
    sizes = placed.groupBy("tree", "near", "component").agg(F.count("*").alias("count"), F.sum("size").alias("size"))
    top = sizes.groupBy("tree", "near").agg(
        F.sum("count").alias("n"), F.sum("size").alias("w"), F.max(F.struct("count", "component", "size")).alias("top")
    )
    half = max(1, CAP // 2)
    blocks = lambda n, w: F.greatest(F.ceil(n / half), F.ceil(w / BLOCK_SHINGLES), F.lit(1)).cast("int")
    xs, ys = blocks(F.col("n") - F.col("top.count"), F.col("w") - F.col("top.size")), blocks(F.col("n"), F.col("w"))
    one = (F.col("n") <= CAP) & (F.col("w") <= 2 * BLOCK_SHINGLES)
    top = top.where("n > top.count").select(
        "tree", "near", F.col("top.component").alias("top"), F.when(one, 1).otherwise(xs).alias("xs"), F.when(one, 1).otherwise(ys).alias("ys")
    )
    open_ = placed.join(top, ["tree", "near"]).withColumn("out", F.col("component") != F.col("top"))
    dealt = lambda n, seed: F.pmod(F.xxhash64("set_id", "tree", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    tags = "tree", "near", "set_id", F.when(F.col("out"), F.col("component")).alias("component")
    small = open_.where("xs = 1 and ys = 1").select(*tags, F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("out").alias("probe"), F.lit(True).alias("searched"))
    large = open_.where("xs > 1 or ys > 1")
    probes = large.where("out").select(*tags, dealt("xs", 1).alias("x"), F.explode(every("ys")).alias("y"), F.lit(True).alias("probe"), F.lit(False).alias("searched"))
    others = large.select(*tags, F.explode(every("xs")).alias("x"), dealt("ys", 2).alias("y"), F.lit(False).alias("probe"), F.lit(True).alias("searched"))
    return small.unionByName(probes).unionByName(others)


def near_duplicates(
    docs: DataFrame, percent: int = 85, width: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row; see grouped for how."""
    return grouped(docs, percent, width, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(
    docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of docs, with all columns, of which one stays for each group of near-duplicates.

    It is the one with the smallest id (null ids last; then by hash of id and text). Rows are told apart by id and
    text, so different texts under one id are different documents; of rows equal in both, one stays, any of them.
    Texts without words are no one's duplicates and stay, repeated rows included. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.cut(grouped(docs, percent, width, id_col, text_col).groupBy("text_key").agg(
        F.count("*").alias("rows"), F.min("stays").alias("stays"), F.max("n_shingles").alias("words")
    ))
    names = docs.columns
    rows = docs.select(*[col(c).alias(f"__c{i}") for i, c in enumerate(names)], row_key(id_col, text_col).alias("text_key"))
    gone = scratch.cut(found.where("not stays").select("text_key", "rows"))
    rows = met(rows, gone, ["text_key"], "rows", "left_anti")
    again = scratch.cut(found.where("stays and rows > 1 and words > 0").select("text_key", "rows"))
    if not again.isEmpty():
        one = met(rows, again, ["text_key"], "rows", "left_semi").dropDuplicates(["text_key"])
        rows = met(rows, again, ["text_key"], "rows", "left_anti").unionByName(one)
    return rows.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)])


def grouped(docs: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept, stays), one row per input row.

    stays: whether the row is the one of its group that has the smallest id (null last), then the smallest text_key.

    A document is the set of its ``width``-word shingles (lower-cased ASCII; all words if fewer). Documents
    with equal sets are one class. Each class has a key in each of TREES sorted orders; classes whose keys
    share a prefix form a region, however many. Neighbours in a region's order are compared on their full
    sets; for this order alone, a region with more than CAP classes is divided by a longer prefix, at the
    full key by a salt that differs by tree. In such a region all classes are also compared with the one
    that has most links so far. Regions that then still hold more than one component are searched whole, in
    blocks: classes outside the largest component against all, on their full sets, at most about BLOCK_SHINGLES shingles to a side. So
    within a region no link between components is missed. A region costs rows in proportion to its classes, and beyond CAP
    also to those times the classes outside the largest component, over CAP / 2.

    Null or empty text, or no words: size 0, linked with nothing. Repeated rows share a class. A component
    without any id has a null component_id. An empty table gives an empty result; other columns are unused.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.cut(_signed(docs, id_col, text_col, width))
    classes = rows.where("set_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("least"),
        F.min("signature").alias("signature"),
        F.max("n_shingles").alias("size"),
        F.count("*").alias("rows"),
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")).alias("first"),
    )
    classes = scratch.cut(classes)
    step = 2 * DEPTH
    keys = classes.select(
        "set_id",
        "size",
        F.posexplode(F.array(*[F.substring("signature", 1 + step * t, step) for t in range(TREES)])).alias("tree", "key"),
    )
    # the shallowest prefix that keeps a region within CAP; regions of one row are of no use
    near = F.substring("key", 1, 2 * DEPTHS[0])
    keyed = keys.select("set_id", "size", "tree", "key", near.alias("near"))
    crowd = keyed.groupBy("tree", "near").count().where("count > 1")
    region = keyed = scratch.cut(keyed.join(crowd, ["tree", "near"]))
    for d, deeper in zip(DEPTHS, [*DEPTHS[1:], None]):
        full = keyed.where(F.col("count") > CAP).select("tree", "near", "count").distinct()
        if full.isEmpty():
            break
        if deeper:
            name = F.when(F.col("count") > CAP, F.substring("key", 1, 2 * deeper)).otherwise(F.col("near"))
        else:
            salt = F.pmod(F.xxhash64("set_id", "tree"), F.ceil(F.col("count") / CAP).cast("long"))
            name = F.when(F.col("count") > CAP, F.concat("near", salt.cast("string").cast("binary"))).otherwise(F.col("near"))
        again = keyed.select("set_id", "tree", "key", name.alias("near"))
        before, keyed = keyed, scratch.cut(again.join(again.groupBy("tree", "near").count().where("count > 1"), ["tree", "near"]))
        if before is not region:
            scratch.drop(before)
    order = Window.partitionBy("tree", "near").orderBy("key", "set_id")
    beside = keyed.select("set_id", *[F.lag("set_id", k).over(order).alias(f"b{k}") for k in range(1, WINDOW + 1)])
    beside = beside.select("set_id", F.explode(F.array(*[f"b{k}" for k in range(1, WINDOW + 1)])).alias("b"))
    pairs = scratch.cut(
        beside.where("b is not null").select(F.least("set_id", "b").alias("a"), F.greatest("set_id", "b").alias("b")).distinct()
    )
    # the text of one document of each wanted class: rows with that class's least id
    source = docs.select(col(id_col).alias("__id"), col(text_col))
    ids = region.select("set_id").distinct()
    wanted = scratch.cut(classes.join(ids, "set_id").select(F.col("least").alias("__want")).distinct())
    found = _sets(source, text_col, width, F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted)
    sets = scratch.cut(found.dropDuplicates(["set_id"]))
    links = scratch.cut(_confirmed(pairs, sets, percent))
    parts = scratch.cut(connected_components(links, scratch))
    full = region.where(F.col("count") > CAP).select("set_id", "tree", "near")
    if not full.isEmpty():
        # the middle of a star is a neighbour of few, but linked with most of those
        degree = links.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count("*").alias("links"))
        hubs = full.join(degree, "set_id").groupBy("tree", "near").agg(F.max(F.struct("links", "set_id"))["set_id"].alias("hub"))
        pairs = full.join(hubs, ["tree", "near"]).where("set_id <> hub")
        pairs = pairs.select(F.least("set_id", "hub").alias("a"), F.greatest("set_id", "hub").alias("b")).distinct()
        links = scratch.cut(links.unionByName(_confirmed(pairs, sets, percent)))
        parts = scratch.cut(connected_components(links, scratch))
    # regions with several components: whatever this did not settle; the smallest ones are all neighbours
    left = scratch.cut(_blocks(region.where(F.col("count") > min(CAP, WINDOW + 1)), parts))
    found = left.join(sets, "set_id").groupBy("tree", "near", "x", "y").applyInPandas(_between(percent), "a binary, b binary")
    more = scratch.cut(found.distinct())
    if not more.isEmpty():
        parts = scratch.cut(connected_components(links.unionByName(more), scratch))
    named = classes.select("set_id", "least", "rows", "first").join(parts, F.col("set_id") == F.col("node"), "left")
    named = scratch.cut(named.select("set_id", "least", "rows", "first", F.coalesce("component", "set_id").alias("component")))
    least = named.groupBy("component").agg(
        F.count("*").alias("classes"), F.min("least").alias("component_id"), F.min("first").alias("one")
    )
    named = met(named.select("set_id", "rows", "component"), scratch.cut(least), ["component"], "classes")
    named = scratch.cut(named.select("set_id", "component_id", "one", "rows"))
    out = met(rows.drop("signature"), named, ["set_id"], "rows", "left").select(
        "doc_id",
        "text_key",
        "n_shingles",
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("set_id").isNull() | (F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("text_key") == F.col("one.text_key")))).alias("stays"),
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
