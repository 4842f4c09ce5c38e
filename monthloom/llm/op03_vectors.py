"""Embedding near-dedup by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, col, connected_components, met, partitions

#: Random sign bits in each order's key.
BITS = 32
#: Orders are as many as meet a pair at the threshold with this probability (see passes). A label that asks for more than
#: MANY_PASSES is compared whole instead, if that takes no more comparisons.
RECALL, MANY_PASSES = 0.99, 64
#: Share of a label's vectors whose surroundings are thinner than those that its orders are chosen for.
DENSE = 0.98
#: A row is compared with at least so many rows after it in each order, at most with twice as many.
WINDOW = 512
#: Rows of an order that one task compares (with WINDOW rows of the next).
BLOCK = 2048
#: Members of a component that are compared at once when its links are counted.
PART = 1024


def _unit(vectors: pd.Series) -> np.ndarray:
    """Vectors of length 1; the largest component is made 1 first, so that no square over- or underflows."""
    x = np.stack(vectors.to_numpy()).astype("f8")
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def passes(n: int, mean_cosine: float, bits: float, threshold: float, window: int) -> int:
    """Orders for a label of n vectors with this mean cosine, most of which need no more than these bits.

    A pair at the threshold meets in an order if its keys agree in as many bits as leave a window of rows. A bit
    agrees with 1 - angle / pi, for other pairs at the mean cosine; where vectors cluster more bits are needed, as many
    as measured. One order is enough where a window holds all.
    """
    if n <= window:
        return 1
    agree = lambda c: 1 - math.acos(min(1.0, max(-1.0, c))) / math.pi
    others = min(agree(mean_cosine), 0.95)
    once = agree(threshold) ** min(BITS, max(bits, math.log(n / window) / -math.log(others)))
    return math.ceil(math.log(1 - RECALL) / math.log1p(-once)) if once < 1 else 1


def _first_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors with their keys in the first order."""
    for df in batches:
        for keys in _keys(iter([df.assign(turns=1)])):
            yield keys[["label", "dim", "h"]].assign(vector=df["vector"].loc[keys.index])


def _needed_bits(window: int, threshold: float):
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(label, dim, bits, n): bits of one more than rows a window apart have in common, over an order's sorted batches.

        Rows that are linked with the row a window ahead lie in a group of near copies, whose members meet whatever the
        order; they ask for no more bits.
        """
        for df in batches:
            near, far = df.iloc[:-window].reset_index(drop=True), df.iloc[window:].reset_index(drop=True)
            same = (near["label"] == far["label"]) & (near["dim"] == far["dim"])
            for (label, d), at in near[same].groupby(["label", "dim"]).groups.items():
                apart = (_unit(near["vector"].loc[at]) * _unit(far["vector"].loc[at])).sum(axis=1) < threshold
                differ = (near["h"].loc[at].to_numpy() ^ far["h"].loc[at].to_numpy())[apart]
                bits = np.minimum(BITS, BITS - np.floor(np.log2(np.maximum(differ, 0.5))).astype("i4"))
                kinds, n = np.unique(np.concatenate([bits, np.zeros((~apart).sum(), "i4")]), return_counts=True)
                yield pd.DataFrame({"label": label, "dim": np.int32(d), "bits": kinds.astype("i4"), "n": n.astype("i8")})

    return measure


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(label, dim, n, at, x): number and components of the sum of unit vectors, by label and length, of a batch."""
    for df in batches:
        for (label, d), part in df.groupby(["label", "dim"]):
            x = _unit(part["vector"]).sum(axis=0)
            yield pd.DataFrame({"label": label, "dim": np.int32(d), "n": np.int64(len(part)), "at": np.arange(int(d), dtype="i4"), "x": x})


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per vector and pass: the signs of BITS random projections, most significant first."""
    planes: dict[tuple[int, int], np.ndarray] = {}
    for df in batches:
        for (d, turns), part in df.groupby(["dim", "turns"]):
            h = np.empty((len(part), turns), "i8")
            x = _unit(part["vector"])
            for t in range(turns):
                if (d, t) not in planes:
                    planes[(d, t)] = np.random.Generator(np.random.PCG64([3, int(d), t])).standard_normal((int(d), BITS))
                h[:, t] = (x @ planes[(d, t)] > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype="i8"))
            yield pd.DataFrame(
                {
                    "node": part["node"].repeat(turns),
                    "turn": np.tile(np.arange(turns, dtype="i4"), len(part)),
                    "label": part["label"].repeat(turns),
                    "dim": np.int32(d),
                    "h": h.ravel(),
                }
            )


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable by the edges (a, b) from each of n places."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def _linker(threshold: float, window: int):
    def link(group: pd.DataFrame) -> pd.DataFrame:
        """Edges that join what is linked in one block: rows within the window, same pass, label and length."""
        group = group.sort_values("place")
        nodes, out = group["node"].to_numpy(), []
        for _, rows in group.assign(at=np.arange(len(group))).groupby(["turn", "label", "dim"], sort=False):
            at, x, place = rows["at"].to_numpy(), _unit(rows["vector"]), rows["place"].to_numpy()
            piece, edges = place // window, []
            for p in np.unique(piece):
                i, j = np.flatnonzero(piece == p), np.flatnonzero((piece == p) | (piece == p + 1))
                a, b = np.nonzero(x[i] @ x[j].T >= threshold)
                edges.append((i[a], j[b]))
            a, b = (np.concatenate([e[k] for e in edges]) for k in (0, 1))
            root = _roots(len(x), a, b)
            own = np.flatnonzero(root != np.arange(len(x)))
            out.append(pd.DataFrame({"a": nodes[at[own]], "b": nodes[at[root[own]]]}))
        return pd.concat(out)

    return link


def _whole(threshold: float):
    def link(group: pd.DataFrame) -> pd.DataFrame:
        """Edges that join what is linked between two parts of a label."""
        one, two = (group[group["part"] == group[c].iloc[0]] for c in ("lo", "hi"))
        if not len(one) or not len(two):
            return pd.DataFrame({"a": [], "b": []}).astype(object)
        a, b = np.nonzero(_unit(one["vector"]) @ _unit(two["vector"]).T >= threshold)
        nodes = np.concatenate([one["node"], two["node"]])
        root = _roots(len(nodes), a, b + len(one))
        own = np.flatnonzero(root != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[own], "b": nodes[root[own]]})

    return link


def _by_two_parts(rows: DataFrame) -> DataFrame:
    """rows (part, parts, ...) once for each other part, with lo and hi, the pair of parts that meets in a task."""
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return spread.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})


def _counter(threshold: float):
    def count(group: pd.DataFrame) -> pd.DataFrame:
        """Links of each node between two parts of a component, each weighted by the copies of the other vector."""
        lo = group["lo"].iloc[0]
        same = lo == group["hi"].iloc[0]
        one = group[group["part"] == lo]
        two = one if same else group[group["part"] != lo]
        if not len(one) or not len(two):
            return pd.DataFrame({"node": [], "links": []}).astype({"links": "i8"})
        hit = _unit(one["vector"]) @ _unit(two["vector"]).T >= threshold
        if same:
            np.fill_diagonal(hit, False)
            return pd.DataFrame({"node": one["node"], "links": hit @ one["copies"].to_numpy()})
        return pd.DataFrame(
            {
                "node": pd.concat([one["node"], two["node"]]),
                "links": np.concatenate([hit @ two["copies"].to_numpy(), hit.T @ one["copies"].to_numpy()]),
            }
        )

    return count


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Rows with equal label and vector are one class with so many copies. Each class gets keys of random sign
    bits, as many as ``passes`` says for the size, mean cosine and density of its label (all measured, the last in one
    order); every pass sorts all classes by (label, key), cuts the order into blocks and compares each class with the
    WINDOW or more that follow it, block edges included. Where so many orders are asked for that comparing all of a label
    takes no more comparisons, all are compared, by pairs of parts. Blocks report only the edges
    of a spanning forest, so a dense group costs no more rows than it has members. Components of the union
    of all passes are then counted exactly: every two members of a component are compared, a large one by
    pairs of parts in separate tasks, which also finds links that no window held.

    A vector that is null, zero, or holds a null or non-finite number, or whose label is null, links with
    nothing; nor do vectors of different lengths. Repeated rows are other vectors, linked with cosine 1.
    Null ids: never the smallest of a component that has others. An empty table gives no rows. Other columns, of
    whatever name, are not used.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    v = col(vector_col)
    as_double = F.transform(v, lambda x: x.cast("double"))
    finite = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = col(label_col).isNotNull() & v.isNotNull() & finite & F.exists(as_double, lambda x: x != 0)
    label = col(label_col).cast("string")
    name = F.md5(F.concat(F.char_length(label).cast("string"), F.lit(":"), label, F.array_join(v.cast("array<string>"), ",")))
    rows = vectors.select(
        col(id_col).alias("vec_id"),
        col(label_col).cast("string").alias("label"),
        v.alias("vector"),
        F.when(F.coalesce(usable, F.lit(False)), F.unhex(name)).alias("node"),
    )
    ids = rows.select("vec_id", "node")
    classes = scratch.cut(
        rows.where("node is not null")
        .groupBy("node")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.min(F.struct("label", "vector")).alias("x"))
        .select("node", "least", "copies", "x.label", "x.vector", F.size("x.vector").alias("dim"))
    )
    order = ["turn", "label", "dim", "h", "node"]
    sums = classes.select("label", "dim", "vector").mapInPandas(_sums, "label string, dim int, n long, at int, x double")
    sums = sums.groupBy("label", "dim", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    kinds = sums.groupBy("label", "dim").agg(F.max("n").alias("n"), F.sum(F.col("x") * F.col("x")).alias("x"))
    window = WINDOW
    ordered = lambda d: d.mapInPandas(_keys, "node binary, turn int, label string, dim int, h long").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    # how dense it is around the vectors, by the rows of one order
    first = classes.select("node", "label", "dim", "vector").mapInPandas(_first_keys, f"label string, dim int, h long, vector {classes.schema['vector'].dataType.simpleString()}")
    first = first.repartitionByRange(partitions(spark), "label", "dim", "h").sortWithinPartitions("label", "dim", "h")
    bits = first.mapInPandas(_needed_bits(window, threshold), "label string, dim int, bits int, n long").groupBy("label", "dim").agg(F.percentile("bits", F.lit(DENSE), F.col("n")).alias("bits"))
    turns = F.udf(lambda n, x, b: passes(n, x / n / n, b, threshold, window), "int")  # once per label, not per row
    kinds = kinds.join(bits, ["label", "dim"], "left").select("label", "dim", "n", turns("n", "x", F.coalesce("bits", F.lit(0.0))).alias("turns"))
    whole = (F.col("turns") > MANY_PASSES) & (F.col("n") <= F.col("turns") * 3 * window)
    kinds = kinds.withColumn("parts", F.when(whole, F.ceil(F.col("n") / PART)).otherwise(0).cast("int"))
    kinds = scratch.cut(kinds.withColumn("turns", F.when(whole, 0).otherwise(F.col("turns"))))
    dealt = scratch.cut(met(classes.select("node", "label", "dim", "vector"), kinds, ["label", "dim"], "n"))
    keys = scratch.cut(ordered(dealt.where("turns > 0").drop("parts")).withColumn("m", F.monotonically_increasing_id()))
    between = _by_two_parts(dealt.where("parts > 0").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))
    between = between.groupBy("label", "dim", "lo", "hi").applyInPandas(_whole(threshold), "a binary, b binary")
    part, index = F.shiftright("m", 33), F.col("m").bitwiseAND((1 << 33) - 1)
    sizes = {r[0]: r[1] for r in keys.groupBy(part.alias("part")).count().collect()}  # one row per partition
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    starts = F.broadcast(spark.createDataFrame(starts, "part long, start long"))
    placed = keys.withColumn("part", part).join(starts, "part").withColumn("place", F.col("start") + index)
    block = F.floor(F.col("place") / BLOCK)
    ahead = (F.col("place") % BLOCK < WINDOW) & (F.col("place") >= BLOCK)
    dealt = placed.join(classes.select("node", "vector"), "node").select(
        "node",
        "turn",
        "label",
        "dim",
        "place",
        "vector",
        F.explode(F.when(ahead, F.array(block, block - 1)).otherwise(F.array(block))).alias("block"),
    )
    edges = scratch.cut(dealt.groupBy("block").applyInPandas(_linker(threshold, window), "a binary, b binary").unionByName(between).distinct())
    scratch.drop(keys)
    parts = scratch.cut(connected_components(edges, scratch))
    sized = parts.groupBy("component").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    members = parts.join(sized, "component").join(classes.select("node", "vector", "copies"), "node")
    members = members.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    spread = _by_two_parts(members.select("component", "node", "vector", "copies", "part", "parts"))
    counted = spread.groupBy("component", "lo", "hi").applyInPandas(_counter(threshold), "node binary, links long")
    links = counted.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "least", "copies").join(parts, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    least = scratch.cut(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    named = scratch.cut(
        met(named, least, ["component"], "n")
        .join(links, "node", "left")
        .select("node", "component_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    out = met(ids, named, ["node"], "copies", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
