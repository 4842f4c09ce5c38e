"""Hard negatives: exact inner-product search over candidates in buckets of norms, pruned by the Cauchy-Schwarz bound."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, col, partitions

#: Buckets of norms, at most; labels are dealt to as many groups.
BUCKETS = GROUPS = 16
#: Rows that a bucket of norms has at least, about.
ROWS_A_BUCKET = 4096
#: Anchors that meet a part of the candidates in one task.
ANCHORS = 4096
#: Numbers that a part's vectors have together, about; cells of a score matrix at once.
PART_NUMBERS, CELLS = 4_000_000, 4_000_000
#: Beyond all scores: a vector's squared norm lies below.
LIMIT = 1 << 62


def quantised(df: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> DataFrame:
    """(id, label, q, norm) of the vectors that take part, q of whole numbers; one row per id."""
    vec = col(vec_col)
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    q = F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    square = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = df.where(col(id_col).isNotNull() & label.isNotNull() & vec.isNotNull() & ~bad)
    rows = rows.select(col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), q.alias("q"))
    rows = rows.withColumn("norm", F.sqrt(square)).where(F.col("norm") < float(1 << 31))
    one = rows.groupBy("id").agg(F.min(F.struct("label", "q", "norm")).alias("x"))
    return one.select("id", "x.*")


def _matrix(t: pa.Table, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    column = t.column("q").combine_chunks()
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, "i8")
    flat = column.flatten().to_numpy()
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _best(scores: np.ndarray, want: int) -> np.ndarray:
    """Which cells are among the first of their row: larger first, equal ones from the left; the least number is no score."""
    nothing = scores.dtype.type(-np.inf) if scores.dtype.kind == "f" else np.iinfo(np.int64).min
    if scores.shape[1] <= want:
        return scores > nothing
    edge = np.partition(scores, scores.shape[1] - want, axis=1)[:, [scores.shape[1] - want]]
    over = scores > edge
    equal = (scores == edge) & (edge > nothing)
    return over | equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= want - over.sum(axis=1, keepdims=True))


FOUND = "anchor_id long, positive_id long, id long, score long"
_FOUND = pa.schema([(c, pa.int64()) for c in ("anchor_id", "positive_id", "id", "score")])


def _searcher(want: int, same: bool):
    def search(anchors: pa.Table, part: pa.Table) -> pa.Table:
        if not anchors.num_rows or not part.num_rows:
            return _FOUND.empty_table()
        part = part.sort_by("id")
        ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
        a_ids, a_labels = anchors.column("anchor_id").to_numpy(), anchors.column("label").to_numpy()
        width = max(int(np.diff(t.column("q").combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (anchors, part))
        a, c = _matrix(anchors, width), _matrix(part, width)
        # sums of products are exact as doubles while no norm product passes 2^53; beyond, 64-bit products can't overflow
        if anchors.column("norm").to_numpy().max() * part.column("norm").to_numpy().max() < float(1 << 52):
            a, c = a.astype("f8"), c.astype("f8")
        nothing = -np.inf if a.dtype.kind == "f" else np.iinfo(np.int64).min
        windows = [anchors.column(x).to_pylist() for x in ("positives", "low", "high")]
        most = max(map(len, windows[0]))
        filled = [np.array([[*x, *[gap] * (most - len(x))] for x in w], np.int64) for w, gap in zip(windows, (0, 1, 0))]
        out, step = [], max(1, CELLS // len(ids))
        for s in range(0, len(a), step):
            e = slice(s, s + step)
            scores = a[e] @ c.T
            ok = (a_labels[e, None] == labels) == same
            ok &= a_ids[e, None] != ids
            for j in range(most):
                pos, low, high = (x[e, j] for x in filled)
                inside = np.where(ok & (scores >= low[:, None]) & (scores <= high[:, None]), scores, scores.dtype.type(nothing))
                r, k = np.nonzero(_best(inside, want))
                out.append((a_ids[e][r], pos[r], ids[k], inside[r, k].astype(np.int64)))
        return pa.table([np.concatenate(x) for x in zip(*out)], schema=_FOUND)

    return search


def _first(found: DataFrame, want: int) -> DataFrame:
    w = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= want)


def _search(queries: DataFrame, parts: DataFrame, sizes: list, want: int, same: bool, scratch: Scratch) -> DataFrame | None:
    """(anchor_id, positive_id, id, score, rank): the first ``want`` candidates in each window of each anchor.

    queries: (anchor_id, label, q, norm, positives, low, high), arrays with an entry for each window. sizes: (group, bucket,
    parts, largest norm). Buckets are searched in rounds by falling norm; an anchor goes on to a bucket only while its norm
    times the bucket's largest reaches a window's lower limit and that window's last place so far.
    """
    spark = queries.sparkSession
    n = queries.count()
    if not n or not sizes:
        return None
    blocks = n // ANCHORS + 1
    queries = queries.withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int"))
    state, start, last = None, 0, max(s[1] for s in sizes)
    while start <= last:
        end = min(last, 3 * start + 1) if start else 0
        now = [s for s in sizes if start <= s[1] <= end]
        start = end + 1
        if not now:
            continue
        asked = queries
        floor = F.col("low")
        if state is not None:  # a window with all its places taken asks for more than its last score, or as much
            kth = state.where(F.col("rank") == want).select("anchor_id", F.struct("positive_id", "score").alias("x"))
            kth = kth.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list("x")).alias("__kth"))  # a window each, few
            asked = asked.join(kth, "anchor_id", "left")
            floor = F.transform(F.arrays_zip("positives", "low"), lambda x: F.greatest(x["low"], F.coalesce(F.try_element_at("__kth", x["positives"]), x["low"])))
        asked = asked.withColumn("__least", F.array_min(floor).cast("double"))
        table = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(k).alias("bucket"), F.lit(m).alias("m"), F.lit(top).alias("top")) for g, k, m, top in now])  # at most GROUPS x BUCKETS
        mine = F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int")
        near = lambda x: F.col("norm") * x["top"] * (1 + 1e-9) + 1 >= F.col("__least")
        go = F.filter(table, lambda x: near(x) & (x["group"] == mine) if same else near(x))
        asked = asked.withColumn("x", F.explode(go)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("x.m") - 1)))
        asked = asked.select("block", "x.group", "x.bucket", "part", "anchor_id", "label", "q", "norm", "positives", "low", "high")
        these = parts.where(F.col("bucket").between(now[0][1], end))
        these = these.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else these.withColumn("block", F.lit(0))
        key = ["block", "group", "bucket", "part"]
        found = asked.groupBy(*key).cogroup(these.groupBy(*key)).applyInArrow(_searcher(want, same), FOUND)
        if state is not None:
            found = found.unionByName(state.drop("rank"))
        state = scratch.cut(_first(found, want))
    return state


def hard_negatives(
    df: DataFrame,
    anchor: Callable[[Column], Column],
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 5,
    low_percent: int = 80,
    high_percent: int = 100,
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for whose id ``anchor`` holds.

    Scores are inner products of vectors of floor(scale x), larger first, then by smaller id. An anchor's positives are its
    first other rows of its label; a negative has another label and a score from low_percent to high_percent of the
    positive's. All anchors are compared with all rows, in blocks, but for buckets that no window can reach. Labels are
    whole numbers. Rows with a null id, label, vector or component, a component that is no finite number, or a
    norm of 2^31 or more after scaling take no part. Rows with one id are one (the smallest label, then vector). Shorter
    vectors end in zeros; empty ones are zero. Negative positive scores leave no negatives. An empty table, or one without
    anchors, gives no rows. Other columns are not used.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = scratch.cut(quantised(df, id_col, vec_col, col("label") if label is None else label, scale))
    total, width = rows.agg(F.count("*"), F.max(F.size("q"))).first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not total:
        return empty
    buckets = max(1, min(BUCKETS, total // ROWS_A_BUCKET))
    edges = rows.agg(F.percentile_approx("norm", F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), F.lit(10_000))).first()[0] if buckets > 1 else []
    at = F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))), lambda e: e > F.col("norm"))) if edges else F.lit(0)  # 0: the largest norms
    parts = rows.withColumns({"bucket": at.cast("int"), "group": F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int")})
    held = parts.groupBy("group", "bucket").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()  # at most GROUPS x BUCKETS
    room = max(min(256, ROWS_A_BUCKET), min(total // (2 * partitions(spark)), PART_NUMBERS // max(1, width)))
    sizes = sorted(((r["group"], r["bucket"], -(-r["n"] // room), r["top"]) for r in held), key=lambda s: (s[1], s[0]))
    pieces = F.element_at(F.create_map(*[F.lit(x) for g, b, m, _ in sizes for x in (g * BUCKETS + b, m)]), F.col("group") * BUCKETS + F.col("bucket"))
    parts = parts.withColumn("part", F.pmod(F.xxhash64("id"), pieces).cast("int"))
    chosen = scratch.cut(rows.where(anchor(F.col("id"))))
    whole = {"positives": F.array(F.lit(0).cast("long")), "low": F.array(F.lit(-LIMIT).cast("long")), "high": F.array(F.lit(LIMIT).cast("long"))}
    near = _search(chosen.withColumnRenamed("id", "anchor_id").withColumns(whole), parts, sizes, positives, True, scratch)
    if near is None:
        return empty
    # shares of whole hundreds and of the rest, so that nothing overflows
    share = lambda percent, up: F.expr(f"(score - pmod(score, 100)) div 100 * {percent} + (pmod(score, 100) * {percent} + {up}) div 100")
    window = F.struct(F.col("id").alias("p"), share(low_percent, 99).alias("l"), share(high_percent, 0).alias("h"))
    windows = near.withColumn("w", window).where("w.l <= w.h").groupBy("anchor_id").agg(F.collect_list("w").alias("w"))  # ``positives`` each
    asked = chosen.withColumnRenamed("id", "anchor_id").join(windows, "anchor_id")
    asked = scratch.cut(asked.select("anchor_id", "label", "q", "norm", F.col("w.p").alias("positives"), F.col("w.l").alias("low"), F.col("w.h").alias("high")))
    far = _search(asked, parts, sizes, negatives, False, scratch)
    if far is None:
        return empty
    positive = near.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(positive, ["anchor_id", "positive_id"]).select(*empty.columns)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, lambda i: i % 100 == 0, label=label)


OP13_SQL = """with e as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings where label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id as a, b.id as b, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score from e a join e b on a.id % 100 = 0 and a.id <> b.id),
p as (select a, b, score from s where same qualify row_number() over (partition by a order by score desc, b) <= 5),
n as (select p.a, p.b, s.b as n, p.score as ps, s.score as ns, row_number() over (partition by p.a, p.b order by s.score desc, s.b) as r
  from p join s on s.a = p.a and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score)
select a as anchor_id, b as positive_id, r::int as rank, n as negative_id, ps as positive_score, ns as negative_score from n where r <= 5"""
