"""Exact nearest vectors by cosine, with partitions that a query need not open.

The store is cut once around pivots, a bounded sample of its vectors: each vector belongs
to its nearest pivot, and a partition's radius is the largest angle between the two. By
the triangle inequality for angles, no vector of a partition is nearer to a query than the
angle to its pivot less the radius. Queries visit partitions in rounds, the most promising
first; after each round the k-th similarity so far closes partitions that can't reach it.
A visit sends the query to the partition, never the store to the query.

Null, empty and zero vectors and those that hold null or non-finite components take no
part, nor do null keys or vectors of another length than most of the store; queries among
them get no rows. Equal similarities go to the smaller key. An empty side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.scratch import written

#: Vectors around a pivot, on average, and pivots at most; what fits in one block has one pivot.
PIVOT_ROWS, MOST_PIVOTS = 512, 1024
#: Rows of a partition, and visitors to it, that meet in one task.
BLOCK_ROWS = 4096
#: Places in a query's order of partitions at which rounds end; the last takes all that are left.
ROUNDS = (2, 16, MOST_PIVOTS)
#: Angles and similarities closer than this count as equal in leaving partitions out.
SLACK = 1e-6


def usable(x: Column) -> Column:
    """A vector with a direction: not null, empty or zero, all components finite numbers."""
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


@dataclass(frozen=True)
class Partitions:
    """Stored vectors (``id``, ``v``, ``part``), the pivots, and each partition's radius and rows."""

    rows: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    count: np.ndarray

    @property
    def length(self) -> int:
        return self.pivots.shape[1]


def partition(store: DataFrame, key: str, vector: str) -> Partitions | None:
    """Cut the store around pivots; None if it has no usable vector."""
    rows = store.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    size = F.size("v")
    most = rows.groupBy(size.alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    if most is None:
        return None
    rows = rows.where(size == most.length)
    few = rows.orderBy(F.xxhash64("id"), "id", "v").limit(min(MOST_PIVOTS, -(-most.n // PIVOT_ROWS)) if most.n > BLOCK_ROWS else 1).select("v").toArrow()
    pivots = _unit(few.column("v"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angle = _angles(_unit(batch.column("v")), pivots)
                near = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(angle[np.arange(len(near)), near])], ["id", "v", "part", "angle"])

    placed = written(rows.mapInArrow(assign, "id long, v array<double>, part int, angle double"), "partitions")
    found = placed.groupBy("part").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    radius, count = np.full(len(pivots), -1.0), np.zeros(len(pivots), np.int64)
    for r in found:
        radius[r.part], count[r.part] = r.radius, r.n
    return Partitions(placed.drop("angle"), pivots, radius, count)


def _visits(queries: DataFrame, index: Partitions, begin: int, end: int) -> DataFrame:
    """The partitions, from place ``begin`` to ``end`` of each query's order, that may still change its answer."""
    pivots, radius, count = index.pivots, index.radius, index.count

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            angle = _angles(_unit(batch.column("v")), pivots)
            least = np.where(count > 0, np.maximum(angle - radius, 0), np.inf)
            order = np.lexsort((angle, least), axis=1)[:, begin:end]
            reach = np.arccos(np.clip(batch.column("kth").to_numpy(), -1, 1))[:, None] + SLACK
            open_ = np.take_along_axis(least, order, 1) <= reach
            who, which = np.nonzero(open_)
            rows = batch.take(pa.array(who))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(order[who, which], pa.int32())], ["id", "v", "kth", "part"])

    return queries.mapInArrow(visit, "id long, v array<double>, kth double, part int")


def _best_in_block(k: int, skip_own: bool):
    def best(asking: pa.Table, stored: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query", "id", "similarity"])
        if not asking.num_rows or not stored.num_rows:
            return empty
        stored = stored.sort_by("id")
        q, s = asking.column("id").to_numpy(), stored.column("id").to_numpy()
        similarity = _unit(asking.column("v")) @ _unit(stored.column("v")).T
        if skip_own:
            similarity[q[:, None] == s] = -np.inf
        order = np.argsort(-similarity, axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(similarity, order, 1)
        who, place = np.nonzero((value > -np.inf) & (value >= asking.column("kth").to_numpy()[:, None] - SLACK))
        return pa.table([q[who], s[order[who, place]], value[who, place]], ["query", "id", "similarity"])

    return best


def search(index: Partitions, queries: DataFrame, k: int, query_key: str, vector: str, skip_own: bool = False) -> tuple[DataFrame, list[int]]:
    """The k best (query, id, similarity) of each query, and how many partitions were visited in each round."""
    rows = queries.select(F.col(query_key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = written(rows.where(F.col("id").isNotNull() & usable(F.col("v")) & (F.size("v") == index.length)), "queries")
    spark, made = asked.sparkSession, []
    best = spark.createDataFrame([], "query long, id long, similarity double")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    for begin, end in zip((0, *ROUNDS[:-1]), ROUNDS, strict=True):
        if begin >= len(index.pivots):
            break
        kth = best.groupBy("query").agg(F.min("similarity").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
        state = asked.join(kth.select(F.col("query").alias("id"), "kth"), "id", "left").select("id", "v", F.coalesce("kth", F.lit(-1.0)).alias("kth"))
        visits = written(_visits(state, index, begin, end), "visits")
        counts = visits.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per partition at most
        made.append(sum(r.n for r in counts))
        if not counts:
            break
        shape = [(r.part, -(-int(index.count[r.part]) // BLOCK_ROWS), -(-r.n // BLOCK_ROWS)) for r in counts]
        shapes = F.broadcast(spark.createDataFrame(shape, "part int, blocks int, crowds int"))  # at most MOST_PIVOTS rows
        part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        asking = visits.join(shapes, "part").withColumn("crowd", part("crowds")).withColumn("block", every("blocks")).drop("blocks", "crowds")
        stored = index.rows.join(shapes, "part").withColumn("block", part("blocks")).withColumn("crowd", every("crowds")).drop("blocks", "crowds")
        keys = ["part", "block", "crowd"]
        met = asking.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(_best_in_block(k, skip_own), "query long, id long, similarity double")
        ranked = best.unionByName(met).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
        best = written(ranked, "best")
    return best, made


def nearest(queries: DataFrame, store: DataFrame, k: int, query_key: str = "query_id", key: str = "vec_id", vector: str = "embedding", skip_own: bool = False) -> DataFrame:
    """(query, key, similarity, rank) of the k most similar stored vectors, by cosine.

    With ``skip_own``, a stored row with the query's own id is not an answer.
    """
    index = partition(store, key, vector)
    if index is None:
        return queries.sparkSession.createDataFrame([], f"{query_key} long, {key} long, similarity double, rank int")
    best, _ = search(index, queries, k, query_key, vector, skip_own)
    order = Window.partitionBy(query_key).orderBy(F.desc("similarity"), key)
    return best.select(F.col("query").alias(query_key), F.col("id").alias(key), "similarity").withColumn("rank", F.row_number().over(order))


def nearest_with(queries: DataFrame, store: DataFrame, k: int, flag: str, rounds: int = 1, widen: int = 3, query_key: str = "query_id", key: str = "vec_id", vector: str = "embedding", skip_own: bool = False) -> DataFrame:
    """(query, key, similarity, rank): the first k flagged ones among a query's ``widen * k`` nearest.

    With more rounds, queries that have fewer than k go on, ``widen`` times as deep each
    time; the others are not searched again. A null flag is false. Keys are unique.
    """
    empty = queries.sparkSession.createDataFrame([], f"{query_key} long, {key} long, similarity double")
    index = partition(store, key, vector)
    marked = store.where(F.col(flag)).select(F.col(key).cast("long").alias(key)).distinct()
    pending, done, depth = queries, empty, k
    for left in reversed(range(rounds if index else 0)):
        depth *= widen
        best, _ = search(index, pending, depth, query_key, vector, skip_own)
        kept = written(best.select(F.col("query").alias(query_key), F.col("id").alias(key), "similarity").join(marked, key, "left_semi"), "flagged")
        full = kept.groupBy(query_key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(query_key)
        done = done.unionByName((kept.join(full, query_key, "left_semi") if left else kept).select(*done.columns))
        pending = pending.join(full, query_key, "left_anti")
        if left and pending.isEmpty():
            break
    order = Window.partitionBy(query_key).orderBy(F.desc("similarity"), key)
    return done.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vote_or_default(queries: DataFrame, found: DataFrame, labels: DataFrame, key: str, label: str, default, query_key: str = "query_id", scale: float = 0.05) -> DataFrame:
    """(query, label, share): the label with the largest exp((s - best) / scale), the nearer one on ties.

    A query without neighbours gets the default with share 0.
    """
    per = Window.partitionBy(query_key)
    weight = F.exp((F.col("similarity") - F.max("similarity").over(per)) / scale)
    votes = found.withColumn("_w", weight).join(labels.select(key, label), key).groupBy(query_key, label).agg(F.sum("_w").alias("_v"), F.min("rank").alias("_first"))
    best = votes.groupBy(query_key).agg(F.max_by(label, F.struct("_v", -F.col("_first"))).alias(label), (F.max("_v") / F.sum("_v")).alias("share"))
    joined = queries.select(query_key).distinct().join(best, query_key, "left")
    return joined.select(query_key, F.when(F.col("share").isNull(), F.lit(default)).otherwise(F.col(label)).alias(label), F.coalesce("share", F.lit(0.0)).alias("share"))


#: What to do where there is no evidence.
FALLBACKS = ("top_facet", "similar_papers")


def fallback_of(value: str | bool | None, store) -> str | None:
    """The named fallback; True means similar papers, which need a store. Anything else is none."""
    value = "similar_papers" if value is True else value
    return None if value not in FALLBACKS or (value == "similar_papers" and store is None) else value
