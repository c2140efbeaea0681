"""Connected components of a table of links, by star contraction on DataFrames.

Links are first thinned inside each partition to a spanning forest; then alternate
large-star and small-star steps (Kiveris et al., 2014) pull every node to the
smallest of its component. Each round is written to the shared folder, so the lineage
stays short and nothing but a change count reaches the driver. Rounds grow with the
logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import in_few, materialize

MAX_ROUNDS = 60


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that connect the same nodes."""
    nodes, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(which[: len(a)].tolist(), which[len(a) :].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x < y:
            parent[y] = x
        else:
            parent[x] = y
    root = np.array(parent, np.int64)
    while len(root) and (root[root] != root).any():
        root = root[root]
    linked = np.flatnonzero(root != np.arange(len(root)))
    return nodes[linked], nodes[root[linked]]


def spanning(links: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of a matrix of links between ids xs and ys: few are joined one by one,
    many by spreading the least id."""
    i, j = np.nonzero(links)
    if len(i) <= 20 * (len(xs) + len(ys)):
        return forest(xs[i], ys[j])
    own, other, big = xs.copy(), ys.copy(), np.iinfo(np.int64).max
    while True:
        new_own = np.minimum(own, np.where(links, other[None, :], big).min(1))
        new_other = np.minimum(other, np.where(links, new_own[:, None], big).min(0))
        if (new_own == own).all() and (new_other == other).all():
            return forest(np.concatenate([xs, ys]), np.concatenate([own, other]))
        own, other = new_own, new_other


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:  # never more than a forest and a batch in memory
        a = np.concatenate([a, batch.column("src").to_numpy()])
        b = np.concatenate([b, batch.column("dst").to_numpy()])
        a, b = forest(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["src", "dst"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (src > dst) -> links from each neighbour of a node to the smallest of all."""
    if large:
        both = links.select("src", "dst").union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    else:
        both = links
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
    joined = both.join(least, "src")
    if large:
        out = joined.where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    else:
        out = joined.select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(least.select("src", F.col("m").alias("dst")))
    return out.where("src <> dst").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that has a link; component is its smallest node."""
    clean = links.select(F.greatest("src", "dst").cast("long").alias("src"), F.least("src", "dst").cast("long").alias("dst")).where("src <> dst")
    now = materialize(clean.mapInArrow(_thin, "src long, dst long"), "forest")
    now = in_few(now, now.count())
    mark = None
    for _ in range(MAX_ROUNDS):
        now = materialize(_star(_star(now, True), False), "stars")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
        now = in_few(now, new[0])
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
