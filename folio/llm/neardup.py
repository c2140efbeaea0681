"""Embedding near-duplicates within a label: PCA-ordered tiled comparison.

Vectors are rotated to their principal axes (a rotation keeps every cosine), largest
second moment first. Two unit vectors with cosine t are at most sqrt(2 - 2 t) apart, on
every axis, so the axes on which the vectors spread most cut a label into cells of
that width: only vectors of the same or of touching cells can link, and pairs of other
cells never meet. Cells are cut into tiles of bounded size by hash, and every pair of
tiles of touching cells is one group of a grouped map. There, products of the leading
axes are summed first; what the remaining axes can add is at most the product of the
two suffix norms, so most pairs stop after a few axes, and only the rest go on.
Cosines within ``CLOSE`` of the threshold are taken again from the vectors as given.

Equal vectors of a label are one row with a weight, so copies cost nothing. A tile
pair returns link counts per row and a spanning forest of its links, never all links.

Null labels, null or zero vectors and those with null or non-finite components link
with nothing; nor do vectors of different length. Extra columns are ignored. Repeated
ids count as separate rows with the same id, each with the links of its own vector. A
null id is a row like others and counts as larger than any in choosing the smallest.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.components import components, forest, spanning
from folio.llm.shared import materialize

THRESHOLD = 0.93
#: Rows in a tile, on average.
TILE_ROWS = 2048
#: Axes that cut a label into cells; each vector has up to 3 ** CELL_AXES touching cells.
CELL_AXES = 3
#: Axes after which pairs are dropped; the last step has all.
STEPS = (8, 16, 32)
#: Rows compared with a tile at once.
CHUNK = 512
CLOSE = 1e-9

PAIR_SCHEMA = "node long, other long, n_links long"


def usable(embedding: str = "embedding", label: str = "label"):
    """A vector that can link: labelled, not zero, all components finite numbers."""
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(F.col(label).isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class Axes:
    """A rotation (columns, by second moment) and those of its axes with most variance."""

    rotation: np.ndarray
    cut: np.ndarray


def principal_axes(vectors: DataFrame) -> dict[int, Axes]:
    """By vector length, axes in order of their second moment.

    Tasks return sums of products, d * d + d numbers each; the driver gets their total.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for d in np.unique(sizes).tolist():
                x = _unit(_matrix(batch.column("embedding").filter(pa.array(sizes == d))))
                x = np.column_stack([x, np.ones(len(x))])
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, d), pa.int32()), pa.array(np.arange(m.size), pa.int32()), pa.array(m.ravel())], ["dim", "cell", "value"])

    cells = vectors.select("dim", "embedding").mapInArrow(moments, "dim int, cell int, value double").groupBy("dim", "cell").agg(F.sum("value").alias("value")).toPandas()
    axes = {}
    for d, own in cells.groupby("dim"):
        m = np.zeros((d + 1) * (d + 1))
        m[own["cell"].to_numpy()] = own["value"].to_numpy()
        m = m.reshape(d + 1, d + 1)
        n, mean, m = m[d, d], m[d, :d] / m[d, d], m[:d, :d]
        moment, rotation = np.linalg.eigh((m + m.T) / 2)
        moment, rotation = moment[::-1], rotation[:, ::-1].copy()
        spread = moment / n - (mean @ rotation) ** 2
        axes[int(d)] = Axes(rotation, rotation[:, np.argsort(-spread, kind="stable")[:CELL_AXES]].copy())
    return axes


def with_cells(reps: DataFrame, axes: dict[int, Axes], threshold: float) -> DataFrame:
    """Add ``cell``, the place of each vector on the cutting axes in steps of the largest distance of a link."""
    step = float(np.sqrt(max(2 - 2 * threshold, 0.0))) + 1e-6
    names = [*reps.columns, "cell"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            cells = np.zeros((batch.num_rows, CELL_AXES), np.int32)
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                at = _unit(_matrix(batch.column("embedding").take(pa.array(own)))) @ axes[d].cut
                cells[own, : at.shape[1]] = np.floor(at / step)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), CELL_AXES).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reps.schema) + ", cell array<int>"
    return reps.mapInArrow(place, schema)


def tile_pairs(placed: DataFrame, tile_rows: int) -> DataFrame:
    """(label, dim, cell, tile, one, two): the tile pairs that the rows of each tile take part in.

    It is made of one row per cell and tile, never of vectors. ``one`` and ``two`` name
    tiles by cell and number, the smaller first.
    """
    counts = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("tiles"))
    counts = materialize(counts, "cells")
    steps = F.array(*(F.lit(x) for x in (-1, 0, 1)))
    near = counts.select("label", "dim", "cell", "tiles")
    for k in range(CELL_AXES):
        near = near.withColumn(f"_{k}", F.explode(steps))
    beside = near.select("label", "dim", F.col("cell").alias("own"), F.col("tiles").alias("own_tiles"), F.array(*(F.col("cell")[k] + F.col(f"_{k}") for k in range(CELL_AXES))).alias("cell"))
    met = beside.join(counts, ["label", "dim", "cell"])  # touching cells that have vectors
    met = met.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("own_tiles") - 1))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    mine, theirs = F.struct(F.col("own").alias("cell"), F.col("tile").alias("tile")), F.struct(F.col("cell").alias("cell"), F.col("other").alias("tile"))
    return met.select("label", "dim", F.col("own").alias("cell"), "tile", F.least(mine, theirs).alias("one"), F.greatest(mine, theirs).alias("two"))


def links_between(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[int, np.ndarray]]:
    """Rotated unit rows x against y: (first row, matrix of links) by chunks of x."""
    d = x.shape[1]
    steps = [s for s in STEPS if s < d] + [d]
    suffix = [(np.sqrt((x[:, s:] ** 2).sum(1)), np.sqrt((y[:, s:] ** 2).sum(1))) for s in steps]
    for a in range(0, len(x), CHUNK):
        part = x[a : a + CHUNK]
        total = part[:, : steps[0]] @ y[:, : steps[0]].T
        where = None  # all pairs, or those that may still reach the threshold
        for k, s in enumerate(steps):
            if k:
                if where is None:
                    total += part[:, steps[k - 1] : s] @ y[:, steps[k - 1] : s].T
                else:
                    values += np.einsum("ij,ij->i", part[where[0], steps[k - 1] : s], y[where[1], steps[k - 1] : s])
            sx, sy = suffix[k][0][a : a + CHUNK], suffix[k][1]
            if where is None:
                alive = total + sx[:, None] * sy[None, :] >= threshold - 1e-7
                if s < d and alive.mean() < 0.05:
                    where = np.nonzero(alive)
                    values = total[where]
            else:
                alive = values + sx[where[0]] * sy[where[1]] >= threshold - 1e-7
                where, values = (where[0][alive], where[1][alive]), values[alive]
        if where is None:
            yield a, total
        else:
            cosines = np.full(total.shape, -2.0)
            cosines[where] = values
            yield a, cosines


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = vectors.select(F.col("vec_id").cast("long"), "label", "embedding")
    good = rows.where(usable()).withColumn("dim", F.size("embedding")).withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(1), "embedding"))
    copies = ["label", "dim", "k1", "k2"]
    distinct = good.groupBy(*copies).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times"), F.any_value("embedding").alias("embedding"))
    # a vector is a node of its own, whatever ids it has
    reps = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    axes = principal_axes(reps)

    def compare(table: pa.Table) -> pa.Table:
        v = axes[table.column("dim")[0].as_py()].rotation
        given = _matrix(table.column("embedding"))
        x = _unit(given) @ v
        ids, times, side = (table.column(c).to_numpy() for c in ("node", "times", "side"))
        same = bool(table.column("same")[0].as_py())
        left = np.flatnonzero(side == 1)
        right = left if same else np.flatnonzero(side == 2)
        count = np.zeros(len(ids), np.int64)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for start, cosine in links_between(x[left], x[right], threshold) if len(left) and len(right) else ():
            mine = left[start : start + len(cosine)]
            for i, j in zip(*np.nonzero(np.abs(cosine - threshold) < CLOSE), strict=True):
                p, q = (y / np.abs(y).max() for y in (given[mine[i]], given[right[j]]))  # so that no square overflows
                cosine[i, j] = p @ q / np.sqrt((p @ p) * (q @ q))
            links = cosine >= threshold
            if same:
                links[np.arange(len(mine)), start + np.arange(len(mine))] = False
            count[mine] += links @ times[right]
            if not same:
                count[right] += times[mine] @ links
            if links.any():
                new = spanning(links, ids[mine], ids[right])
                a, b = forest(np.concatenate([a, new[0]]), np.concatenate([b, new[1]]))
        some = np.flatnonzero(count)
        nothing = pa.nulls(len(some), pa.int64())
        return pa.table([pa.array(np.concatenate([ids[some], a])), pa.concat_arrays([nothing, pa.array(b, pa.int64())]), pa.concat_arrays([pa.array(count[some]), pa.nulls(len(a), pa.int64())])], ["node", "other", "n_links"])

    placed = with_cells(reps, axes, threshold)
    pairs = materialize(tile_pairs(placed, tile_rows), "tile-pairs")
    sizes = pairs.groupBy("label", "dim", "cell").agg((F.max("tile") + 1).alias("tiles"))
    dealt = placed.join(sizes, ["label", "dim", "cell"]).withColumn("tile", F.pmod(F.xxhash64("k1", "k2"), "tiles").cast("int"))
    met = dealt.join(pairs, ["label", "dim", "cell", "tile"])
    own = F.struct("cell", "tile")
    met = met.select("label", "dim", "node", "times", "embedding", "one", "two", F.when(own == F.col("one"), 1).otherwise(2).alias("side"), (F.col("one") == F.col("two")).alias("same"))
    found = materialize(met.groupBy("label", "dim", "one", "two").applyInArrow(compare, PAIR_SCHEMA), "tile-links")
    counts = found.where("other is null").groupBy("node").agg(F.sum("n_links").alias("links"))
    joined = components(found.where("other is not null").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    named = reps.select(*copies, "rep", "times", "node").join(counts, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    per_rep = named.join(least, "component")
    keys = good.select("vec_id", *copies).join(per_rep, copies).select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    alone = rows.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return keys.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
