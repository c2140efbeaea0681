"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes: vectors are centred, turned to their principal axes and by rotations that iterative
quantisation fits to a bounded sample; on which side of a cut they lie is a bit, ``BITS`` in
all. Cuts lie around the centre, ``OFFSETS`` of the spread away on average, so that lengths
count and not only angles. The sample has at most ``SAMPLE`` vectors and ``SAMPLE_VALUES``
numbers, those of smallest hash. Every vector is indexed.

Index: a code is cut into substrings, each a bucket key of its own. A code within Hamming
radius r of a query's has, in at least one substring, at most as many differing bits as
that substring's threshold, if thresholds plus one add up to r + 1 (pigeonhole). So a query
probes, per substring, all values within the threshold; a join on the bucket meets every
code within the radius, and the whole code decides. All vectors of such codes are
reranked by their distance in double precision, from the vectors as given.

Radius: that within which the sample puts ``TARGET`` codes. A query for which fewer than
``LEAST`` were found goes on with a larger one until there are, or the radius covers all.

Equal vectors are one node with its k + 1 smallest ids. Buckets of more than
``BUCKET_ROWS`` codes are salted. Null, empty and zero vectors and those that hold null or
non-finite components take no part, nor do null ids; vectors of different length are
searched apart. Of rows that share an id, the one with the smallest vector stands. Equal
distances go to the smaller id. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.shared import materialize

BITS = 256
WORDS = BITS // 64
SAMPLE, SAMPLE_VALUES = 16_384, 1 << 23
#: Codes that a query's radius should hold, and with how few it is widened, by how many bits.
TARGET, LEAST, WIDEN = 800, 300, 12
#: Sample codes below which a quantile is taken from a normal distribution instead.
FEW_CODES = 8
#: Sweeps of iterative quantisation.
SWEEPS = 20
#: How far from the centre a bit's cut lies, in median distances from it (standard deviation of a normal).
OFFSETS = 0.37
BUCKET_ROWS = 4096
#: Codes from which substrings have 16 bits instead of 8; either finds the same.
MANY_CODES = 1 << 22

CODE = [f"c{w}" for w in range(WORDS)]


def usable(x: Column) -> Column:
    """A vector with a direction: not null, empty or zero, all components finite numbers."""
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


@dataclass(frozen=True)
class Codes:
    """Learned codes: the directions of the bits, where each is cut, and the sample's codes."""

    directions: np.ndarray
    cuts: np.ndarray
    sample: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        """A row of ``WORDS`` 64-bit words per vector."""
        return np.packbits(x @ self.directions > self.cuts, axis=1, bitorder="little").view(np.uint64)


def fit(x: np.ndarray, seed: int = 11) -> Codes:
    """Rotations that bring signs close to the rotated vectors, from random ones, until there are enough bits."""
    centre = x.mean(axis=0)
    centred = x - centre
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :BITS]
    v, rng, directions = centred @ axes, np.random.default_rng(seed), []
    for _ in range(-(-BITS // v.shape[1])):
        turn = np.linalg.qr(rng.normal(size=(v.shape[1],) * 2))[0]
        for _ in range(SWEEPS if v.shape[1] > 1 else 0):
            left, _, right = np.linalg.svd(v.T @ np.where(v @ turn > 0, 1.0, -1.0))
            turn = left @ right
        directions.append(axes @ turn)
    turned = np.hstack(directions)[:, :BITS].copy()
    spread = np.median(np.abs(centred @ turned), axis=0)
    codes = Codes(turned, centre @ turned + OFFSETS * spread * rng.normal(size=BITS), np.zeros((0, WORDS), np.uint64))
    return Codes(codes.directions, codes.cuts, codes.of(x))


def _radius(distances: np.ndarray, codes: int) -> int:
    """The radius within which a sample with these distances puts ``TARGET`` of so many codes."""
    if codes <= TARGET:
        return BITS
    share, ordered = TARGET / codes, np.sort(distances)
    want = math.ceil(share * len(ordered))
    if want >= FEW_CODES:
        return int(ordered[want - 1])
    tail = distances.mean() + NormalDist().inv_cdf(share) * distances.std()
    return max(0, min(int(tail), int(ordered[min(FEW_CODES, len(ordered)) - 1])))


def _words(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy() for c in CODE]).view(np.uint64)


def _coded(rows: DataFrame, codes: Codes, nodes: int | None = None) -> DataFrame:
    """The first column, the words of the code and, given the number of nodes, a radius."""
    key = rows.columns[0]
    schema = ", ".join([f"{key} long", *(f"{c} long" for c in CODE), *(["radius int"] if nodes else [])])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = codes.of(_matrix(batch.column("vector")))
            columns = [batch.column(key), *(pa.array(words[:, w].view(np.int64)) for w in range(WORDS))]
            if nodes:
                columns.append(pa.array([_radius(np.bitwise_count(codes.sample ^ x).sum(axis=1, dtype=np.int64), nodes) for x in words], pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, [key, *CODE, *(["radius"] if nodes else [])])

    return rows.select(key, "vector").mapInArrow(code, schema)


@dataclass(frozen=True)
class Index:
    """Nodes (``node``, ``ids``, ``vector``) of one length, their codes, how codes are cut, and how full the buckets are."""

    nodes: DataFrame
    codes: DataFrame
    model: Codes
    count: int
    width: int
    salts: DataFrame

    def postings(self) -> DataFrame:
        return _postings(self.codes, self.width)


def _postings(codes: DataFrame, width: int) -> DataFrame:
    """A row per code and substring; ``bucket`` is the substring's place and value."""
    per = 64 // width
    values = [F.shiftright(F.col(CODE[p // per]), (p % per) * width).bitwiseAND((1 << width) - 1).cast("int").bitwiseOR(p << width) for p in range(BITS // width)]
    return codes.select("node", *CODE, F.explode(F.array(*values)).alias("bucket"))


def one_per_id(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """``key`` and ``vector`` of the usable rows, one per id."""
    rows = vectors.select(F.col(key).cast("long").alias(key), F.col(embedding).alias("vector"))
    return rows.where(F.col(key).isNotNull() & usable(F.col("vector"))).groupBy(key).agg(F.min("vector").alias("vector"))


def build_index(rows: DataFrame, k: int = 10) -> Index:
    """Index ``vec_id`` and ``vector``, all of one length and one row per id."""
    # a task keeps at most k + 1 ids of a vector before anything is sent
    order = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    nodes = materialize(few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("node"), "ids", "vector"), "nodes")
    count, length = nodes.agg(F.count("*"), F.max(F.size("vector"))).first()
    size = max(1, min(SAMPLE, SAMPLE_VALUES // (length or 1)))
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(size).select("vector").toPandas()["vector"]
    model = fit(np.stack([np.asarray(x, np.float64) for x in sample]))
    width = 16 if count >= MANY_CODES else 8
    codes = materialize(_coded(nodes, model), "codes")
    # as many rows as there are buckets: at most BITS / width * 2 ** width
    salts = materialize(_postings(codes, width).groupBy("bucket").agg(F.ceil(F.count("*") / BUCKET_ROWS).cast("int").alias("salts")), "bucket-salts")
    return Index(nodes, codes, model, count, width, salts)


def thresholds(radius: int, substrings: int) -> list[int]:
    """Differing bits to probe for per substring, -1 for none; they and one each add up to radius + 1."""
    each, more = divmod(radius + 1, substrings)
    return [each - (p >= more) for p in range(substrings)]


def _probes(queries: DataFrame, width: int) -> DataFrame:
    """A row per query and bucket in which a code within its radius may be."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.arange(1 << width, dtype=np.int64)
        masks = masks[np.argsort(np.bitwise_count(masks), kind="stable")]
        within = np.cumsum([math.comb(width, t) for t in range(width + 1)])
        for batch in batches:
            words = _words(batch)
            values = words.view(np.uint8 if width == 8 else np.uint16).astype(np.int64)
            for row, radius in enumerate(batch.column("radius").to_pylist()):
                few = thresholds(radius, BITS // width)
                bucket = np.concatenate([p << width | values[row, p] ^ masks[: within[t]] for p, t in enumerate(few) if t >= 0]).astype(np.int32)
                same = pa.array(np.zeros(len(bucket), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(bucket), *(batch.column(c).slice(row, 1).take(same) for c in ("query_id", "radius", *CODE))], ["bucket", "query_id", "radius", *(f"q{c}" for c in CODE)])

    return queries.select("query_id", "radius", *CODE).mapInArrow(probe, "bucket int, query_id long, radius int, " + ", ".join(f"q{c} long" for c in CODE))


def within_radius(index: Index, queries: DataFrame) -> DataFrame:
    """Every (query_id, node) whose codes differ in at most ``radius`` bits, once."""
    salts = F.broadcast(index.salts)  # bounded by the number of buckets
    probes = _probes(queries, index.width).join(salts, "bucket").select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).drop("salts")
    postings = index.postings().join(salts, "bucket").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).drop("salts")
    differing = sum((F.bit_count(F.col(f"q{c}").bitwiseXOR(F.col(c))) for c in CODE), F.lit(0))
    met = probes.alias("p").join(postings.alias("x"), (F.col("p.bucket") == F.col("x.bucket")) & (F.col("p.salt") == F.col("x.salt")) & (differing <= F.col("radius")))
    return met.select("query_id", "node").distinct()


def euclidean(a: Column, b: Column) -> Column:
    """The distance in double precision; scaled where squares would overflow or vanish."""
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    plain = F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v * v)
    most = F.array_max(F.transform(gaps, F.abs))
    scaled = most * F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, v: s + (v / most) * (v / most)))
    return F.when((plain > 1e-290) & (plain < 1e300), F.sqrt(plain)).when(most == 0, F.lit(0.0)).otherwise(scaled)


def _nearest(index: Index, queries: DataFrame, k: int) -> DataFrame:
    coded = materialize(_coded(queries, index.model, index.count), "query-codes")
    pending, found = coded, None
    while True:
        met = materialize(within_radius(index, pending), "candidates")
        counts = met.groupBy("query_id").agg(F.count("*").alias("n"))
        short = pending.join(counts, "query_id", "left").where((F.coalesce("n", F.lit(0)) < max(LEAST, k + 1)) & (F.col("radius") < BITS)).drop("n")
        short = materialize(short.withColumn("radius", F.least(F.col("radius") + WIDEN, F.lit(BITS))), "short-queries")
        last = short.isEmpty()
        full = met if last else met.join(short.select("query_id"), "query_id", "left_anti")
        found = full if found is None else found.unionByName(full)
        if last:
            break
        pending = short
    pairs = found.join(index.nodes, "node").join(queries.withColumnRenamed("vector", "asked"), "query_id")
    scored = pairs.select("query_id", euclidean(F.col("asked"), F.col("vector")).alias("score"), F.explode("ids").alias("vec_id")).where(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` nearest of ``vectors`` (``vec_id``, ``embedding``) to each of ``queries``
    (``query_id``, ``embedding``), a query's own id aside: query_id, rank, vec_id, score."""
    rows, asked = one_per_id(vectors, "vec_id", "embedding"), one_per_id(queries, "query_id", "embedding")
    asked = materialize(asked, "queries")
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = {r[0] for r in asked.select(F.size("vector")).distinct().collect()}
    if lengths:
        rows = materialize(rows, "vectors")
    for length in sorted(lengths):
        own = rows.where(F.size("vector") == length)
        if not own.isEmpty():
            out = out.unionByName(_nearest(build_index(own, k), asked.where(F.size("vector") == length), k))
    return out
