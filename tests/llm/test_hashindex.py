"""Multi-index hashing: the radius search is exact, recall against brute force, awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import hashindex
from folio.llm.shared import materialize

SCHEMA = "vec_id long, embedding array<float>, label int, c0 string, bucket int"


def exact(rows, k=10):
    """rows: (id, list); nearest by id of those divisible by 100."""
    good = {}
    for i, x in rows:
        if i is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x):
            x = [float(np.float32(v)) for v in x]
            good[i] = min(good.get(i, x), x)
    out = {}
    for q in (i for i in good if i % 100 == 0):
        near = sorted((float(np.sqrt(((np.array(x) - np.array(good[q])) ** 2).sum())), i) for i, x in good.items() if i != q and len(x) == len(good[q]))
        out[q] = near[:k]
    return out


def found(df, k=10):
    queries = df.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    out = {}
    for r in hashindex.nearest(df, queries, k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(df, rows):
    want, got = exact(rows), found(df)
    hits = sum(len({i for _, i in near} & {i for _, i in got.get(q, [])}) for q, near in want.items())
    return hits / sum(map(len, want.values()))


def table(spark, x):
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    return spark.createDataFrame([(i, v, 0, "clash", 1) for i, v in rows], SCHEMA).repartition(4), rows


@pytest.mark.parametrize("kind", ["even", "clustered", "lengths", "few axes"])
def test_recall(spark, kind):
    rng = np.random.default_rng(5)
    n, d = 4000, 48
    x = rng.normal(size=(n, d))
    if kind == "clustered":
        x = rng.normal(size=(40, d))[rng.integers(0, 40, n)] + 0.3 * x
    elif kind == "lengths":
        x *= np.exp(rng.normal(size=(n, 1)))
    elif kind == "few axes":
        x *= 0.7 ** np.arange(d)
    assert recall(*table(spark, x)) >= 0.9


@pytest.mark.parametrize(("width", "rows"), [(8, 4096), (8, 5), (16, 4096)])
def test_every_code_within_the_radius_is_met_once(spark, monkeypatch, width, rows):
    """Near copies share buckets; small buckets are salted."""
    monkeypatch.setattr(hashindex, "BUCKET_ROWS", rows)
    monkeypatch.setattr(hashindex, "MANY_CODES", 1 << 22 if width == 8 else 1)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(10, 16))[rng.integers(0, 10, 300)] + 0.2 * rng.normal(size=(300, 16))
    df, _ = table(spark, x)
    index = hashindex.build_index(hashindex.one_per_id(df, "vec_id", "embedding"))
    assert index.width == width
    codes = {r.node: np.array([r[c] for c in hashindex.CODE], np.int64).view(np.uint64) for r in index.codes.collect()}
    for radius in (0, 20, 45) if width == 8 else (20,):
        asked = materialize(index.codes.where("node < 6").withColumnRenamed("node", "query_id").withColumn("radius", F.lit(radius)), "asked")
        got = sorted((r.query_id, r.node) for r in hashindex.within_radius(index, asked).collect())
        assert got == sorted((q, i) for q in range(6) for i in codes if np.bitwise_count(codes[q] ^ codes[i]).sum() <= radius)


def test_thresholds_leave_no_gap():
    for substrings in (16, 32):
        for radius in range(257):
            few = hashindex.thresholds(radius, substrings)
            assert sum(t + 1 for t in few) == radius + 1 and max(few) - min(few) <= 1 and max(few) <= 256 // substrings


def test_queries_that_find_few_go_on(spark, monkeypatch):
    monkeypatch.setattr(hashindex, "TARGET", 1)
    monkeypatch.setattr(hashindex, "LEAST", 40)
    monkeypatch.setattr(hashindex, "WIDEN", 60)
    df, rows = table(spark, np.random.default_rng(7).normal(size=(300, 8)))
    assert all(len(x) == 10 for x in found(df).values()) and recall(df, rows) > 0.5


def test_awkward_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 4)).astype(np.float32).tolist()
    rows = [*enumerate(x), (100, x[3]), (200, x[3]), *((1000 + k, [1.0, 2.0, 3.0, 4.0]) for k in range(301)), (3, x[3]), (5, x[9]), (300, None), (400, []), (500, [0.0] * 4), (600, [1.0, None, 1.0, 1.0]), (700, [1.0, float("nan"), 1.0, 1.0])]
    rows += [(800, [float("inf"), 0.0, 0.0, 1.0]), (None, x[0]), (900, [1.0, 2.0]), (901, [1.0, 2.5]), (2000, [5.0] * 7), (2100, [1e30, 0.0, 0.0, 0.0]), (2101, [1e30, 1.0, 0.0, 0.0]), (2200, [1e-30, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, None, "clash", 1) for i, v in rows], SCHEMA)
    want, got = exact(rows), found(df)
    assert set(got) == {q for q, near in want.items() if near} and 2000 not in got
    for q, near in got.items():
        assert [i for _, i in near] == [i for _, i in want[q]] and np.allclose([s for s, _ in near], [s for s, _ in want[q]], rtol=1e-12)
    assert found(df.where("vec_id = 1000 or vec_id = 1001")) == {1000: [(0.0, 1001)]}
    assert found(df.limit(0)) == {} and found(df.where("vec_id = 100")) == {}


def test_distances_of_extreme_doubles(spark):
    df = spark.createDataFrame([([1e200, 0.0], [0.0, 1e200]), ([1e-200, 0.0], [0.0, 1e-200]), ([1.0], [1.0])], "a array<double>, b array<double>")
    assert np.allclose([r[0] for r in df.select(hashindex.euclidean(F.col("a"), F.col("b"))).collect()], [2**0.5 * 1e200, 2**0.5 * 1e-200, 0.0], rtol=1e-12, atol=0)
