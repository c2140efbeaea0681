"""Exact nearest vectors with partitions left out; neighbours with a flag; votes with a default."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.operators import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, even boolean"


def usable(x):
    return bool(x) and all(v is not None and np.isfinite(v) for v in x) and any(x)


def exact(rows, k, length, skip_own=True):
    good = [(i, np.asarray(x, np.float32).astype(float)) for i, x, _ in rows if i is not None and usable(x) and len(x) == length]
    unit = {i: x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) for i, x in good}
    return {q: sorted((round(-float(unit[q] @ x), 9), i) for i, x in unit.items() if not (skip_own and i == q))[:k] for q in unit if q % 20 == 0}


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((round(-r.similarity, 9), r.vec_id))
    return out


def same(a, b):
    assert set(a) == set(b)
    for q in a:
        assert np.allclose([s for s, _ in a[q]], [s for s, _ in b[q]], atol=1e-8)
        ties = {s for s, _ in a[q] if sum(abs(s - t) < 1e-8 for t, _ in a[q]) > 1} | {a[q][-1][0]} if a[q] else set()
        assert [i for s, i in a[q] if s not in ties] == [i for s, i in b[q] if s not in ties]


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df, df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 64)
    monkeypatch.setattr(N, "PIVOT_ROWS", 20)


def test_same_as_brute_force_and_few_partitions_are_opened(spark, small):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 12))[rng.integers(0, 30, 1500)] + 0.05 * rng.normal(size=(1500, 12))
    x[400:900] = x[3] + 1e-3 * rng.normal(size=(500, 12))  # a third are near copies: more than a block
    rows = [(i, v, i % 2 == 0) for i, v in enumerate(x.astype(np.float32).tolist())]
    df, queries = table(spark, rows)
    index = N.partition(df, "vec_id", "embedding")
    best, made = N.search(index, queries, 5, "query_id", "embedding", skip_own=True)
    found = {}
    for r in best.orderBy("query", F.desc("similarity"), "id").collect():
        found.setdefault(r["query"], []).append((round(-r.similarity, 9), r.id))
    same(exact(rows, 5, 12), found)
    assert len(index.pivots) == 75 and sum(made) < 0.3 * 75 * queries.count()


def test_even_vectors_need_all_partitions(spark, small):
    x = np.random.default_rng(2).normal(size=(300, 10)).astype(np.float32).tolist()
    rows = [(i, v, True) for i, v in enumerate(x)]
    df, queries = table(spark, rows)
    same(exact(rows, 7, 10), got(N.nearest(queries, df, 7, skip_own=True)))
    same(exact(rows, 400, 10, False), got(N.nearest(queries, df, 400)))


def test_awkward_rows(spark, small):
    rng = np.random.default_rng(3)
    rows = [(i, v, True) for i, v in enumerate(rng.normal(size=(90, 3)).astype(np.float32).tolist())]
    rows += [(100, None, True), (120, [], True), (140, [0.0, 0.0, 0.0], True), (160, [1.0, None, 0.0], True), (180, [float("nan"), 1.0, 1.0], True), (200, [float("inf"), 1.0, 1.0], True), (220, [1.0, 2.0], True), (None, rows[1][1], True)]
    rows += [(240, rows[5][1], None), (260, rows[5][1], False), (280, [1e30, 1e30, 0.0], True), (281, [1e-30, 1e-30, 0.0], True)]
    df, queries = table(spark, rows)
    expected = exact(rows, 4, 3)
    assert set(expected) == {0, 20, 40, 60, 80, 240, 260, 280}
    same(expected, got(N.nearest(queries, df, 4, skip_own=True)))
    assert N.nearest(queries, df.limit(0), 4).count() == 0 and N.nearest(queries.limit(0), df, 4).count() == 0
    assert N.nearest_with(queries, df.limit(0), 4, "even").count() == 0


@pytest.mark.parametrize("rounds", [1, 3])
def test_flagged_ones_among_the_nearest(spark, rounds):
    rng = np.random.default_rng(4)
    rows = [(i, v, None if i % 9 == 1 else bool(i % 9 == 0)) for i, v in enumerate(rng.normal(size=(200, 6)).astype(np.float32).tolist())]
    df, queries = table(spark, rows)
    flags, expected = {i: f for i, _, f in rows}, {}
    for q, near in exact(rows, 200, 6).items():
        depth = 2
        for _ in range(rounds):
            depth *= 3
            own = [x for x in near[:depth] if flags[x[1]]][:2]
            if len(own) == 2:
                break
        if own:
            expected[q] = own
    found = N.nearest_with(queries, df, 2, "even", rounds=rounds, skip_own=True)
    same(expected, got(found))
    votes = {r.query_id: (r.label, r.share) for r in N.vote_or_default(queries, found, df.selectExpr("vec_id", "vec_id % 4 as label"), "vec_id", "label", -1).collect()}
    assert len(votes) == 10 and all(votes[q] == (-1, 0.0) for q in votes if q not in expected)
    for q, near in expected.items():
        weights = {}
        for s, i in near:
            weights[i % 4] = weights.get(i % 4, 0) + np.exp((near[0][0] - s) / 0.05)
        best = max(weights, key=weights.get)
        assert votes[q][0] == best and np.isclose(votes[q][1], weights[best] / sum(weights.values()), atol=1e-4)


def test_fallback_names():
    assert N.fallback_of(True, object()) == "similar_papers" and N.fallback_of(True, None) is None
    assert N.fallback_of("top_facet", None) == "top_facet" and N.fallback_of("else", object()) is None and N.fallback_of(False, object()) is None
