"""Quotas, running sums and first rows: against plain loops, on hot groups, nulls, ties and nothing."""

import random

from pyspark.sql import functions as F

from folio.operators import relational as R


def shared_out(supply, target, share):
    """The rounds of an even spread, one group after the other."""
    target = min(target, sum(supply.values()))
    out = {}
    for part in (share, 1.5 * share, 2 * share, 0.5, 0.75, 1.0):
        cap = max(1, int(target * min(1.0, part)))
        limit = {c: min(n, cap) for c, n in supply.items() if n > 0}
        out, left, live = dict.fromkeys(limit, 0), target, sorted(limit)
        while left > 0 and live:
            even = max(1, left // len(live))
            for c in list(live):
                give = min(limit[c] - out[c], even, left)
                out[c] += give
                left -= give
                if out[c] >= limit[c]:
                    live.remove(c)
        if left == 0:
            break
    return {c: q for c, q in out.items() if q > 0}


def spread(spark, cases):
    """{case: {group: quota}} of (supply, target, share) cases; shares are equal."""
    rows = [(k, g, n, t) for k, (supply, t, _) in enumerate(cases) for g, n in supply.items()]
    df = spark.createDataFrame(rows, "level long, g string, n long, t long")
    found = {k: {} for k in range(len(cases))}
    for r in R.quotas(df, "level", "g", "n", F.col("t"), cases[0][2]).collect():
        found[r.level][r.g] = r.quota
    return found


def test_quotas_by_hand(spark):
    assert spread(spark, [({"a": 100, "b": 5, "c": 100}, 60, 0.5)]) == {0: {"a": 28, "b": 5, "c": 27}}
    assert spread(spark, [({"a": 3}, 10, 0.3), ({"b": 0}, 10, 0.3), ({"c": 4}, 0, 0.3)]) == {0: {"a": 3}, 1: {}, 2: {}}
    assert spread(spark, [({}, 10, 0.3)]) == {0: {}}


def test_quotas_against_rounds(spark):
    draw = random.Random(7)
    for share in (0.1, 0.3, 0.4, 1.0):
        cases = [({f"g{k:02}": draw.choice([0, 1, 2, 7, 7, draw.randint(1, 400)]) for k in range(draw.randint(1, 14))}, draw.randint(1, 700), share) for _ in range(60)]
        got = spread(spark, cases)
        for k, (supply, target, _) in enumerate(cases):
            assert got[k] == shared_out(supply, target, share), (supply, target, share)


def test_samples_meet_quotas(spark):
    rows = [(k, "ab"[k % 7 == 0] if k % 11 else None, 2000 + k % 3 if k % 13 else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, y int")
    got = dict(R.sample_to_quota(df, "g", "id", 100, 0.3).groupBy("g").count().collect())
    assert got == {"a": 50, "b": 50}
    assert {tuple(r) for r in R.quota_per_level(df, "y", "g", "id", 90, 0.5).groupBy("y", "g").count().collect()} == {(y, g, 15) for y in (2000, 2001, 2002) for g in "ab"}
    assert R.sample_to_quota(df, "g", "id", 100, 0.3).columns == df.columns
    assert R.sample_to_quota(df.limit(0), "g", "id", 100, 0.3).count() == 0
    assert R.quota_per_level(df.limit(0), "y", "g", "id", 90, 0.5).count() == 0


def test_running_sums_of_a_hot_group_with_outliers(spark):
    rows = [("hot", x * 1.0, x % 5) for x in range(4000)] + [("hot", 1e300, 3), ("hot", float("inf"), 2), ("hot", None, 7), ("cold", 1.0, None), ("cold", 2.0, 4), (None, 5.0, 6)]
    df = spark.createDataFrame(rows, "g string, x double, n long")
    for descending in (False, True):
        for keys in (["g"], []):
            table = df if keys else df.where("g = 'hot'")
            out = R.running_sums(table, "x", ["n"], keys, descending)
            got = {(r.g, r.x): r.run_n for r in out.collect()}
            want = {}
            for g in ("hot", "cold", None) if keys else ("hot",):
                run = 0
                ordered = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0.0), reverse=descending)
                for _, x, n in ordered:
                    run += n or 0
                    want[g, x] = run
            assert got == want
    assert R.running_sums(df.limit(0), "x", ["n"]).count() == 0
    assert R.running_sums(df.limit(0), "x", ["n"], ["g"]).count() == 0


def test_running_sums_split_a_hot_group(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("g"), F.pow(F.lit(1.001), F.col("id") % 9000).alias("x"), F.lit(1).alias("n"))
    once = df.groupBy("g", "x").agg(F.sum("n").alias("n"))
    # with the outlier, cuts of equal width would put all rows in one bucket
    far = once.unionByName(spark.createDataFrame([("hot", 1e300, 0), ("cold", 1.0, 0)], "g string, x double, n long"))
    sizes = [r["count"] for r in R.bucketed(far, "x", ["g"], 256).groupBy("g", "_b").count().collect()]
    assert sum(sizes) == 9_002 and max(sizes) <= 9_000 // 256 * 2
    assert R.running_sums(once, "x", ["n"], ["g"]).agg(F.max("run_n")).first()[0] == 20_000


def test_first_rows(spark):
    rows = [("t", 3, "c"), ("t", 1, "a"), (None, 9, "n"), (None, 8, "m"), ("", 5, None), ("t", 1, "a"), ("u", None, "x"), ("u", 2, "y")]
    df = spark.createDataFrame(rows, "text string, id long, more string")
    out = R.keep_first(df, ["text"], ["id", "more"])
    assert out.columns == df.columns
    assert {tuple(r) for r in out.collect()} == {("t", 1, "a"), (None, 8, "m"), ("", 5, None), ("u", None, "x")}
    assert R.keep_first(df.limit(0), ["text"], ["id"]).count() == 0
