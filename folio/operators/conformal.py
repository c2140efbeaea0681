"""Conformal prediction sets: scores, quantiles, calibration, sets and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import vectors as V
from folio.operators.relational import running_sums

INFINITY = float("inf")


def size_histogram(rows: DataFrame, labels: str) -> DataFrame:
    """(set_size, n, share) of prediction sets."""
    counts = rows.groupBy(F.size(labels).alias("set_size")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def aps_randomised(probs: Column, uniform: Column) -> Column:
    """For every label, the mass of labels ranked above it and a share of its own: ``uniform`` is a number in [0, 1) per row."""
    return F.zip_with(aps(probs), probs, lambda s, p: s - uniform * p)


def lac(probs: Column) -> Column:
    """1 - p for every label."""
    return F.transform(probs, lambda p: 1.0 - p)


def aps(probs: Column) -> Column:
    """For every label, the mass of labels ranked above it and its own."""
    order = V.ranked(probs)
    # the mass down to a label: all that come before it in the ranking, itself included
    return F.transform(probs, lambda p, k: F.aggregate(order, F.lit(0.0), lambda a, x: a + F.when((x["p"] > p) | ((x["p"] == p) & (x["k"] <= k)), x["p"]).otherwise(0.0)))


def scores(probs: Column, method: str = "lac") -> Column:
    if method not in ("lac", "aps"):
        raise ValueError(f"unknown method {method!r}")
    return lac(probs) if method == "lac" else aps(probs)


def quantiles(calibration: DataFrame, score: str, alphas: list[float], group: str | None = None) -> DataFrame:
    """([group,] alpha, n, qhat): order statistic min(k, n - 1) from 0, k = ceil((n + 1)(1 - alpha)).

    Infinite where k exceeds n. One running count of the distinct scores serves every
    alpha, in one pass and without a join of data: the threshold is the least score whose
    running count reaches k. Null scores don't count; without any score the threshold is infinite.
    """
    if not all(0 < a < 1 for a in alphas):
        raise ValueError("alpha must be between 0 and 1")
    keys = [group] if group else []
    scored = calibration.where(F.col(score).isNotNull())
    per = scored.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_c"))
    steps = running_sums(per, score, ["_c"], keys)
    sizes = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # n is one row per group; the steps meet it and shrink to one value per alpha at once
    if keys:
        steps = steps.join(sizes, keys)
    else:
        steps = steps.withColumn("n", F.lit(sizes.first()[0]).cast("long"))
    at = lambda a: F.least(F.ceil((F.col("n") + 1) * F.lit(1.0 - a)), F.col("n") - 1) + 1
    found = [F.min(F.when(F.col("run__c") >= at(float(a)), F.col(score))).alias(f"_q{k}") for k, a in enumerate(alphas)]
    least = steps.groupBy(*keys).agg(F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("n"), *found)
    rows = F.explode(F.array(*(F.struct(F.lit(float(a)).alias("alpha"), F.col(f"_q{k}").alias("q")) for k, a in enumerate(alphas))))
    grid = least.select(*keys, "n", rows.alias("x"))
    beyond = F.ceil((F.col("n") + 1) * (F.lit(1.0) - F.col("x.alpha"))) > F.col("n")
    return grid.select(*keys, "x.alpha", "n", F.when(beyond, F.lit(INFINITY)).otherwise(F.col("x.q")).alias("qhat"))


def prediction_set(score_vector: Column, qhat: Column) -> Column:
    """Labels (by number, in order) whose score is within the threshold (a number or one per label)."""
    labels = F.sequence(F.lit(0), F.size(score_vector) - 1)
    return F.filter(labels, lambda k: F.element_at(score_vector, k + 1) <= qhat)


def route(labels: Column) -> Column:
    """Sent on for review: anything but one label."""
    return F.size(labels) != 1


def with_fallback(labels: Column, probs: Column) -> Column:
    """An empty set becomes the best label."""
    return F.when(F.size(labels) == 0, F.array(V.argmax(probs))).otherwise(labels)


def nearest_alpha(bank: DataFrame, alpha: float) -> DataFrame:
    """Rows of the calibrated alpha that is nearest, the first on ties."""
    best = bank.agg(F.min_by("alpha", F.struct(F.abs(F.col("alpha") - alpha), "alpha"))).first()[0]
    return bank.where(F.col("alpha") == best)


def evaluate_sets(rows: DataFrame, labels: str, truth: str, predicted: str, groups: list[str] | None = None) -> DataFrame:
    """Coverage, size, routing and what routing catches, overall or by group."""
    size, covered = F.size(labels), F.array_contains(labels, F.col(truth))
    wrong, routed = F.col(predicted) != F.col(truth), F.size(labels) != 1
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*(groups or [])).agg(
        F.count(F.lit(1)).alias("n"), share(covered).alias("coverage"), F.avg(size.cast("double")).alias("avg_size"), F.median(size).alias("median_size"),
        share(routed).alias("routed"), share(size == 1).alias("singleton"), share(size == 0).alias("empty"),
        F.avg(F.when(size == 1, covered.cast("double"))).alias("singleton_accuracy"),
        F.avg(F.when(wrong, routed.cast("double"))).alias("error_recall"), F.avg(F.when(routed, wrong.cast("double"))).alias("routed_precision"),
    )


def alpha_for_budget(curve: DataFrame, budget: float) -> float | None:
    """The smallest alpha whose routed share stays within the budget."""
    return curve.where(F.col("routed") <= budget).agg(F.min("alpha")).first()[0]
