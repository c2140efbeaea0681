"""Predictions and weak labels held against the labels that people gave.

One join and one aggregation give cells of (gold, predicted, weak); the reports are over
those, so beyond the join nothing is larger than the set of labels. Answers that are no
label, nulls and empties are left out; of an id given twice, the smallest label counts.
Without gold labels, counts are zero, shares null, and the tables by label empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators import metrics

#: What annotators answer in place of a label.
UNSURE = "Unsure / borderline"
NOT_APPLICABLE = "Not empirical research / N/A"


def usable(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, gold): one label per id."""
    given = F.col(label).isNotNull() & ~F.col(label).isin(UNSURE, NOT_APPLICABLE, "")
    return labels.where(given & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("gold"))


def answers(labels: DataFrame, label: str) -> DataFrame:
    """How many answers were shown, usable, unsure and not applicable."""
    c = F.coalesce(F.col(label), F.lit(""))
    return labels.agg(F.count(F.lit(1)).alias("shown"), F.count_if(~c.isin(UNSURE, NOT_APPLICABLE, "")).alias("usable"), F.count_if(c == UNSURE).alias("unsure"), F.count_if(c == NOT_APPLICABLE).alias("not_applicable"))


def cells(labels: DataFrame, known: DataFrame, key: str, label: str, predicted: str, weak: str) -> DataFrame:
    """(gold, known, predicted, weak, n); ``known`` is false where an id has no prediction row."""
    own = known.groupBy(key).agg(F.min(F.struct(F.col(predicted).alias("p"), F.col(weak).alias("w"))).alias("_own"))
    joined = usable(labels, key, label).join(own, key, "left")
    return joined.groupBy("gold", F.col("_own").isNotNull().alias("known"), F.col("_own.p").alias("predicted"), F.col("_own.w").alias("weak")).agg(F.count(F.lit(1)).alias("n"))


def _sum(when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))


def _share(when: Column) -> Column:
    return _sum(when) / F.nullif(F.sum("n"), F.lit(0))


def _trained(counts: DataFrame, designs: list[str]) -> DataFrame:
    return counts.where(F.col("known") & F.col("gold").isin(*designs))


def model_report(counts: DataFrame, designs: list[str]) -> DataFrame:
    """One row over the designs a model was trained on: n, accuracy, macro_f1; a design that neither side has counts zero."""
    truth, guess = F.col("gold"), F.col("predicted")
    f1 = [F.coalesce(2 * _sum((truth == d) & (guess == d)) / F.nullif(_sum(truth == d) + _sum(guess == d), F.lit(0)), F.lit(0.0)) for d in designs]
    return _trained(counts, designs).agg(_sum(F.lit(True)).alias("n"), _share(truth == guess).alias("accuracy"), (sum(f1[1:], f1[0]) / len(designs)).alias("macro_f1"))


def design_recall(counts: DataFrame, designs: list[str]) -> DataFrame:
    """(gold, n, recall) of the designs that have gold rows."""
    return _trained(counts, designs).groupBy("gold").agg(F.sum("n").alias("n"), _share(F.col("gold") == F.col("predicted")).alias("recall"))


def weak_report(counts: DataFrame, designs: list[str]) -> DataFrame:
    """n, accuracy of the weak labels: what a model trained on them can reach at most."""
    both = _trained(counts, designs).where(F.col("weak").isin(*designs))
    return both.agg(_sum(F.lit(True)).alias("n"), _share(F.col("gold") == F.col("weak")).alias("accuracy"))


def rare_designs(counts: DataFrame, designs: list[str], k: int = 2) -> DataFrame:
    """(gold, n, top): designs a model cannot give, and the ``k`` it gave instead as ``label:count``, ties by label."""
    per = counts.where(~F.col("gold").isin(*designs)).groupBy("gold", "predicted").agg(F.sum("n").alias("n"))
    order = F.array_sort(F.collect_list(F.when(F.col("predicted").isNotNull(), F.struct((-F.col("n")).alias("c"), F.col("predicted").alias("p")))))
    named = F.transform(F.slice(order, 1, k), lambda x: F.concat_ws(":", x["p"], (-x["c"]).cast("string")))
    return per.groupBy("gold").agg(F.sum("n").alias("n"), named.alias("top"))


def annotator_kappa(first: DataFrame, second: DataFrame, key: str, label: str) -> DataFrame:
    """n, agreement and Cohen's kappa over the ids that both annotators gave a label."""
    both = usable(first, key, label).join(usable(second, key, label).withColumnRenamed("gold", "_second"), key)
    return metrics.kappa(both, "gold", "_second")
