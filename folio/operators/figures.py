"""The tables behind the figures of a report; drawing them is left to the reader's tool.

Each is one aggregation of the rows to a table of plotted points. Empty tables give no
points, but for the grid of a confusion matrix, whose labels are a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _share(c: Column) -> Column:
    return F.avg(F.coalesce(c, F.lit(False)).cast("double"))


def confusion_grid(rows: DataFrame, group: str, truth: str, predicted: str, labels: dict[str, list[int]]) -> DataFrame:
    """(panel, truth, predicted, n, share of the true label): every pair of a panel's labels, zeros included.

    ``labels`` names the panels, values of ``group``, and the label numbers of each. Rows
    of other panels, or with a label that theirs lacks, are in no cell.
    """
    pairs = [(g, a, b) for g, own in labels.items() for a in own for b in own]
    grid = rows.sparkSession.createDataFrame(pairs, "panel string, truth int, predicted int")
    counts = rows.groupBy(F.col(group).cast("string").alias("panel"), F.col(truth).cast("int").alias("truth"), F.col(predicted).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    filled = grid.join(counts, ["panel", "truth", "predicted"], "left").na.fill({"n": 0})
    own = F.sum("n").over(Window.partitionBy("panel", "truth"))
    return filled.withColumn("share", F.when(own > 0, F.col("n") / own).otherwise(0.0))


def reliability_curves(rows: DataFrame, series: str, confidence: str, correct: str, bins: int = 15, least: int = 30) -> DataFrame:
    """(series, bin, n, confidence, accuracy, ece): bins with too few rows aren't drawn, but count in the error."""
    b = F.ceil(F.col(confidence) * bins).cast("int")
    each = rows.where(F.col(confidence) > 0).groupBy(F.col(series).alias("series"), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), _share(F.col(correct)).alias("accuracy"))
    whole = Window.partitionBy("series")
    ece = F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))).over(whole) / F.sum("n").over(whole)
    return each.withColumn("ece", ece).where(F.col("n") >= least)


def score_bars(results: DataFrame, model: str, split: str, score: str, first: str, second: str) -> DataFrame:
    """(model, place, first, second): models with a score on both splits, by that on the first, ties by name."""
    per = results.groupBy(F.col(model).alias("model")).agg(F.max(F.when(F.col(split) == first, F.col(score))).alias("first"), F.max(F.when(F.col(split) == second, F.col(score))).alias("second"))
    return per.where("first is not null and second is not null").withColumn("place", F.row_number().over(Window.orderBy("first", "model")))


def share_bars(rows: DataFrame, label: str, before: str, after: str, unsupported: str) -> DataFrame:
    """(label, before, after, unsupported): shares of all rows with a label in an earlier and a later run.

    ``unsupported``: the share with the label before and, by that boolean column, no evidence for it.
    Labels that only the later run has are left out, as in the figure.
    """
    runs = F.explode(F.array(F.struct(F.col(before).alias(label), F.lit(1).alias("b"), F.lit(0).alias("a"), F.coalesce(F.col(unsupported), F.lit(False)).cast("int").alias("u")), F.struct(F.col(after).alias(label), F.lit(0).alias("b"), F.lit(1).alias("a"), F.lit(0).alias("u"))))
    sums = rows.select(runs.alias("x")).select("x.*").where(F.col(label).isNotNull()).groupBy(label).agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.sum("u").alias("u"))
    n = F.sum("b").over(Window.partitionBy())
    return sums.select(label, (F.col("b") / n).alias("before"), (F.col("a") / n).alias("after"), (F.col("u") / n).alias("unsupported"), F.col("b").alias("_b")).where("_b > 0").drop("_b")


def agreement_bars(rows: DataFrame, split: str, unseen: str, candidates: dict[str, Column], commonest: str) -> DataFrame:
    """(split, answer, n, agreement): how often each candidate answer is among the labels of ``unseen`` text.

    ``commonest`` names one answer more: always the label that most rows of the split have
    in ``unseen``, ties by label. Rows whose ``unseen`` is null or empty are left out.
    """
    judged = rows.where(F.size(unseen) > 0)
    pairs = F.explode(F.array(*(F.struct(F.lit(name).alias("answer"), F.array_contains(unseen, c).alias("hit")) for name, c in candidates.items())))
    named = judged.select(F.col(split).alias("split"), pairs.alias("x")).groupBy("split", "x.answer").agg(F.count(F.lit(1)).alias("n"), _share(F.col("x.hit")).alias("agreement"))
    held = judged.select(F.col(split).alias("split"), F.explode(F.array_distinct(unseen)).alias("label")).groupBy("split", "label").agg(F.count(F.lit(1)).alias("c"))
    sizes = judged.groupBy(F.col(split).alias("split")).agg(F.count(F.lit(1)).alias("n"))
    best = held.groupBy("split").agg(F.max("c").alias("c")).join(sizes, "split")
    return named.unionByName(best.select("split", F.lit(commonest).alias("answer"), "n", (F.col("c") / F.col("n")).alias("agreement")))
