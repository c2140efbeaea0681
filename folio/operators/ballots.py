"""Labels that only some groups allow: scores, thresholds and sets over ragged label spaces.

A ballot table says which labels a group allows; groups may differ in size and share
labels. Scores are in long form, a row per item and label, so a set over several candidate
groups is a union of rows and no group is padded to the widest. Items without a label of
a group have no row there; null scores don't count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.operators import conformal


def ballot_probabilities(logits: DataFrame, ballots: DataFrame, key: str, group: str, label: str, logit: str) -> DataFrame:
    """(key, group, label, p): softmax over the labels that each group allows."""
    per = Window.partitionBy(key, group)
    rows = logits.where(F.col(logit).isNotNull()).join(ballots.select(group, label).distinct(), label)
    raised = rows.select(key, group, label, F.exp(F.col(logit) - F.max(logit).over(per)).alias("_e"))
    return raised.select(key, group, label, (F.col("_e") / F.sum("_e").over(per)).alias("p"))


def ballot_thresholds(probabilities: DataFrame, truth: DataFrame, key: str, group: str, label: str, alphas: list[float]) -> DataFrame:
    """(group, alpha, n, qhat) from calibration items: ``truth`` has key, group and label of each.

    A group without calibration items has no row; its sets hold every label.
    """
    own = probabilities.join(truth.select(key, group, label), [key, group, label]).withColumn("own", 1.0 - F.col("p"))
    return conformal.quantiles(own, "own", alphas, group)


def ballot_sets(probabilities: DataFrame, thresholds: DataFrame, candidates: DataFrame, key: str, group: str, label: str) -> DataFrame:
    """(the columns of ``candidates`` but group, n_groups, set): the union of the sets of an item's candidate groups.

    ``thresholds`` has one row a group. An item none of whose labels qualify has an empty set.
    """
    names = [c for c in candidates.columns if c != group]
    inside = probabilities.join(thresholds.select(group, "qhat"), group, "left").where(F.col("qhat").isNull() | (1.0 - F.col("p") <= F.col("qhat"))).select(key, group, label)
    sets = candidates.join(inside, [key, group], "left").groupBy(*names)
    return sets.agg(F.count_distinct(group).alias("n_groups"), F.array_sort(F.collect_set(label)).alias("set"))


def policies(groups: DataFrame, key: str, group: str, score: str, low: float, tight: float, qhat: float | None = None) -> DataFrame:
    """(policy, key, group): the groups each policy reads, from (key, group, score), one row per item and group.

    ``top``: the best; ``borderline``: also the second, where the best is below ``low`` or leads
    by less than ``tight``; ``set`` (with ``qhat``): all whose 1 - score is within it, and the
    best; ``all``. The smaller group is the better of equals.
    """
    order = Window.partitionBy(key).orderBy(F.desc(score), group)
    best = F.max(score).over(Window.partitionBy(key))
    ranked = groups.select(key, group, F.col(score).alias("_s"), F.row_number().over(order).alias("_r"), best.alias("_best"))
    second = F.max(F.when(F.col("_r") == 2, F.col("_s"))).over(Window.partitionBy(key))
    ranked = ranked.withColumn("_unsure", (F.col("_best") < low) | F.coalesce(F.col("_best") - second < tight, F.lit(False)))
    reads = {"top": F.col("_r") == 1, "borderline": (F.col("_r") == 1) | ((F.col("_r") == 2) & F.col("_unsure")), "all": F.lit(True)}
    if qhat is not None:
        reads["set"] = (F.col("_r") == 1) | (1.0 - F.col("_s") <= qhat)
    named = F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in sorted(reads.items()))), lambda x: x.isNotNull()))
    return ranked.select(named.alias("policy"), key, group)


def policy_report(sets: DataFrame, truth: DataFrame, key: str, label: str) -> DataFrame:
    """Per policy: items, coverage of the true label, mean groups read and set size, shares of one label and of none."""
    rows = sets.join(truth.select(key, label), key)
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy("policy").agg(
        F.count(F.lit(1)).alias("n"), share(F.array_contains("set", F.col(label))).alias("coverage"), share(F.col("n_groups")).alias("groups_read"),
        share(F.size("set")).alias("avg_size"), share(F.size("set") == 1).alias("singleton"), share(F.size("set") == 0).alias("empty"),
    )
