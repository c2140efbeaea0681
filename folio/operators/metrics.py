"""Evaluation reports as aggregates. Every report is one pass to a small table of counts."""

from __future__ import annotations

from math import exp, lgamma, log, log1p, pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.relational import running_sums


def _share(c: Column) -> Column:
    return F.avg(c.cast("double"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts per pair, and each as a share of its true class."""
    counts = rows.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))


def per_class(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """class, support, precision, recall, f1; zero where a division is by zero."""
    sides = F.explode(F.array(F.struct(F.col(truth).alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    hit = (F.col(truth) == F.col(predicted)).cast("int")
    sums = rows.select(hit.alias("hit"), sides.alias("x")).groupBy("x.class").agg(F.sum("x.t").alias("support"), F.sum("x.p").alias("claimed"), F.sum(F.col("hit") * F.col("x.t")).alias("tp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, s, c = F.col("tp"), F.col("support"), F.col("claimed")
    return sums.select("class", "support", ratio(tp, c).alias("precision"), ratio(tp, s).alias("recall"), ratio(2 * tp, s + c).alias("f1"))


def summary(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """n, accuracy, macro_f1, weighted_f1."""
    f = per_class(rows, truth, predicted)
    return f.agg(F.sum("support").alias("n"), (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def reliability(rows: DataFrame, confidence: str, correct: str, bins: int = 15) -> DataFrame:
    """Per bin (lo, hi] with rows: n, mean confidence, accuracy."""
    b = F.ceil(F.col(confidence) * bins).cast("int")
    return rows.where(F.col(confidence) > 0).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), _share(F.col(correct)).alias("accuracy"))


def calibration_error(rows: DataFrame, confidence: str, correct: str, bins: int = 15) -> DataFrame:
    """Expected calibration error over all rows."""
    per = reliability(rows, confidence, correct, bins)
    return per.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def _kind(truth: str, predicted: str, allowed: str, adjacent: str) -> Column:
    return F.when(F.col(truth) == F.col(predicted), "correct").when(F.array_contains(allowed, F.col(predicted)), "co_listed").when(F.array_contains(adjacent, F.col(predicted)), "adjacent").otherwise("genuine")


def error_kinds(rows: DataFrame, truth: str, predicted: str, allowed: str, adjacent: str) -> DataFrame:
    """Counts of correct, co_listed (in allowed), adjacent and genuine."""
    return rows.groupBy(_kind(truth, predicted, allowed, adjacent).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def confused_pairs(rows: DataFrame, truth: str, predicted: str, allowed: str, adjacent: str, k: int = 5) -> DataFrame:
    """(kind, truth, predicted, n, place): the k commonest pairs of each kind of error, ties by truth, then predicted."""
    kind = _kind(truth, predicted, allowed, adjacent)
    pairs = rows.select(kind.alias("kind"), truth, predicted).where("kind <> 'correct'").groupBy("kind", truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), truth, predicted))
    return pairs.withColumn("place", place).where(F.col("place") <= k)


def margin_bands(rows: DataFrame, margin: str, correct: str, edges: list[float]) -> DataFrame:
    """(low, high, n, accuracy, mean_margin) of margins from one edge to below the next.

    The last band has no upper end; margins below the first edge, and null ones, are in no band.
    """
    m = F.col(margin)
    pairs = list(zip(edges, [*edges[1:], None], strict=True))
    band = F.coalesce(*(F.when((m >= a) & (F.lit(True) if b is None else m < b), F.struct(F.lit(a).alias("low"), F.lit(b).cast("double").alias("high"))) for a, b in pairs))
    held = rows.select(band.alias("b"), m.alias("m"), F.col(correct).alias("c")).where(F.col("b").isNotNull())
    return held.groupBy("b.low", "b.high").agg(F.count(F.lit(1)).alias("n"), _share(F.col("c")).alias("accuracy"), F.avg("m").alias("mean_margin"))


def hierarchical(rows: DataFrame, truth: str, predicted: str, truth_parent: str, predicted_parent: str) -> DataFrame:
    """Credit of 1 for the class and its parent, half for the parent alone (precision = recall = F1)."""
    leaf, top = F.col(truth) == F.col(predicted), F.col(truth_parent) == F.col(predicted_parent)
    return rows.agg(F.count(F.lit(1)).alias("n"), _share(leaf).alias("leaf_accuracy"), _share(top).alias("parent_accuracy"), F.avg((leaf.cast("int") + top.cast("int")) / 2.0).alias("hierarchical_f1"))


def threshold_sweep(rows: DataFrame, confidence: str, gap: str, correct: str, lows: list[float], tights: list[float]) -> DataFrame:
    """Per pair of thresholds: share flagged, errors caught, precision of the flag. The grid
    is an array of constants, so the rows are read once."""
    grid = F.explode(F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b).alias("tight")) for a in lows for b in tights)))
    each = rows.select(F.col(confidence).alias("c"), F.col(gap).alias("g"), (~F.col(correct)).alias("wrong"), grid.alias("t"))
    fired = (F.col("c") < F.col("t.low")) | (F.col("g") < F.col("t.tight"))
    return each.withColumn("fired", fired).groupBy("t.low", "t.tight").agg(_share(F.col("fired")).alias("fire_rate"), F.avg(F.when(F.col("wrong"), F.col("fired").cast("double"))).alias("error_recall"), F.avg(F.when(F.col("fired"), F.col("wrong").cast("double"))).alias("precision"))


def best_thresholds(sweep: DataFrame, budget: float) -> DataFrame:
    """The pair of best recall, then precision, whose fire rate is within the budget."""
    best = F.max_by(F.struct("low", "tight", "fire_rate", "error_recall", "precision"), F.struct("error_recall", "precision", -F.col("low"), -F.col("tight")))
    return sweep.where(F.col("fire_rate") <= budget).agg(best.alias("x")).select("x.*")


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two label columns where both are given."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = both.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    left = cells.groupBy(F.col(a).alias("x")).agg(F.sum("n").alias("na"))
    right = cells.groupBy(F.col(b).alias("x")).agg(F.sum("n").alias("nb"))
    pe = left.join(right, "x").agg(F.sum(F.col("na") * F.col("nb")).alias("pe"))
    po = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    joined = po.join(pe, F.lit(True))  # one row each
    agree, chance = F.col("same") / F.col("n"), F.coalesce("pe", F.lit(0)) / (F.col("n") * F.col("n"))
    return joined.select("n", agree.alias("agreement"), F.when(chance < 1, (agree - chance) / (1 - chance)).alias("kappa"))


def _stirling_rest(n: int) -> float:
    """ln n! less Stirling's formula for it."""
    if n < 16:
        return lgamma(n + 1) - (n + 0.5) * log(n) + n - 0.5 * log(2 * pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n**2) / n**2) / n**2) / n


def _fair_coin(n: int, k: int) -> float:
    """The chance of k heads in n throws, without the difference of large logarithms."""
    if k == 0 or k == n:
        return exp(-n * log(2))
    d = (n - 2 * k) / n
    apart = n / 2 * ((1 - d) * log1p(-d) + (1 + d) * log1p(d))
    return exp(_stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k) - apart) * sqrt(n / (2 * pi * k * (n - k)))


def _two_sided(b: int, c: int) -> float:
    """Twice the chance of min(b, c) heads or fewer in b + c throws, at most 1."""
    n, k = b + c, min(b, c)
    term = total = _fair_coin(n, k)
    while k and term > total * 1e-17:  # each term is less than the one before
        term *= k / (n - k + 1)
        total += term
        k -= 1
    return min(1.0, 2 * total)


def mcnemar(rows: DataFrame, first: str, second: str) -> dict:
    """Exact two-sided McNemar test of two boolean columns, from two counts.

    Its sum starts at the largest term and ends where the rest is below a double's last place.
    """
    b, c = rows.agg(F.count_if(F.col(first) & ~F.col(second)), F.count_if(~F.col(first) & F.col(second))).first()
    return {"first_only": b, "second_only": c, "p_value": 1.0 if b == c else _two_sided(b, c)}


def roc_auc(rows: DataFrame, score: str, truth: str, groups: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by rank sums, ties at their mean rank.

    Equal scores are counted first, so the running sum is over distinct scores.
    """
    keys = groups or []
    per = rows.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(truth).cast("int")).alias("_pos"))
    ranked = running_sums(per, score, ["_n"], keys).withColumn("_rank", F.col("run__n") - (F.col("_n") - 1) / 2.0)
    pos, neg = F.sum("_pos"), F.sum(F.col("_n") - F.col("_pos"))
    auc = (F.sum(F.col("_rank") * F.col("_pos")) - pos * (pos + 1) / 2.0) / (pos * neg)
    return ranked.groupBy(*keys).agg(pos.alias("positives"), neg.alias("negatives"), F.when((pos > 0) & (neg > 0), auc).alias("auc"))


def average_precision(rows: DataFrame, score: str, truth: str, groups: list[str] | None = None) -> DataFrame:
    keys = groups or []
    per = rows.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(truth).cast("int")).alias("_pos"))
    precision = running_sums(per, score, ["_n", "_pos"], keys, descending=True).withColumn("_p", F.col("run__pos") / F.col("run__n"))
    return precision.groupBy(*keys).agg((F.sum(F.col("_p") * F.col("_pos")) / F.nullif(F.sum("_pos"), F.lit(0))).alias("average_precision"))


def mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Normalised by the mean of the two entropies."""
    cells = rows.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    w = cells.withColumn("t", F.sum("n").over(Window.partitionBy())).withColumn("na", F.sum("n").over(Window.partitionBy(a))).withColumn("nb", F.sum("n").over(Window.partitionBy(b)))
    p, pa, pb = F.col("n") / F.col("t"), F.col("na") / F.col("t"), F.col("nb") / F.col("t")
    mi, ha, hb = F.sum(p * F.ln(p / (pa * pb))), -F.sum(p * F.ln(pa)), -F.sum(p * F.ln(pb))
    return w.agg(F.when(ha + hb > 0, 2 * mi / (ha + hb)).otherwise(1.0).alias("nmi"))


def fitted_threshold(rows: DataFrame, score: str, truth: str, grid: list[float]) -> DataFrame:
    """The threshold of best F1, the first on ties."""
    t = F.explode(F.array(*(F.lit(float(x)) for x in grid)))
    hit = F.col("s") >= F.col("threshold")
    per = rows.select(F.col(score).alias("s"), F.col(truth).alias("y"), t.alias("threshold")).groupBy("threshold").agg(F.count_if(hit & F.col("y")).alias("tp"), F.count_if(hit).alias("c"), F.count_if(F.col("y")).alias("s"))
    f1 = F.when(F.col("s") + F.col("c") > 0, 2 * F.col("tp") / (F.col("s") + F.col("c"))).otherwise(0.0)
    return per.withColumn("f1", f1).agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("x")).select("x.*")


def lift(rows: DataFrame, signal: str, outcome: str) -> DataFrame:
    """Share of the outcome with and without a signal, and their ratio."""
    with_, without = _share(F.when(F.col(signal), F.col(outcome))), _share(F.when(~F.col(signal), F.col(outcome)))
    return rows.agg(with_.alias("with_signal"), without.alias("without_signal"), F.when(without > 0, with_ / without).alias("lift"))


def bootstrap_difference(rows: DataFrame, a: str, b: str, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """95 % interval of mean(a - b) by Poisson bootstrap, from the counts of distinct differences.

    How often a difference that n rows have is drawn in a resample is Poisson of mean n,
    as the sum of n draws of mean 1 is. So rows are counted first; each task adds up the
    resamples over its differences and sends two numbers for each, however many rows there
    are. Draws are seeded by the difference itself: the same in every run. Rows where a or
    b is null don't count; without rows all three numbers are null.
    """
    gap = F.col(a).cast("double") - F.col(b).cast("double")
    cells = rows.select(gap.alias("d")).where("d is not null").groupBy("d").agg(F.count(F.lit(1)).alias("n"))

    def draw(batches):
        import numpy as np
        import pyarrow as pa

        weight, total = np.zeros(resamples), np.zeros(resamples)
        for batch in batches:
            for d, n in zip(batch.column("d").to_pylist(), batch.column("n").to_pylist(), strict=True):
                times = np.random.default_rng([seed, *np.array([d + 0.0]).view(np.uint32).tolist()]).poisson(n, resamples)
                weight, total = weight + times, total + times * d
        if weight.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(resamples), pa.int32()), pa.array(weight), pa.array(total)], ["r", "w", "s"])

    means = cells.mapInArrow(draw, "r int, w double, s double").groupBy("r").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.avg("m").alias("mean"))


def routing_report(rows: DataFrame, labels: str, under_each: str, truth: str, group_truth: str) -> DataFrame:
    """Does the shortlist of groups hold the right label? Coverage, candidates, routed and singleton shares.

    ``labels``: array of groups ruled in; ``under_each``: the best label under every group.
    """
    size = F.size(labels)
    hit = F.exists(labels, lambda g: F.element_at(F.col(under_each), g + 1) == F.col(truth))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), _share(F.array_contains(labels, F.col(group_truth))).alias("set_coverage"), _share(hit).alias("label_in_candidates"), F.avg(size.cast("double")).alias("avg_candidates"),
        _share(size != 1).alias("routed"), _share(size == 0).alias("empty"), _share(size == 1).alias("singleton"), F.avg(F.when(size == 1, hit.cast("double"))).alias("singleton_accuracy"),
    )


def cascade_report(rows: DataFrame, group_truth: str, group: str, truth: str, oracle: str, end_to_end: str, groups: list[str] | None = None) -> DataFrame:
    """Accuracy of the group, of the label under the true and under the predicted group, and what that costs."""
    right, ideal, real = F.col(group) == F.col(group_truth), F.col(oracle) == F.col(truth), F.col(end_to_end) == F.col(truth)
    out = rows.groupBy(*(groups or [])).agg(F.count(F.lit(1)).alias("n"), _share(right).alias("group_accuracy"), _share(ideal).alias("oracle_accuracy"), _share(real).alias("end_to_end_accuracy"), F.avg(F.when(right, real.cast("double"))).alias("accuracy_given_group"))
    return out.withColumn("cascade_loss", F.col("oracle_accuracy") - F.col("end_to_end_accuracy"))


def abstaining_agreement(rows: DataFrame, truth: str, predicted: str, allowed: str) -> DataFrame:
    """Agreement of a labeller that may give no label (null): coverage, strict, and with co-listed labels."""
    there = F.col(predicted).isNotNull()
    strict = F.col(truth) == F.col(predicted)
    co = strict | F.array_contains(allowed, F.col(predicted))
    return rows.agg(_share(there).alias("coverage"), F.count_if(there).alias("n"), F.avg(F.when(there, strict.cast("double"))).alias("strict"), F.avg(F.when(there, co.cast("double"))).alias("co_listed"))


def breakdown(rows: DataFrame, group: str, correct: str, confidence: str) -> DataFrame:
    """n, accuracy and mean confidence by group."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), _share(F.col(correct)).alias("accuracy"), F.avg(confidence).alias("confidence"))


def weakest(rows: DataFrame, group: str, correct: str, k: int = 8, least: int = 10) -> DataFrame:
    """The k groups of lowest accuracy among those with enough rows, ties by group."""
    shares = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), _share(F.col(correct)).alias("accuracy")).where(F.col("n") >= least)
    return shares.orderBy("accuracy", group).limit(k)


def kappas(rows: DataFrame, a: str, b: str, group: str) -> DataFrame:
    """(group, n, agreement, kappa) of two label columns within each group, where both are given."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(group, a, b).agg(F.count(F.lit(1)).alias("n"))
    sides = F.explode(F.array(F.struct(F.col(a).alias("x"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb")), F.struct(F.col(b).alias("x"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb"))))
    chance = cells.select(group, sides.alias("s")).groupBy(group, "s.x").agg(F.sum("s.na").alias("na"), F.sum("s.nb").alias("nb")).groupBy(group).agg(F.sum(F.col("na") * F.col("nb")).alias("pe"))
    same = cells.groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    po, pe = F.col("same") / F.col("n"), F.col("pe") / (F.col("n") * F.col("n"))
    return same.join(chance, group).select(group, "n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def smallest_best(curve: DataFrame, setting: str, value: str, slack: float = 1e-9) -> DataFrame:
    """The smallest setting whose value is the best of the curve."""
    top = curve.agg(F.max(value)).first()[0]
    return curve.where(F.col(value) >= F.lit(top) - slack).orderBy(setting).limit(1)
