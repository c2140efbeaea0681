"""Studies of predictions: where they fail, for whom, and what another calibration changes.

All are aggregations of the rows given; a null prediction is a wrong one. Empty tables
give no groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import vectors as V
from folio.operators import conformal, labelling, scoring


def _rate(c: Column) -> Column:
    return F.avg(F.coalesce(c, F.lit(False)).cast("double"))


def strata(rows: DataFrame, stratum: str, truth: str, predicted: str, allowed: str) -> DataFrame:
    """Per stratum: n, accuracy, macro F1 over the labels it has or predicts, accuracy with co-listed labels.

    One pass to cells of (stratum, truth, predicted, co-listed), the rest is over those.
    """
    co = F.coalesce(F.array_contains(allowed, F.col(predicted)), F.lit(False)) | F.coalesce(F.col(truth) == F.col(predicted), F.lit(False))
    cells = rows.groupBy(F.col(stratum).alias("stratum"), F.col(truth).alias("t"), F.col(predicted).alias("p"), co.alias("co")).agg(F.count(F.lit(1)).alias("c"))
    same = F.coalesce(F.col("t") == F.col("p"), F.lit(False))
    sides = F.explode(F.array(F.struct(F.col("t").alias("k"), F.lit(1).alias("n")), F.struct(F.col("p").alias("k"), F.lit(1).alias("n"))))
    per = cells.select("stratum", "c", same.alias("same"), sides.alias("x")).where("x.k is not null").groupBy("stratum", "x.k").agg(F.sum("c").alias("both"), F.sum(F.when(F.col("same"), F.col("c")).otherwise(0)).alias("hits"))
    f1 = per.groupBy("stratum").agg(F.avg(F.col("hits") / F.col("both")).alias("macro_f1"))
    weight = lambda c: F.sum(F.when(c, F.col("c")).otherwise(0)) / F.sum("c")
    base = cells.groupBy("stratum").agg(F.sum("c").alias("n"), weight(same).alias("accuracy"), weight(F.col("co")).alias("co_listed"))
    return base.join(f1, base["stratum"].eqNullSafe(f1["stratum"])).select(base["stratum"], "n", "accuracy", "macro_f1", "co_listed")


def misses(rows: DataFrame, truth: str, predicted: str, of: Column) -> DataFrame:
    """Where the wrong rows among ``of`` went: predicted, n, share of the wrong ones."""
    wrong = rows.where(of & ~F.coalesce(F.col(truth) == F.col(predicted), F.lit(False)))
    counts = wrong.groupBy(predicted).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def mirrored(rows: DataFrame, categories: str, pairs: list[tuple[str, str]], correct: str, ambiguous: str, margin: str) -> DataFrame:
    """Per pair of categories that rows list together: n, ambiguous share, mean vote margin, accuracy.

    A row with several pairs counts for each. The pairs are parameters, a few literals.
    """
    listed = lambda c: F.array_contains(categories, c)
    own = F.array(*(F.when(listed(a) & listed(b), F.lit(f"{a}+{b}")) for a, b in pairs))
    each = rows.select(F.explode(F.filter(own, lambda x: x.isNotNull())).alias("pair"), correct, ambiguous, margin)
    return each.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), _rate(F.col(ambiguous)).alias("ambiguous_share"), F.avg(F.col(margin).cast("double")).alias("mean_margin"), _rate(F.col(correct)).alias("accuracy"))


def areas(rows: DataFrame, area: str, truth: str, predicted: str, k: int = 3) -> DataFrame:
    """Per area: n, hit rate and the ``k`` commonest predictions as ``label:count``, ties by label."""
    cells = rows.groupBy(area, predicted).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col(truth) == F.col(predicted)).alias("h"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), F.col(predicted).alias("p"))))
    named = F.transform(F.slice(order, 1, k), lambda x: F.concat_ws(":", x["p"].cast("string"), (-x["c"]).cast("string")))
    return cells.groupBy(area).agg(F.sum("c").alias("n"), (F.sum("h") / F.sum("c")).alias("hit_rate"), named.alias("top"))


def recalibrated(old: DataFrame, new: DataFrame, test: DataFrame, scores: str, own: str, truth: str, predicted: str, alphas: list[float], by: str | None = None) -> DataFrame:
    """Per alpha and source of calibration (``old``, ``new``): what the sets of the test rows hold and route.

    With ``by`` (such as a mark of ambiguous rows) for each of its values, null among them.
    """
    grid = []
    for name, rows in (("old", old), ("new", new)):
        grid += [F.struct(F.lit(name).alias("calibration"), F.lit(float(r["alpha"])).alias("alpha"), F.lit(float(r["qhat"])).alias("qhat")) for r in conformal.quantiles(rows, own, alphas).collect()]
    own_groups = [by] if by else []
    each = test.select(scores, truth, predicted, *own_groups, F.explode(F.array(*grid)).alias("g")).withColumn("_set", conformal.prediction_set(F.col(scores), F.col("g.qhat")))
    return conformal.evaluate_sets(each.select("g.*", "_set", truth, predicted, *own_groups), "_set", truth, predicted, [*own_groups, "calibration", "alpha", "qhat"])


def document_sets(chunks: DataFrame, key: str, strategy: str, qhat: float, classes: int, method: str = "lac") -> DataFrame:
    """Sets of documents from chunk scores under a threshold fitted on chunks: key, predicted, set."""
    pooled = scoring.pool(chunks, key, strategy, classes=classes)
    found = conformal.prediction_set(conformal.scores(F.col("probs"), method), F.lit(qhat))
    return pooled.select(key, V.argmax(F.col("probs")).alias("predicted"), found.alias("set"))


def strategies(chunks: DataFrame, key: str, truth: DataFrame, label: str, names: list[str], classes: int) -> DataFrame:
    """Accuracy of documents under each pooling strategy; ``truth`` has key and label."""
    parts = [scoring.pool(chunks, key, s, classes=classes).select(key, F.lit(s).alias("strategy"), V.argmax(F.col("probs")).alias("_p")) for s in names]
    every = reduce(DataFrame.unionByName, parts)
    return every.join(truth, key).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), _rate(F.col("_p") == F.col(label)).alias("accuracy"))


#: Below this probability of its own rule a design is marked.
LOW_CONFIDENCE = 0.45


def resolved_design(probs: dict[str, Column], thresholds: dict[str, float], similar: Column | None = None) -> Column:
    """Struct (design, source, flag) from facet probabilities.

    Facets over their thresholds (0.5 where none is given) decide by the design rules.
    Where none is, the design that similar items vote for stands in if given, else that
    of the most probable facet, the first on ties; with null probabilities the default.
    """
    over = {f: F.coalesce(p >= thresholds.get(f, 0.5), F.lit(False)) for f, p in probs.items()}
    first = _designs(over)
    best = F.greatest(*(F.coalesce(p, F.lit(-1.0)) for p in probs.values()))
    lone, tops = F.lit(None).cast("string"), list(probs.items())
    for f, p in reversed(tops):
        lone = F.when(p == best, F.lit(_only(f))).otherwise(lone)
    fired = reduce(Column.__or__, over.values())
    instead = F.struct(lone.alias("d"), F.lit("top_facet").alias("s")) if similar is None else F.struct(similar.alias("d"), F.lit("similar_items").alias("s"))
    none = F.when(instead["d"].isNotNull(), instead).otherwise(F.struct(F.lit(labelling.DEFAULT_DESIGN).alias("d"), F.lit("default").alias("s")))
    sure = _rule_probability(over, probs)
    flag = F.when(~fired, "NO_EVIDENCE").when(sure < LOW_CONFIDENCE, "LOW_CONFIDENCE").when(F.size(first) > 1, "UNDERDETERMINED")
    return F.struct(F.when(fired, first[0]).otherwise(none["d"]).alias("design"), F.when(fired, "facets").otherwise(none["s"]).alias("source"), flag.alias("flag"))


def _all(yes: tuple[str, ...], no: tuple[str, ...], over: dict[str, Column]) -> Column:
    return reduce(Column.__and__, [*(over[f] for f in yes), *(~over[f] for f in no)])


def _designs(over: dict[str, Column]) -> Column:
    fired = F.array(*(F.when(_all(yes, no, over), name) for name, yes, no in labelling.DESIGN_RULES))
    found = F.array_distinct(F.filter(fired, lambda x: x.isNotNull()))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(labelling.DEFAULT_DESIGN)))


def _only(facet: str) -> str:
    """The design of a row with this facet alone."""
    return next((name for name, yes, _ in labelling.DESIGN_RULES if yes == (facet,)), labelling.DEFAULT_DESIGN)


def _rule_probability(over: dict[str, Column], probs: dict[str, Column]) -> Column:
    """The probability that the first rule that fired holds."""
    out = F.lit(None).cast("double")
    for _, yes, no in reversed(labelling.DESIGN_RULES):
        p = reduce(lambda a, b: a * b, [*(probs[f] for f in yes), *(1 - probs[f] for f in no)])
        out = F.when(_all(yes, no, over), p).otherwise(out)
    return out


def ballot_probs(probs: Column, classes: int) -> Column:
    """The probabilities, or even shares where a document has no classifiable text (null or none)."""
    even = F.array(*(F.lit(1.0 / classes) for _ in range(classes)))
    return F.when(F.size(probs) > 0, probs).otherwise(even)


def ranking(results: DataFrame, name: str, by: list[str]) -> DataFrame:
    """Models of a comparison in order of the given figures, best first, ties by name, with ``place``.

    A row per model: small by nature.
    """
    order = Window.partitionBy().orderBy(*(F.col(c).desc_nulls_last() for c in by), name)
    return results.withColumn("place", F.row_number().over(order))


def markdown_table(results: DataFrame, columns: list[str], order: str) -> str:
    """The rows of a small report as a Markdown table, numbers with four places."""
    cell = lambda x: "-" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    lines = [columns, ["---"] * len(columns), *([cell(x) for x in r] for r in results.orderBy(order).select(*columns).collect())]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
