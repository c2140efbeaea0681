"""Composed reports: document routing, curves over alpha, recall by group, prompts, banks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import vectors as V
from folio.operators import conformal, scoring


def route_documents(chunks: DataFrame, key: str, bank: DataFrame, alpha: float, low: float = 0.4, tight: float = 0.1, method: str = "lac") -> DataFrame:
    """Chunk scores to one row per document: label, confidence, set, flag and whether it is routed.

    A prediction set of one label decides; otherwise the flag of the thresholds names
    the doubt. ``bank`` holds (alpha, qhat); the nearest alpha is used.
    """
    qhat = conformal.nearest_alpha(bank, alpha).first()["qhat"]
    pooled = scoring.pool(chunks, key)
    v = scoring.verdict(F.col("probs"))
    d = pooled.select(key, "n_chunks", "probs", v.alias("v"))
    d = d.select(key, "n_chunks", "probs", "v.*").withColumn("set", conformal.prediction_set(conformal.scores(F.col("probs"), method), F.lit(qhat)))
    d = d.withColumn("routed", conformal.route(F.col("set"))).withColumn("set", conformal.with_fallback(F.col("set"), F.col("probs")))
    return d.withColumn("flag", F.when(F.col("routed"), F.coalesce(scoring.borderline(F.col("confidence"), F.col("gap"), low, tight), F.lit("SET"))))


def candidates(labels: Column, probs: Column, flag: Column) -> Column:
    """Labels to try next: the prediction set by confidence; two best where the document is borderline."""
    order = F.transform(V.ranked(probs), lambda x: x["k"])
    chosen = F.filter(order, lambda k: F.array_contains(labels, k))
    return F.when(F.size(chosen) > 1, chosen).when(flag.isNotNull(), F.slice(order, 1, 2)).otherwise(F.slice(order, 1, 1))


def coverage_curve(fit: DataFrame, test: DataFrame, scores: str, own: str, truth: str, alphas: list[float]) -> DataFrame:
    """Per alpha: threshold, coverage, mean size and routed share on the test rows.

    The thresholds are a few rows, sent along as constants; the test rows are read once.
    """
    bank = {r["alpha"]: r["qhat"] for r in conformal.quantiles(fit, own, alphas).collect()}
    grid = F.explode(F.array(*(F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(q)).alias("qhat")) for a, q in sorted(bank.items()))))
    each = test.select(scores, truth, grid.alias("g")).withColumn("n_set", F.size(F.filter(scores, lambda s: s <= F.col("g.qhat")))).withColumn("covered", F.element_at(scores, F.col(truth) + 1) <= F.col("g.qhat"))
    return each.groupBy("g.alpha", "g.qhat").agg(F.avg(F.col("covered").cast("double")).alias("coverage"), F.avg(F.col("n_set").cast("double")).alias("avg_size"), F.avg((F.col("n_set") != 1).cast("double")).alias("routed"))


def recall_by(rows: DataFrame, group: str, correct: str, least: int = 10) -> DataFrame:
    """n and recall per group of at least ``least`` rows."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(correct).cast("double")).alias("recall")).where(F.col("n") >= least)


def recalibration_halves(rows: DataFrame, key: str, seed: str = "half") -> tuple[DataFrame, DataFrame]:
    """Two halves by the first digit of md5(key-seed)."""
    first = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))) < "8"
    return rows.where(first), rows.where(~first)


def scope_text(dimension: DataFrame, name: str, description: str, order: str) -> DataFrame:
    """One row: the names and descriptions of a dimension, numbered, as lines of a prompt."""
    rows = F.array_sort(F.collect_list(F.struct(order, name, description)))
    line = F.transform(rows, lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), x[name], F.lit(": "), x[description]))
    return dimension.agg(F.array_join(line, "\n").alias("scope"))


def save_bank(bank: DataFrame, path: str) -> None:
    bank.coalesce(1).write.mode("overwrite").json(path)


def load_bank(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("alpha double, n long, qhat double").option("allowNonNumericNumbers", True).json(path)


def section_weights(chunks: DataFrame, key: str, truth: DataFrame, start: dict[str, float], rounds: int = 40) -> dict[str, float]:
    """Section weights that lower the documents' negative log-likelihood, or ``start`` if none do.

    Coordinate search on log weights with a shrinking step. Every trial of a round is a
    column of one aggregation, so a round is one job whatever the number of sections.
    ``truth``: key and label. The result has a median of 1.
    """
    base = chunks.join(truth, key).select(key, "section", "label", F.element_at("probs", F.col("label") + 1).alias("own"), F.greatest(V.total(F.col("probs")), F.lit(V.TINY)).alias("all"), (F.sqrt(F.greatest("n_words", F.lit(1)) / 200.0)).alias("size"))
    names = sorted(start)

    def losses(tables: list[dict[str, float]]) -> list[float]:
        sums = []
        for k, table in enumerate(tables):
            w = F.lit(0.0)
            for name, weight in table.items():
                w = F.when(F.col("section") == name, weight).otherwise(w)
            w = w * F.col("size")
            sums += [F.sum(w * F.col("own")).alias(f"o{k}"), F.sum(w * F.col("all")).alias(f"a{k}")]
        docs = base.groupBy(key).agg(*sums)
        nll = [F.avg(-F.ln(F.greatest(F.try_divide(f"o{k}", f"a{k}"), F.lit(V.TINY)))) for k in range(len(tables))]
        return list(docs.agg(*nll).first())

    now, best, step = dict(start), losses([start])[0], 2.0
    first = best
    for _ in range(rounds):
        trials = [now | {name: max(now[name], 0.05) * factor} for name in names for factor in (step, 1 / step)]
        found = losses(trials)
        k = min(range(len(trials)), key=found.__getitem__)
        if found[k] < best - 1e-6:
            now, best = trials[k], found[k]
        elif step > 1.05:
            step = step**0.5
        else:
            break
    if best >= first:
        return dict(start)
    middle = sorted(now.values())[len(now) // 2] or 1.0
    return {name: round(w / middle, 4) for name, w in now.items()}


def audit(chunks: DataFrame, key: str, preview: int = 120) -> DataFrame:
    """Per chunk: its verdict, its share of the document's weight, the start of its text."""
    v = scoring.verdict(F.col("probs"))
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy(key))
    return chunks.select(key, "chunk_index", "section", v["label"].alias("label"), F.round(v["confidence"], 4).alias("confidence"), F.round(share, 4).alias("share"), F.substring("text", 1, preview).alias("preview"))
