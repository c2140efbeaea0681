"""Chunk scores to documents, ballots, blends, temperature, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions import vectors as V


def chunk_weight(section: Column, n_words: Column, probs: Column, classes: int) -> Column:
    """Section prior times a root of the length times how sure the chunk is."""
    sure = F.least(F.greatest(1 - V.entropy_share(probs, classes), F.lit(0.05)), F.lit(1.0))
    return T.section_prior(section) * F.sqrt(F.greatest(n_words, F.lit(1)) / 200.0) * sure


def pool(chunks: DataFrame, key: str, strategy: str = "weighted_mean", weight: str = "weight", order: str = "chunk_index", classes: int | None = None) -> DataFrame:
    """(key, n_chunks, probs): mean, max, weighted_mean or weighted_geometric of ``probs``.

    ``max`` takes the row whose largest probability is largest, the first on ties. A
    document whose weights sum to nothing counts its chunks alike. One aggregation with
    a sum per class, so a chunk never becomes several rows; without ``classes`` the
    first row tells how many there are. A null weight counts as 0.
    """
    if strategy == "max":
        best = F.max_by("probs", F.struct(F.array_max("probs"), -F.col(order)))
        return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"), best.alias("_p")).select(key, "n_chunks", V.renormalised(F.col("_p")).alias("probs"))
    if classes is None:
        first = chunks.select(F.size("probs")).first()
        classes = first[0] if first else 0
    geometric = strategy == "weighted_geometric"
    at = lambda k: F.ln(F.greatest(F.col("probs")[k], F.lit(V.TINY))) if geometric else F.col("probs")[k]
    w = F.coalesce(F.col(weight), F.lit(0.0)) if strategy != "mean" else F.lit(1.0)
    sums = [F.sum(w * at(k)).alias(f"_w{k}") for k in range(classes)] + [F.sum(at(k)).alias(f"_s{k}") for k in range(classes)]
    held = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(w).alias("_t"), *sums)
    mean = lambda k: F.when(F.col("_t") > 0, F.try_divide(F.col(f"_w{k}"), F.col("_t"))).otherwise(F.col(f"_s{k}") / F.col("n_chunks"))
    probs = F.array(*(F.exp(mean(k)) if geometric else mean(k) for k in range(classes)))
    return held.select(key, "n_chunks", V.renormalised(probs).alias("probs"))


def pool_section(chunks: DataFrame, key: str, sections: list[str], **how) -> DataFrame:
    """Documents pooled over their chunks of some sections alone; those without any are absent."""
    return pool(chunks.where(F.col("section").isin(*sections)), key, **how)


def largest_per_class(blocks: DataFrame, key: str, classes: int) -> DataFrame:
    """(key, n_blocks, probs): each class's largest probability over the blocks of a document."""
    most = F.array(*(F.max(F.col("probs")[k]) for k in range(classes)))
    return blocks.groupBy(key).agg(F.count(F.lit(1)).alias("n_blocks"), most.alias("probs"))


#: The order in which sections are read for a document's design.
READ_ORDER = ("methods", "abstract", "introduction")


def read_order(chunks: DataFrame, key: str, order: tuple[str, ...] = READ_ORDER, fallback: int = 2) -> DataFrame:
    """The chunks of the first section in ``order`` that a document has, else its longest few; with ``source``."""
    place = F.array_position(F.array(*(F.lit(x) for x in order)), F.col("section"))
    mine = F.when(place > 0, place)
    per = Window.partitionBy(key)
    ranked = chunks.withColumn("_at", mine).withColumn("_first", F.min("_at").over(per)).withColumn("_rank", F.row_number().over(per.orderBy(F.desc("n_words"), "chunk_index")))
    kept = ranked.where((F.col("_at") == F.col("_first")) | (F.col("_first").isNull() & (F.col("_rank") <= fallback)))
    return kept.withColumn("source", F.when(F.col("_first").isNull(), "fallback").otherwise(F.col("section"))).drop("_at", "_first", "_rank")


def mean_logs(rows: DataFrame, probs: str, classes: int) -> list[float]:
    """Mean log-probability of each class: a prior to be taken out."""
    row = rows.agg(*(F.avg(F.ln(F.col(probs)[k] + 1e-12)) for k in range(classes))).first()
    return [x or 0.0 for x in row]


def blend_curve(rows: DataFrame, parts: list[str], truth: str, grid: list[tuple[float, ...]]) -> DataFrame:
    """(weights, accuracy) of every blend of probability columns; rows are read once, the grid is constants."""
    hits = [F.avg((V.argmax(V.blend([(F.col(p), w) for p, w in zip(parts, weights, strict=True)])) == F.col(truth)).cast("double")).alias(f"_{k}") for k, weights in enumerate(grid)]
    row = F.explode(F.array(*(F.struct(F.array(*(F.lit(float(w)) for w in weights)).alias("weights"), F.col(f"_{k}").alias("accuracy")) for k, weights in enumerate(grid))))
    return rows.agg(*hits).select(row.alias("x")).select("x.*")


def searched_temperature(rows: DataFrame, logits: str, label: str, low: float = 0.05, high: float = 20.0, rounds: int = 12) -> float:
    """The temperature of least loss by golden-section search on its logarithm; 1 if that doesn't lower the loss."""
    import math

    loss = lambda ts: {r["temperature"]: r["nll"] for r in temperature_by_grid(rows, logits, label, ts).collect()}
    a, b, ratio = math.log(low), math.log(high), (math.sqrt(5) - 1) / 2
    for _ in range(rounds):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        found = loss([math.exp(c), math.exp(d)])
        if found[math.exp(c)] <= found[math.exp(d)]:
            b = d
        else:
            a = c
    t = math.exp((a + b) / 2)
    both = loss([t, 1.0])
    return t if both[t] < both[1.0] else 1.0


def adopt_temperature(raw: float, fitted: float, guard_raw: float | None = None, guard_fitted: float | None = None) -> bool:
    """Does a fitted temperature lower the calibration error, on the guard slice too if there is one?"""
    guarded = guard_raw is None or guard_fitted is None or guard_fitted < guard_raw
    return fitted < raw and guarded


def verdict(probs: Column) -> Column:
    """Struct (label, confidence, runner_up, gap)."""
    r = V.ranked(probs)
    return F.struct(r[0]["k"].alias("label"), r[0]["p"].alias("confidence"), r[1]["k"].alias("runner_up"), (r[0]["p"] - r[1]["p"]).alias("gap"))


def borderline(confidence: Column, gap: Column, low: float, tight: float) -> Column:
    return F.when(confidence < low, "LOW_CONFIDENCE").when(gap < tight, "TIGHT_GAP")


def ballot_softmax(scores: DataFrame, key: str, group: str, tree: DataFrame, logit: str = "logit") -> DataFrame:
    """Softmax of long-form scores (key, group, class_id, logit) over the classes of the row's group.

    ``tree``: class_id and its group.
    """
    on = scores.join(tree.select("class_id", F.col(group).alias("_g")), "class_id").where(F.col(group) == F.col("_g")).drop("_g")
    per = Window.partitionBy(key, group)
    e = F.exp(F.col(logit) - F.max(logit).over(per))
    return on.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(per)).drop("_e")


def conditioned_class(scores: DataFrame, key: str, group: str, tree: DataFrame, logit: str = "logit") -> DataFrame:
    """The best class within the row's group, the first on ties."""
    on = ballot_softmax(scores, key, group, tree, logit)
    return on.groupBy(key).agg(F.max_by("class_id", F.struct(F.col(logit), -F.col("class_id"))).alias("class_id"), F.max("p").alias("p"))


def marginal(scores: DataFrame, key: str, tree: DataFrame, group: str) -> DataFrame:
    """Class probabilities summed to the groups of a tree."""
    return scores.join(tree.select("class_id", group), "class_id").groupBy(key, group).agg(F.sum("p").alias("p"))


def joint(direct: Column, summed: Column, weight: float) -> Column:
    """Geometric pool of two vectors."""
    if not 0 <= weight <= 1:
        raise ValueError("weight must be within 0 and 1")
    return V.softmax(F.zip_with(direct, summed, lambda a, b: (1 - weight) * F.ln(F.greatest(a, F.lit(V.TINY))) + weight * F.ln(F.greatest(b, F.lit(V.TINY)))))


def temperature_by_grid(rows: DataFrame, logits: str, label: str, grid: list[float]) -> DataFrame:
    """(temperature, nll) of the grid; rows are read once, the grid is a small array."""
    t = F.explode(F.array(*(F.lit(float(x)) for x in grid)))
    each = rows.select(F.col(logits).alias("x"), F.col(label).alias("y"), t.alias("temperature"))
    scaled = each.withColumn("z", F.transform("x", lambda v: v / F.col("temperature")))
    nll = -F.element_at(V.log_softmax(F.col("z")), F.col("y") + 1)
    return scaled.withColumn("nll", nll).groupBy("temperature").agg(F.avg("nll").alias("nll"))


def fitted_temperature(curve: DataFrame) -> float:
    return curve.agg(F.min_by("temperature", F.struct("nll", "temperature"))).first()[0]


def neighbour_vote(found: DataFrame, labels: DataFrame, key: str, label: str, query_key: str = "query_id", scale: float = 0.05) -> DataFrame:
    """(query, label, p): neighbours vote by exp((s - best) / scale), normalised."""
    per = Window.partitionBy(query_key)
    w = found.withColumn("_w", F.exp((F.col("similarity") - F.max("similarity").over(per)) / scale)).join(labels.select(key, label), key)
    sums = w.groupBy(query_key, label).agg(F.sum("_w").alias("_v"))
    return sums.select(query_key, label, (F.col("_v") / F.sum("_v").over(per)).alias("p"))


def soft_vote(found: DataFrame, targets: DataFrame, key: str, probs: str, classes: int, query_key: str = "query_id", scale: float = 0.05) -> DataFrame:
    """(query, probs): neighbours' target vectors averaged by exp((s - best) / scale)."""
    per = Window.partitionBy(query_key)
    w = found.withColumn("_w", F.exp((F.col("similarity") - F.max("similarity").over(per)) / scale)).join(targets.select(key, probs), key)
    mean = F.array(*(F.sum(F.col("_w") * F.col(probs)[k]) / F.sum("_w") for k in range(classes)))
    return w.groupBy(query_key).agg(mean.alias("probs"))


def examples(found: DataFrame, labels: DataFrame, key: str, label: str, k: int, barred: DataFrame | None = None, query_key: str = "query_id") -> DataFrame:
    """(query, key, label, similarity, place): the nearest of each label, the k best of those.

    ``barred``: (query, key) pairs that may not be shown, such as a query's own document.
    """
    rows = found if barred is None else found.join(barred, [query_key, key], "left_anti")
    named = rows.join(labels.select(key, label), key)
    own = Window.partitionBy(query_key, label).orderBy(F.desc("similarity"), key)
    best = named.withColumn("_r", F.row_number().over(own)).where("_r = 1").drop("_r")
    place = Window.partitionBy(query_key).orderBy(F.desc("similarity"), key)
    return best.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).select(query_key, key, label, "similarity", "place")


def best_under_each(logits: Column, ballots: list[list[int]]) -> Column:
    """For each ballot (labels that a group allows), its best label; the first on ties."""
    return F.array(*(V.masked_argmax(V.softmax(logits), F.array(*(F.lit(k) for k in own))) for own in ballots))


def subspaces(vectors: DataFrame, label: str, r: int, vector: str = "embedding") -> dict:
    """By label, the top r principal axes (uncentred), from d * d sums that Spark adds up."""
    import numpy as np
    import pandas as pd

    def moments(batches):
        sums: dict = {}
        for pdf in batches:
            for name, own in pdf.groupby(label):
                x = np.array(own[vector].tolist(), dtype=np.float64)
                sums[name] = sums.get(name, 0) + x.T @ x
        for name, m in sums.items():
            i, j = np.indices(m.shape)
            yield pd.DataFrame({label: name, "i": i.ravel(), "j": j.ravel(), "s": m.ravel()})

    kind = vectors.schema[label].dataType.simpleString()
    parts = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(label, vector).mapInPandas(moments, f"{label} {kind}, i int, j int, s double")
    cells = parts.groupBy(label, "i", "j").agg(F.sum("s").alias("s")).toPandas()
    axes = {}
    for name, own in cells.groupby(label):
        d = own["i"].max() + 1
        m = np.zeros((d, d))
        m[own["i"], own["j"]] = own["s"]
        axes[name] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1][:, :r].T.tolist()
    return axes


def subspace_scores(vectors: DataFrame, axes: dict, key: str, vector: str = "embedding") -> DataFrame:
    """(key, label, score): squared length of the vector's part in each label's subspace."""
    rows = [F.struct(F.lit(name).alias("label"), sum((F.pow(V.dot(F.col(vector), F.array(*(F.lit(float(x)) for x in axis))), F.lit(2)) for axis in basis), F.lit(0.0)).alias("score")) for name, basis in sorted(axes.items())]
    return vectors.select(key, F.explode(F.array(*rows)).alias("x")).select(key, "x.*")
