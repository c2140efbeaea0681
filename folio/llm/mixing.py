"""Mixing sources to target weights by iterative proportional fitting, relationally.

Documents fall into cells (source, language, topic). The fit rakes the cells' token
weights until the marginals of source, language and topic match their targets, one
dimension after another; a cell's factor (its fitted over its actual tokens) then
gives each of its documents an inclusion probability, calibrated so that the expected
tokens meet the budget with no probability over 1. A document is kept if a hash of
its id, uniform in [0, 1), lies below its probability, so a rerun keeps the same.

Nothing but pre-aggregated cells is shuffled; the fit works on cells alone, and the
last join brings factors back to documents. All of it is DataFrame code.

Without a topic of the caller's, a document's words are hashed by their first letter
to ``TOPICS`` groups, and its topic is the group that it has most above the share which
the whole corpus has, the first of equal ones.

Null values of a dimension form a value of their own. Null text has no tokens: the
document gets its cell's probability, or 0 where the cell has no tokens at all; empty
and blank texts likewise. Repeated ids share their fate; a null id is never sampled.
Extra columns stay as they are; where one has a name of a new column, the new one gets
an underscore behind. An empty table gives an empty one.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.shared import free_name, in_few, materialize

#: The fit ends when no marginal is off by more than this share of all tokens, or after so many sweeps.
TOLERANCE = 1e-12
SWEEPS = 40
SWEEPS_A_PLAN = 8
#: Cells that one partition holds.
FEW_CELLS = 100_000
#: A gap that is reported.
NOTED_GAP = 1e-2
#: Share of all tokens that the sample should hold.
BUDGET = 0.5
DIMENSIONS = ("source", "lang", "topic")
#: How far each marginal is drawn to even shares where no target is given: 1 keeps its mix.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
TOPICS = 4
SPACES = " \t\n\x0b\x0c\r"
NULL = "\0null"


def initials(text: Column) -> Column:
    """The first character of each white-space separated word, in order."""
    firsts = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]*([^\x20\x09-\x0D])[^\x20\x09-\x0D]*[\x20\x09-\x0D]*", "$1")
    return F.translate(firsts, SPACES, "")


def letters(group: int) -> str:
    """The letters that a topic group has, in both cases."""
    own = "abcdefghijklmnopqrstuvwxyz"[group::TOPICS]
    return own + own.upper()


def group_counts(firsts: Column) -> list[Column]:
    """Words of each topic group."""
    return [F.length(firsts) - F.length(F.translate(firsts, letters(k), "")) for k in range(TOPICS)]


def topic_of(counts: list[Column], shares: list[float]) -> Column:
    """The group with the largest count in relation to its share in the corpus; ``none`` without words of any."""
    above = [F.when(c > 0, c / F.lit(s)).otherwise(F.lit(0.0)) for c, s in zip(counts, shares, strict=True) if s > 0]
    named = [k for k, s in enumerate(shares) if s > 0]
    if not named:
        return F.lit("none")
    top = F.greatest(*above) if len(above) > 1 else above[0]
    out = F.when(top == 0, "none")
    for k, a in zip(named, above, strict=True):
        out = out.when(a == top, f"group{k}")
    return out


def corpus_shares(counted: DataFrame) -> list[float]:
    """Each topic group's share of all words that have one, from columns c0, c1, ..."""
    sums = counted.agg(*(F.sum(f"c{k}") for k in range(TOPICS))).first()
    whole = sum(x or 0 for x in sums)
    return [(x or 0) / whole if whole else 0.0 for x in sums]


def uniform(*key: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from the key alone, the same in any engine with MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *key))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def cells_of(tagged: DataFrame) -> DataFrame:
    """Tokens of each (source, lang, topic), aggregated before the shuffle."""
    return tagged.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("tokens"))


def softened_targets(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares in proportion to tokens ** power: 1 keeps the mix, 0 makes it even."""
    own = cells.groupBy(dimension).agg(F.sum("tokens").alias("t")).where("t > 0").select(dimension, F.pow("t", F.lit(power)).alias("p"))
    total = own.agg(F.sum("p")).first()[0]
    return own.select(dimension, (F.col("p") / F.lit(total)).alias("share"))


def _sweep_of_few(now: DataFrame, total: Column, sweeps: int) -> DataFrame:
    """Sweeps over cells in one partition, as windows of one plan; ``_gap`` is that of the last."""
    for k in range(sweeps):
        gaps = []
        for d in DIMENSIONS:
            held = F.sum("weight").over(Window.partitionBy(d))
            if k == sweeps - 1:
                now = now.withColumn(f"_gap_{d}", F.abs(F.col(f"_share_{d}") - held / total))
                gaps.append(f"_gap_{d}")
            now = now.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"_share_{d}") * total, held), F.lit(0.0)))
    return now.withColumn("_gap", F.greatest(*gaps)).drop(*gaps)


def _sweep_of_many(now: DataFrame, total: Column) -> DataFrame:
    """One sweep over any number of cells: pre-aggregated sums, joined back."""
    gaps = []
    for d in DIMENSIONS:
        sums = now.groupBy(d).agg(F.sum("weight").alias("_sum"))
        now = now.join(sums, d).withColumn(f"_gap_{d}", F.abs(F.col(f"_share_{d}") - F.col("_sum") / total))
        now = now.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"_share_{d}") * total, F.col("_sum")), F.lit(0.0))).drop("_sum")
        gaps.append(f"_gap_{d}")
    return now.withColumn("_gap", F.greatest(*gaps)).drop(*gaps)


def fit(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> tuple[DataFrame, float]:
    """Cells with tokens and ``weight``, whose marginals match the targets, and the largest gap left.

    ``cells`` must be a written table. Sweeps end early when the marginals match; the
    gap, as a share of all tokens, tells how far ``sweeps`` of them came, and one
    that is not small is a warning: some targets can't be met together, or only slowly.
    A few sweeps of few cells, else one, are a plan, whose result is written. The
    driver sees one number per plan. A target of a value without tokens can't be met;
    the shares of the others hold relative to each other.
    """
    n, total = cells.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    total = F.lit(total or 0.0)
    now = in_few(cells, n).where("tokens > 0").withColumn("weight", F.col("tokens"))
    for d, target in targets.items():
        now = now.join(target.select(d, F.col("share").alias(f"_share_{d}")), d, "left").withColumn(f"_share_{d}", F.coalesce(f"_share_{d}", F.lit(0.0)))
    now, few, gap = in_few(materialize(now, "goals"), n), n <= FEW_CELLS, None
    done = 0
    while done < sweeps and (gap is None or gap > TOLERANCE):
        step = min(SWEEPS_A_PLAN, sweeps - done) if few else 1
        now = materialize(_sweep_of_few(now, total, step) if few else _sweep_of_many(now, total), "raked")
        gap = now.agg(F.max("_gap")).first()[0]
        now, done = in_few(now, n).drop("_gap"), done + step
        if gap is None:  # no cells
            break
    if gap is not None and gap > NOTED_GAP:
        warnings.warn(f"the marginals are off by {gap:.2g} of all tokens after {done} sweeps", stacklevel=2)
    return now.where("weight > 0").select(*DIMENSIONS, "tokens", "weight"), gap or 0.0


def calibrate(fitted: DataFrame, budget: float) -> float:
    """The scale s for which sum(min(1, s * weight / tokens) * tokens) = budget * tokens.

    Each round reads one row of sums; rounds end when no further cell reaches 1.
    """
    total = fitted.agg(F.sum("tokens"), F.sum("weight")).first()
    if not total[0] or not total[1]:
        return 0.0
    want, scale, capped = budget * total[0], budget * total[0] / total[1], -1
    while True:
        full = F.col("weight") * F.lit(scale) >= F.col("tokens")
        n, held, free = fitted.agg(F.count_if(full), F.sum(F.when(full, F.col("tokens")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == capped or not free or held >= want:
            return scale
        capped, scale = n, (want - held) / free


def weighed(docs: DataFrame, powers: dict[str, float] | None = None, budget: float = BUDGET, targets: dict[str, DataFrame] | None = None, topic: Column | None = None) -> DataFrame:
    """(doc, n_tokens, topic, factor, probability, sampled); ``doc`` holds the row as it was."""
    powers = POWERS | (powers or {})
    base = docs.select(F.struct("*").alias("doc"), *(F.coalesce(F.col(x).cast("string"), F.lit(NULL)).alias(x) for x in ("source", "lang")), initials(F.col("text")).alias("firsts"), *([] if topic is None else [topic.alias("topic")]))
    if topic is None:
        # texts are read twice: once for these few numbers a row, once for the verdict
        counts = [c.alias(f"c{k}") for k, c in enumerate(group_counts(F.col("firsts")))]
        counted = materialize(base.select("source", "lang", F.length("firsts").cast("long").alias("n_tokens"), *counts), "word-counts")
        shares = corpus_shares(counted)
        cells = cells_of(counted.withColumn("topic", topic_of([F.col(f"c{k}") for k in range(TOPICS)], shares)))
        own = topic_of(group_counts(F.col("firsts")), shares)
    else:
        own = F.coalesce(F.col("topic").cast("string"), F.lit(NULL))
        cells = cells_of(base.select("source", "lang", own.alias("topic"), F.length("firsts").cast("long").alias("n_tokens")))
    tagged = base.select("doc", "source", "lang", own.alias("topic"), F.length("firsts").cast("long").alias("n_tokens"))
    cells = materialize(cells, "cells")
    goals = {d: (targets or {}).get(d, softened_targets(cells, d, powers[d])) for d in DIMENSIONS}
    goals = {d: materialize(g, f"target-{d}") for d, g in goals.items()}
    fitted, _ = fit(cells, goals)
    scale = calibrate(fitted, budget)
    factors = fitted.select(*DIMENSIONS, (F.col("weight") / F.col("tokens")).alias("factor"))
    out = tagged.join(factors, list(DIMENSIONS), "left").withColumn("factor", F.coalesce("factor", F.lit(0.0)))
    out = out.withColumn("probability", F.least(F.lit(1.0), F.lit(scale) * F.col("factor")))
    sampled = F.coalesce(uniform(F.col("doc.doc_id").cast("string")) < F.col("probability"), F.lit(False))
    return out.select("doc", "n_tokens", "topic", "factor", "probability", (F.col("doc.doc_id").isNotNull() & sampled).alias("sampled"))


def mix(docs: DataFrame, powers: dict[str, float] | None = None, budget: float = BUDGET, targets: dict[str, DataFrame] | None = None, topic: Column | None = None) -> DataFrame:
    """All documents with n_tokens, topic, factor, probability and ``sampled``.

    Targets are tables (dimension, share); those not given soften the present mix.
    """
    new = ("n_tokens", "topic", "factor", "probability", "sampled")
    return weighed(docs, powers, budget, targets, topic).select("doc.*", *(F.col(x).alias(free_name(docs, x)) for x in new))


def sample(docs: DataFrame, **how) -> DataFrame:
    """The sampled documents, as they were."""
    return weighed(docs, **how).where("sampled").select("doc.*")
