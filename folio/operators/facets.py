"""Facets of documents: votes of their regions, designs, what unread regions assert, and gates that choose settings.

Null keys form a document of their own; a document without any region has no row; empty
tables give no rows (a report over all rows: one row with n = 0).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators import labelling, metrics
from folio.operators.evidence import SIGNAL_FACET
from folio.operators.relational import ordered_concat

#: The sections of each region.
REGIONS = {
    "title": ("title",),
    "abstract": ("abstract",),
    "introduction": ("introduction", "background"),
    "methods": ("methods",),
    "results_conclusion": ("results", "discussion", "conclusion"),
}
#: Regions that a model of titles and abstracts doesn't read.
UNSEEN = ("methods", "results_conclusion")
#: Votes.
PRESENT, ABSENT, ABSTAIN = 1, -1, 0
#: A shorter region doesn't vote; the title does, but never for absence.
LEAST_WORDS = 40


def region_of(section: Column, regions: dict[str, tuple[str, ...]] = REGIONS) -> Column:
    """The region of a section; null for others."""
    return F.coalesce(*(F.when(section.isin(*own), name) for name, own in regions.items()))


def region_texts(chunks: DataFrame, key: str, order: str = "chunk_index", regions: dict[str, tuple[str, ...]] = REGIONS) -> DataFrame:
    """(key, region, text, n_words): the texts of a document's chunks by region, joined in order.

    Chunk tables may overlap: equal texts of one section of a document count once, where
    they come first. A null text is empty. Chunks of other sections are left out.
    """
    rows = chunks.select(key, region_of(F.col("section"), regions).alias("region"), "section", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_words", F.lit(0)).alias("n_words"), F.col(order).alias("_at"))
    once = rows.where(F.col("region").isNotNull()).groupBy(key, "region", "section", F.sha2("text", 256).alias("_d")).agg(F.min(F.struct("_at", "text", "n_words")).alias("x"))
    return once.select(key, "region", "x.*").groupBy(key, "region").agg(ordered_concat("text", "_at").alias("text"), F.sum("n_words").alias("n_words"))


def _any_of(low: Column, phrases) -> Column:
    return reduce(Column.__or__, (F.contains(low, F.lit(p)) for p in phrases), F.lit(False))


def region_votes(regions: DataFrame, key: str, cues: dict[str, list[str]], anti_cues: dict[str, list[str]] | None = None, titles: dict[str, str] | None = None, extended: bool = True, least_words: int = LEAST_WORDS) -> DataFrame:
    """(key, region, v_<facet>...): what each region's text says on each facet of ``cues``.

    A title votes present where its facet's pattern (``titles``, lower case) holds, and
    else not at all. Other regions abstain below ``least_words``; an anti-cue outweighs
    cues; without either they vote absent. ``extended`` adds evidence that phrases can't
    express. A null text is empty, a null length 0.
    """
    text = F.coalesce("text", F.lit(""))
    rows = regions.select(key, "region", text.alias("_text"), F.lower(text).alias("_low"), F.coalesce("n_words", F.lit(0)).alias("_n"))
    more = labelling.extended_evidence(F.col("_text")) if extended else {}
    low, votes = F.col("_low"), []
    for facet, own in cues.items():
        pattern = (titles or {}).get(facet)
        title = F.when(low.rlike(pattern), PRESENT).otherwise(ABSTAIN) if pattern else F.lit(ABSTAIN)
        against = _any_of(low, (anti_cues or {}).get(facet, ()))
        hit = _any_of(low, own) | more.get(facet, F.lit(False))
        votes.append(F.when(F.col("region") == "title", title).when(F.col("_n") < least_words, ABSTAIN).when(against, ABSENT).when(hit, PRESENT).otherwise(ABSENT).alias(f"v_{facet}"))
    return rows.select(key, "region", *votes)


def asserted(votes: DataFrame, key: str, facets: list[str], regions: tuple[str, ...] | None = None) -> DataFrame:
    """(key, voted, <facet>...): is a facet present in any of the regions, and did any of them vote at all?

    One aggregation; a document that has only other regions asserts nothing.
    """
    inside = F.col("region").isin(*regions) if regions else F.lit(True)
    said = lambda wanted: F.coalesce(F.max(inside & wanted), F.lit(False))
    any_vote = reduce(Column.__or__, (F.col(f"v_{f}") != ABSTAIN for f in facets))
    return votes.groupBy(key).agg(said(any_vote).alias("voted"), *(said(F.col(f"v_{f}") == PRESENT).alias(f) for f in facets))


def shares(votes: DataFrame, key: str, facets: list[str], regions: tuple[str, ...] | None = None, prior: float = 0.4) -> DataFrame:
    """(key, p_<facet>...): the share of voting regions that a facet is present in, drawn to ``prior`` by one vote."""
    inside = F.col("region").isin(*regions) if regions else F.lit(True)

    def share(f: str) -> Column:
        v = F.col(f"v_{f}")
        return ((prior + F.count_if(inside & (v == PRESENT))) / (1 + F.count_if(inside & (v != ABSTAIN)))).alias(f"p_{f}")

    return votes.groupBy(key).agg(*(share(f) for f in facets))


def first_design(over: dict[str, Column]) -> tuple[Column, Column]:
    """The design of the first rule that holds, else the default one, and whether none held."""
    held = lambda yes, no: reduce(Column.__and__, [*(over[f] for f in yes), *(~over[f] for f in no)])
    found = F.coalesce(*(F.when(held(yes, no), name) for name, yes, no in labelling.DESIGN_RULES))
    return F.coalesce(found, F.lit(labelling.DEFAULT_DESIGN)), found.isNull()


def unseen_reference(votes: DataFrame, key: str, unseen: tuple[str, ...] = UNSEEN) -> DataFrame:
    """(key, design, has_reference, <facet>...): what the unread regions assert.

    It is a reference only where one of them voted and a rule holds.
    """
    held = asserted(votes, key, list(labelling.FACETS), unseen)
    design, default = first_design({f: F.col(f) for f in labelling.FACETS})
    return held.select(key, design.alias("design"), (F.col("voted") & ~default).alias("has_reference"), *labelling.FACETS)


def decided(probs: DataFrame, key: str, thresholds: dict[str, float] | None = None) -> DataFrame:
    """(key, h_<facet>..., design, no_evidence, top_facet): facets at or over their thresholds (0.5 by default).

    ``top_facet`` is the design of the most probable facet alone, the first on ties. A
    null probability holds nowhere; with all of them null top_facet is the default design.
    """
    rows = probs.select(key, *(F.coalesce(F.col(f"p_{f}"), F.lit(-1.0)).alias(f"p_{f}") for f in labelling.FACETS))
    over = {f: F.col(f"p_{f}") >= (thresholds or {}).get(f, 0.5) for f in labelling.FACETS}
    design, default = first_design(over)
    best = F.greatest(*(F.col(f"p_{f}") for f in labelling.FACETS))
    alone = {f: next((name for name, yes, _ in labelling.DESIGN_RULES if yes == (f,)), labelling.DEFAULT_DESIGN) for f in labelling.FACETS}
    top = F.when(best < 0, labelling.DEFAULT_DESIGN).otherwise(F.coalesce(*(F.when(F.col(f"p_{f}") == best, d) for f, d in alone.items())))
    return rows.select(key, *(c.alias(f"h_{f}") for f, c in over.items()), design.alias("design"), default.alias("no_evidence"), top.alias("top_facet"))


def region_agreement(rows: DataFrame, votes: DataFrame, key: str, unseen: tuple[str, ...] = UNSEEN) -> DataFrame:
    """(facet, region, n, agreement, kappa) of decisions with the votes of each unread region, where it voted."""
    joined = votes.where(F.col("region").isin(*unseen)).join(rows.select(key, *(f"h_{f}" for f in labelling.FACETS)), key)
    sides = F.array(*(F.struct(F.lit(f).alias("facet"), F.when(F.col(f"h_{f}"), PRESENT).otherwise(ABSENT).alias("said"), F.col(f"v_{f}").alias("vote")) for f in labelling.FACETS))
    long = joined.select("region", F.inline(sides)).where(F.col("vote") != ABSTAIN).withColumn("cell", F.struct("facet", "region"))
    return metrics.kappas(long, "said", "vote", "cell").select("cell.*", "n", "agreement", "kappa")


def design_report(rows: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """One row: n, no_evidence rate, documents with a reference, agreement of designs with it, and with top_facet where none held."""
    ref = reference.where("has_reference").select(key, F.col("design").alias("_ref"))
    both = rows.join(ref, key, "left")
    filled = F.when(F.col("no_evidence"), F.col("top_facet")).otherwise(F.col("design"))
    agree = lambda c: F.avg((c == F.col("_ref")).cast("double"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("no_evidence").cast("double")).alias("no_evidence_rate"), F.count("_ref").alias("n_reference"), agree(F.col("design")).alias("agreement"), agree(filled).alias("agreement_with_top_facet"))


def commonest_design(store: DataFrame, design: str = "design", evidence: str = "has_reference") -> DataFrame:
    """(design): the commonest among documents with evidence, the first by name on ties; no row without any."""
    counts = store.where(F.col(evidence)).groupBy(F.col(design).alias("design")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min(F.struct((-F.col("n")).alias("neg"), "design")).alias("x")).where(F.col("x").isNotNull()).select("x.design")


def fallback_report(rows: DataFrame, reference: DataFrame, key: str, similar: DataFrame, majority: str | None) -> DataFrame:
    """(candidate, reads, n, agreement): four answers for documents that no rule decides, against their reference.

    ``similar``: (key, design) that similar documents vote for; a document without a vote
    gets the default. ``majority``: the answer that never looks at the document, as of
    ``commonest_design``; null agrees with nothing. ``reads``: does the answer look at it?
    """
    ref = reference.where("has_reference").select(key, F.col("design").alias("_ref"))
    open_ = rows.where("no_evidence").join(ref, key).join(similar.select(key, F.col("design").alias("_similar")), key, "left")
    answers = [("default", False, F.lit(labelling.DEFAULT_DESIGN)), ("majority", False, F.lit(majority).cast("string")), ("top_facet", True, F.col("top_facet")), ("similar_items", True, F.coalesce("_similar", F.lit(labelling.DEFAULT_DESIGN)))]
    each = F.array(*(F.struct(F.lit(n).alias("candidate"), F.lit(r).alias("reads"), F.coalesce(a == F.col("_ref"), F.lit(False)).alias("hit")) for n, r, a in answers))
    return open_.select(F.inline(each)).groupBy("candidate", "reads").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("agreement"))


def fallback_gate(report: DataFrame) -> DataFrame:
    """One row: the best answer that reads the document, if it beats every one that doesn't; null otherwise.

    Ties among readers go to similar items.
    """
    reading = F.max(F.when(F.col("reads"), F.struct("agreement", (F.col("candidate") == "similar_items").cast("int").alias("_first"), "candidate")))
    both = report.agg(reading.alias("x"), F.max(F.when(~F.col("reads"), F.col("agreement"))).alias("blind"))
    return both.select(F.when(F.col("x.agreement") > F.col("blind"), F.col("x.candidate")).alias("fallback"), F.col("x.agreement").alias("reading"), "blind")


def threshold_gate(plain: DataFrame, fitted: DataFrame) -> DataFrame:
    """One row from two reports of ``region_agreement``: mean kappas, and whether fitted thresholds do no worse."""
    mean = lambda report, name: report.agg(F.avg("kappa").alias(name))
    return mean(plain, "plain").crossJoin(mean(fitted, "fitted")).select("plain", "fitted", (F.col("fitted") >= F.col("plain")).alias("use_fitted"))


def group_votes(reference: DataFrame, key: str, groups: list[str]) -> DataFrame:
    """(key, design): the commonest reference design among the other documents of a group; the first by name on ties.

    A group is at most a row per design; a document's own reference is taken out of the
    counts. Null group values are a group.
    """
    counts = reference.where("has_reference").groupBy(*groups, "design").agg(F.count(F.lit(1)).alias("n"))
    tops = counts.groupBy(*groups).agg(F.collect_list(F.struct((-F.col("n")).alias("neg"), "design")).alias("_all"))
    own = reference.withColumn("_own", F.when(F.col("has_reference"), F.col("design")))
    on = reduce(Column.__and__, (F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in groups))
    joined = own.alias("l").join(tops.alias("r"), on)
    less = F.transform("_all", lambda x: F.struct((x["neg"] + F.when(x["design"] == F.col("_own"), 1).otherwise(0)).alias("neg"), x["design"].alias("design")))
    best = F.array_min(F.filter(less, lambda x: x["neg"] < 0))
    return joined.select(F.col(f"l.{key}").alias(key), best["design"].alias("design")).where(F.col("design").isNotNull())


def signal_lift(rows: DataFrame, signals: DataFrame, key: str, of: dict[str, str] = SIGNAL_FACET) -> DataFrame:
    """(signal, facet, n, given, otherwise, lift): how often a facet is decided with an outside signal and without.

    ``signals``: a row per key, a boolean per signal of ``of``; documents without a row, and
    nulls, have no signal. A signal that no document has is left out; the lift is null
    where the facet is never decided without it.
    """
    flags = signals.select(key, *(F.col(s).alias(f"_s_{s}") for s in of))
    both = rows.join(flags, key, "left")
    each = F.array(*(F.struct(F.lit(s).alias("signal"), F.lit(f).alias("facet"), F.coalesce(F.col(f"_s_{s}"), F.lit(False)).alias("on"), F.col(f"h_{f}").cast("double").alias("h")) for s, f in of.items()))
    sums = both.select(F.inline(each)).groupBy("signal", "facet").agg(F.count_if("on").alias("n"), F.avg(F.when(F.col("on"), F.col("h"))).alias("given"), F.avg(F.when(~F.col("on"), F.col("h"))).alias("otherwise"))
    return sums.where("n > 0").withColumn("lift", F.when(F.col("otherwise") > 0, F.col("given") / F.col("otherwise")))
