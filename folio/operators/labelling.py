"""Labels without ground truth: weighted votes, keywords, rules, a label model."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators.relational import cap_groups

PRIMARY_WEIGHT, SECONDARY_SHARE, AMBIGUITY_MARGIN = 2.0, 0.5, 0.25
CATEGORY_WEIGHT, TITLE_WEIGHT, LEAST_MARGIN, LEAST_SCORE, LEAST_HITS = 3.0, 2.0, 0.20, 2.0, 2


def _votes(items: DataFrame, key: str, categories: str, mapping: DataFrame) -> DataFrame:
    """(key, label, v, o): every vote with its weight and its place."""
    cats = items.select(key, F.posexplode(categories).alias("_at", "category"))
    m = cats.join(mapping, "category").withColumn("_w", F.when(F.col("_at") == 0, PRIMARY_WEIGHT).otherwise(1.0))
    first = F.struct(F.col("label"), (F.col("_w") * F.col("strength")).alias("v"), (2 * F.col("_at")).alias("o"))
    second = F.struct(F.col("secondary").alias("label"), (F.col("_w") * (1 - F.col("strength")) * SECONDARY_SHARE).alias("v"), (2 * F.col("_at") + 1).alias("o"))
    return m.select(key, F.explode(F.array(first, second)).alias("x")).where("x.label is not null").select(key, "x.*")


def vote_labels(items: DataFrame, key: str, categories: str, mapping: DataFrame) -> DataFrame:
    """A label per item by weighted vote over its categories.

    ``mapping``: category, label, strength, secondary (or null). The first category
    counts double; a secondary label gets half of what strength leaves. Ties go to
    the label voted for first. Items without a mapped category get null, ambiguous.
    """
    sums = _votes(items, key, categories, mapping).groupBy(key, "label").agg(F.sum("v").alias("v"), F.min("o").alias("o"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("neg"), "o", "label")))
    out = sums.groupBy(key).agg(ranked.alias("r"), F.sum("v").alias("total"))
    second_v = F.coalesce(-F.try_element_at("r", F.lit(2))["neg"], F.lit(0.0))
    margin = F.when(F.col("total") > 0, (-F.col("r")[0]["neg"] - second_v) / F.col("total")).otherwise(0.0)
    voted = out.select(key, F.col("r")[0]["label"].alias("label"), margin.alias("margin"), F.transform("r", lambda x: x["label"]).alias("co_listed"))
    return items.join(voted, key, "left").withColumn("margin", F.coalesce("margin", F.lit(0.0))).withColumn("ambiguous", F.col("label").isNull() | (F.col("margin") < AMBIGUITY_MARGIN))


def voted(categories: Column, mapping: list[tuple]) -> Column:
    """Struct (label, margin, co_listed, ambiguous): the vote of vote_labels as one expression over an array of categories.

    ``mapping``: (category, label, strength, secondary or None), a parameter of tens of
    rows. Rows are labelled where they lie: no join, no shuffle. Null, empty and unmapped
    categories give a null label, margin 0 and no labels.
    """
    names = [x for x in dict.fromkeys(x for _, a, _, b in mapping for x in (a, b)) if x is not None]
    known = F.map_from_arrays(F.array(*(F.lit(m[0]) for m in mapping)), F.array(*(F.struct(F.lit(a).alias("label"), F.lit(float(s)).alias("strength"), F.lit(b).cast("string").alias("secondary")) for _, a, s, b in mapping)))

    def vote(m: Column, at: Column) -> Column:
        w = F.when(at == 0, PRIMARY_WEIGHT).otherwise(1.0)
        first = F.struct(m["label"].alias("label"), (w * m["strength"]).alias("v"), (2 * at).alias("o"))
        return F.array(first, F.struct(m["secondary"].alias("label"), (w * (1 - m["strength"]) * SECONDARY_SHARE).alias("v"), (2 * at + 1).alias("o")))

    votes = F.filter(F.flatten(F.transform(F.coalesce(categories, F.array().cast("array<string>")), lambda c, at: T.once(F.try_element_at(known, c), lambda m: vote(m, at)))), lambda x: x["label"].isNotNull())

    def add(sums: Column, x: Column) -> Column:
        """Fold a vote into the array of (neg, o, label), a place for each label."""
        return F.transform(sums, lambda s: F.when(s["label"] == x["label"], F.struct((s["neg"] - x["v"]).alias("neg"), F.least(s["o"], x["o"]).alias("o"), s["label"].alias("label"))).otherwise(s))

    unvoted = F.array(*(F.struct(F.lit(0.0).alias("neg"), F.lit(None).cast("int").alias("o"), F.lit(x).alias("label")) for x in names))
    ranked = F.array_sort(F.filter(F.aggregate(votes, unvoted, add), lambda s: s["o"].isNotNull()))

    def verdict(r: Column) -> Column:
        total = F.aggregate(r, F.lit(0.0), lambda a, x: a - x["neg"])
        top, second = F.try_element_at(r, F.lit(1)), F.coalesce(F.try_element_at(r, F.lit(2))["neg"], F.lit(0.0))
        margin = F.when(total > 0, (second - top["neg"]) / total).otherwise(0.0)
        return F.struct(top["label"].alias("label"), margin.alias("margin"), F.transform(r, lambda x: x["label"]).alias("co_listed"), (top["label"].isNull() | (margin < AMBIGUITY_MARGIN)).alias("ambiguous"))

    return T.once(ranked, verdict)


def keyword_pattern(keyword: Column) -> Column:
    """Literal for phrases and long words; short words may go on to the right."""
    literal = F.concat(F.lit(r"\Q"), keyword, F.lit(r"\E"))
    return F.when(keyword.contains(" ") | (F.length(keyword) > 12), literal).otherwise(F.concat(F.lit(r"\b"), literal, F.lit(r"\w*")))


def keyword_scores(title: Column, body: Column, category: Column, fields: list[tuple]) -> Column:
    """Per field a struct (neg, field_index, field, hits, cat), best first, ties by field_index.

    ``fields``: (field, field_index, pattern, categories), a parameter of tens of rows.
    """

    def scorer(name: str, index: int, categories):
        cat = F.coalesce(category.isin(*categories), F.lit(False)) if categories else F.lit(False)

        def score(x: Column) -> Column:
            points = F.when(cat, CATEGORY_WEIGHT).otherwise(0.0) + TITLE_WEIGHT * F.size(x["t"]) + F.size(F.array_except(x["b"], x["t"]))
            return F.struct((-points).alias("neg"), F.lit(index).alias("field_index"), F.lit(name).alias("field"), F.size(F.array_union(x["t"], x["b"])).alias("hits"), cat.alias("cat"))

        return score

    return F.array_sort(T.once(_lowered(title, body), lambda low: F.array(*(T.once(_found(low, pattern), scorer(name, index, categories)) for name, index, pattern, categories in fields))))


def _lowered(title: Column, body: Column) -> Column:
    return F.struct(F.lower(F.coalesce(title, F.lit(""))).alias("t"), F.lower(F.coalesce(body, F.lit(""))).alias("b"))


def _found(low: Column, pattern: str) -> Column:
    """The distinct phrases of lowered title and body."""
    return F.struct(*(F.array_distinct(F.regexp_extract_all(low[k], F.lit(pattern), F.lit(0))).alias(k) for k in ("t", "b")))


def keyword_labels(items: DataFrame, key: str, title: str, body: str, category: str, fields: list[tuple]) -> DataFrame:
    """Score every field on distinct phrases and the item's category; keep a clear winner.

    All fields are looked for in one expression, so a text is read where it lies: no
    join, no shuffle. Null texts and categories give no evidence; rows that repeat a
    key are labelled each.
    """
    scored = items.select(key, keyword_scores(F.col(title), F.col(body), F.col(category), fields).alias("r"))
    scored = scored.withColumn("total", F.aggregate("r", F.lit(0.0), lambda a, x: a - x["neg"]))
    top, second = F.col("r")[0], F.try_element_at("r", F.lit(2))
    margin = F.when(F.col("total") > 0, (-top["neg"] + F.coalesce(second["neg"], F.lit(0.0))) / F.col("total")).otherwise(0.0)
    enough = (-top["neg"] >= LEAST_SCORE) & (top["cat"] | (top["hits"] >= LEAST_HITS)) & (margin >= LEAST_MARGIN)
    evidence = F.when(~enough, "none").when(top["cat"] & (top["hits"] > 0), "both").when(top["cat"], "category").otherwise("keyword")
    return scored.select(key, F.when(enough, top["field"]).alias("field"), (-top["neg"]).alias("score"), margin.alias("margin"), evidence.alias("evidence"), second["field"].alias("runner_up"))


def keyword_vote(title: Column, body: Column, fields: list[tuple]) -> Column:
    """Struct (field, hits): the field with most distinct phrases in title and body, the first of equals; null without any."""
    def hits(low: Column) -> Column:
        return F.array(*(F.struct(T.once(_found(low, pattern), lambda x: -F.size(F.array_union(x["t"], x["b"]))).alias("neg"), F.lit(index).alias("at"), F.lit(name).alias("field")) for name, index, pattern, _ in fields))

    best = F.array_min(T.once(_lowered(title, body), hits))
    return T.once(best, lambda first: F.struct(F.when(first["neg"] < 0, first["field"]).alias("field"), (-first["neg"]).alias("hits")))


def vote_distribution(items: DataFrame, key: str, categories: str, mapping: DataFrame, labels: list[str]) -> DataFrame:
    """(key, p): the weighted votes of an item's categories as shares over ``labels``, in their order.

    An item without a mapped category gets even shares. ``mapping`` is as for vote_labels.
    """
    votes = _votes(items, key, categories, mapping).groupBy(key).agg(*(F.sum(F.when(F.col("label") == x, F.col("v")).otherwise(0.0)).alias(f"_{k}") for k, x in enumerate(labels)))
    sums = F.array(*(F.coalesce(f"_{k}", F.lit(0.0)) for k in range(len(labels))))
    joined = items.select(key).distinct().join(votes, key, "left").select(key, sums.alias("s")).withColumn("t", F.aggregate("s", F.lit(0.0), lambda a, x: a + x))
    return joined.select(key, F.transform("s", lambda x: F.when(F.col("t") > 0, x / F.col("t")).otherwise(1.0 / len(labels))).alias("p"))


def self_training(scored: DataFrame, label: str, confidence: str, agrees: str, key: str, cap: int, sure: float = 0.9, likely: float = 0.7) -> DataFrame:
    """Pseudo-labels that are sure, or likely and backed by keywords; the best of each label up to cap."""
    accepted = scored.where((F.col(confidence) >= sure) | ((F.col(confidence) >= likely) & F.col(agrees)))
    w = Window.partitionBy(label).orderBy(F.desc(confidence), key)
    return accepted.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


FACETS = ("builds", "evaluates", "proves", "simulates", "human_data", "field_context", "secondary", "intervenes")
#: Designs by facets that must hold and must not, the first rule that fits first.
DESIGN_RULES = [
    ("Action Research", ("intervenes", "field_context"), ()),
    ("Systematic Literature Review / Secondary Study", ("secondary",), ("human_data",)),
    ("Case Study", ("field_context",), ("intervenes", "secondary")),
    ("Qualitative Field Study / Grounded Theory", ("human_data",), ("evaluates",)),
    ("Survey (empirical study of respondents)", ("human_data",), ()),
    ("Simulation & Modelling", ("simulates",), ("builds",)),
    ("Formal / Theoretical", ("proves",), ("builds",)),
    ("Design & Creation (Design Science)", ("builds",), ()),
    ("Experiment / Empirical Evaluation", ("evaluates",), ()),
    ("Formal / Theoretical", ("proves",), ()),
    ("Simulation & Modelling", ("simulates",), ()),
]
DEFAULT_DESIGN = "Design & Creation (Design Science)"

#: The worldview and the kind of method that go with each design.
STANCES = {
    "Formal / Theoretical": ("positivist", "secondary"),
    "Experiment / Empirical Evaluation": ("positivist", "quantitative"),
    "Design & Creation (Design Science)": ("pragmatist", "quantitative"),
    "Case Study": ("interpretivist", "mixed"),
    "Survey (empirical study of respondents)": ("positivist", "mixed"),
    "Systematic Literature Review / Secondary Study": ("positivist", "secondary"),
    "Simulation & Modelling": ("positivist", "quantitative"),
    "Qualitative Field Study / Grounded Theory": ("interpretivist", "qualitative"),
    "Action Research": ("critical", "mixed"),
}


def worldview(design: Column) -> Column:
    """That of a design; of an unknown one or null, positivist."""
    return T.looked_up(design, {d: s[0] for d, s in STANCES.items()}, "positivist")


def method(design: Column) -> Column:
    """That of a design; of an unknown one or null, quantitative."""
    return T.looked_up(design, {d: s[1] for d, s in STANCES.items()}, "quantitative")


def _holds(yes: tuple[str, ...], no: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for f in yes:
        out = out & F.col(f)
    for f in no:
        out = out & ~F.col(f)
    return out


def derive_designs() -> Column:
    """Distinct designs of the boolean facet columns, most specific first."""
    fired = F.array(*(F.when(_holds(yes, no), name) for name, yes, no in DESIGN_RULES))
    found = F.array_distinct(F.filter(fired, lambda x: x.isNotNull()))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(DEFAULT_DESIGN)))


def design_distribution(prefix: str = "p_") -> dict[str, Column]:
    """Per design, the best probability of its rules from facet probabilities, normalised."""
    best: dict[str, list[Column]] = {}
    for name, yes, no in DESIGN_RULES:
        p = F.lit(1.0)
        for f in yes:
            p = p * F.col(prefix + f)
        for f in no:
            p = p * (1 - F.col(prefix + f))
        best.setdefault(name, []).append(p)
    top = {k: F.greatest(*v) if len(v) > 1 else v[0] for k, v in best.items()}
    total = sum(top.values(), F.lit(0.0))
    return {k: F.when(total > 0, v / total).otherwise(1.0 / len(top)) for k, v in top.items()}


def decide_design(strong: list[str], design: str, experiment: str, simulation: str) -> Column:
    """Struct (design, margin, runner_up) from cue counts, one column per design.

    A strong design wins with two cues and a lead; simulation needs to beat all; then
    building before evaluating. Ties among strong ones go to the later name.
    """
    ranked = F.array_sort(F.array(*(F.struct(F.col(n).alias("s"), F.lit(n).alias("n")) for n in strong)), lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).otherwise(0))
    top, second = ranked[0], ranked[1]
    dc, ex, sim = F.col(design), F.col(experiment), F.col(simulation)

    def row(name: Column, margin: Column, other: Column) -> Column:
        return F.struct(name.alias("design"), margin.cast("double").alias("margin"), other.alias("runner_up"))

    none = F.lit(None).cast("string")
    return (
        F.when((top["s"] >= 2) & (top["s"] - second["s"] >= 1), row(top["n"], top["s"] - second["s"], F.when(second["s"] > 0, second["n"])))
        .when((sim >= 2) & (sim >= F.greatest(dc, ex)) & (sim > top["s"]), row(F.lit(simulation), sim - F.greatest(dc, ex), none))
        .when((dc >= 2) & (dc >= ex), row(F.lit(design), dc - ex, F.when(ex > 0, F.lit(experiment))))
        .when((ex >= 2) & (ex > dc), row(F.lit(experiment), ex - dc, F.when(dc > 0, F.lit(design))))
        .otherwise(row(none, F.lit(0.0), none))
    )


def facet_vote(text: Column, n_words: Column, cues: list[str], anti_cues: list[str], least_words: int = 40) -> Column:
    """1 present, -1 absent, 0 no vote: short regions abstain, an anti-cue outweighs cues."""
    low = F.lower(text)
    has = lambda words: F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(low, w)) if words else F.lit(False)
    return F.when(n_words < least_words, 0).when(has(anti_cues), -1).when(has(cues), 1).otherwise(-1)


def label_model(votes: DataFrame, columns: list[str], rounds: int = 100, tolerance: float = 1e-6) -> tuple[DataFrame, dict]:
    """Posterior of present by expectation-maximisation over binary votes (1, -1, 0).

    Starts from majority shares. Spark counts the vote patterns, at most 3 ** columns;
    the driver fits those; posteriors are joined back on the pattern.
    """
    counted = votes.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).collect()
    spark = votes.sparkSession
    pats, n = [tuple(r)[:-1] for r in counted], [r["n"] for r in counted]
    post = [sum(v == 1 for v in p) / k if (k := sum(v != 0 for v in p)) else 0.5 for p in pats]
    clip = lambda x, lo, hi: min(max(x, lo), hi)
    sens, spec, prior, last = [0.7] * len(columns), [0.7] * len(columns), 0.5, None
    for _ in range(rounds if pats else 0):
        prior = clip(sum(q * c for q, c in zip(post, n, strict=True)) / sum(n), 0.02, 0.98)
        for j in range(len(columns)):
            s = {(v, y): sum(c * (q if y else 1 - q) for p, q, c in zip(pats, post, n, strict=True) if p[j] == v) for v in (1, -1) for y in (1, 0)}
            sens[j] = clip((s[1, 1] + 1) / (s[1, 1] + s[-1, 1] + 2), 0.01, 0.99)
            spec[j] = clip((s[-1, 0] + 1) / (s[-1, 0] + s[1, 0] + 2), 0.01, 0.99)
        whole, post = 0.0, []
        for p, c in zip(pats, n, strict=True):
            a, b = math.log(prior), math.log1p(-prior)
            for v, se, sp in zip(p, sens, spec, strict=True):
                if v == 1:
                    a, b = a + math.log(se), b + math.log1p(-sp)
                elif v == -1:
                    a, b = a + math.log1p(-se), b + math.log(sp)
            top = max(a, b)
            mass = math.exp(a - top) + math.exp(b - top)
            post.append(math.exp(a - top) / mass)
            whole += c * (top + math.log(mass))
        if last is not None and abs(whole - last) < tolerance:
            break
        last = whole
    schema = ", ".join(f"{c} int" for c in columns) + ", posterior double"
    table = spark.createDataFrame([(*map(int, p), q) for p, q in zip(pats, post, strict=True)], schema)
    return votes.join(table, columns), {"prior": prior, "sensitivity": sens, "specificity": spec}


#: Phrasings of three facets that plain cues can't express.
NAMED_ARTEFACT = r"\b(?:[Ww]e|[Tt]his (?:paper|work)) (?:propose|present|introduce|develop)s? [A-Z][\w-]*[A-Z0-9][\w-]*\s*[,(:]"
IMPLEMENTATION = ("design and implementation", "designed and implemented", "we implemented", "is implemented in", "is implemented on", "is implemented as")
EXPERIMENTS = r"(?i)\bexperiments? (?:on|with|show|demonstrate|reveal|indicate|confirm|conducted)|extensive experiments|experimental (?:evaluation|study|analysis|validation|comparison)|\bempirical(?:ly)? (?:results|evaluation|study|analysis|validat\w+|evidence)|evaluated (?:on|using|against|with)|state[- ]of[- ]the[- ]art (?:performance|results|accuracy|methods|approaches|baselines)"
QUANTITY = r"\d+(?:\.\d+)?\s?(?:%|x\b|×|times\b|percentage points)"
GAINS = ("improv", "reduc", "increas", "speed", "gain", "outperform", "lower", "boost")
PROOF = r"(?i)regret bounds?|sample complexity|convergence (?:rate|guarantee)s?|provabl[ey]|theoretical guarantees?|we establish|approximation (?:ratio|factor|algorithm|guarantee)|hardness|decidab|polynomial[- ]time"
BIG_O = r"(?<![A-Za-z])[OΘΩ]\((?:n|d|k|t|m|T|N|\\|log|1|sqrt|\d)"
#: Characters before a quantity in which a gain word makes it a result.
GAIN_REACH = 70
#: One pattern: a gain word that lies whole within the reach of a quantity.
QUANTIFIED_GAIN = "(?s)(?:" + "|".join(f"(?i:{g}).{{0,{GAIN_REACH - len(g)}}}" for g in GAINS) + f")(?:{QUANTITY})"


def extended_evidence(text: Column) -> dict[str, Column]:
    """One boolean for each of builds, evaluates and proves, from the text in its own case; null text has none."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    built = text.rlike(NAMED_ARTEFACT)
    for cue in IMPLEMENTATION:
        built = built | F.contains(low, F.lit(cue))
    return {"builds": built, "evaluates": text.rlike(EXPERIMENTS) | text.rlike(QUANTIFIED_GAIN), "proves": text.rlike(PROOF) | text.rlike(BIG_O)}


def cue_scores(text: Column, cues: dict[str, list[str]]) -> dict[str, Column]:
    """Per design, how many of its cues occur."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return {name: sum((F.contains(low, F.lit(c)).cast("int") for c in own), F.lit(0)) for name, own in cues.items()}


def cap_fields(df: DataFrame, field: str, key: str, most: int, share: float, seed: str = "fields") -> DataFrame:
    """Rows of each field up to a cap: ``most``, or less where three medians and a share of all rows are.

    The cap comes from the counts, one row per field, so one huge field can't set its own.
    """
    counts = df.where(F.col(field).isNotNull()).groupBy(field).agg(F.count(F.lit(1)).alias("n"))
    middle, whole = counts.agg(F.median("n"), F.sum("n")).first()
    if not whole:
        return df.limit(0)
    return cap_groups(df.where(F.col(field).isNotNull()), field, key, min(most, max(int(max(middle * 3, whole * share)), 1)), seed)
