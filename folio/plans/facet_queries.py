"""Queries of document facets: votes of regions, designs, references from unread regions, gates, with their SQL.

A document is cut into a title of eight words and six even parts of at least twenty words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import vectors as V
from folio.operators import facets as A
from folio.operators import labelling, scorers, studies
from folio.plans.more_queries import quoted
from folio.plans.text_queries import docs_of
from folio.scratch import scratch_path, written

QUERIES: dict = {}
ORACLES: dict = {}

#: Phrases of the invented texts that stand for each facet, and against it.
CUES = {"builds": ["thwh", "eaux"], "evaluates": ["ndst"], "proves": ["orre"], "simulates": ["stre"], "human_data": ["edth"], "field_context": ["bleth"], "secondary": ["lyth"], "intervenes": ["shth"]}
ANTI_CUES = {"builds": ["andre"], "secondary": ["tionth"]}
TITLES = {"builds": r"\bthe\b", "secondary": r"\bof\b", "proves": "tion"}
#: Phrases counted for each design.
DESIGN_CUES = {"case": ["bleth", "shth", "stre"], "survey": ["edth", "lyth", "whst"], "design": ["thwh", "onnt", "eaux"], "experiment": ["ndst", "hean", "orre"], "simulation": ["tionth", "ingre", "andre"]}
#: Thresholds as a fit would give them.
FITTED = {"builds": 0.45, "evaluates": 0.35, "proves": 0.6, "secondary": 0.3}
SECTIONS = ("abstract", "introduction", "background", "methods", "results", "discussion")
SEEN = tuple(r for r in A.REGIONS if r not in A.UNSEEN)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _contains(phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains(low, {quoted(p)})" for p in phrases) + ")" if phrases else "FALSE"


def _vote(f: str) -> str:
    title = f"CASE WHEN regexp_matches(low, {quoted(TITLES[f])}) THEN 1 ELSE 0 END" if f in TITLES else "0"
    return f"CASE WHEN region = 'title' THEN {title} WHEN n < 40 THEN 0 WHEN {_contains(ANTI_CUES.get(f, []))} THEN -1 WHEN {_contains(CUES[f])} THEN 1 ELSE -1 END AS v_{f}"


_SPANS = {"title": ("1", "8"), "abstract": ("9", "8 + size"), "introduction": ("9 + size", "8 + 3 * size"), "methods": ("9 + 3 * size", "8 + 4 * size"), "results_conclusion": ("9 + 4 * size", "8 + 6 * size")}
_SEEN = "region NOT IN ('methods', 'results_conclusion')"


def _each(form: str, glue: str = ", ") -> str:
    return glue.join(form.format(f=f) for f in labelling.FACETS)


def _rules(over: str) -> str:
    """The first rule that holds; null without any."""
    return "CASE " + " ".join("WHEN " + " AND ".join([*(over.format(f=f) for f in yes), *("NOT " + over.format(f=f) for f in no)]) + f" THEN {quoted(name)}" for name, yes, no in labelling.DESIGN_RULES) + " END"


_ALONE = {f: next((n for n, yes, _ in labelling.DESIGN_RULES if yes == (f,)), labelling.DEFAULT_DESIGN) for f in labelling.FACETS}
_TOP = "CASE " + _each("WHEN p_{f} = greatest(" + _each("p_{f}") .replace("{", "{{").replace("}", "}}") + ") THEN @{f}@", " ") + " END"
for _f, _d in _ALONE.items():
    _TOP = _TOP.replace(f"@{_f}@", quoted(_d))
_DEFAULT = quoted(labelling.DEFAULT_DESIGN)

_VOTES = rf"""WITH w AS (SELECT doc_id, w, greatest(20, ceil((len(w) - 8) / 6)::BIGINT) AS size FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\S+') AS w FROM documents)),
rg AS ({" UNION ALL ".join(f"SELECT doc_id, '{r}' AS region, w[{a}:{b}] AS w FROM w" for r, (a, b) in _SPANS.items())}),
rt AS (SELECT doc_id, region, lower(array_to_string(w, ' ')) AS low, len(w) AS n FROM rg WHERE len(w) > 0),
v AS MATERIALIZED (SELECT doc_id, region, {", ".join(_vote(f) for f in labelling.FACETS)} FROM rt)"""
_SHARES = _VOTES + f""", p AS MATERIALIZED (SELECT doc_id, {_each("(0.4::DOUBLE + count(*) FILTER (" + _SEEN + " AND v_{f} = 1)) / (1 + count(*) FILTER (" + _SEEN + " AND v_{f} <> 0)) AS p_{f}")} FROM v GROUP BY doc_id)"""
_REFERENCE = f""", ra AS (SELECT doc_id, bool_or(NOT {_SEEN} AND ({_each("v_{f} <> 0", " OR ")})) AS voted, {_each("bool_or(NOT " + _SEEN + " AND v_{f} = 1) AS {f}")} FROM v GROUP BY doc_id),
r AS MATERIALIZED (SELECT doc_id, coalesce(d, {_DEFAULT}) AS design, voted AND d IS NOT NULL AS has_reference FROM (SELECT *, {_rules("{f}")} AS d FROM ra))"""


def _decided(name: str, thresholds: dict[str, float]) -> str:
    over = ", ".join(f"p_{f} >= {thresholds.get(f, 0.5)}::DOUBLE AS h_{f}" for f in labelling.FACETS)
    return f", {name} AS MATERIALIZED (SELECT doc_id, {_each('h_{f}')}, coalesce(d, {_DEFAULT}) AS design, d IS NULL AS no_evidence, top_facet FROM (SELECT *, {_rules('h_{f}')} AS d FROM (SELECT *, {over}, {_TOP} AS top_facet FROM p)))"


def _agreement(name: str, source: str) -> str:
    long = " UNION ALL ".join(f"SELECT region, '{f}' AS facet, CASE WHEN h_{f} THEN 1 ELSE -1 END AS a, v_{f} AS b FROM v JOIN {source} USING (doc_id) WHERE NOT {_SEEN} AND v_{f} <> 0" for f in labelling.FACETS)
    return f""", {name} AS (SELECT facet, region, n, po AS agreement, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END AS kappa FROM (SELECT facet, region, count(*) AS n, avg((a = b)::INT) AS po,
  (count(*) FILTER (a = 1) * count(*) FILTER (b = 1) + count(*) FILTER (a = -1) * count(*) FILTER (b = -1)) / (count(*) * count(*))::DOUBLE AS pe FROM ({long}) GROUP BY facet, region))"""


_FALLBACKS = _SHARES + _REFERENCE + _decided("h", {}) + f""", g AS (SELECT lang, source, design, count(*) AS n FROM r JOIN documents USING (doc_id) WHERE has_reference GROUP BY lang, source, design),
sv AS (SELECT doc_id, arg_min(design, (-n, design)) AS alike FROM (SELECT d.doc_id, g.design, g.n - CASE WHEN r.has_reference AND r.design = g.design THEN 1 ELSE 0 END AS n FROM documents d JOIN r USING (doc_id)
  JOIN g ON d.lang IS NOT DISTINCT FROM g.lang AND d.source IS NOT DISTINCT FROM g.source) WHERE n > 0 GROUP BY doc_id),
mj AS (SELECT arg_min(design, (-n, design)) AS design FROM (SELECT design, count(*) AS n FROM r WHERE has_reference GROUP BY design)),
o AS (SELECT h.top_facet, coalesce(sv.alike, {_DEFAULT}) AS alike, r.design AS ref FROM h JOIN r USING (doc_id) LEFT JOIN sv USING (doc_id) WHERE no_evidence AND has_reference),
fr AS (SELECT candidate, reads, count(*) AS n, avg(hit::INT) AS agreement FROM (SELECT 'default' AS candidate, FALSE AS reads, ref = {_DEFAULT} AS hit FROM o UNION ALL SELECT 'majority', FALSE, ref = (SELECT design FROM mj) FROM o
  UNION ALL SELECT 'top_facet', TRUE, ref = top_facet FROM o UNION ALL SELECT 'similar_items', TRUE, ref = alike FROM o) GROUP BY candidate, reads)"""


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of the regions; parts without a word are no chunks."""
    w, size = F.col("w"), F.col("size")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+"), F.lit(0))
    d = docs_of(spark, sf).select("doc_id", words.alias("w")).withColumn("size", F.greatest(F.lit(20), F.ceil((F.size("w") - 8) / 6).cast("int")))
    parts = [("title", F.slice(w, 1, 8)), *((s, F.slice(w, size * k + 9, size)) for k, s in enumerate(SECTIONS))]
    chunks = d.select("doc_id", F.posexplode(F.array(*(F.struct(F.lit(s).alias("section"), p.alias("own")) for s, p in parts))).alias("chunk_index", "x")).where(F.size("x.own") > 0)
    return A.region_texts(chunks.select("doc_id", "chunk_index", "x.section", F.array_join("x.own", " ").alias("text"), F.size("x.own").alias("n_words")), "doc_id")


def votes_of(spark: SparkSession, sf: str) -> DataFrame:
    return A.region_votes(_regions(spark, sf), "doc_id", CUES, ANTI_CUES, TITLES, extended=False)


def _shares(votes: DataFrame) -> DataFrame:
    return A.shares(votes, "doc_id", list(labelling.FACETS), SEEN)


def _stored_votes(spark: SparkSession, sf: str) -> DataFrame:
    """The votes as a narrow table, for reports that look at them more than once: texts are read once."""
    return written(votes_of(spark, sf), "votes")


@query(_VOTES + f" SELECT doc_id, region, {_each('v_{f}')} FROM v")
def region_votes(spark: SparkSession, sf: str) -> DataFrame:
    """What each region of each document says on each facet."""
    return votes_of(spark, sf)


_FIRED = "list_filter([" + ", ".join("CASE WHEN " + " AND ".join([*yes, *(f"NOT {n}" for n in no)]) + f" THEN {quoted(name)} END" for name, yes, no in labelling.DESIGN_RULES) + "], lambda x: x IS NOT NULL)"


@query(_VOTES + f", a AS (SELECT doc_id, {_each('bool_or(v_{f} = 1) AS {f}')} FROM v GROUP BY doc_id) SELECT doc_id, coalesce(l[1], {_DEFAULT}) AS first_design, CASE WHEN len(l) = 0 THEN 1 ELSE len(list_distinct(l)) END AS n_designs FROM (SELECT doc_id, {_FIRED} AS l FROM a)")
def design_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Designs of documents from the facets that any of their regions asserts."""
    d = labelling.derive_designs()
    held = A.asserted(votes_of(spark, sf), "doc_id", list(labelling.FACETS))
    return held.select("doc_id", d[0].alias("first_design"), F.size(d).cast("long").alias("n_designs"))


_COUNTS = ", ".join(" + ".join(f"contains(low, {quoted(c)})::INT" for c in own) + f' AS "{n}"' for n, own in DESIGN_CUES.items())


@query(f"""WITH c AS (SELECT doc_id, {_COUNTS} FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)),
s AS (SELECT *, greatest("case", survey) AS s1, least("case", survey) AS s2, CASE WHEN survey >= "case" THEN 'survey' ELSE 'case' END AS n1, CASE WHEN survey >= "case" THEN 'case' ELSE 'survey' END AS n2 FROM c),
b AS (SELECT *, CASE WHEN s1 >= 2 AND s1 - s2 >= 1 THEN 1 WHEN simulation >= 2 AND simulation >= greatest(design, experiment) AND simulation > s1 THEN 2 WHEN design >= 2 AND design >= experiment THEN 3 WHEN experiment >= 2 AND experiment > design THEN 4 ELSE 0 END AS way FROM s)
SELECT doc_id, CASE way WHEN 1 THEN n1 WHEN 2 THEN 'simulation' WHEN 3 THEN 'design' WHEN 4 THEN 'experiment' END AS design, (CASE way WHEN 1 THEN s1 - s2 WHEN 2 THEN simulation - greatest(b.design, experiment) WHEN 3 THEN b.design - experiment WHEN 4 THEN experiment - b.design ELSE 0 END)::DOUBLE AS margin,
  CASE WHEN way = 1 AND s2 > 0 THEN n2 WHEN way = 3 AND experiment > 0 THEN 'experiment' WHEN way = 4 AND b.design > 0 THEN 'design' END AS runner_up FROM b""")
def design_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """The design that each document's phrases decide for."""
    counts = docs_of(spark, sf).select("doc_id", *(c.alias(n) for n, c in labelling.cue_scores(F.col("text"), DESIGN_CUES).items()))
    return counts.select("doc_id", labelling.decide_design(["case", "survey"], "design", "experiment", "simulation").alias("x")).select("doc_id", "x.*")


_BY_DESIGN: dict[str, list[str]] = {}
for _name, _yes, _no in labelling.DESIGN_RULES:
    _BY_DESIGN.setdefault(_name, []).append(" * ".join([*(f"p_{f}" for f in _yes), *(f"(1 - p_{f})" for f in _no)]))


@query(_SHARES + ", d AS (SELECT doc_id, unnest([" + ", ".join(f"{{'design': {quoted(n)}, 'v': greatest({', '.join(v)})}}" for n, v in _BY_DESIGN.items()) + "]) AS x FROM p) SELECT doc_id, x.design AS design, round(x.v / sum(x.v) OVER (PARTITION BY doc_id), 6) AS p FROM d")
def design_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Design probabilities of documents from the shares of their regions that assert each facet."""
    rows = F.array(*(F.struct(F.lit(n).alias("design"), c.alias("p")) for n, c in labelling.design_distribution().items()))
    return _shares(votes_of(spark, sf)).select("doc_id", F.inline(rows)).withColumn("p", F.round("p", 6))


_SURE = "CASE " + " ".join("WHEN " + " AND ".join([*(f"p_{f} >= 0.5" for f in yes), *(f"NOT p_{f} >= 0.5" for f in no)]) + " THEN " + " * ".join([*(f"p_{f}" for f in yes), *(f"(1 - p_{f})" for f in no)]) for _, yes, no in labelling.DESIGN_RULES) + " END"


@query(_SHARES + f", f AS (SELECT *, {_each('p_{f} >= 0.5 AS {f}')} FROM p), g AS (SELECT *, {_FIRED} AS l, {_each('{f}', ' OR ')} AS fired, {_SURE} AS sure FROM f) SELECT doc_id, CASE WHEN fired THEN coalesce(l[1], {_DEFAULT}) ELSE {_TOP} END AS design, CASE WHEN fired THEN 'facets' ELSE 'top_facet' END AS source, CASE WHEN NOT fired THEN 'NO_EVIDENCE' WHEN sure < 0.45 THEN 'LOW_CONFIDENCE' WHEN len(list_distinct(l)) > 1 THEN 'UNDERDETERMINED' END AS flag FROM g")
def resolved_designs(spark: SparkSession, sf: str) -> DataFrame:
    """Designs of documents with and without evidence, where they come from, and what is doubtful."""
    return _shares(votes_of(spark, sf)).select("doc_id", studies.resolved_design({f: F.col(f"p_{f}") for f in labelling.FACETS}, {}).alias("x")).select("doc_id", "x.*")


@query(_VOTES + _REFERENCE + " SELECT doc_id, design, has_reference FROM r")
def unseen_designs(spark: SparkSession, sf: str) -> DataFrame:
    """The design that the regions behind the introduction assert."""
    return A.unseen_reference(votes_of(spark, sf), "doc_id").select("doc_id", "design", "has_reference")


@query(_SHARES + _decided("h", {}) + _agreement("ag", "h") + " SELECT facet, region, n, round(agreement, 6) AS agreement, round(kappa, 6) AS kappa FROM ag")
def region_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions on the read regions against the votes of each unread one."""
    votes = _stored_votes(spark, sf)
    report = A.region_agreement(A.decided(_shares(votes), "doc_id"), votes, "doc_id")
    return report.select("facet", "region", "n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query(_SHARES + _REFERENCE + _decided("h", FITTED) + """ SELECT count(*) AS n, round(avg(no_evidence::INT), 6) AS no_evidence_rate, count(*) FILTER (has_reference) AS n_reference, round(avg(CASE WHEN has_reference THEN (h.design = r.design)::INT END), 6) AS agreement,
  round(avg(CASE WHEN has_reference THEN (CASE WHEN no_evidence THEN top_facet ELSE h.design END = r.design)::INT END), 6) AS agreement_with_top_facet FROM h JOIN r USING (doc_id)""")
def design_report(spark: SparkSession, sf: str) -> DataFrame:
    """Designs under fitted thresholds against those of the unread regions."""
    votes = _stored_votes(spark, sf)
    r = A.design_report(A.decided(_shares(votes), "doc_id", FITTED), A.unseen_reference(votes, "doc_id"), "doc_id")
    return r.select("n", "n_reference", *(F.round(c, 6).alias(c) for c in ("no_evidence_rate", "agreement", "agreement_with_top_facet")))


def _fallbacks(spark: SparkSession, sf: str, votes: DataFrame) -> DataFrame:
    reference = A.unseen_reference(votes, "doc_id")
    similar = A.group_votes(reference.join(docs_of(spark, sf).select("doc_id", "lang", "source"), "doc_id"), "doc_id", ["lang", "source"])
    top = A.commonest_design(reference).first()
    return A.fallback_report(A.decided(_shares(votes), "doc_id"), reference, "doc_id", similar, top and top[0])


@query(_FALLBACKS + " SELECT candidate, reads, n, round(agreement, 6) AS agreement FROM fr")
def fallback_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Four answers for documents that no rule decides."""
    return _fallbacks(spark, sf, _stored_votes(spark, sf)).withColumn("agreement", F.round("agreement", 6))


@query(_FALLBACKS + _decided("h2", FITTED) + _agreement("ag", "h") + _agreement("ag2", "h2") + """, x AS (SELECT max(agreement) FILTER (NOT reads) AS blind, max(agreement) FILTER (reads) AS reading, arg_max(candidate, (agreement, candidate = 'similar_items')) FILTER (reads) AS best FROM fr),
k AS (SELECT (SELECT avg(kappa) FROM ag) AS plain, (SELECT avg(kappa) FROM ag2) AS fitted)
SELECT CASE WHEN reading > blind THEN best END AS fallback, round(reading, 6) AS reading, round(blind, 6) AS blind, round(plain, 6) AS plain, round(fitted, 6) AS fitted, fitted >= plain AS use_fitted FROM x, k""")
def decision_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Are fitted thresholds taken, and which answer stands in where no rule holds?"""
    votes = _stored_votes(spark, sf)
    probs = _shares(votes)
    plain, fitted = (A.region_agreement(A.decided(probs, "doc_id", t), votes, "doc_id") for t in (None, FITTED))
    both = A.fallback_gate(_fallbacks(spark, sf, votes)).crossJoin(A.threshold_gate(plain, fitted))
    return both.select("fallback", "use_fitted", *(F.round(c, 6).alias(c) for c in ("reading", "blind", "plain", "fitted")))


#: Outside signals stand for languages and sources here.
SIGNALS = {"code_release": "source = 'src0'", "tool_demo": "lang = 'de'", "theory_venue": "source = 'src1'", "hci_venue": "lang = 'fr'", "industry_track": "source = 'src2'", "survey_venue": "lang = 'es'", "simulation_venue": "source = 'none'"}


@query(_SHARES + _decided("h", {}) + ", s AS (" + " UNION ALL ".join(f"SELECT '{s}' AS signal, '{A.SIGNAL_FACET[s]}' AS facet, coalesce({c} AND doc_id % 9 <> 0, FALSE) AS hit, h_{A.SIGNAL_FACET[s]}::INT AS h FROM h JOIN documents USING (doc_id)" for s, c in SIGNALS.items()) + """),
x AS (SELECT signal, facet, count(*) FILTER (hit) AS n, avg(h) FILTER (hit) AS given, avg(h) FILTER (NOT hit) AS otherwise FROM s GROUP BY signal, facet) SELECT signal, facet, n, round(given, 6) AS given, round(otherwise, 6) AS otherwise, round(CASE WHEN otherwise > 0 THEN given / otherwise END, 6) AS lift FROM x WHERE n > 0""")
def signal_lift(spark: SparkSession, sf: str) -> DataFrame:
    """Facets with an outside signal and without; every ninth document has no row of signals."""
    signals = docs_of(spark, sf).where("doc_id % 9 <> 0").select("doc_id", *(F.expr(c).alias(s) for s, c in SIGNALS.items()))
    report = A.signal_lift(A.decided(_shares(votes_of(spark, sf)), "doc_id"), signals, "doc_id")
    return report.select("signal", "facet", "n", *(F.round(c, 6).alias(c) for c in ("given", "otherwise", "lift")))


#: Languages in the order that all scorers share.
LANGUAGES = ["en", "fr", "de", "es"]


def _language_models(spark: SparkSession, sf: str) -> list[tuple[dict, float]]:
    """Two scorers of the language, by words and by characters, from documents whose id's digest isn't in the fifth part."""
    train = docs_of(spark, sf).where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    models = []
    for kind, classes, weight in (("words", LANGUAGES, 0.6), ("trigrams", sorted(LANGUAGES), 0.4)):
        path = scratch_path(spark, kind)
        scorers.fit(train, "text", "lang", classes, kind, kind, path)
        models.append((scorers.load(spark, path), weight))
    return models


def ensemble_languages(spark: SparkSession, sf: str) -> DataFrame:
    """The language that two scorers together find, with each one's probability of it."""
    rows = scorers.ensemble(docs_of(spark, sf).select("doc_id", "text"), "text", _language_models(spark, sf), LANGUAGES)
    best = V.argmax(F.col("probs"))
    return rows.select("doc_id", F.element_at(F.array(*(F.lit(x) for x in LANGUAGES)), best + 1).alias("predicted"), *(F.round(F.col(c)[best], 6).alias(n) for c, n in (("probs", "p"), ("p_words", "by_words"), ("p_trigrams", "by_characters"))))


QUERIES["ensemble_languages"] = ensemble_languages
