"""Facet votes, references and gates against small brute-force versions."""

import math

import pytest

from folio.operators import facets as A
from folio.operators import labelling, metrics
from folio.operators import relational as R
from folio.sources.files import read_optional_csv

LONG = " ".join(["word"] * 40)


def votes(spark, rows, **how):
    regions = spark.createDataFrame(rows, "id long, region string, text string, n_words long")
    how = {"cues": {"builds": ["we built"], "proves": ["lemma"]}, "anti_cues": {"builds": ["they built"]}, "titles": {"builds": r"\btool\b"}, **how}
    return {(r.id, r.region): (r.v_builds, r.v_proves) for r in A.region_votes(regions, "id", **how).collect()}


def test_regions_vote(spark):
    rows = [(1, "title", "A Tool for x", 4), (1, "abstract", "We built a lemma", 40), (1, "methods", "We built what they built " + LONG, 45), (2, "title", "toolbox", 1), (2, "abstract", "we built", 39), (3, "methods", None, None), (3, "abstract", None, 50), (None, "abstract", LONG, 40)]
    assert votes(spark, rows) == {(1, "title"): (1, 0), (1, "abstract"): (1, 1), (1, "methods"): (-1, -1), (2, "title"): (0, 0), (2, "abstract"): (0, 0), (3, "methods"): (0, 0), (3, "abstract"): (-1, -1), (None, "abstract"): (-1, -1)}


def test_extended_evidence_votes_only_if_asked(spark):
    rows = [(1, "abstract", "We present FOO-1, which gives sample complexity", 40)]
    assert votes(spark, rows) == {(1, "abstract"): (1, 1)}
    assert votes(spark, rows, extended=False) == {(1, "abstract"): (-1, -1)}


def test_region_texts_join_sections_and_count_overlaps_once(spark):
    rows = [(1, 0, "background", "b", 1), (1, 2, "introduction", "a", 1), (1, 1, "introduction", "a", 1), (1, 3, "methods", None, None), (1, 4, "references", "z", 1), (2, 0, None, "q", 1), (1, 5, "background", "a", 1)]
    chunks = spark.createDataFrame(rows, "id long, chunk_index int, section string, text string, n_words long")
    found = {(r.id, r.region): (r.text, r.n_words) for r in A.region_texts(chunks, "id").collect()}
    assert found == {(1, "introduction"): ("b a a", 3), (1, "methods"): ("", 0)}
    assert A.region_texts(chunks.limit(0), "id").count() == 0


def long_votes(spark, rows):
    """rows: id, region, facet names asserted; all other facets are voted absent, None is no vote at all."""
    out = [(i, r, *(0 if on is None else 1 if f in on else -1 for f in labelling.FACETS)) for i, r, on in rows]
    return spark.createDataFrame(out, "id long, region string, " + ", ".join(f"v_{f} int" for f in labelling.FACETS))


def test_references_come_from_unseen_regions(spark):
    v = long_votes(spark, [(1, "abstract", ["proves"]), (1, "methods", ["builds"]), (2, "abstract", ["proves"]), (3, "methods", []), (4, "methods", None), (5, "methods", ["secondary"]), (5, "results_conclusion", ["human_data", "evaluates"]), (6, "methods", ["intervenes"])])
    found = {r.id: (r.design, r.has_reference) for r in A.unseen_reference(v, "id").collect()}
    d = labelling.DEFAULT_DESIGN
    assert found == {1: (d, True), 2: (d, False), 3: (d, False), 4: (d, False), 5: ("Survey (empirical study of respondents)", True), 6: (d, False)}


def probs(spark, rows):
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"p_{f} double" for f in labelling.FACETS))


def test_decisions_thresholds_ties_and_nulls(spark):
    rows = probs(spark, [(1, 0.5, *[0.1] * 7), (2, *[0.3] * 8), (3, *[None] * 8), (4, 0.1, 0.1, 0.45, *[0.1] * 5)])
    found = {r.id: (r.design, r.no_evidence, r.top_facet) for r in A.decided(rows, "id", {"proves": 0.45}).collect()}
    d, formal = labelling.DEFAULT_DESIGN, "Formal / Theoretical"
    assert found == {1: (d, False, d), 2: (d, True, d), 3: (d, True, d), 4: (formal, False, formal)}
    assert {r.id for r in A.decided(rows, "id").where("no_evidence").collect()} == {2, 3, 4}


def test_fallbacks_and_gates(spark):
    formal, survey, d = "Formal / Theoretical", "Survey (empirical study of respondents)", labelling.DEFAULT_DESIGN
    rows = A.decided(probs(spark, [(k, 0.1, 0.1, 0.3, *[0.1] * 5) for k in range(1, 6)] + [(6, 0.9, *[0.1] * 7)]), "id")
    reference = spark.createDataFrame([(1, formal, True), (2, formal, True), (3, survey, True), (4, survey, True), (5, formal, False), (6, survey, True)], "id long, design string, has_reference boolean")
    assert A.commonest_design(reference).first()[0] == survey
    assert A.commonest_design(reference.where("not has_reference")).first() is None
    similar = spark.createDataFrame([(1, formal), (2, formal), (3, survey), (9, survey)], "id long, design string")
    report = A.fallback_report(rows, reference, "id", similar, survey)
    found = {r.candidate: (r.reads, r.n, r.agreement) for r in report.collect()}
    assert found == {"default": (False, 4, 0.0), "majority": (False, 4, 0.5), "top_facet": (True, 4, 0.5), "similar_items": (True, 4, 0.75)}
    assert tuple(A.fallback_gate(report).first()) == ("similar_items", 0.75, 0.5)
    worse = report.where("candidate <> 'similar_items'")
    assert tuple(A.fallback_gate(worse).first()) == (None, 0.5, 0.5)
    tied = spark.createDataFrame([("top_facet", True, 0.6), ("similar_items", True, 0.6), ("default", False, 0.1)], "candidate string, reads boolean, agreement double")
    assert A.fallback_gate(tied).first().fallback == "similar_items"
    assert tuple(A.fallback_gate(report.limit(0)).first()) == (None, None, None)
    whole = A.design_report(rows, reference, "id").first()
    assert (whole.n, whole.n_reference) == (6, 5) and math.isclose(whole.no_evidence_rate, 5 / 6) and math.isclose(whole.agreement, 0.0) and math.isclose(whole.agreement_with_top_facet, 2 / 5)
    assert d not in (formal, survey)


def test_groups_vote_without_the_document_itself(spark):
    rows = [(1, "a", "x", True), (2, "a", "x", True), (3, "a", "y", True), (4, "a", "y", False), (5, None, "z", True), (6, None, "y", False), (7, "b", "x", True)]
    reference = spark.createDataFrame(rows, "id long, g string, design string, has_reference boolean")
    found = {r.id: r.design for r in A.group_votes(reference, "id", ["g"]).collect()}
    assert found == {1: "x", 2: "x", 3: "x", 4: "x", 6: "z"}  # 5 and 7 are alone in their groups; 1 and 2 tie, the first name wins


def test_lift_of_signals(spark):
    rows = A.decided(probs(spark, [(1, 0.9, *[0.1] * 7), (2, 0.9, *[0.1] * 7), (3, *[0.1] * 8)]), "id")
    signals = spark.createDataFrame([(1, True, False), (2, None, False)], "id long, code_release boolean, position boolean")
    found = A.signal_lift(rows, signals, "id", {"code_release": "builds", "position": "proves"}).collect()
    assert [tuple(r) for r in found] == [("code_release", "builds", 1, 1.0, 0.5, 2.0)]


def test_confusions_and_bands(spark):
    rows = spark.createDataFrame([(0, 1, 0.1), (0, 1, 0.2), (1, 0, 0.2), (2, 0, None), (0, 0, 0.9), (1, 1, -0.1)], "t int, p int, m double").selectExpr("*", "array(1) AS a", "array(0) AS n", "t = p AS ok")
    assert sorted(map(tuple, metrics.confused_pairs(rows, "t", "p", "a", "n", 1).collect())) == [("adjacent", 1, 0, 1, 1), ("co_listed", 0, 1, 2, 1)]
    bands = sorted(metrics.margin_bands(rows, "m", "ok", [0.0, 0.2]).collect())
    assert [(r.low, r.high, r.n, round(r.accuracy, 6)) for r in bands] == [(0.0, 0.2, 1, 0.0), (0.2, None, 3, 0.333333)]


def test_members_and_turns_of_priority(spark):
    rows = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "b"), ("h", None), (None, "c")], "g string, m string")
    assert {r.g: r.members for r in R.members(rows, "g", "m").collect()} == {"g": ["a", "b"], "h": [], None: ["c"]}
    blocks = spark.createDataFrame([(k, "p", s) for k, s in enumerate(["results", "methods", "results", "intro", "methods", "zzz", None])], "id long, paper string, section string")
    kept = lambda cap: sorted(str(r.section) for r in R.round_robin(blocks, ["paper"], "section", "id", cap, priority=["methods", "intro"]).collect())
    assert kept(1) == ["methods"] and kept(2) == ["intro", "methods"] and len(kept(7)) == 7


def test_a_side_table_may_be_absent(spark, tmp_path):
    assert read_optional_csv(spark, f"{tmp_path}/none.csv", "id long, s boolean").count() == 0
    (tmp_path / "some.csv").write_text("id,s\n1,true\n")
    assert [tuple(r) for r in read_optional_csv(spark, f"{tmp_path}/some.csv", "id long, s boolean").collect()] == [(1, True)]


@pytest.mark.parametrize("name", ["decision_gates", "fallback_candidates"])
def test_reports_over_no_documents(spark, sf, tmp_path, name):
    from folio.plans import facet_queries

    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    rows = facet_queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == ([(None,) * 6] if name == "decision_gates" else [])
