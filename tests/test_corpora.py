"""Training tables and studies on small tables with nulls, ties and repeated rows."""

import pytest
from pyspark.sql import functions as F

from folio.operators import corpora, studies


def test_inputs_need_one_of_two_shapes(spark):
    one = spark.createDataFrame([("A title", "methods", "words"), (None, None, None)], "title string, section string, text string")
    assert [r.text_in for r in corpora.model_inputs(one).collect()] == ["[methods] A title. words", ""]
    two = spark.createDataFrame([("T", "T is told again"), ("T", None)], "title string, abstract string")
    assert [r.text_in for r in corpora.model_inputs(two).collect()] == ["[abstract] T is told again", "[abstract] T. "]
    with pytest.raises(ValueError, match="need columns"):
        corpora.model_inputs(spark.range(1))


def test_titles_and_abstracts_of_items(spark):
    rows = [(1, 0, "title", 1, "old"), (1, 1, "title", 1, "new"), (1, 2, "abstract", 15, "a"), (1, 3, "abstract", 15, "a"), (1, 4, "abstract", 9, "b"), (2, 0, "abstract", 19, "short"), (3, 0, "methods", 50, "m")]
    chunks = spark.createDataFrame(rows, "item long, chunk_index int, section string, n_words int, text string")
    assert {r.item: r.title for r in corpora.paper_titles(chunks, "item").collect()} == {1: "new"}
    assert {r.text_in for r in corpora.chunk_texts(chunks, "item").where("item <> 1").collect()} == {"[abstract] short", "[methods] m"}
    facets = spark.createDataFrame([(1, True), (2, True), (9, False)], "item long, builds boolean")
    assert [tuple(r) for r in corpora.facet_corpus(facets, chunks, "item").collect()] == [(1, True, "a b", 24)]
    assert corpora.facet_corpus(facets, chunks.limit(0), "item").count() == 0


def test_gold_rows_are_taken_once(spark):
    rows = spark.createDataFrame([(k, "x" if k % 3 else None, k == 1) for k in range(12)], "id long, design string, rare boolean")
    got = {r.id: r.reasons for r in corpora.gold_sample(rows, "id", "design", {"rare": 5}, 100, 2).collect()}
    assert got[1] == ["design", "rare"] and sum(r == ["unlabelled"] for r in got.values()) == 2 and len(got) == 10


def test_strata_with_null_predictions(spark):
    rows = spark.createDataFrame([(None, 0, 0), ("a", 0, None), ("a", 1, 1), ("a", 1, 2)], "s string, t int, p int").withColumn("co", F.array(F.lit(2)))
    got = {r.stratum: (r.n, round(r.accuracy, 4), round(r.macro_f1, 4), round(r.co_listed, 4)) for r in studies.strata(rows, "s", "t", "p", "co").collect()}
    # of stratum a: label 0 has no hit, 1 has one of two and one claim, 2 a false claim
    assert got == {None: (1, 1.0, 1.0, 1.0), "a": (3, 0.3333, round(2 / 9, 4), 0.6667)}
    assert studies.strata(rows.limit(0), "s", "t", "p", "co").count() == 0


def test_designs_without_evidence(spark):
    cases = spark.createDataFrame([(0.9, 0.1, "s"), (0.2, 0.4, "s"), (None, None, None), (0.2, 0.4, None)], "p_builds double, p_proves double, near string")
    facets = ("builds", "evaluates", "proves", "simulates", "human_data", "field_context", "secondary", "intervenes")
    own = {f: F.col(f"p_{f}") if f in ("builds", "proves") else F.lit(0.0) for f in facets}
    got = [tuple(r.x) for r in cases.select(studies.resolved_design(own, {}, F.col("near")).alias("x")).collect()]
    build = "Design & Creation (Design Science)"
    assert got == [(build, "facets", None), ("s", "similar_items", "NO_EVIDENCE"), (build, "default", "NO_EVIDENCE"), (build, "default", "NO_EVIDENCE")]
    lone = [tuple(r.x) for r in cases.where("p_builds = 0.2").select(studies.resolved_design(own, {}).alias("x")).collect()]
    assert lone == [("Formal / Theoretical", "top_facet", "NO_EVIDENCE")] * 2
    strict = [tuple(r.x) for r in cases.where("p_builds = 0.9").select(studies.resolved_design(own, {"builds": 0.95}).alias("x")).collect()]
    assert strict == [(build, "top_facet", "NO_EVIDENCE")]


def test_reports(spark):
    got = spark.createDataFrame([([],), (None,), ([0.7, 0.3],)], "p array<double>").select(studies.ballot_probs(F.col("p"), 2).alias("p")).collect()
    assert [r.p for r in got] == [[0.5, 0.5], [0.5, 0.5], [0.7, 0.3]]
    results = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", None)], "model string, f1 double")
    assert [(r.model, r.place) for r in studies.ranking(results, "model", ["f1"]).orderBy("place").collect()] == [("a", 1), ("b", 2), ("c", 3)]
    assert studies.markdown_table(results, ["model", "f1"], "model").splitlines()[2:] == ["| a | 0.5000 |", "| b | 0.5000 |", "| c | - |"]
