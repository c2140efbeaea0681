"""Gold reports, figure tables and lookups on small tables with nulls, ties, repeats and no rows."""

import pytest
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import figures, gold


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (3, "b"), (4, "r"), (5, "r"), (6, gold.UNSURE), (7, gold.NOT_APPLICABLE), (8, ""), (9, None), (None, "a"), (10, "a"), (11, "r")]
    return spark.createDataFrame(rows, "id int, design string")


@pytest.fixture(scope="module")
def counts(spark, labels):
    known = spark.createDataFrame([(1, "a", "a"), (2, "b", "a"), (3, "b", None), (4, "b", "a"), (5, "a", "a"), (10, None, "b"), (6, "a", "a")], "id int, p string, w string")
    return gold.cells(labels, known, "id", "design", "p", "w")


def test_gold_reports(labels, counts):
    assert gold.answers(labels, "design").first().asDict() == {"shown": 13, "usable": 9, "unsure": 1, "not_applicable": 1}
    # a: ids 1, 2, 10 with one hit and no other claim; b: id 3, a hit, and a false claim of id 2
    got = gold.model_report(counts, ["a", "b", "c"]).first()
    assert (got.n, got.accuracy, round(got.macro_f1, 6)) == (4, 0.5, round((2 / 4 + 2 / 3 + 0) / 3, 6))
    assert {r.gold: (r.n, round(r.recall, 4)) for r in gold.design_recall(counts, ["a", "b"]).collect()} == {"a": (3, 0.3333), "b": (1, 1.0)}
    weak = gold.weak_report(counts, ["a", "b"]).first()
    assert (weak.n, round(weak.accuracy, 4)) == (3, 0.6667)
    assert [tuple(r) for r in gold.rare_designs(counts, ["a", "b"]).collect()] == [("r", 3, ["a:1", "b:1"])]


def test_gold_reports_without_rows(labels, counts):
    assert tuple(gold.model_report(counts.limit(0), ["a", "b"]).first()) == (0, None, 0.0)
    assert tuple(gold.weak_report(counts, ["c"]).first()) == (0, None)
    assert gold.rare_designs(counts.limit(0), ["a"]).count() == 0
    assert gold.answers(labels.limit(0), "design").first().shown == 0


def test_kappa_of_the_ids_both_know(spark, labels):
    second = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (6, "a"), (4, None)], "id int, design string")
    got = gold.annotator_kappa(labels, second, "id", "design").first()
    assert (got.n, round(got.agreement, 4), round(got.kappa, 4)) == (3, 0.6667, 0.4)


def test_confusion_grid_has_zeros(spark):
    rows = spark.createDataFrame([("x", 0, 0), ("x", 0, 1), ("x", 2, 0), ("y", 0, 0), (None, 0, 0), ("x", None, 0)], "g string, t int, p int")
    got = {(r.panel, r.truth, r.predicted): (r.n, r.share) for r in figures.confusion_grid(rows, "g", "t", "p", {"x": [0, 1]}).collect()}
    assert got == {("x", 0, 0): (1, 0.5), ("x", 0, 1): (1, 0.5), ("x", 1, 0): (0, 0.0), ("x", 1, 1): (0, 0.0)}
    assert {r.n for r in figures.confusion_grid(rows.limit(0), "g", "t", "p", {"x": [0, 1]}).collect()} == {0}


def test_thin_bins_count_in_the_error_only(spark):
    rows = spark.createDataFrame([("s", 0.9, True), ("s", 0.9, False), ("s", 0.1, None), ("s", None, True)], "s string, c double, ok boolean")
    got = figures.reliability_curves(rows, "s", "c", "ok", 10, 2).collect()
    assert [(r.bin, r.n, r.accuracy) for r in got] == [(9, 2, 0.5)] and got[0].ece == pytest.approx((2 * 0.4 + 0.1) / 3)


def test_bars(spark):
    results = spark.createDataFrame([("m", "t", 0.5), ("m", "l", 0.4), ("n", "t", 0.5), ("n", "l", 0.1), ("o", "t", 0.9)], "m string, s string, f double")
    assert [(r.model, r.second, r.place) for r in figures.score_bars(results, "m", "s", "f", "t", "l").orderBy("place").collect()] == [("m", 0.4, 1), ("n", 0.1, 2)]
    runs = spark.createDataFrame([("a", "b", True), ("a", "a", None), ("c", None, False), ("c", "z", True)], "b string, a string, u boolean")
    assert {tuple(r) for r in figures.share_bars(runs, "label", "b", "a", "u").collect()} == {("a", 0.5, 0.25, 0.25), ("c", 0.5, 0.0, 0.25)}
    seen = spark.createDataFrame([("v", ["a", "b"], "b"), ("v", ["a"], None), ("v", [], "a"), ("v", None, "a")], "s string, u array<string>, g string")
    assert {tuple(r) for r in figures.agreement_bars(seen, "s", "u", {"g": F.col("g")}, "most").collect()} == {("v", "g", 2, 0.5), ("v", "most", 2, 1.0)}


def test_lookups(spark):
    rows = spark.createDataFrame([(" A ",), (None,), ("?",)], "x string")
    assert [r.y for r in rows.select(T.looked_up(F.col("x"), {"A": "one"}).alias("y")).collect()] == ["one", None, None]
    assert [r.y for r in rows.select(T.looked_up(F.col("x"), {}, "none").alias("y")).collect()] == ["none"] * 3
