"""Operators that SQL can't express, and corner cases, on inline tables."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions import headings as H
from folio.functions import text as T
from folio.functions import vectors as V
from folio.operators import chunking, conformal, evidence, labelling, metrics, scoring
from folio.operators import relational as R
from folio.plans import baselines, reports
from folio.sources import files
from folio.streaming import chunks as stream


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("n", [0, 1, 199, 200, 201, 360, 361, 1000])
def test_windows_cover_all_words(spark, n):
    spans = spark.range(1).select(chunking.windows(F.lit(n)).alias("w")).first()["w"]
    assert {k for s in spans for k in range(s.start, s.stop)} == set(range(n))
    assert all(b.start == a.start + 160 for a, b in zip(spans, spans[1:]))


def test_article_chunks_keep_every_word(spark):
    text = "\n".join(" ".join(f"p{p}w{k}" for k in range(size)) for p, size in enumerate([30, 90, 120, 500, 10, 150]))
    rows = chunking.article_chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), "doc_id").collect()
    assert {r.doc_id for r in rows} == {1}
    assert {w for r in rows for w in r.text.split()} == set(text.split())
    assert [r.chunk_index for r in rows] == list(range(len(rows)))


def test_tidy(spark):
    assert one(spark, T.tidy(F.col("t")), t="Abstract—We pro-\npose  x\n\n\n\ny ") == "Abstract\nWe propose x\n\ny"


def test_format_chunk(spark):
    f = T.format_chunk(F.col("t"), F.col("s"), F.col("h"))
    assert one(spark, f, t="Body text", s="related_work", h="Title") == "[related work] Title. Body text"
    assert one(spark, f, t="Title goes on", s="body", h="Title") == "Title goes on"


def test_looks_like_path(spark):
    rows = spark.createDataFrame([("paper.pdf",), ("a b.pdf",), ("a/b c.pdf",), ("prose",)], "t string").select(T.looks_like_path(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == [True, False, True, False]


def test_highlight_escapes(spark):
    assert one(spark, T.highlight(F.col("t"), ["case", "case study"]), t="A <Case Study> & case") == "A &lt;<mark>Case Study</mark>&gt; &amp; <mark>case</mark>"


def test_document_type(spark):
    assert one(spark, T.document_type(F.col("t"), F.col("n")), t="short", n=0) == "paragraph"
    assert one(spark, T.document_type(F.col("t"), F.col("n")), t="short", n=3) == "paper"
    assert one(spark, T.document_type(F.col("t"), F.col("n")), t="w " * 400, n=1) == "article"


def test_markdown_sections(spark):
    md = "lead\n# T\n## Abstract\nfirst\nsecond\n## 2 Methods\nthird"
    rows = chunking.markdown_sections(spark.createDataFrame([(1, md)], "doc_id long, text string"), "doc_id").orderBy("section_index").collect()
    assert [(r.section, r.body) for r in rows] == [("abstract", "lead"), ("other", ""), ("abstract", "first\nsecond"), ("methods", "third")]


def test_noise_sections_go_unless_alone(spark):
    rows = [(1, "methods"), (1, "references"), (2, "references")]
    kept = chunking.classifiable(spark.createDataFrame(rows, "doc_id long, section string"), "doc_id")
    assert sorted((r.doc_id, r.section) for r in kept.collect()) == [(1, "methods"), (2, "references")]


def test_splits_with_guarantee(spark):
    rows = R.add_splits(spark.createDataFrame([(k, "g") for k in range(3)], "id long, g string"), ["g"], "id", guarantee=True)
    assert sorted(r.split for r in rows.collect()) == ["test", "train", "val"]


def test_label_model_against_direct_iteration(spark):
    rng = np.random.default_rng(4)
    truth = rng.random(800) < 0.4
    votes = np.stack([np.where(rng.random(800) < 0.2, 0, np.where(rng.random(800) < a, np.where(truth, 1, -1), np.where(truth, -1, 1))) for a in (0.9, 0.8, 0.7)], 1)
    df = spark.createDataFrame([(k, *map(int, v)) for k, v in enumerate(votes)], "id long, a int, b int, c int")
    out, model = labelling.label_model(df, ["a", "b", "c"])
    post = {r.id: r.posterior for r in out.collect()}
    assert np.mean([(post[k] > 0.5) == truth[k] for k in range(800)]) > 0.85
    assert model["sensitivity"][0] > model["sensitivity"][2]


def test_design_decisions(spark):
    def brute(case, survey, design, experiment, simulation):
        (s1, n1), (s2, n2) = sorted([(case, "case"), (survey, "survey")], reverse=True)
        if s1 >= 2 and s1 > s2:
            return n1, float(s1 - s2), n2 if s2 else None
        if simulation >= 2 and simulation >= max(design, experiment) and simulation > s1:
            return "simulation", float(simulation - max(design, experiment)), None
        if design >= 2 and design >= experiment:
            return "design", float(design - experiment), "experiment" if experiment else None
        if experiment >= 2:
            return "experiment", float(experiment - design), "design" if design else None
        return None, 0.0, None

    names = ["case", "survey", "design", "experiment", "simulation"]
    grid = spark.createDataFrame(list(product(range(4), repeat=5)), ", ".join(f"{n} int" for n in names))
    rows = grid.select("*", labelling.decide_design(["case", "survey"], "design", "experiment", "simulation").alias("x")).collect()
    for r in rows:
        assert tuple(r.x) == brute(*(r[n] for n in names))


def test_design_distribution_sums_to_one(spark):
    rows = spark.createDataFrame([(0.2,) * 8, (0.9,) * 8, (0.0,) * 8], ", ".join(f"p_{f} double" for f in labelling.FACETS))
    parts = labelling.design_distribution()
    for r in rows.select(*(c.alias(f"d{k}") for k, c in enumerate(parts.values()))).collect():
        assert math.isclose(sum(r), 1, rel_tol=1e-9)


def test_joint_and_smoothing(spark):
    p, q = F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.9), F.lit(0.1))
    row = spark.range(1).select(scoring.joint(p, q, 1.0).alias("j"), V.smooth(q, 0.1, 2).alias("s"), V.one_hot(F.lit(1), 3).alias("o"), V.sigmoid(F.lit(0.0)).alias("g")).first()
    assert np.allclose(row.j, [0.9, 0.1]) and np.allclose(row.s, [0.86, 0.14]) and row.o == [0.0, 1.0, 0.0] and row.g == 0.5
    with pytest.raises(ValueError, match="weight"):
        scoring.joint(p, q, 2.0)


@pytest.mark.parametrize(("n", "alpha", "place"), [(100, 0.1, 91), (9, 0.1, 8), (8, 0.1, None), (0, 0.1, None)])
def test_conformal_quantile(spark, n, alpha, place):
    df = spark.createDataFrame([(float(k),) for k in range(n)], "s double")
    q = conformal.quantiles(df, "s", [alpha]).first()["qhat"]
    assert q == (math.inf if place is None else place)


def test_bad_alpha_and_method(spark):
    with pytest.raises(ValueError, match="alpha"):
        conformal.quantiles(spark.range(1), "id", [1.5])
    with pytest.raises(ValueError, match="method"):
        conformal.scores(F.lit(1), "other")


def test_mcnemar(spark):
    rows = spark.createDataFrame([(True, False)] * 8 + [(False, True)] * 2 + [(True, True)] * 5, "a boolean, b boolean")
    assert metrics.mcnemar(rows, "a", "b") == {"first_only": 8, "second_only": 2, "p_value": pytest.approx(0.109375)}


def test_bootstrap_covers_the_mean(spark):
    rows = spark.createDataFrame([(k, k % 3 != 0, k % 2 == 0) for k in range(600)], "id long, a boolean, b boolean")
    r = metrics.bootstrap_difference(rows, "a", "b", 300).first()
    assert r.low < 400 / 600 - 0.5 < r.high and r.high - r.low < 0.2


def test_document_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("A title of five words here\nbody text")
    (tmp_path / "b.md").write_text("# Heading\n\nbody")
    (tmp_path / "c.pptx").write_bytes(b"x")
    (tmp_path / "d.txt").write_text(" ")
    rows = {r.path.rpartition("/")[2]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].title == "A title of five words here" and rows["b.md"].title == "Heading"
    assert rows["c.pptx"].error == "unsupported kind" and rows["d.txt"].error == "no text"


def test_resumed_append_and_truncated_lines(spark, tmp_path):
    rows, path = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), str(tmp_path / "cache")
    assert files.append_missing(rows.limit(1), path, "id") == 1
    assert files.append_missing(rows, path, "id") == 1
    (tmp_path / "cache" / "part-x.json").write_text('{"id": 3, "v": "c"}\n{"id": 4, "v"')
    assert sorted(r.id for r in files.read_json_lines(spark, path, "id long, v string").collect()) == [1, 2, 3]


def test_csv_and_stats(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,t\n1,"two\nlines"\n2,plain\n')
    df = files.read_csv(spark, str(tmp_path / "x.csv"), "id int, t string")
    assert [r.t for r in df.orderBy("id").collect()] == ["two\nlines", "plain"]
    assert files.write_with_stats(df, str(tmp_path / "out"), "id").count() == 2


def test_stream_equals_batch(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.limit(100).repartition(4).write.parquet(str(tmp_path / "in"))
    source = stream.read_document_stream(spark, str(tmp_path / "in"), docs.schema, 2)
    stream.stream_chunks(source, str(tmp_path / "cp"), str(tmp_path / "out")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    expected = chunking.window_chunks(spark.read.parquet(str(tmp_path / "in")), "doc_id")
    assert got.exceptAll(expected).count() == 0 and got.count() == expected.count()


def test_plain_sections_and_types(spark):
    paper = "A lead line here.\nAbstract\nWe do.\n1. Introduction\nwords\nTABLE III\n3) Our New Method\nsteps\nRELATED WORK\nothers\nThe results show that our model outperforms\nReferences\n[1] x"
    docs = spark.createDataFrame([(1, paper), (2, "just prose"), (3, None)], "doc_id long, text string")
    rows = {(r.doc_id, r.section_index): (r.heading, r.section) for r in H.plain_sections(docs, "doc_id").collect()}
    assert [v for k, v in sorted(rows.items()) if k[0] == 1] == [(None, "abstract"), ("Abstract", "abstract"), ("1. Introduction", "introduction"), ("3) Our New Method", "methods"), ("RELATED WORK", "related_work"), ("References", "references")]
    assert {r.doc_id: r.doc_type for r in H.typed(docs).collect()} == {1: "paper", 2: "paragraph", 3: "paragraph"}
    assert not docs.select(H.is_strict_name(F.lit("The results show that our model outperforms")).alias("x")).first()["x"]


def test_paper_text_falls_back(spark):
    rows = [(1, 0, "abstract", "A"), (1, 1, "methods", "M  m"), (2, 0, "introduction", "I"), (2, 1, "abstract", "B")]
    out = evidence.paper_text(spark.createDataFrame(rows, "id int, chunk_index int, section string, text string"), "id").collect()
    assert {r.id: r.text for r in out} == {1: "m m a", 2: "b i"}


def test_evidence_first_and_label_sets(spark):
    rows = spark.createDataFrame([(1, "abstract"), (1, "body"), (2, "body")], "id int, section string")
    assert sorted(tuple(r) for r in evidence.evidence_first(rows, "id", F.col("section") == "abstract").collect()) == [(1, "abstract"), (2, "body")]
    items = spark.createDataFrame([(1, ["a", "b"])], "id int, c array<string>")
    mapping = spark.createDataFrame([("a", "X", "Y"), ("b", "Z", None)], "category string, label string, secondary string")
    assert tuple(evidence.label_sets(items, "id", "c", mapping).first()) == (1, ["X", "Z"], ["Y"])


@pytest.mark.parametrize("name", baselines.CLASSIFIERS)
def test_baselines_learn(spark, name):
    rows = [(f"{'alpha beta gamma' if k % 2 else 'delta epsilon zeta'} word{k % 5}", float(k % 2)) for k in range(60)]
    df = spark.createDataFrame(rows, "text string, label double")
    out = baselines.fit_baseline(df, name, 200).transform(df)
    assert out.where("prediction = label").count() >= 57


def test_trees_on_chosen_terms(spark):
    rows = [(f"{'alpha beta' if k % 2 else 'delta epsilon'} word{k % 5} noise{k % 3}", float(k % 2)) for k in range(60)] + [(None, 0.0)]
    df = spark.createDataFrame(rows, "text string, label double")
    model = baselines.fit_baseline(df, "rf", 200, best_terms=6)
    terms = model.stages[4].vocabulary
    assert {t for k in model.stages[6].selectedFeatures for t in terms[k].split()} == {"alpha", "beta", "delta", "epsilon"}
    assert model.transform(df.where("text is not null")).where("prediction = label").count() == 60


def test_bank_round_trip(spark, tmp_path):
    bank = spark.createDataFrame([(0.1, 50, 0.7), (0.01, 50, math.inf)], "alpha double, n long, qhat double")
    reports.save_bank(bank, str(tmp_path / "bank"))
    loaded = reports.load_bank(spark, str(tmp_path / "bank"))
    assert sorted(tuple(r) for r in loaded.collect()) == [(0.01, 50, math.inf), (0.1, 50, 0.7)]
    assert conformal.nearest_alpha(loaded, 0.2).first()["qhat"] == 0.7


def test_candidates(spark):
    probs = F.array(*(F.lit(x) for x in (0.1, 0.5, 0.4)))
    row = spark.range(1).select(reports.candidates(F.array(F.lit(2), F.lit(1)), probs, F.lit(None)).alias("a"), reports.candidates(F.array(F.lit(1)), probs, F.lit("TIGHT_GAP")).alias("b"), reports.candidates(F.array(F.lit(1)), probs, F.lit(None)).alias("c")).first()
    assert (row.a, row.b, row.c) == ([1, 2], [1, 2], [1])


def test_section_weights_favour_what_informs(spark):
    rng = np.random.default_rng(6)
    rows = []
    for d in range(200):
        y = int(rng.integers(0, 2))
        for s, sure in (("methods", 0.9), ("body", 0.5)):
            p = sure if rng.random() < 0.95 else 1 - sure
            rows.append((d, s, [1 - p, p] if y else [p, 1 - p], 100, y))
    df = spark.createDataFrame(rows, "doc int, section string, probs array<double>, n_words int, label int")
    out = reports.section_weights(df.drop("label"), "doc", df.select("doc", "label").distinct(), {"methods": 1.0, "body": 1.0}, 8)
    assert out["methods"] > out["body"]


def test_event_windows(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    out = stream.events_per_window(events, "1 day")
    assert out.agg(F.sum("n")).first()[0] == events.count()


def test_the_first_field_wins_a_tie(spark):
    from folio.operators import labelling

    fields = [("a", 0, "x+", []), ("b", 1, "y+", [])]
    df = spark.createDataFrame([("x y", None), ("Y", "yy x"), (None, "none"), ("x", "X")], "title string, body string")
    found = [tuple(r[0]) for r in df.select(labelling.keyword_vote(F.col("title"), F.col("body"), fields)).collect()]
    assert found == [("a", 1), ("b", 2), (None, 0), ("a", 1)]


def test_rows_with_null_keys_keep_their_place(spark):
    from folio.operators import relational as R

    df = spark.createDataFrame([(None if k % 5 == 0 else k, "g" if k % 2 else None, k) for k in range(40)], "id long, g string, size long")
    split = R.add_splits(df, ["g"], "id")
    assert split.count() == 40 and split.where("split = 'train'").count() == 28
    assert R.cap_groups(df, "g", "id", 3).count() == 6
    assert sorted(r.size for r in R.running_cap(df, ["g"], "id", "size", 10**6).collect()) == list(range(40))


def test_padded_headings_count(spark):
    from folio.functions import headings

    df = spark.createDataFrame([("INTRODUCTION" + " " * 150 + "\nsome words here.\nMETHODS",)], "t string")
    assert df.select(headings.candidate_headings(F.col("t"))).first()[0] == ["INTRODUCTION", "METHODS"]
