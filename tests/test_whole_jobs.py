"""Queries do the whole job: no row, word or neighbour is left out."""

import numpy as np
import pytest

from folio.operators import chunking, labelling, metrics
from folio.plans import baselines, model_queries, text_queries
from tests.test_queries import SQL, duck, plain  # noqa: F401


def same_rows(df, found):
    names = [d[0] for d in found.description]
    expected = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr) == expected and expected


def test_facet_regions_cover_the_text(spark, tmp_path):
    filler = lambda n: ["word"] * n
    texts = [filler(n) for n in (0, 39, 60, 130, 180, 190, 500, 3000)]
    texts += [filler(400) + ["nation"], filler(900) + ["queau"] + filler(100), ["tion"] + filler(700) + ["tion"], filler(181) + ["tion"], filler(250) + ["tion"] + filler(250)]
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)] + [(99, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def votes(words):
        size = max(60, -(-len(words) // 3))
        parts = [words[k * size : (k + 1) * size] for k in range(3)]
        assert sum(parts, []) == words
        return [0 if len(p) < 40 else -1 if any("queau" in w for w in p) else 1 if any("tion" in w for w in p) else -1 for p in parts]

    table = spark.createDataFrame([(k, *votes((t or "").split())) for k, t in rows], "doc_id long, v0 int, v1 int, v2 int")
    expected = {r.doc_id: round(r.posterior, 6) for r in labelling.label_model(table, ["v0", "v1", "v2"])[0].collect()}
    assert {r.doc_id: r.posterior for r in text_queries.facet_label_model(spark, str(tmp_path)).collect()} == expected
    assert expected[8] > expected[6] and len(expected) == len(rows)


def test_keyword_fields_label_every_language(spark, sf, duck):  # noqa: F811
    df = text_queries.keyword_fields(spark, sf)
    same_rows(df, duck.execute(SQL["keyword_fields"]))
    assert df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


@pytest.mark.parametrize("name", ["nearest_vectors", "neighbour_votes"])
def test_neighbours_come_from_all_vectors(spark, sf, duck, name):  # noqa: F811
    same_rows(model_queries.QUERIES[name](spark, sf), duck.execute(SQL[name]))


def test_queries_find_each_other_not_themselves(spark, tmp_path):
    rows = [(0, [1.0, 0.0], 0), (20, [1.0, 0.001], 0), (7, [0.0, 1.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = model_queries.nearest_vectors(spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == [(0, 1, 20), (0, 2, 7), (20, 1, 0), (20, 2, 7)]


def test_subspaces_label_every_vector(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in rows}
    axes = {}
    for label in {r.label for r in rows if r.vec_id % 20}:
        m = np.array([x[r.vec_id] for r in rows if r.label == label and r.vec_id % 20])
        axes[label] = np.linalg.svd(m, full_matrices=False)[2][:3]
    expected = {k: max(sorted(axes), key=lambda a: ((axes[a] @ v) ** 2).sum()) for k, v in x.items()}
    assert {r.vec_id: r.label for r in model_queries.subspace_labels(spark, sf).collect()} == expected


LONG = [f"w{k}" for k in range(20_000)]


@pytest.mark.parametrize("chunks", [chunking.window_chunks, chunking.article_chunks])
@pytest.mark.parametrize("most", [None, 7])
def test_chunks_keep_every_word_of_long_texts(spark, chunks, most):
    lines = "\n".join(" ".join(LONG[k : k + 90]) for k in range(0, len(LONG), 90))
    rows = chunks(spark.createDataFrame([(1, lines)], "doc_id long, text string"), "doc_id", most=most).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(most or len(rows)))
    assert most or {w for r in rows for w in r.text.split()} == set(LONG)


def test_queries_chunk_whole_texts_and_pages(spark, tmp_path):
    text = " ".join(LONG)
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "u", f"<html><body><h1>Methods</h1><p>{text}</p></body></html>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    n = 1 + -(-(len(LONG) - 200) // 160)
    for query in (text_queries.window_chunks, text_queries.article_chunks, text_queries.section_chunks):
        rows = query(spark, str(tmp_path)).orderBy("chunk_index").collect()
        assert [r.chunk_index for r in rows] == list(range(n))
        assert sum(r.n_words for r in rows) == len(LONG) + 40 * (n - 1)


def test_paired_bootstrap_draws_2000_resamples(spark, sf):
    rows = model_queries.scored(spark, sf).selectExpr("vec_id", "correct AS a", "truth = 0 AS b")
    got, expected, fewer = model_queries.paired_bootstrap(spark, sf).first(), *(metrics.bootstrap_difference(rows, "a", "b", n).first() for n in (2000, 200))
    near = lambda r: pytest.approx(tuple(r), abs=1e-9)
    assert tuple(got) == near(expected) and tuple(got) != near(fewer)


def test_quality_baseline_keeps_50_000_terms(spark, sf, monkeypatch):
    fitted = []
    fit = baselines.fit_baseline
    monkeypatch.setattr(baselines, "fit_baseline", lambda *a, **b: fitted.append(fit(*a, **b)) or fitted[-1])
    assert text_queries.quality_baseline(spark, sf).count()
    counts = next(s for s in fitted[0].stages if hasattr(s, "vocabulary"))
    assert counts.getVocabSize() == 50_000 and len(counts.vocabulary) > 5000
