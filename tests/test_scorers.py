"""Fitted scorers against a plain version, and their blend."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.operators import metrics, scorers
from folio.plans import facet_queries as Q


def plain_probabilities(train, texts, classes):
    """By words, one count at a time."""
    counts = {c: Counter() for c in classes}
    words = lambda x: [zlib.crc32(w.encode()) % scorers.BUCKETS for w in "".join(c.lower() if c.isascii() else c for c in x or "").split()]
    for text, y in train:
        if y in counts:
            counts[y].update(words(text))
    whole = sum(counts.values(), Counter())
    total = {c: sum(n.values()) for c, n in counts.items()}
    out = []
    for text in texts:
        own, s = words(text), []
        for c in classes:
            ratio = lambda w: math.log((counts[c][w] + 1) / (total[c] + scorers.BUCKETS)) - math.log((whole[w] - counts[c][w] + 1) / (sum(total.values()) - total[c] + scorers.BUCKETS))  # noqa: B023, E731
            s.append(10 * sum(map(ratio, own)) / max(len(own), 1))
        e = [math.exp(x - max(s)) for x in s]
        out.append([x / sum(e) for x in e])
    return out


TRAIN = [("red red Apple", "a"), ("blue sky\tred", "b"), ("green", None), (None, "a"), ("sky sky", "b"), ("tree", "other"), ("", "a")]
TEXTS = ["red apple", "SKY", "unknown", "", None, "red sky " * 5000]


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model") / "words")
    scorers.fit(spark.createDataFrame(TRAIN, "t string, y string"), "t", "y", ["b", "a"], "words", "words", path)
    return scorers.load(spark, path)


def test_scores_equal_the_plain_version_in_canonical_order(spark, model):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").repartition(3)
    found = {r.id: r.p_words for r in scorers.score(rows, "t", [model], ["a", "b"]).collect()}
    for k, p in enumerate(plain_probabilities(TRAIN, TEXTS, ["a", "b"])):
        assert np.allclose(found[k], p, atol=1e-9)
    assert found[3] == found[4] == [0.5, 0.5]


def test_classes_must_agree(spark, model):
    rows = spark.createDataFrame([("x",)], "t string")
    for wrong in (["a"], ["a", "b", "c"], ["a", "c"]):
        with pytest.raises(ValueError, match="classes"):
            scorers.score(rows, "t", [model], wrong)
    assert scorers.to_canonical(np.array([[1, 2, 3]]), ["x", "y", "z"], ["z", "x", "y"]).tolist() == [[3, 1, 2]]


def test_empty_tables_and_large_models(spark, tmp_path, model, monkeypatch):
    none = spark.createDataFrame([], "t string, y string")
    scorers.fit(none, "t", "y", ["a", "b"], "trigrams", "even", f"{tmp_path}/even")
    even = scorers.load(spark, f"{tmp_path}/even")
    rows = spark.createDataFrame([("some text",)], "t string")
    assert scorers.score(rows, "t", [even], ["a", "b"]).first().p_even == [0.5, 0.5]
    assert scorers.score(none.select("t"), "t", [model], ["a", "b"]).count() == 0
    monkeypatch.setattr(scorers, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="limit"):
        scorers.load(spark, f"{tmp_path}/even")


def test_trigrams_are_of_characters():
    assert len(scorers.trigram_cells("ab")) == 0 and len(scorers.trigram_cells("aéb😀")) == 2
    assert scorers.trigram_cells("ABC").tolist() == scorers.trigram_cells("abc").tolist()
    assert scorers.word_cells(" \n").tolist() == []


def test_ensemble_finds_held_out_languages(spark, sf):
    docs = Q.docs_of(spark, sf).select("doc_id", "lang")
    found = Q.ensemble_languages(spark, sf)
    assert found.count() == docs.count()
    held = found.join(docs, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    assert metrics.summary(held, "lang", "predicted").first().accuracy > 0.95
    for r in found.limit(200).collect():
        assert math.isclose(r.p, 0.6 * r.by_words + 0.4 * r.by_characters, abs_tol=3e-6)
