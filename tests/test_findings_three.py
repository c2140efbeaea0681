"""Cases of the third round of findings: each failed before its change."""

from __future__ import annotations

import time
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.functions import text
from folio.llm import jaccard
from folio.operators import metrics, terms
from folio.plans import baselines
from folio.scratch import written
from tests import test_terms


def test_titles_keep_the_digits_at_their_ends(spark):
    lines = {0: "Report of the year 100", 1: "one\n11 lines and 1 more 1", 2: "  spaces around the words  ", 3: "　\xa0\n00", 4: None, 5: ""}
    docs = spark.createDataFrame([*lines.items()], "doc_id long, text string")
    found = {r.doc_id: r.title for r in docs.select("doc_id", text.guess_title(F.col("text")).alias("title")).collect()}
    assert found == {0: "Report of the year 100", 1: "11 lines and 1 more 1", 2: "spaces around the words", 3: "00", 4: None, 5: None}


@pytest.mark.parametrize("waiting", [1 << 14, 3])
def test_links_found_on_many_lists_leave_a_group_once(monkeypatch, waiting):
    monkeypatch.setattr(jaccard, "FOREST_ROWS", waiting)
    sets = [np.arange(100 * (k // 10), 100 * (k // 10) + 60, dtype=np.uint64) for k in range(30)]
    lists = [sorted({1 + k % 7, 20 + k % 3, 30, 40 + k // 10}) for k in range(30)]
    table = pa.table({"set_id": np.arange(30), "tile": np.zeros(30, np.int32), "one": np.zeros(30, np.int32), "two": np.zeros(30, np.int32), "lists": lists, "shingles": [x.tobytes() for x in sets]})
    found = jaccard._compare(table)
    assert found.num_rows == 27
    assert set(zip(found["src"].to_pylist(), found["dst"].to_pylist(), strict=True)) == {(k, k - k % 10) for k in range(30) if k % 10}


def test_mcnemar_of_millions_of_rows_ends_soon():
    begun = time.perf_counter()
    for b, c in ((1, 0), (0, 40), (3, 9), (15, 17), (1000, 1100), (2500, 2300), (9_000, 9_300)):
        n = b + c
        term = total = 1  # counts of throws, in whole numbers
        for k in range(min(b, c)):
            term = term * (n - k) // (k + 1)
            total += term
        assert metrics._two_sided(b, c) == pytest.approx(min(1.0, float(Fraction(2 * total, 2**n))), rel=1e-11)
    assert metrics._two_sided(5_000_000, 5_004_000) == pytest.approx(0.2061, abs=1e-3)
    assert metrics._two_sided(20_000_000, 30_000_000) == 0
    assert time.perf_counter() - begun < 20


@pytest.mark.parametrize("docs_at_once", [2, 500])
def test_blocks_find_the_neighbours_of_the_plain_version(spark, monkeypatch, docs_at_once):
    monkeypatch.setattr(terms, "DOCS_AT_ONCE", docs_at_once)
    monkeypatch.setattr(terms, "QUERY_ROWS", 7)
    monkeypatch.setattr(terms, "DOC_ROWS", 30)
    rng = np.random.default_rng(3)
    texts = {k: " ".join(f"w{x}" for x in rng.integers(0, 60, 12)) for k in range(90)} | {100: None, 101: "", 102: "zz"}
    texts |= {k: texts[4] for k in range(110, 125)}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3)
    counts = terms.term_counts(docs, "doc_id", "text", 3, test_terms.STOP)
    kept = written(terms.numbered(terms.vocabulary(counts, len(texts))), "kept")
    found = terms.block_neighbours(terms.weights(counts, kept, len(texts), "doc_id", "term_id"), docs.where("doc_id % 4 = 0"), 3, "doc_id")
    near = test_terms.brute(texts, 3, 50_000, lambda i: i % 4 == 0)[1]
    assert {(r["query"], r["rank"], r["id"]) for r in found.collect()} == {(q, n, i) for q, x in near.items() for n, (i, _) in enumerate(x, 1)}


def test_counts_of_unique_documents_are_not_shuffled(spark, capsys):
    docs = spark.createDataFrame([(1, "aa bb aa", "x"), (2, "bb", "y"), (None, "cc", "y")], "doc_id long, text string, lang string")
    counts = terms.term_counts(docs, "doc_id", "text", also=("lang",))
    counts.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert {tuple(r) for r in counts.collect()} == {(1, "x", "aa", 2), (1, "x", "bb", 1), (1, "x", "aa bb", 1), (1, "x", "bb aa", 1), (2, "y", "bb", 1)}
    twice = terms.term_counts(docs.union(docs), "doc_id", "text")
    assert {tuple(r) for r in twice.collect()} == {(1, "aa", 4), (1, "bb", 2), (1, "aa bb", 2), (1, "bb aa", 2), (2, "bb", 2)}


def largest_read(spark, before):
    """Most bytes that the tasks of one stage have read from tables and memory, in stages from ``before``."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    nothing = spark._jvm.java.util.ArrayList()
    stages = sc.statusStore().stageList(nothing, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), nothing)
    return max(stages.apply(k).inputBytes() for k in range(stages.size()) if stages.apply(k).stageId() >= before)


def test_a_baseline_keeps_no_terms_of_texts_in_memory(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, 1500)) for _ in range(80)]
    rows = spark.createDataFrame([(t, float(k % 2)) for k, t in enumerate(texts)], "text string, label double")
    train = written(rows, "train")
    before = spark.sparkContext._jsc.sc().dagScheduler().nextStageId()
    baselines.fit_baseline(train, "nb")
    assert largest_read(spark, before) < 2 * sum(map(len, texts))


@pytest.mark.parametrize("tasks", [1, 5])
def test_a_baseline_has_the_terms_of_the_plain_version(spark, tasks):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, 30)) + " often" for _ in range(40)] + ["the", "", None, "Once ONCE once"]
    rows = spark.createDataFrame([(t, float(k % 2)) for k, t in enumerate(texts)], "text string, label double").repartition(tasks)
    df, n = Counter(), Counter()
    for t in texts:
        w = [x for x in (t or "").lower().split() if x != "the" and x != "once"]
        own = [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]
        n.update(own)
        df.update(set(own))
    order = sorted((t for t in n if 2 <= df[t] <= 0.9 * len(texts)), key=lambda t: (-n[t], t))
    for most in (45, 100, 5000):
        counts = next(s for s in baselines.fit_baseline(rows, "nb", most).stages if hasattr(s, "vocabulary"))
        assert counts.vocabulary == order[:most] and counts.getVocabSize() == most
