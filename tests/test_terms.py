"""Sparse text vectors against a plain version; lists that stay closed; empty texts and tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from folio.operators import terms as T
from folio.scratch import written

STOP = ("the", "of")


def split(text):
    w = [x for x in re.findall(r"[^\W]{2,}", (text or "").lower()) if x not in STOP]
    return w + [" ".join(w[k : k + 2]) for k in range(len(w) - 1)] + [" ".join(w[k : k + 3]) for k in range(len(w) - 2)]


def brute(texts, k, most, ask):
    counts = {i: Counter(split(t)) for i, t in texts.items()}
    df, n = Counter(x for c in counts.values() for x in c), Counter()
    for c in counts.values():
        n.update(c)
    kept = sorted((x for x in df if 2 <= df[x] <= 0.9 * len(texts)), key=lambda x: (-n[x], x))[:most]
    vectors = {}
    for i, c in counts.items():
        v = {x: (1 + math.log(c[x])) * (math.log((1 + len(texts)) / (1 + df[x])) + 1) for x in c if x in set(kept)}
        length = math.sqrt(sum(w * w for w in v.values()))
        vectors[i] = {x: w / length for x, w in v.items()}
    out = {}
    for q in (i for i in texts if ask(i) and vectors[i]):
        near = [(sum(w * vectors[i].get(x, 0) for x, w in vectors[q].items()), i) for i in texts if i != q and vectors[i].keys() & vectors[q].keys()]
        out[q] = [(i, s) for s, i in sorted(near, key=lambda x: (-round(x[0], 9), x[1]))[:k]]
    return {x: (df[x], n[x]) for x in kept}, {q: x for q, x in out.items() if x}


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(400)]
    groups = [rng.choice(400, 30) for _ in range(8)]
    out = {k: " ".join(words[w] for w in rng.choice(groups[k % 8], 40)) + " the common of phrase" * (k % 3) for k in range(160)}
    out |= {200: out[3], 201: out[3], 202: None, 203: "", 204: "zz", 205: "a b c", 206: "Été été ÉTÉ naïve", 207: "naïve été"}
    return out


def search(spark, texts, k, most):
    docs = spark.createDataFrame([*texts.items(), (None, "w1 w2 w3")], "doc_id long, text string").repartition(3)
    n = len(texts)
    counts = written(T.term_counts(docs, "doc_id", "text", 3, STOP), "counts")
    terms = T.vocabulary(counts, n, most=most)
    vectors = written(T.weights(counts, T.numbered(terms), n, "doc_id", "term_id"), "vectors")
    return terms, *T.term_neighbours(vectors, docs.where("doc_id % 4 = 0"), k, "doc_id", "term_id")


@pytest.mark.parametrize(("most", "first", "rows"), [(10**6, 1, 10), (300, 1000, 4096)])
def test_neighbours_as_the_plain_version(spark, texts, monkeypatch, most, first, rows):
    monkeypatch.setattr(T, "FIRST_POSTINGS", first)
    monkeypatch.setattr(T, "LIST_ROWS", rows)
    vocabulary, near = brute(texts, 3, most, lambda i: i % 4 == 0)
    terms, found, opened = search(spark, texts, 3, most)
    assert {r.term: (r.df, r.n) for r in terms.collect()} == vocabulary
    got = defaultdict(list)
    for r in found.orderBy("query", "rank").collect():
        got[r["query"]].append((r.id, r.similarity))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in near.items()}
    assert all(abs(a[1] - b[1]) < 1e-9 for q in got for a, b in zip(got[q], near[q], strict=True))
    lists = opened.selectExpr("sum(lists) as lists", "sum(opened) as opened").first()
    assert lists.opened < (1 if first == 1 else 1.01) * lists.lists


def test_near_copies_leave_most_lists_closed(spark, monkeypatch):
    monkeypatch.setattr(T, "FIRST_POSTINGS", 10)
    monkeypatch.setattr(T, "MORE", 2)
    rng = np.random.default_rng(2)
    bases = [[f"w{x}" for x in rng.choice(500, 60)] for _ in range(12)]
    texts = {6 * g + c: " ".join([*base, f"w{rng.integers(500)}"]) for g, base in enumerate(bases) for c in range(6)}
    _, near = brute(texts, 3, 10**6, lambda i: i % 4 == 0)
    _, found, opened = search(spark, texts, 3, 10**6)
    assert {(r["query"], r["rank"], r.id) for r in found.collect()} == {(q, k, i) for q, x in near.items() for k, (i, _) in enumerate(x, 1)}
    share = opened.selectExpr("sum(opened) / sum(lists)").first()[0]
    assert share < 0.5


def test_ids_number_the_terms(spark):
    import hashlib

    words = [f"t{k}" for k in range(1000)]
    got = {r.term: r.term_id for r in T.numbered(spark.createDataFrame([(w,) for w in words], "term string")).collect()}
    assert got == {w: k for k, w in enumerate(sorted(words, key=lambda w: (hashlib.md5(w.encode()).hexdigest(), w)))}


def test_dependence_counts_classes_without_the_term(spark):
    docs = spark.createDataFrame([(k, "xx yy" if k < 6 else "yy zz", "a" if k < 4 else "b" if k < 9 else None) for k in range(12)], "doc_id long, text string, label string")
    counts = T.term_counts(docs, "doc_id", "text", 1)
    got = {r.term: r.chi2 for r in T.dependence(counts, T.vocabulary(counts, 12, max_df=1.0), docs, "doc_id", "label").collect()}
    expected = {}
    for term, has in (("xx", range(6)), ("yy", range(9)), ("zz", range(6, 9))):
        n = len(has)
        expected[term] = sum((sum(k in c for k in has) - n * len(c) / 9) ** 2 / (n * len(c) / 9) for c in (range(4), range(4, 9)))
    assert got == pytest.approx(expected)


def test_nothing_asked_or_stored(spark, texts):
    for few in ({}, {1: None, 4: ""}, {1: "ab cd", 2: "ef"}):
        terms, found, opened = search(spark, few, 3, 10)
        assert terms.count() == found.count() == opened.count() == 0
