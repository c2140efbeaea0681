"""Ranked lexical search against a plain version, on awkward rows and at small segments."""

import math
import re
from collections import Counter

import pytest

from folio.llm import lexical
from tests.llm.cases import SCHEMA, awkward, lower

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k):
    """docs: (id, text) rows; items: texts by id."""
    terms = [(x, Counter(TERM.findall(lower(t or "")))) for x, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, texts in items.items():
        found = []
        for x, own in terms:
            m = 10 + (90 * sum(own.values()) * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * own[t]) // (1000 * own[t] + 8 * m)) for t in {t for text in texts for t in TERM.findall(lower(text or ""))} if own[t])
            if score > 0:
                found.append((-score, x is None, x or 0))
        out += [(item, r, None if null else x, -s) for r, (s, null, x) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["item_id"], r["rank"], r.doc_id, r.score) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture
def cases(spark):
    same = [(1000 + k, "a very common passage of many documents " + "x" * (k % 3), None, None, None, None, None, None, None) for k in range(300)]
    rows = [*awkward(), *same, (None, "the quick brown fox", None, None, None, None, None, None, None), (6, "the quick brown fox again", None, None, None, None, None, None, None)]
    items = [(1, "Quick, BROWN fox!"), (2, None), (3, ""), (4, "é ü zzz"), (5, "common passage"), (5, "fox"), (6, "nowheretobefound"), (None, "fox"), (7, "w1x1 w2x2 word dog dog dog"), (7, "w1x1 w2x2 word dog dog dog"), (8, "日本 é")]
    return rows, items, spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, terms int")


def by_item(items):
    out = {}
    for item, text in items:
        if item is not None:
            out.setdefault(item, []).append(text)
    return out


@pytest.mark.parametrize("size", [(8 << 20, 1 << 16, 1024), (200, 4, 2), (1, 2, 1)])
def test_ranks_as_the_plain_version(spark, cases, monkeypatch, size):
    rows, items, docs, asked = cases
    for name, value in zip(("SEGMENT_BYTES", "SEGMENT_DOCS", "BLOCK_ITEMS"), size, strict=True):
        monkeypatch.setattr(lexical, name, value)
    index = lexical.build_index(docs)
    assert index.segments.count() > (1 if size[1] < 10 else 0)
    for k in (1, 10):
        assert got(lexical.search(index, asked, k)) == brute([(r[0], r[1]) for r in rows], by_item(items), k)


def test_bounds_hold_and_most_documents_are_not_rescored(spark, sf, monkeypatch):
    """Every upper bound is above the exact score; few documents reach the k-th lower bound."""
    import numpy as np

    rng = np.random.default_rng(3)
    tf, n = rng.integers(1, 50, 5000), rng.integers(1, 10**6, 5000)
    part = lexical._parts(tf, lexical._medians(n, 1000, 10**7))
    byte = -(-part // lexical.STEP)
    assert byte.max() <= 255 and (byte * lexical.STEP >= part).all() and ((byte - 1) * lexical.STEP < part).all()

    index = lexical.build_index(spark.read.parquet(f"{sf}/documents.parquet"))
    row = index.segments.first().asDict()
    items = next(lexical._blocks(lexical.item_terms(spark.read.parquet(f"{sf}/benchmark.parquet"))))
    weights, rescored = lexical._weights(index, items.terms), []
    add = lexical._Best.add
    monkeypatch.setattr(lexical._Best, "add", lambda self, item, scores, ids: (rescored.append(len(ids)), add(self, item, scores, ids))[1])
    lexical._search_segment(row, items, weights, (index.n_docs, index.n_terms), lexical._Best(len(items.ids), 10))
    assert sum(rescored) < 0.1 * index.n_docs * len(items.ids)


def test_empty_tables(spark, cases):
    _, _, docs, asked = cases
    assert lexical.search(lexical.build_index(docs.limit(0)), asked).count() == 0
    assert lexical.search(lexical.build_index(docs), asked.limit(0)).count() == 0
    assert lexical.search(lexical.build_index(docs.where("text = ''")), asked).count() == 0
