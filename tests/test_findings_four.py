"""Cases of the fourth round of findings: each failed before its change."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import documents, layout, terms
from folio.plans import document_queries
from folio.scratch import written
from tests import test_terms


@pytest.fixture(scope="module")
def some():
    rng = np.random.default_rng(7)
    texts = {k: " ".join(f"w{min(x, 60)}" for x in rng.zipf(1.3, 20)) for k in range(240)} | {500: None, 501: "", 502: "zz"}
    return texts | {k: texts[4] for k in range(510, 525)} | {k: "été Straße été naïve_1 İx" for k in range(530, 536)}


def docs_of(spark, texts):
    return spark.createDataFrame([*texts.items(), (None, "w1 w2 w3")], "doc_id long, text string").repartition(3)


def shuffled(spark, before):
    """Rows that stages from ``before`` on have written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    nothing = spark._jvm.java.util.ArrayList()
    stages = sc.statusStore().stageList(nothing, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), nothing)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()) if stages.apply(k).stageId() >= before)


def test_vectors_are_not_shuffled_for_every_block_of_queries(spark, monkeypatch):
    monkeypatch.setattr(terms, "QUERY_ROWS", 2)
    monkeypatch.setattr(terms, "DOC_ROWS", 40)
    rows = [(d, int(t), 0.5) for d in range(400) for t in np.random.default_rng(d).choice(60, 4, replace=False)]
    vectors = written(spark.createDataFrame(rows, "id long, term_id long, w double"), "vectors")
    before = spark.sparkContext._jsc.sc().dagScheduler().nextStageId()
    found = terms.block_neighbours(vectors, spark.range(0, 400, 4), 3, "id").collect()
    assert len(found) == 300
    assert shuffled(spark, before) < 5 * 400


@pytest.mark.parametrize("most", [30, 300, 10**6])
def test_frequent_terms_are_the_vocabulary(spark, some, most):
    docs = docs_of(spark, some)
    counts = written(terms.term_counts(docs, "doc_id", "text", 3, test_terms.STOP), "counts")
    expected = {tuple(r) for r in terms.vocabulary(counts, len(some), most=most).collect()}
    found = terms.frequent_terms(docs, len(some), "doc_id", "text", 3, test_terms.STOP, most=most)
    rows = [tuple(r) for r in found.select("term", "df", "n").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected


def test_terms_frequent_in_no_bucket_of_their_own_are_counted_again(spark, monkeypatch):
    """Terms in nearly all documents fill the largest buckets and aren't chosen: the least number has to fall."""
    texts = {k: " ".join(f"often{x}" for x in range(50)) + f" rare{k % 90} rare{k % 90}" for k in range(180)}
    found = terms.frequent_terms(docs_of(spark, texts), 180, "doc_id", "text", 1, most=20)
    assert {tuple(r) for r in found.collect()} == {(f"rare{k}", 2, 4) for k in sorted(range(90), key=str)[:20]}


@pytest.mark.parametrize(("dense", "width", "products"), [(16, 1024, 1 << 21), (1, 3, 5), (10**6, 1024, 40)])
def test_blocks_are_multiplied_as_plain_vectors(monkeypatch, dense, width, products):
    for name, value in (("DENSE_PART", dense), ("DENSE_TERMS", width), ("PRODUCTS", products), ("SUM_ROWS", 7)):
        monkeypatch.setattr(terms, name, value)
    rng = np.random.default_rng(8)
    plain = rng.random((60, 45)) * (rng.random((60, 45)) < np.linspace(0.02, 0.9, 45))
    plain[[5, 31]] = 0

    def block(at):
        rows, own = np.nonzero(plain[at])
        return terms._Block(at, rows, own.astype(np.int32), plain[at][rows, own])

    docs, queries = np.arange(50), np.array([3, 59, 58, 7, 31, 49])
    expected = plain[docs] @ plain[queries].T
    expected[docs[:, None] == queries] = 0
    assert terms._Docs(block(docs)).products(block(queries)) == pytest.approx(expected)
    assert not terms._Docs(block(np.array([5]))).products(block(queries)).any()


def test_rows_find_the_neighbours_of_the_plain_version(spark, some, monkeypatch):
    monkeypatch.setattr(terms, "QUERY_ROWS", 9)
    monkeypatch.setattr(terms, "FILES_AT_ONCE", 2)
    docs, n = docs_of(spark, some), len(some)
    kept = written(terms.numbered(terms.frequent_terms(docs, n, "doc_id", "text", 3, test_terms.STOP)), "kept")
    idf = {r.term_id: np.log((1.0 + n) / (1.0 + r.df)) + 1.0 for r in kept.collect()}
    asks = F.coalesce(F.col("doc_id") % 4 == 0, F.lit(False))
    rows = terms.term_rows(docs, kept, "doc_id", "text", asks, test_terms.STOP)
    found = terms.row_neighbours(rows, 3, np.array([idf[k] for k in range(len(idf))])).collect()
    near = test_terms.brute(some, 3, 50_000, lambda i: i % 4 == 0)[1]
    assert {(r["query"], r["rank"], r.id) for r in found} == {(q, m, i) for q, x in near.items() for m, (i, _) in enumerate(x, 1)}
    assert {(r["query"], r["rank"]): r.similarity for r in found} == pytest.approx({(q, m): s for q, x in near.items() for m, (_, s) in enumerate(x, 1)})


def test_typeset_documents_are_made_in_one_pass(spark, capsys):
    document_queries.typeset_documents(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert "inline(" in plan and "size(CASE" not in plan  # no filter makes the sections once more


def test_outlines_count_sizes_as_the_plain_version(spark):
    rng = np.random.default_rng(9)
    texts = ["plain words run on", "Abstract: given", "  ", None, "Some Larger Line", "2. Methods", "RESULTS", "tail\t "]
    lines = [(int(d), int(rng.integers(0, 2)) if d % 5 else None, n, [9.0, 10.0, 11.0, 18.0, None][rng.integers(0, 5)], [True, False, None][rng.integers(0, 3)], texts[rng.integers(0, 8)]) for d in range(60) for n in range(rng.integers(1, 9))]
    lines += [(None, 0, 0, 10.0, False, "no key"), (None, 0, 1, 12.0, False, "No Key Either")]
    rows = spark.createDataFrame(lines, "k long, page int, line int, size double, bold boolean, text string")
    plain = {}
    for k in {x[0] for x in lines} - {None}:
        kept = [x[3] for x in lines if x[0] == k and x[3] is not None and (x[5] or "").strip(" \t\n\r")]
        if kept:
            n = Counter(kept)
            body = min(n, key=lambda s: (-n[s], s))
            plain[k] = (body, max(kept) if max(kept) > body * layout.TITLE_RATIO else None)
    outlines = {r.k: r for r in layout.outline(rows, "k").collect()}
    assert outlines.keys() == plain.keys()
    sized = layout.gathered(rows.where("size IS NOT NULL AND trim(replace(text, '\t', ' ')) <> '' AND k IS NOT NULL"), "k").select("k", layout.sizes(F.transform("lines", lambda x: x["size"])).alias("s"))
    assert {r.k: (r.s.body, r.s.title_size) for r in sized.collect()} == plain
    whole = {r.k: r for r in documents.from_lines(rows, "k").collect()}
    assert whole.keys() == {x[0] for x in lines} and whole[None].text == "no key\nNo Key Either" and whole[None].sections == []
    assert all(r.title is None or whole[k].title == r.title for k, r in outlines.items())


def test_section_names_open_words(spark):
    """Patterns are tried at first letters of words alone: no name may open elsewhere."""
    names = ["set up", "experimental setup", "our contributions", "intro", "outline", "data sets", "fine-tuning", "preset up", "mydata", "competing interests", "x results", "states of the art", "structure of the paper", "12 findings", "summary of contributions"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    plain = F.when(text.heading_key(F.col("n")) == "", "other")
    for section, pattern in text.SECTION_PATTERNS:
        plain = plain.when(text.heading_key(F.col("n")).rlike(pattern), section)
    for section, a, b in rows.select("n", text.normalise_heading(F.col("n")), plain.otherwise("other")).collect():
        assert a == b, section


def openings(pattern, most):
    """What strings that a parsed pattern matches open with, ``most`` characters at least if they have so many."""
    out = {""}
    for kind, value in pattern:
        kind, new = str(kind), {""}
        if kind == "LITERAL":
            new = {chr(value)}
        elif kind == "IN":
            new = {chr(v) for k, v in value if str(k) == "LITERAL"} | {" " for k, _ in value if str(k) == "CATEGORY"}
        elif kind == "ANY":
            new = {"."}
        elif kind == "SUBPATTERN":
            new = openings(value[-1], most)
        elif kind == "BRANCH":
            new = set().union(*(openings(x, most) for x in value[1]))
        elif kind == "MAX_REPEAT":
            new = openings(value[2], most) | ({""} if value[0] == 0 else set())
        else:
            assert kind in ("AT", "ASSERT_NOT"), kind
        out = {a if len(a) >= most else a + b for a in out for b in new}
    return out


def test_every_section_name_opens_as_listed():
    for section, pattern in text.SECTION_PATTERNS:
        for opening in openings(re._parser.parse(pattern), 4):
            assert any(opening.startswith(x) for x in text.SECTION_OPENINGS), (section, opening)


def test_tidy_keeps_single_spaces_and_joins_runs(spark):
    cases = {"a\tb": "a b", "a \t b  c d": "a b c d", "\t a": "a", "a\n\t\tb": "a\n b", " ": "", "": ""}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.tidy(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == cases
