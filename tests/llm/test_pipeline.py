"""The pipeline against a brute-force version of its stages, and on awkward rows."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from folio.llm import mixing, quality, secrets
from tests.llm.cases import SCHEMA, awkward
from tests.llm.test_scale_operators import brute_jaccard
from tests.llm.test_text_operators import check_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What each stage returned, written as the contract has it."""
    from folio.llm.shared import materialize

    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), name.replace(" ", "-"))
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stage_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "best-fit packing"]
    assert all(s.columns == COLUMNS for s in stages[:-1])


def test_quality_stage(spark, sf, stages):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    assert set(rows(stages[0])) == kept and stages[0].count() == len(kept)
    assert rows(stages[0]) == {k: r for k, r in rows(docs).items() if k in kept}


def test_duplicate_stage(stages):
    before = [(r.doc_id, r.text) for r in stages[0].collect()]
    assert set(rows(stages[1])) == {d for d, _, c in brute_jaccard(before) if d == c}


def test_secret_stage(stages):
    before, after = rows(stages[1]), rows(stages[2])
    assert set(before) == set(after)
    changed = [k for k in before if before[k].text != after[k].text]
    assert changed and all("[SECRET]" in after[k].text and after[k].n_chars == len(after[k].text) for k in changed)
    left = secrets.findings_of(stages[2], secrets.scan_unseen(stages[2], secrets.RULES)).where("size(findings) > 0")
    assert left.count() == 0


def test_mixing_stage(stages):
    mixed = rows(mixing.mix(stages[2], budget=corpus_pipeline.MIX_BUDGET))
    u = lambda k: int(hashlib.md5(f"mix:{k}".encode()).hexdigest()[:12], 16) / 2**48
    assert set(rows(stages[3])) == {k for k, r in mixed.items() if u(k) < r.probability}


def test_packing_stage(stages):
    used, bound = check_packing(stages[4].collect(), [(r.doc_id, r.text) for r in stages[3].collect()], 4096)
    assert used <= bound + 1


def test_stages_on_awkward_rows(spark, sf):
    odd = spark.createDataFrame(awkward(), SCHEMA).select(*COLUMNS)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() <= 10 * max(docs.count(), 1)
    assert Counter(r.doc_id for r in corpus_pipeline.best_fit_packing(spark, odd, sf).collect())[0] == 1
