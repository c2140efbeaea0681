"""Awkward rows: repeated ids, labels that disagree, columns of any name; and what is compared."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm import jaccard, mixing, neardup, packing, quality, secrets, tokenfiles, toxicity, warc
from folio.llm.queries import op9_lm_scoring
from folio.llm.shared import materialize, scratch_path
from tests.llm import brute
from tests.llm.cases import SCHEMA, awkward
from tests.llm.test_scale_operators import brute_jaccard, brute_near, brute_scores
from tests.llm.test_text_operators import check_packing

CLASHES = {"topic": "'mine'", "sampled": "'mine'", "n_tokens": "-1", "factor": "-2.0", "probability": "'p'", "findings": "'mine'", "_text": "'mine'", "kept": "false", "doc": "'mine'", "firsts": "1", "digest": "'mine'", "_count_n_words": "7", "lists": "0", "tie": "1"}


@pytest.fixture(scope="module")
def clashing(spark):
    odd = spark.createDataFrame(awkward(), SCHEMA)
    return materialize(odd.select("*", *(F.expr(v).alias(k) for k, v in CLASHES.items())), "clashing")


def test_stages_keep_columns_of_any_name(spark, sf, clashing):
    before = {r.doc_id: r.asDict() for r in clashing.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (clashing, clashing.limit(0)):
            out = stage(spark, docs, sf)
            assert out.columns == clashing.columns and out.schema.simpleString() == clashing.schema.simpleString()
            for r in out.collect():
                now, was = r.asDict(), before[r.doc_id]
                assert {k: v for k, v in now.items() if k not in ("text", "n_chars")} == {k: v for k, v in was.items() if k not in ("text", "n_chars")}
    assert corpus_pipeline.best_fit_packing(spark, clashing, sf).count() >= len(before)


def test_operators_take_columns_of_any_name(spark, clashing):
    n = clashing.count()
    out = mixing.mix(clashing)
    assert out.columns[: len(clashing.columns)] == clashing.columns and out.count() == n
    assert {"topic_", "sampled_", "n_tokens_", "factor_", "probability_"} <= set(out.columns) and {r.topic for r in out.collect()} == {"mine"}
    found = secrets.findings_of(clashing, secrets.scan_unseen(clashing, secrets.RULES))
    assert found.count() == n and "findings_" in found.columns and "blob_" in found.columns
    for got in (quality.quality(clashing), jaccard.jaccard_components(clashing), packing.pack_documents(clashing.where("length(text) < 10000 or text is null"), _word_bpe(), 1)):
        assert got.count() > 0


def _word_bpe():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_run_against_brute_force(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf.replace('0.01', '0.001')}/documents.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    rows = [r for r, (_, kept) in zip(rows, brute.quality([r[1] for r in rows]), strict=True) if kept]
    first = {d for d, _, c in brute_jaccard([(r[0], r[1]) for r in rows]) if d == c}
    rows = [(r[0], brute.masked(r[1]), *r[2:]) for r in rows if r[0] in first]
    rows = [r for r, s in zip(rows, brute.mixed(rows, corpus_pipeline.MIX_BUDGET), strict=True) if s]
    used, bound = check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), [(r[0], r[1]) for r in rows], 4096)
    assert used <= bound + 1


def test_quality_verdict_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(400).union(spark.createDataFrame(awkward(), SCHEMA).selectExpr("doc_id + 1000000", "text"))
    docs = materialize(docs, "some")
    rows = docs.collect()
    got = {(r.doc_id, r.n_words): (r.p_good, r.kept) for r in quality.quality(docs).collect()}
    for r, (p, kept) in zip(rows, brute.quality([r.text for r in rows]), strict=True):
        q, k = got[r.doc_id, len(brute.WORD.findall(r.text or ""))]
        assert abs(p - q) < 1e-6 and k == kept


def test_toxicity_matches_brute_force(spark):
    """Features gram by gram and dense gradient steps give the same scores."""
    rng = np.random.default_rng(4)
    words, bad = [f"w{k}ord" for k in range(40)], ["idiotic", "stüpid", "hateful"]
    rows = [(k, " ".join([*rng.choice(words, 12), *(rng.choice(bad, 2) if k % 3 == 0 else [])]), int(k % 3 == 0)) for k in range(150)]
    docs = materialize(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), "docs")
    labels = materialize(spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), "labels")
    got = {r.doc_id: (r.held_out, r.score) for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}

    import zlib

    mask = (1 << 64) - 1

    def mix(h):
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & mask
        return h ^ (h >> 31)

    def grams(text):
        out = set()
        for w in set(text.lower().split()):
            row = [1, *(int.from_bytes(c.encode(), "big") for c in w), 1]
            for n in toxicity.GRAMS:
                for k in range(len(row) - n + 1):
                    out.add(mix((sum(x * int(f) for x, f in zip(row[k : k + n], toxicity._FACTORS)) + n) & mask) % toxicity.BUCKETS)
        return out

    held = {k: zlib.crc32(str(k).encode()) % 5 == 0 for k, _, _ in rows}
    fit = [(grams(t), y) for k, t, y in rows if not held[k]]
    names = sorted(set().union(*(g for g, _ in fit)))
    x = np.array([[f in g for f in names] for g, _ in fit], float)
    y = np.array([v for _, v in fit], float)
    n1, n0 = y.sum(), len(y) - y.sum()
    ratio = np.log((x[y == 1].sum(0) + 1) / (n1 + 2)) - np.log((x[y == 0].sum(0) + 1) / (n0 + 2))
    ratio[(x.sum(0) < toxicity.LEAST_TEXTS) | (np.abs(ratio) <= 0.25)] *= np.where(x.sum(0) < toxicity.LEAST_TEXTS, 0, 1)[(x.sum(0) < toxicity.LEAST_TEXTS) | (np.abs(ratio) <= 0.25)]
    z = np.where(np.abs(ratio) > 0.25, x * ratio, 0)
    w, b, balance = np.zeros(len(names)), 0.0, np.where(y == 1, 0.5 / n1, 0.5 / n0)
    m, v, mb, vb = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    for t in range(1, toxicity.ROUNDS + 1):
        e = (1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) - y) * balance
        g = z.T @ e + 2e-5 * w
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * e.sum(), 0.99 * vb + 0.01 * e.sum() ** 2
        rate = 0.05 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w, b = w - rate * m / (np.sqrt(v) + 1e-7), b - rate * mb / (np.sqrt(vb) + 1e-7)
    weight = dict(zip(names, w * ratio, strict=True))
    for k, text, _ in rows:
        score = 1 / (1 + np.exp(-(sum(weight.get(f, 0.0) for f in grams(text)) + b)))
        assert got[k][0] == held[k] and abs(got[k][1] - score) < 1e-3


def test_toxicity_ids_and_labels(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 0), (None, 1), (3, 0)], "doc_id long, toxic int")
    got = {(r.doc_id, r.toxic) for r in toxicity.settled(labels).collect()}
    assert got <= {(2, 1), (3, 0)}
    docs = spark.createDataFrame([(None, "x"), (2, "x"), (2, "y"), (3, None)], "doc_id long, text string")
    assert spark.createDataFrame([(None,)], "doc_id long").select(toxicity.held_out()).first()[0] is True
    assert toxicity.training_sample(docs, labels).count() == len(got)


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (4, [0.0, 1.0], 0), (4, [0.0, 1.0], 0), (None, [1.0, 0.02], 0), (5, [-1.0, 0.0], 0), (6, [1.0, 0.0], 1)]
    known = [r for r in rows if r[0] is not None]
    df = spark.createDataFrame(known, "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in neardup.near_duplicates(df).collect()) == brute_near(known, 0.93)
    assert neardup.near_duplicates(spark.createDataFrame(rows, df.schema)).count() == len(rows)


def test_far_cells_never_meet(spark):
    """Two far groups of one label share no tile pair, and results are those of all pairs."""
    rng = np.random.default_rng(2)
    axis = lambda k: np.eye(8)[k] + rng.normal(0, 0.05, 8)
    rows = [(k, [float(x) for x in axis(0 if k < 60 else 5)], 0) for k in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in neardup.near_duplicates(df, tile_rows=16).collect()) == brute_near(rows, 0.93)
    reps = df.withColumn("dim", F.size("embedding"))
    placed = neardup.with_cells(reps, neardup.principal_axes(reps), 0.93)
    cells = {r.vec_id: tuple(r.cell) for r in placed.collect()}
    met = {tuple(sorted([tuple(r.one.cell), tuple(r.two.cell)])) for r in neardup.tile_pairs(placed, 16).collect()}
    apart = [(a, b) for a in range(60) for b in range(60, 120)]
    assert all(tuple(sorted([cells[a], cells[b]])) not in met for a, b in apart)


def test_only_sets_that_share_a_signature_are_compared(spark, monkeypatch):
    """Texts of a few passages out of a pool: comparisons grow with shared signatures, not with all pairs."""
    monkeypatch.setattr(jaccard, "TILE_SETS", 8)
    rng = np.random.default_rng(7)
    share = {}
    for n in (200, 400):
        lists = [[int(x) for x in rng.choice(n // 4, 3, replace=False)] for _ in range(n)]
        sigs = [(s, k, k) for k, own in enumerate(lists) for s in own]
        met = jaccard.meetings(spark.createDataFrame(sigs, "sig long, set_id long, component long")).collect()
        groups = {}
        for r in met:
            for s in r.lists:
                groups.setdefault((r.group, r.one, r.two, s), []).append((r.set_id, r.tile))
        compared = Counter()
        for (_, one, two, _), own in groups.items():
            compared.update({tuple(sorted((a, b))) for a, s in own for b, t in own if s == one and t == two and a != b})
        wanted = {tuple(sorted(p)) for s in range(n // 4) for p in combinations([k for k, own in enumerate(lists) if s in own], 2)}
        assert set(compared) == wanted
        share[n] = sum(compared.values()) / len(wanted)
        assert sum(compared.values()) < n * (n - 1) / 6
    assert share[400] < 2 * share[200]


def test_one_response_among_equal_rows(spark):
    page = "<p>" + "x" * 200 + "</p>"
    rows = [(7, "u", page)] * 3 + [(9, "u", page), (7, "v", page), (1, "w", "short"), (1, "w", "short"), (None, None, None)]
    got = warc.archive(materialize(spark.createDataFrame(rows, "page_id long, url string, html string"), "pages")).collect()
    long = [r for r in got if r.payload_bytes > 100]
    assert Counter(r.record_type for r in long) == {"response": 1, "revisit": 4}
    assert {r.refers_to for r in long if r.record_type == "revisit"} == {7}
    assert [r.page_id for r in long if r.record_type == "response"] == [7]
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 100) and len(got) == len(rows)


def test_equal_rows_spread_over_groups(spark):
    rows = materialize(spark.range(2000).repartition(4).selectExpr("1L AS doc_id", "'a b c' AS text"), "equal")
    packed = packing.pack_documents(rows, _word_bpe(), 1, group_pieces=100)
    sizes = packed.groupBy(F.shiftright("sequence_id", 32)).count().collect()
    assert len(sizes) > 15 and max(r["count"] for r in sizes) < 200


def test_token_files_of_repeated_and_null_ids(spark):
    import public_tokenizers

    rows = [(5, "a b"), (None, "c"), (5, "d e f"), (1, ""), (None, None), (5, "a b")] * 20
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
    got = tokenfiles.encode_corpus(docs, public_tokenizers.path("byte_bpe_50k.json"), 0).collect()
    got.sort(key=lambda r: r.start)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)


def test_a_ledger_is_read_first_and_appended_to(spark):
    path = scratch_path(spark, "ledger")
    texts = [(1, "password=abcdef1"), (2, "x"), (3, "password=abcdef1"), (4, None)]
    versions = spark.createDataFrame(texts, "doc_id long, text string")
    scanned = lambda df: sum(len(r.scanned) for r in df.collect())
    first = secrets.scan(versions, secrets.BASE_RULES, path)
    assert scanned(first) == 3 * len(secrets.BASE_RULES)  # equal texts and null are one blob each
    assert scanned(secrets.scan(versions, secrets.BASE_RULES, path)) == scanned(first)  # nothing new
    later = versions.union(spark.createDataFrame([(5, "AKIA" + "A" * 16)], versions.schema))
    grown = secrets.scan(later, secrets.RULES, path)
    assert scanned(grown) == 4 * len(secrets.RULES)  # three blobs under the added rule, one under all
    found = {r.doc_id: [x.kind for x in r.findings] for r in secrets.findings_of(later, grown).collect()}
    assert found == {1: ["assign"], 2: [], 3: ["assign"], 4: [], 5: ["access"]}


def test_lm_scoring_counts_contexts_of_two_words(spark, tmp_path):
    texts = ["a b c d", "x b c d", "a b e", "b c d a b c", "a", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.n_tokens, r.n_backoff, r.log_score) for r in op9_lm_scoring(spark, str(tmp_path)).collect()), key=str)
    for a, b in zip(got, brute_scores(list(enumerate(texts)), 3), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-3




def test_vectors_of_extreme_size_link(spark):
    rows = [(k, [s * x for x in v], 0) for k, (s, v) in enumerate([(1e200, [1.0, 0.0]), (1e-200, [0.93, 0.367559518]), (1.0, [0.0, -1.0])])]
    out = {r.vec_id: (r.n_links, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert out == {0: (1, 0), 1: (1, 0), 2: (0, 2)}


def test_ids_are_those_of_the_plain_library_call():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from folio.llm.tokenizing import PieceEncoder

    rng = np.random.default_rng(9)
    parts = ["<|endoftext|>", "<|startoftext|>", " ", "\n", "word", "é", "\u00a0", "12", "<|", "|>", "日本", "'s", ".", "  "]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(2000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        ids, of = PieceEncoder(path).encode(pa.array(texts))
        plain = Tokenizer.from_file(path)
        assert [ids[a:b].tolist() for a, b in zip(of[:-1], of[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
