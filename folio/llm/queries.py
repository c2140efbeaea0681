"""The registered queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import hashindex, jaccard, lexical, lmscore, mixing, neardup, packing, prefixtrie, quality, secrets, tokenfiles, toxicity, warc
from folio.llm.shared import materialize, read_table, scratch_path


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return mixed.select("doc_id", "n_tokens", "topic", F.round("factor", 6).alias("factor"), F.round("probability", 6).alias("probability"), "sampled")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments on one ledger: the base rules, then a rule added; the second scans for that one alone."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_path(spark, "blob-ledger")
    secrets.scan(docs, secrets.BASE_RULES, path)
    found = secrets.findings_of(docs, secrets.scan(docs, secrets.RULES, path))
    kinds = [r.kind for r in secrets.BASE_RULES]
    spans = F.col("findings")
    base = secrets.spans_of_kind(spans, *kinds)
    counts = [F.size(secrets.spans_of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(secrets.digest(base), 256).alias("base_sha256"), secrets.digest(spans).alias("spans"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return tokenfiles.encode_corpus(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(read_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lmscore.score(read_table(spark, sf_dir, "documents"))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens"))
    return scored.select("doc_id", "n_tokens", "n_backoff", F.round("log_score", 4).alias("log_score"), F.round(mean, 6).alias("mean_log_score"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return hashindex.nearest(vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(read_table(spark, sf_dir, "documents"))
    return lexical.search(index, read_table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialize(prefixtrie.turns_of(read_table(spark, sf_dir, "conversations")), "turns")
    return prefixtrie.trie(prefixtrie.rebuilt(turns))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_secret_scans": op3_secret_scans,
    "op4_token_files": op4_token_files,
    "op5_warc": op5_warc,
    "op6_quality_rules": op6_quality_rules,
    "op7_toxicity": op7_toxicity,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_lexical_search": op12_lexical_search,
    "op13_prefix_trie": op13_prefix_trie,
}
