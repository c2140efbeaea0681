"""A training corpus from raw documents: five stages over all that the one before kept.

Each stage takes (spark, docs, sf_dir), ``docs`` with the columns of documents, and
returns a DataFrame; all but the last return those columns. ``run`` writes each
stage's rows to the shared folder and reads them back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import jaccard, mixing, packing, quality, secrets
from folio.llm.shared import materialize, read_table, scratch_path
from folio.session import ship

#: Share of its tokens that the mixing stage keeps.
MIX_BUDGET = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null, empty and blank texts have no words and go. Equal texts share their fate;
    repeated rows that stay, stay repeated. All columns stay as they are, whatever
    their names. An empty table stays one.
    """
    ship(spark)
    return quality.keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays.

    Rows that repeat id and text are one document; of rows with one id and different
    texts all stay if the id is its group's smallest. Null ids are in groups of others
    or stay as they are; null and empty texts are alone. All columns stay as they are.
    """
    ship(spark)
    groups = jaccard.jaccard_components(docs)
    stay = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("\0")), 256).alias("digest"))
    kept = rows.where("doc_id is not null").join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id", "digest"])
    return kept.select("doc.*").union(docs.where("doc_id is null"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are masked; n_chars follows the text.

    Overlapping findings are one mask. Null texts stay null, and n_chars of texts
    without findings stays as given. Rows are kept one for one, all other columns as
    they are, whatever their names.
    """
    ship(spark)
    rows = docs.select(F.struct("*").alias("doc"), F.col("text"))
    ledger = secrets.scan(rows, secrets.RULES, scratch_path(spark, "blob-ledger"))
    found = secrets.findings_of(rows, ledger, blob="blob", findings="findings")
    masked = found.withColumn("text", secrets.redact(F.col("text"), F.col("findings")))
    size = F.when(F.size("findings") > 0, F.length("text").cast("long")).otherwise(F.col("doc.n_chars"))
    own = {"text": F.col("text"), "n_chars": size}
    return masked.select(*(own.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target mix stay.

    Null languages and sources are values of their own; texts without words share the
    probability of their cell; null ids go; repeated ids share their fate. All columns
    stay as they are, whatever their names.
    """
    ship(spark)
    return mixing.sample(docs, budget=MIX_BUDGET)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, placed in sequences of 4096 tokens.

    Null and empty texts are one piece, their end id. Repeated ids stay separate pieces
    that the result can't tell apart. Columns other than id and text are ignored.
    """
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: SQL has neither expectation-maximisation nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
