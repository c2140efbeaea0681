"""Queries over whole tables: differences of versions, observed runs, stored datasets, exports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions import vectors as V
from folio.operators import observed, snapshots
from folio.plans.text_queries import docs_of
from folio.scratch import scratch_path, written
from folio.sources import datasets

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("""
WITH b AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0),
a AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 17 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 19 = 0 THEN 'none' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 13 <> 0),
j AS (SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN a.o_orderkey IS NULL OR b.o_orderkey IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN a.o_custkey IS DISTINCT FROM b.o_custkey THEN 'o_custkey' END, CASE WHEN a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'o_orderpriority' END,
    CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'o_totalprice' END], lambda x: x IS NOT NULL), ',') END AS columns
  FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey)
SELECT * FROM j WHERE change <> 'changed' OR columns <> ''""")
def order_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of the orders: rows missing from either, prices, priorities and states that changed."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    key = F.col("o_orderkey")
    after = orders.where(key % 13 != 0).withColumns({
        "o_orderstatus": F.when(key % 23 != 0, F.col("o_orderstatus")), "o_orderpriority": F.when(key % 19 == 0, "none").otherwise(F.col("o_orderpriority")),
        "o_totalprice": F.when(key % 17 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
    })
    return snapshots.difference(orders.where(key % 11 != 0), after, ["o_orderkey"]).withColumn("columns", F.array_join("columns", ","))


@query(r"""
WITH a AS (SELECT doc_id, text, len(regexp_extract_all(text, '\S+')) AS w FROM documents WHERE text <> ''),
b AS (SELECT text, any_value(w) AS w FROM a GROUP BY text),
c AS (SELECT * FROM b WHERE w >= 20)
SELECT 0 AS place, 'with text' AS stage, NULL::BIGINT AS rows_in, count(*) AS rows FROM a
UNION ALL SELECT 1, 'distinct', (SELECT count(*) FROM a), count(*) FROM b
UNION ALL SELECT 2, 'twenty words', (SELECT count(*) FROM b), count(*) FROM c""")
def observed_stages(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in and out of three stages, counted while they are written; seconds differ from run to run and are left out."""
    stages = [
        ("with text", lambda d: d.where("text <> ''")),
        ("distinct", lambda d: d.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min_by("text", "doc_id").alias("text"))),
        ("twenty words", lambda d: d.where(T.word_count(F.col("text")) >= 20)),
    ]
    _, report = observed.run_observed(docs_of(spark, sf).select("doc_id", "text"), stages, written)
    return observed.report_table(spark, report).select("place", "stage", "rows_in", "rows")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6) AS norm FROM embeddings")
def stored_norms(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths of vectors from a stored dataset, which is checked against the ids asked for."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    stored = datasets.cached_dataset(spark, scratch_path(spark, "datasets"), "vectors", "vec_id", lambda: vectors, vectors.select("vec_id"))
    return stored.select("vec_id", F.round(F.sqrt(V.dot(F.col("embedding").cast("array<double>"), F.col("embedding").cast("array<double>"))), 6).alias("norm"))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def exported_orders(spark: SparkSession, sf: str) -> DataFrame:
    """All orders, written in shards as JSON lines and read back by their commit records."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_totalprice")
    folder = scratch_path(spark, "export")
    datasets.export_shards(orders, folder, "o_orderkey", shards=16)
    return datasets.import_shards(spark, folder)
