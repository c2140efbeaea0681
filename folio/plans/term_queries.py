"""Queries over sparse text vectors: vocabulary, dependence on a label, neighbours, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import terms as T
from folio.plans.text_queries import docs_of
from folio.scratch import written

QUERIES: dict = {}
ORACLES: dict = {}

_TERMS = r"""
WITH t AS MATERIALIZED (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
c AS MATERIALIZED (SELECT doc_id, any_value(lang) AS lang, term, count(*) AS tf FROM (SELECT doc_id, lang, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t) GROUP BY doc_id, term),
d AS (SELECT count(*) AS docs FROM documents),
v AS MATERIALIZED (SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM c GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT docs FROM d) ORDER BY n DESC, term LIMIT 50000)
"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _terms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, int]:
    """Documents, their 50,000 most frequent words and word pairs, and the number of documents."""
    docs = docs_of(spark, sf)
    n = docs.count()
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs, written(T.frequent_terms(docs, n, "doc_id", "text"), "vocabulary"), n
    return docs, written(T.vocabulary(T.term_counts(docs, "doc_id", "text"), n), "vocabulary"), n


@query(_TERMS + "SELECT term, df, n, row_number() OVER (ORDER BY md5(term), term) - 1 AS term_id FROM v")
def text_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return T.numbered(_terms(spark, sf)[1])


@query(_TERMS + """, k AS (SELECT lang, count(*) / sum(count(*)) OVER () AS share FROM documents WHERE lang IS NOT NULL GROUP BY lang),
o AS (SELECT term, lang, count(*) AS o FROM c JOIN v USING (term) WHERE lang IS NOT NULL GROUP BY term, lang),
n AS (SELECT term, sum(o) AS n FROM o GROUP BY term)
SELECT term, round(sum((coalesce(o, 0) - n * share) ** 2 / (n * share)), 6) AS chi2 FROM n CROSS JOIN k LEFT JOIN o USING (term, lang) GROUP BY term""")
def term_dependence(spark: SparkSession, sf: str) -> DataFrame:
    docs, terms, _ = _terms(spark, sf)
    counts = T.term_counts(docs, "doc_id", "text", also=("lang",))
    return T.dependence(counts, terms, docs, "doc_id", "lang").withColumn("chi2", F.round("chi2", 6))


@query(_TERMS + """, x AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + docs) / (1 + df)) + 1) AS w FROM c JOIN v USING (term), d),
u AS MATERIALIZED (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM x),
s AS (SELECT q.doc_id AS query_id, p.doc_id, sum(q.w * p.w) AS similarity FROM u q JOIN u p USING (term) WHERE q.doc_id % 20 = 0 AND p.doc_id <> q.doc_id GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, round(similarity, 6) AS similarity, rank::INTEGER AS rank FROM r WHERE rank <= 10""")
def text_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest documents of each whose id is divisible by 20, by cosine of sublinear weights."""
    docs, terms, n = _terms(spark, sf)
    kept = written(T.numbered(terms), "numbered")
    idf = np.zeros(kept.count())
    for r in kept.select("term_id", "df").collect():
        idf[r.term_id] = np.log((1.0 + n) / (1.0 + r.df)) + 1.0
    asks = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    found = T.row_neighbours(T.term_rows(docs, kept, "doc_id", "text", asks), 10, idf)
    return found.select(F.col("query").alias("query_id"), F.col("id").alias("doc_id"), F.round("similarity", 6).alias("similarity"), "rank")
