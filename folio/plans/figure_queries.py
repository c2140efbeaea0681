"""Queries of the gold reports and of the tables behind figures, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import figures, gold, labelling
from folio.plans import model_queries as M

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


# --- gold labels: two annotators give orders their priority, now and then another or none ---

TRAINED = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
_GOLD = f"""WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN '{gold.UNSURE}' WHEN o_orderkey % 17 = 0 THEN '{gold.NOT_APPLICABLE}' WHEN o_orderkey % 19 = 0 THEN '' WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderpriority END AS label FROM orders),
g AS (SELECT k, label AS gold FROM a WHERE label IS NOT NULL AND label NOT IN ('{gold.UNSURE}', '{gold.NOT_APPLICABLE}', '')),
p AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 4 = 0 THEN '2-HIGH' WHEN o_custkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS predicted, CASE WHEN o_custkey % 3 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS weak FROM orders WHERE o_orderstatus <> 'P'),
t AS (SELECT gold, predicted, weak FROM g JOIN p USING (k) WHERE gold IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))"""


def _annotated(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    label = F.when(k % 13 == 0, gold.UNSURE).when(k % 17 == 0, gold.NOT_APPLICABLE).when(k % 19 == 0, "").when(k % 23 == 0, None).otherwise(F.col("o_orderpriority"))
    return spark.read.parquet(f"{sf}/orders.parquet").select(k.alias("k"), label.alias("label"))


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("o_custkey")
    known = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.when(c % 4 == 0, "2-HIGH").when(c % 7 == 0, None).otherwise(F.col("o_orderpriority")).alias("predicted"), F.when(c % 3 == 0, "1-URGENT").otherwise(F.col("o_orderpriority")).alias("weak"))
    return gold.cells(_annotated(spark, sf), known, "k", "label", "predicted", "weak")


@query(_GOLD + f" SELECT count(*) AS shown, (SELECT count(*) FROM g) AS usable, count(*) FILTER (label = '{gold.UNSURE}') AS unsure, count(*) FILTER (label = '{gold.NOT_APPLICABLE}') AS not_applicable FROM a")
def gold_answers(spark: SparkSession, sf: str) -> DataFrame:
    return gold.answers(_annotated(spark, sf), "label")


@query(_GOLD + ", f AS (SELECT d, coalesce(2 * (SELECT count(*) FROM t WHERE gold = d AND predicted = d) / nullif((SELECT count(*) FROM t WHERE gold = d) + (SELECT count(*) FROM t WHERE predicted = d), 0), 0) AS f1 FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM')) v(d)) SELECT count(*) AS n, round(avg(coalesce(gold = predicted, false)::INT), 6) AS accuracy, round((SELECT avg(f1) FROM f), 6) AS macro_f1 FROM t")
def gold_model_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gold.model_report(_cells(spark, sf), TRAINED), "accuracy", "macro_f1")


@query(_GOLD + " SELECT gold, count(*) AS n, round(avg(coalesce(gold = predicted, false)::INT), 6) AS recall FROM t GROUP BY gold")
def gold_design_recall(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gold.design_recall(_cells(spark, sf), TRAINED), "recall")


@query(_GOLD + " SELECT count(*) AS n, round(avg((gold = weak)::INT), 6) AS accuracy FROM t WHERE weak IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def gold_weak_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gold.weak_report(_cells(spark, sf), TRAINED), "accuracy")


@query(_GOLD + ", c AS (SELECT gold, predicted, count(*) AS n FROM g LEFT JOIN p USING (k) WHERE gold NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY gold, predicted), r AS (SELECT *, row_number() OVER (PARTITION BY gold ORDER BY predicted IS NULL, n DESC, predicted) AS i FROM c) SELECT gold, CAST(sum(n) AS BIGINT) AS n, coalesce(string_agg(predicted || ':' || n, ' ' ORDER BY i) FILTER (i <= 2 AND predicted IS NOT NULL), '') AS top FROM r GROUP BY gold")
def gold_rare_designs(spark: SparkSession, sf: str) -> DataFrame:
    return gold.rare_designs(_cells(spark, sf), TRAINED).withColumn("top", F.array_join("top", " "))


@query(_GOLD + ", b AS (SELECT gold AS x, weak AS y FROM g JOIN p USING (k)), n AS (SELECT count(*) AS n, avg((x = y)::INT) AS po FROM b), e AS (SELECT sum(l.c * r.c) AS pe FROM (SELECT x, count(*) AS c FROM b GROUP BY x) l JOIN (SELECT y, count(*) AS c FROM b GROUP BY y) r ON x = y) SELECT n, round(po, 6) AS agreement, round((po - pe / (n * n)) / (1 - pe / (n * n)), 6) AS kappa FROM n, e")
def annotator_kappa(spark: SparkSession, sf: str) -> DataFrame:
    second = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_custkey") % 3 == 0, "1-URGENT").otherwise(F.col("o_orderpriority")).alias("label"))
    return rounded(gold.annotator_kappa(_annotated(spark, sf), second, "k", "label"), "agreement", "kappa")


# --- figures ---


@query(M._P + """, g AS (SELECT * FROM (VALUES ('0', 6), ('1', 3)) x(panel, m)), grid AS (SELECT panel, CAST(a AS INT) AS truth, CAST(b AS INT) AS predicted FROM g, range(6) s(a), range(6) t(b) WHERE a < m AND b < m),
n AS (SELECT (vec_id % 2)::VARCHAR AS panel, truth, predicted, count(*) AS n FROM v GROUP BY ALL), f AS (SELECT grid.*, coalesce(n, 0) AS n FROM grid LEFT JOIN n USING (panel, truth, predicted))
SELECT panel, truth, predicted, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY panel, truth), 0), 0), 6) AS share FROM f""")
def figure_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Two panels, the second of three labels only."""
    d = M.scored(spark, sf).withColumn("panel", F.col("vec_id") % 2)
    return rounded(figures.confusion_grid(d, "panel", "truth", "predicted", {"0": list(range(6)), "1": [0, 1, 2]}), "share")


@query(M._P + """, b AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'test' ELSE 'later' END AS series, CAST(ceil(confidence * 15) AS INT) AS bin, count(*) AS n, avg(confidence) AS c, avg(correct::INT) AS a FROM v GROUP BY 1, 2), z AS (SELECT *, sum(n * abs(a - c)) OVER w / sum(n) OVER w AS ece FROM b WINDOW w AS (PARTITION BY series))
SELECT series, bin, n, round(c, 6) AS confidence, round(a, 6) AS accuracy, round(ece, 6) AS ece FROM z WHERE n >= 30""")
def figure_reliability(spark: SparkSession, sf: str) -> DataFrame:
    d = M.scored(spark, sf).withColumn("series", F.when(F.col("vec_id") % 2 == 0, "test").otherwise("later"))
    return rounded(figures.reliability_curves(d, "series", "confidence", "correct"), "confidence", "accuracy", "ece")


@query("""WITH r AS (SELECT p_brand AS model, CASE WHEN p_size % 2 = 0 THEN 'test' ELSE 'later' END AS split, max(p_size) / 50.0::DOUBLE AS score FROM part WHERE p_brand <> 'Brand#11' OR p_size % 2 = 0 GROUP BY 1, 2),
m AS (SELECT model, max(score) FILTER (split = 'test') AS first, max(score) FILTER (split = 'later') AS second FROM r GROUP BY model)
SELECT model, first, second, CAST(row_number() OVER (ORDER BY first, model) AS INT) AS place FROM m WHERE first IS NOT NULL AND second IS NOT NULL""")
def figure_scores(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet").where("p_brand <> 'Brand#11' or p_size % 2 = 0")
    results = p.groupBy("p_brand", F.when(F.col("p_size") % 2 == 0, "test").otherwise("later").alias("split")).agg((F.max("p_size") / 50.0).alias("score"))
    return figures.score_bars(results, "p_brand", "split", "score", "test", "later")


@query("""WITH o AS (SELECT o_orderpriority AS b, CASE WHEN o_custkey % 5 = 0 THEN 'none' WHEN o_custkey % 3 = 0 THEN '5-LOW' ELSE o_orderpriority END AS a, o_orderkey % 6 = 0 AS u FROM orders), n AS (SELECT count(*) AS n FROM o)
SELECT b AS label, round(count(*) / any_value(n), 6) AS before, round((SELECT count(*) FROM o x WHERE x.a = o.b) / any_value(n), 6) AS after, round(count(*) FILTER (u) / any_value(n), 6) AS unsupported FROM o, n GROUP BY b""")
def figure_shares(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("o_custkey")
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderpriority").alias("b"), F.when(c % 5 == 0, "none").when(c % 3 == 0, "5-LOW").otherwise(F.col("o_orderpriority")).alias("a"), (F.col("o_orderkey") % 6 == 0).alias("u"))
    return rounded(figures.share_bars(o, "label", "b", "a", "u"), "before", "after", "unsupported")


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'val' ELSE 'test' END AS split, CASE WHEN o_orderkey % 9 = 0 THEN [] ELSE [o_orderpriority, o_orderstatus] END AS seen, CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority END AS guess FROM orders), j AS (SELECT * FROM o WHERE len(seen) > 0),
h AS (SELECT split, x, count(*) AS c FROM (SELECT split, unnest(seen) AS x FROM j) GROUP BY split, x), n AS (SELECT split, count(*) AS n, avg(list_contains(seen, '1-URGENT')::INT) AS a, avg(coalesce(list_contains(seen, guess), false)::INT) AS b FROM j GROUP BY split)
SELECT split, 'default' AS answer, n, round(a, 6) AS agreement FROM n UNION ALL SELECT split, 'guess', n, round(b, 6) FROM n UNION ALL SELECT split, 'commonest', n, round((SELECT max(c) FROM h WHERE h.split = n.split) / n, 6) FROM n""")
def figure_agreement(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.when(k % 2 == 0, "val").otherwise("test").alias("split"), F.when(k % 9 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderpriority", "o_orderstatus")).alias("seen"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).alias("guess"))
    return rounded(figures.agreement_bars(o, "split", "seen", {"default": F.lit("1-URGENT"), "guess": F.col("guess")}, "commonest"), "agreement")


# --- lookups ---

_DESIGNS = [*labelling.STANCES, "Unknown"]


@query("WITH s(design, worldview, method) AS (VALUES " + ", ".join(f"('{d}', '{w}', '{m}')" for d, (w, m) in labelling.STANCES.items()) + "), d AS (SELECT p_partkey, [" + ", ".join(f"'{d}'" for d in _DESIGNS) + f"][p_size % {len(_DESIGNS)} + 1] AS design, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE '  ' || p_brand || ' ' END AS area FROM part) SELECT p_partkey, coalesce(worldview, 'positivist') AS worldview, coalesce(method, 'quantitative') AS method, CASE trim(area) WHEN 'Brand#11' THEN 'CS' WHEN 'Brand#12' THEN 'IS' END AS mapped FROM d LEFT JOIN s USING (design)")
def design_stances(spark: SparkSession, sf: str) -> DataFrame:
    """Worldview and method of designs, and the label of an area, by lookup."""
    design = F.element_at(F.array(*(F.lit(d) for d in _DESIGNS)), (F.col("p_size") % len(_DESIGNS) + 1).cast("int"))
    area = F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("  "), F.col("p_brand"), F.lit(" ")))
    mapped = T.looked_up(area, {"Brand#11": "CS", "Brand#12": "IS"})
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", labelling.worldview(design).alias("worldview"), labelling.method(design).alias("method"), mapped.alias("mapped"))
