"""Queries of the training tables and the studies of predictions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import headings as H
from folio.functions import text as T
from folio.operators import conformal, corpora, layout, studies
from folio.operators import relational as R
from folio.plans import model_queries as M
from folio.plans.text_queries import docs_of

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


# --- training tables: three documents in a row are the chunks of one item ---

_CHUNKS = "c AS (SELECT doc_id // 3 AS item, CAST(doc_id % 3 AS INT) AS chunk_index, CASE doc_id % 4 WHEN 0 THEN 'abstract' WHEN 1 THEN 'title' WHEN 2 THEN 'abstract' ELSE 'related_work' END AS section, n_chars AS n_words, text FROM documents)"


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    section = F.element_at(F.array(*(F.lit(s) for s in ("abstract", "title", "abstract", "related_work"))), (k % 4 + 1).cast("int"))
    return docs_of(spark, sf).select(F.floor(k / 3).alias("item"), (k % 3).cast("int").alias("chunk_index"), section.alias("section"), F.col("n_chars").alias("n_words"), "text")


def _formatted(section: str, title: str, text: str) -> str:
    tag = f"CASE WHEN {section} IN ('', 'body', 'other') THEN '' ELSE '[' || replace({section}, '_', ' ') || '] ' END"
    head = f"CASE WHEN coalesce({title}, '') = '' OR starts_with(lower({text}), lower(substring({title}, 1, 40))) THEN '' ELSE {title} || '. ' END"
    return f"{tag} || {head} || {text}"


@query(f"WITH {_CHUNKS}, t AS (SELECT item, arg_max(text, chunk_index) AS title FROM c WHERE section = 'title' GROUP BY item) SELECT c.item, chunk_index, md5({_formatted('section', 'title', 'coalesce(text, $$$$)')}) AS input_md5 FROM c LEFT JOIN t ON c.item = t.item")
def chunk_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """What the classifier reads of each chunk, its item's title before it."""
    return corpora.chunk_texts(_chunks(spark, sf), "item").select("item", "chunk_index", F.md5("text_in").alias("input_md5"))


@query(f"WITH {_CHUNKS}, a AS (SELECT item, text, min(chunk_index) AS i, max(n_words) AS n FROM c WHERE section = 'abstract' GROUP BY item, text), w AS (SELECT item, string_agg(coalesce(text, ''), ' ' ORDER BY i) AS t, sum(n) AS n FROM a GROUP BY item HAVING sum(n) >= 200) SELECT item, item % 2 = 0 AS builds, CAST(n AS BIGINT) AS n_words, md5(t) AS text_md5 FROM w WHERE item % 5 <> 0")
def facet_training(spark: SparkSession, sf: str) -> DataFrame:
    """Facets (of four items in five) with the abstracts of their items."""
    c = _chunks(spark, sf)
    facets = c.select("item").distinct().where("item % 5 <> 0").withColumn("builds", F.col("item") % 2 == 0)
    return corpora.facet_corpus(facets, c, "item", least_words=200).select("item", "builds", "n_words", F.md5("text").alias("text_md5"))


_LANGS = ["de", "en", "fr"]


@query("WITH d AS (SELECT *, list_position(['de', 'en', 'fr'], lang) - 1 AS k FROM documents), k AS (SELECT doc_id, k, text FROM d WHERE doc_id % 2 = 1 ORDER BY md5(doc_id || '-corpus'), doc_id LIMIT 300)" + f" SELECT doc_id, 'abstract' AS source, CAST(k AS INT) AS label_id, md5({_formatted('$$abstract$$', 'source', 'coalesce(text, $$$$)')}) AS input_md5 FROM d WHERE doc_id % 2 = 0 AND k >= 0 UNION ALL SELECT doc_id, 'chunk', CAST(k AS INT), md5({_formatted('$$methods$$', 'NULL::VARCHAR', 'coalesce(text, $$$$)')}) FROM k WHERE k >= 0")
def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Abstracts and a sample of 300 chunks as one labelled table."""
    d = docs_of(spark, sf)
    abstracts = d.where("doc_id % 2 = 0").select("doc_id", F.col("source").alias("title"), F.col("text").alias("abstract"), "lang")
    chunks = d.where("doc_id % 2 = 1").select("doc_id", "text", F.lit("methods").alias("section"), "lang")
    rows = corpora.training_corpus(abstracts, chunks, "lang", _LANGS, "doc_id", 300)
    return rows.select("doc_id", "source", "label_id", F.md5("text_in").alias("input_md5"))


@query("""WITH x AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0),
r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || '-additions'), o_orderkey) AS rn FROM orders WHERE year(o_orderdate) BETWEEN 1993 AND 1997 AND o_orderkey NOT IN (SELECT o_orderkey FROM x))
SELECT o_orderkey, o_orderpriority FROM r WHERE rn <= 40""")
def corpus_additions(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of some years that two other tables lack, 40 per priority."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    known = [o.where("o_orderstatus = 'F'"), o.where("o_orderkey % 11 = 0")]
    return corpora.additions(o, known, "o_orderkey", "o_orderpriority", 40, F.year("o_orderdate").between(1993, 1997)).select("o_orderkey", "o_orderpriority")


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS design, o_orderstatus = 'P' AS rare FROM orders),
p AS (SELECT o_orderkey, 'design' AS why FROM (SELECT *, row_number() OVER (PARTITION BY design ORDER BY md5(o_orderkey || '-gold'), o_orderkey) AS rn FROM o WHERE design IS NOT NULL) WHERE rn <= 20
UNION ALL SELECT o_orderkey, 'rare' FROM (SELECT * FROM o WHERE rare ORDER BY md5(o_orderkey || '-gold-rare'), o_orderkey LIMIT 30)
UNION ALL SELECT o_orderkey, 'unlabelled' FROM (SELECT * FROM o WHERE design IS NULL ORDER BY md5(o_orderkey || '-gold-none'), o_orderkey LIMIT 15))
SELECT o_orderkey, string_agg(why, ',' ORDER BY why) AS reasons FROM p GROUP BY o_orderkey""")
def gold_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A sample to annotate: 20 per priority, 30 of a rare kind, 15 without a priority."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("design"), (F.col("o_orderstatus") == "P").alias("rare"))
    return corpora.gold_sample(o, "o_orderkey", "design", {"rare": 30}, 20, 15).select("o_orderkey", F.array_join("reasons", ",").alias("reasons"))


# --- studies ---


def _allowed() -> Column:
    return F.array(((F.col("truth") + 1) % 6).cast("int"))


@query(M._P + """, a AS (SELECT gap < 0.05 AS stratum, truth, predicted, truth = predicted AS h, predicted IN (truth, (truth + 1) % 6) AS co FROM v), k AS (SELECT stratum, truth AS x, h FROM a UNION ALL SELECT stratum, predicted, h FROM a),
f AS (SELECT stratum, x, sum(h::INT) / count(*)::DOUBLE AS f1 FROM k GROUP BY stratum, x), m AS (SELECT stratum, avg(f1) AS macro_f1 FROM f GROUP BY stratum)
SELECT a.stratum, count(*) AS n, round(avg(h::INT), 6) AS accuracy, round(any_value(macro_f1), 6) AS macro_f1, round(avg(co::INT), 6) AS co_listed FROM a JOIN m ON a.stratum = m.stratum GROUP BY a.stratum""")
def ambiguity_strata(spark: SparkSession, sf: str) -> DataFrame:
    d = M.scored(spark, sf).withColumn("allowed", _allowed()).withColumn("tight", F.col("gap") < 0.05)
    return rounded(studies.strata(d, "tight", "truth", "predicted", "allowed"), "accuracy", "macro_f1", "co_listed")


@query(M._P + "SELECT predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM v WHERE truth IN (0, 1) AND truth <> predicted GROUP BY predicted")
def miss_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(studies.misses(M.scored(spark, sf), "truth", "predicted", F.col("truth").isin(0, 1)), "share")


_PAIRS = [("1-URGENT", "O"), ("2-HIGH", "F"), ("O", "5-LOW"), ("F", "P")]


@query("WITH o AS (SELECT o_orderpriority AS a, o_orderstatus AS b, o_orderkey % 3 = 0 AS hit, o_orderkey % 4 = 1 AS amb, (o_orderkey % 10) / 10.0::DOUBLE AS margin FROM orders), " + "m(x, y) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _PAIRS) + ") SELECT x || '+' || y AS pair, count(*) AS n, round(avg(amb::INT), 6) AS ambiguous_share, round(avg(margin), 6) AS mean_margin, round(avg(hit::INT), 6) AS accuracy FROM o JOIN m ON x IN (a, b) AND y IN (a, b) GROUP BY x, y")
def mirrored_categories(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.array("o_orderpriority", "o_orderstatus").alias("categories"), (k % 3 == 0).alias("hit"), (k % 4 == 1).alias("ambiguous"), ((k % 10) / 10.0).alias("margin"))
    return rounded(studies.mirrored(o, "categories", _PAIRS, "hit", "ambiguous", "margin"), "ambiguous_share", "mean_margin", "accuracy")


@query(M._P + ", a AS (SELECT s, predicted, count(*) AS c, sum(correct::INT) AS h FROM v JOIN c USING (vec_id) GROUP BY s, predicted), places AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY c DESC, predicted) AS rn FROM a) SELECT s AS area, CAST(sum(c) AS BIGINT) AS n, round(sum(h) / sum(c), 6) AS hit_rate, string_agg(predicted || ':' || c, ' ' ORDER BY rn) FILTER (rn <= 3) AS top FROM places GROUP BY s")
def area_report(spark: SparkSession, sf: str) -> DataFrame:
    """Hit rate and commonest predictions by section number."""
    d = M.scored(spark, sf).withColumn("area", F.col("vec_id") % 4)
    return rounded(studies.areas(d, "area", "truth", "predicted"), "hit_rate").withColumn("top", F.array_join("top", " "))


@query(M._P + f""", s AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'old' ELSE 'new' END AS calibration, 1.0 - p AS s FROM p WHERE k = truth AND {M._CAL}), o AS (SELECT *, row_number() OVER (PARTITION BY calibration ORDER BY s) AS i, count(*) OVER (PARTITION BY calibration) AS n FROM s),
g AS (SELECT DISTINCT calibration, n, a AS alpha, ceil((n + 1) * (1.0::DOUBLE - a)) AS k FROM o, (VALUES (0.1::DOUBLE), (0.2)) t(a)),
q AS (SELECT g.calibration, g.alpha, CASE WHEN g.k > g.n THEN 'infinity'::DOUBLE ELSE o.s END AS qhat FROM g LEFT JOIN o ON o.calibration = g.calibration AND o.i = least(g.k, g.n - 1) + 1),
t AS (SELECT vec_id, calibration, alpha, count(*) FILTER (1.0 - p <= qhat) AS size, bool_or(k = truth AND 1.0 - p <= qhat) AS covered FROM p, q WHERE NOT ({M._CAL}) GROUP BY vec_id, calibration, alpha)
SELECT calibration, alpha, count(*) AS n, round(avg(covered::INT), 6) AS coverage, round(avg(size), 6) AS avg_size, round(avg((size <> 1)::INT), 6) AS routed FROM t GROUP BY calibration, alpha""")
def recalibration_study(spark: SparkSession, sf: str) -> DataFrame:
    """Sets of one half under thresholds of two parts of the other."""
    fit, test = M._halves(spark, sf)
    r = studies.recalibrated(fit.where("vec_id % 2 = 0"), fit.where("vec_id % 2 = 1"), test, "scores", "own", "truth", "predicted", [0.1, 0.2])
    return rounded(r.select("calibration", "alpha", "n", "coverage", "avg_size", "routed"), "coverage", "avg_size", "routed")


@query(ORACLES["recalibration_study"].replace("SELECT calibration, alpha, count(*) AS n", "SELECT gap < 0.1 AS ambiguous, calibration, alpha, count(*) AS n").replace("FROM t GROUP BY calibration, alpha", "FROM t JOIN v USING (vec_id) GROUP BY ambiguous, calibration, alpha"))
def recalibration_by_ambiguity(spark: SparkSession, sf: str) -> DataFrame:
    """The same apart for rows whose best two labels are close."""
    fit, test = M._halves(spark, sf)
    r = studies.recalibrated(fit.where("vec_id % 2 = 0"), fit.where("vec_id % 2 = 1"), test.withColumn("ambiguous", F.col("gap") < 0.1), "scores", "own", "truth", "predicted", [0.1, 0.2], "ambiguous")
    return rounded(r.select("ambiguous", "calibration", "alpha", "n", "coverage", "avg_size", "routed"), "coverage", "avg_size", "routed")


@query(M._Q + """, d AS (SELECT doc, k, avg(p) AS q FROM p JOIN c USING (vec_id) GROUP BY doc, k), even AS (SELECT doc, k, greatest(q, 1e-9) / sum(greatest(q, 1e-9)) OVER (PARTITION BY doc) AS p FROM d)
SELECT doc, arg_max(k, (p, -k)) AS predicted, string_agg(k::VARCHAR, ',' ORDER BY k) FILTER (1.0 - p <= (SELECT qhat FROM q WHERE alpha = 0.2)) AS found FROM even GROUP BY doc""")
def document_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Sets of documents under a threshold fitted on chunks."""
    qhat = conformal.quantiles(M._halves(spark, sf)[0], "own", [0.2]).first()["qhat"]
    sets = studies.document_sets(M.scored(spark, sf).withColumn("weight", F.lit(1.0)), "doc", "mean", qhat, 6)
    return sets.select("doc", "predicted", F.when(F.size("set") > 0, F.array_join("set", ",")).alias("found"))


_POOLED = {"mean": "avg(p)", "weighted_mean": "sum(ww * p) / sum(ww)"}


@query(M._W + ", y AS (SELECT doc, min(truth) AS y FROM v JOIN c USING (vec_id) GROUP BY doc)" + "".join(f", s_{n} AS (SELECT doc, '{n}' AS strategy, k, {e} AS q FROM x JOIN p USING (vec_id) GROUP BY doc, k)" for n, e in _POOLED.items()) + ", places AS (SELECT *, row_number() OVER (PARTITION BY strategy, doc ORDER BY q DESC, k) AS rn FROM (SELECT * FROM s_mean UNION ALL SELECT * FROM s_weighted_mean)) SELECT strategy, count(*) AS n, round(avg((k = y)::INT), 6) AS accuracy FROM places JOIN y USING (doc) WHERE rn = 1 GROUP BY strategy")
def strategy_comparison(spark: SparkSession, sf: str) -> DataFrame:
    chunks = M.weighted(spark, sf)
    truth = chunks.groupBy("doc").agg(F.min("truth").alias("y"))
    return rounded(studies.strategies(chunks, "doc", truth, "y", list(_POOLED), 6), "accuracy")


@query("WITH b AS (SELECT p_brand, count(*) AS n, max(p_size) AS largest FROM part GROUP BY p_brand) SELECT p_brand, CAST(row_number() OVER (ORDER BY n DESC, largest DESC, p_brand) AS INT) AS place FROM b")
def brand_ranking(spark: SparkSession, sf: str) -> DataFrame:
    brands = spark.read.parquet(f"{sf}/part.parquet").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.max("p_size").alias("largest"))
    return studies.ranking(brands, "p_brand", ["n", "largest"]).select("p_brand", "place")


@query("SELECT doc_id, lang IS NOT NULL AND lang = 'en' AS is_first FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def guarded_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that no training table has, as evaluation sets must be."""
    held = R.without(docs_of(spark, sf).select("doc_id", "lang"), [spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").select("doc_id")], "doc_id")
    return held.select("doc_id", F.coalesce(F.col("lang") == "en", F.lit(False)).alias("is_first"))


# --- typeset documents: eight words a line, the first two lines large, every fifth somewhat larger ---


@query(rf"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\S+') AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(0, (len(w) + 7) // 8)) AS i FROM w),
l AS (SELECT doc_id, i, array_to_string(w[i * 8 + 1:i * 8 + 8], ' ') AS t, CASE WHEN i < 2 THEN 20 WHEN i % 5 = 3 THEN 12 ELSE 10 END AS size FROM i), n AS (SELECT doc_id, size, count(*) AS n FROM l GROUP BY doc_id, size),
b AS (SELECT doc_id, arg_max(size, (n, -size)) AS body, max(size) AS top FROM n GROUP BY doc_id), h AS (SELECT doc_id, count(*) AS n FROM l JOIN b USING (doc_id) WHERE size < CASE WHEN top > body * 1.15 THEN top ELSE 99 END
  AND (regexp_extract(t, '(?i)^[ \t]*({T.LEAD_INS})\s*[-—–:.]+', 1) <> '' OR (size >= body * 1.08 AND NOT regexp_matches(t, '[.,;]$') AND regexp_matches(t, '[A-Za-z]{{3,}}') AND NOT regexp_matches(t, {"'" + H.CAPTION + "'"}))) GROUP BY doc_id),
x AS (SELECT doc_id, max(t) FILTER (i = 0) AS a, max(t) FILTER (i = 1) AS b FROM l GROUP BY doc_id), y AS (SELECT doc_id, CASE WHEN regexp_matches(a, '-$') AND regexp_matches(b, '^\p{{Ll}}') THEN regexp_replace(a, '-$', '') || b ELSE a || ' ' || b END AS t FROM x)
SELECT b.doc_id, CASE WHEN top > body * 1.15 AND regexp_matches(y.t, '[A-Za-z]{{3,}}') THEN md5(y.t) END AS title_md5, coalesce(h.n, 0) AS n_headings FROM b JOIN y USING (doc_id) LEFT JOIN h ON h.doc_id = b.doc_id""")
def typeset_outlines(spark: SparkSession, sf: str) -> DataFrame:
    """Titles and headings by the size of lines."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+"), F.lit(0))
    lines = F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / 8).cast("int") - 1), lambda i: F.struct((i / 40).cast("int").alias("page"), i.alias("line"), F.when(i < 2, 20.0).when(i % 5 == 3, 12.0).otherwise(10.0).alias("size"), F.lit(False).alias("bold"), F.array_join(F.slice("w", i * 8 + 1, 8), " ").alias("text")))
    rows = docs_of(spark, sf).select("doc_id", words.alias("w")).where(F.size("w") > 0).select("doc_id", F.inline(lines))
    return layout.outline(rows, "doc_id").select("doc_id", F.md5("title").alias("title_md5"), F.size("headings").cast("long").alias("n_headings"))
