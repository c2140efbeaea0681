"""Queries over scores, labels, sets and neighbours, with their SQL.

Scores come from the embeddings: six logits from the first six numbers, truth from
the label; five consecutive vectors are the chunks of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import vectors as V
from folio.operators import conformal, labelling, metrics, neighbours, scoring
from folio.operators import relational as R
from folio.plans import reports

QUERIES: dict = {}
ORACLES: dict = {}
CLASSES = 6
SECTIONS = ["abstract", "introduction", "methods", "references"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def vectors_of(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def logits() -> Column:
    return F.transform(F.slice("embedding", 1, CLASSES), lambda x: x.cast("double") * 4.0)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, truth, doc, chunk_index, section, n_words, logits, probs, predicted, confidence, gap."""
    d = vectors_of(spark, sf).select("vec_id", (F.col("label") % CLASSES).alias("truth"), F.floor(F.col("vec_id") / 5).alias("doc"), (F.col("vec_id") % 5).cast("int").alias("chunk_index"), F.element_at(F.array(*(F.lit(s) for s in SECTIONS)), (F.col("vec_id") % 4 + 1).cast("int")).alias("section"), (20 + (F.col("vec_id") * 37) % 300).alias("n_words"), logits().alias("logits"))
    d = d.withColumn("probs", V.softmax(F.col("logits")))
    v = scoring.verdict(F.col("probs"))
    return d.withColumn("_v", v).withColumn("predicted", F.col("_v.label")).withColumn("confidence", F.col("_v.confidence")).withColumn("gap", F.col("_v.gap")).drop("_v").withColumn("correct", F.col("predicted") == F.col("truth"))


#: SQL of the same: long form p, one row per vector v.
_P = """
WITH l AS (SELECT vec_id, label % 6 AS truth, k, 4.0 * CAST(embedding[k + 1] AS DOUBLE) AS z FROM embeddings, range(6) r(k)),
e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM l),
p AS (SELECT vec_id, truth, CAST(k AS INT) AS k, z, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) AS rn FROM p),
v AS (SELECT a.vec_id, a.truth, a.k AS predicted, a.p AS confidence, b.k AS runner_up, a.p - b.p AS gap, a.k = a.truth AS correct FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.rn = 1 AND b.rn = 2),
c AS (SELECT vec_id, vec_id // 5 AS doc, CAST(vec_id % 5 AS INT) AS chunk_index, vec_id % 4 AS s, 20 + (vec_id * 37) % 300 AS n_words FROM embeddings)
"""
_W = _P + """,
h AS (SELECT vec_id, -sum(greatest(p, 1e-9) * ln(greatest(p, 1e-9))) / ln(6) AS h, max(p) AS top FROM p GROUP BY vec_id),
w AS (SELECT c.*, h.top, CASE s WHEN 0 THEN 1.5 WHEN 1 THEN 1.2 WHEN 2 THEN 1.0 ELSE 0.0 END * sqrt(greatest(n_words, 1) / 200.0) * least(greatest(1 - h, 0.05), 1.0) AS w FROM c JOIN h USING (vec_id)),
x AS (SELECT *, CASE WHEN sum(w) OVER (PARTITION BY doc) > 0 THEN w ELSE 1.0 END AS ww FROM w)
"""


def weighted(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).withColumn("weight", scoring.chunk_weight(F.col("section"), F.col("n_words"), F.col("probs"), CLASSES))


def long(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("probs").alias("k", "p")).withColumn("p", F.round("p", 6))


@query(_P + "SELECT vec_id, predicted, round(confidence, 6) AS confidence, runner_up, round(gap, 6) AS gap, CASE WHEN confidence < 0.3 THEN 'LOW_CONFIDENCE' WHEN gap < 0.05 THEN 'TIGHT_GAP' END AS flag FROM v")
def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    d = scored(spark, sf)
    v = scoring.verdict(F.col("probs"))
    return d.select("vec_id", "predicted", F.round("confidence", 6).alias("confidence"), v["runner_up"].alias("runner_up"), F.round("gap", 6).alias("gap"), scoring.borderline(F.col("confidence"), F.col("gap"), 0.3, 0.05).alias("flag"))


_RENORM = " SELECT doc, k, round(greatest(q, 1e-9) / sum(greatest(q, 1e-9)) OVER (PARTITION BY doc), 6) AS p FROM q"


@query(_W + ", q AS (SELECT doc, k, sum(ww * p) / sum(ww) AS q FROM x JOIN p USING (vec_id) GROUP BY doc, k)" + _RENORM)
def pooled_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    return long(scoring.pool(weighted(spark, sf), "doc"), "doc")


@query(_W + ", q AS (SELECT doc, k, avg(p) AS q FROM x JOIN p USING (vec_id) GROUP BY doc, k)" + _RENORM)
def pooled_mean(spark: SparkSession, sf: str) -> DataFrame:
    return long(scoring.pool(weighted(spark, sf), "doc", "mean"), "doc")


@query(_W + ", q AS (SELECT doc, k, exp(sum(ww * ln(greatest(p, 1e-9))) / sum(ww)) AS q FROM x JOIN p USING (vec_id) GROUP BY doc, k)" + _RENORM)
def pooled_geometric(spark: SparkSession, sf: str) -> DataFrame:
    return long(scoring.pool(weighted(spark, sf), "doc", "weighted_geometric"), "doc")


@query(_W + ", b AS (SELECT doc, arg_max(vec_id, top) AS vec_id FROM x GROUP BY doc), q AS (SELECT doc, k, p AS q FROM b JOIN p USING (vec_id))" + _RENORM)
def pooled_max(spark: SparkSession, sf: str) -> DataFrame:
    return long(scoring.pool(weighted(spark, sf), "doc", "max"), "doc")


#: A tree of the six classes: group = class % 2.
_TREE = [(k, k % 2) for k in range(CLASSES)]


def tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_TREE, "class_id int, branch int")


def long_logits(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("vec_id", (F.col("truth") % 2).cast("int").alias("branch"), F.posexplode("logits").alias("class_id", "logit"))


@query(_P + """, b AS (SELECT vec_id, k, z, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM p WHERE k % 2 = truth % 2),
s AS (SELECT vec_id, k, z, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM b)
SELECT vec_id, arg_max(k, z) AS class_id, round(max(p), 6) AS p FROM s GROUP BY vec_id""")
def ballot_class(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.conditioned_class(long_logits(spark, sf), "vec_id", "branch", tree(spark)).withColumn("p", F.round("p", 6))


@query(_P + "SELECT vec_id, k % 2 AS branch, round(sum(p), 6) AS p FROM p GROUP BY vec_id, k % 2")
def branch_marginals(spark: SparkSession, sf: str) -> DataFrame:
    p = scored(spark, sf).select("vec_id", F.posexplode("probs").alias("class_id", "p"))
    return scoring.marginal(p, "vec_id", tree(spark), "branch").withColumn("p", F.round("p", 6))


@query(_P + "SELECT vec_id, k, round(0.7 * p + 0.3 / 6, 6) AS p FROM p")
def blended_with_uniform(spark: SparkSession, sf: str) -> DataFrame:
    uniform = F.array_repeat(F.lit(1 / CLASSES), CLASSES)
    return long(scored(spark, sf).withColumn("probs", V.blend([(F.col("probs"), 7.0), (uniform, 3.0)])), "vec_id")


_GRID = [0.25, 0.5, 1.0, 2.0, 4.0]


@query("""WITH l AS (SELECT vec_id, label % 6 AS truth, k, t, 4.0 * CAST(embedding[k + 1] AS DOUBLE) / t AS z FROM embeddings, range(6) r(k), (VALUES (0.25::DOUBLE), (0.5), (1.0), (2.0), (4.0)) g(t)),
s AS (SELECT vec_id, t, truth, max(z) AS m, ln(sum(exp(z))) AS lse, max(CASE WHEN k = truth THEN z END) AS own FROM l GROUP BY vec_id, t, truth)
SELECT t AS temperature, round(avg(lse - own), 6) AS nll FROM s GROUP BY t""")
def temperature_curve(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.temperature_by_grid(scored(spark, sf), "logits", "truth", _GRID).withColumn("nll", F.round("nll", 6))


_KNN = """
WITH u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT q.vec_id AS query_id, s.vec_id, s.label, list_cosine_similarity(q.e, s.e) AS sim FROM u q JOIN u s ON q.vec_id % 20 = 0 AND s.vec_id <> q.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM n)
"""


@query(_KNN + "SELECT query_id, vec_id, round(sim, 6) AS similarity, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10")
def nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf).withColumn("similarity", F.round("similarity", 6))


def _nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The queries are the vectors whose id is divisible by 20, held against all but themselves."""
    v = vectors_of(spark, sf)
    return neighbours.nearest(v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), v, 10, skip_own=True)


@query(_KNN + ", w AS (SELECT query_id, label, exp((sim - max(sim) OVER (PARTITION BY query_id)) / 0.05) AS w FROM k WHERE rank <= 10), g AS (SELECT query_id, label, sum(w) AS w FROM w GROUP BY query_id, label) SELECT query_id, label, round(w / sum(w) OVER (PARTITION BY query_id), 6) AS p FROM g")
def neighbour_votes(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.neighbour_vote(_nearest(spark, sf), vectors_of(spark, sf), "vec_id", "label").withColumn("p", F.round("p", 6))


#: The nearest of even label among a query's fifteen nearest, five at most.
_FLAGGED = _KNN + """, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM k WHERE rank <= 15 AND label % 2 = 0),
e AS (SELECT * FROM f WHERE place <= 5)
"""


def _flagged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = vectors_of(spark, sf)
    queries = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return queries, v, neighbours.nearest_with(queries, v.withColumn("even", F.col("label") % 2 == 0), 5, "even", skip_own=True)


@query(_FLAGGED + "SELECT query_id, vec_id, round(sim, 6) AS similarity, CAST(place AS INT) AS rank FROM e")
def flagged_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return _flagged(spark, sf)[2].withColumn("similarity", F.round("similarity", 6))


@query(_FLAGGED + """, w AS (SELECT query_id, label, exp((sim - max(sim) OVER (PARTITION BY query_id)) / 0.05) AS w, place FROM e),
g AS (SELECT query_id, label, sum(w) AS w, min(place) AS place FROM w GROUP BY query_id, label),
b AS (SELECT query_id, label, w / sum(w) OVER (PARTITION BY query_id) AS share, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, place) AS rn FROM g)
SELECT q.vec_id AS query_id, coalesce(b.label, -1) AS label, round(coalesce(share, 0), 6) AS share FROM embeddings q LEFT JOIN b ON b.query_id = q.vec_id AND rn = 1 WHERE q.vec_id % 20 = 0""")
def evidence_votes(spark: SparkSession, sf: str) -> DataFrame:
    queries, v, found = _flagged(spark, sf)
    return neighbours.vote_or_default(queries, found, v, "vec_id", "label", -1).withColumn("share", F.round("share", 6))


@query()
def subspace_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A label for every vector; the axes are fitted without those whose id is divisible by 20."""
    v = vectors_of(spark, sf)
    s = scoring.subspace_scores(v, scoring.subspaces(v.where("vec_id % 20 <> 0"), "label", 3), "vec_id")
    return s.groupBy("vec_id").agg(F.max_by("label", F.struct("score", -F.col("label"))).alias("label"))


# --- conformal ---

_CAL = "md5(vec_id || '-half') < '8'"
_Q = _P + f""", s AS (SELECT vec_id, truth, 1.0 - p AS s FROM p WHERE k = truth AND {_CAL}),
o AS (SELECT *, row_number() OVER (ORDER BY s) AS i, count(*) OVER () AS n FROM s),
g AS (SELECT a AS alpha, (SELECT count(*) FROM s) AS n FROM (VALUES (0.05::DOUBLE), (0.1), (0.2), (0.5)) t(a)),
q AS (SELECT g.alpha, g.n, CASE WHEN ceil((g.n + 1) * (1.0::DOUBLE - g.alpha)) > g.n THEN 'infinity'::DOUBLE ELSE o.s END AS qhat FROM g LEFT JOIN o ON o.i = least(ceil((g.n + 1) * (1.0::DOUBLE - g.alpha)), g.n - 1) + 1)
"""
ALPHAS = [0.05, 0.1, 0.2, 0.5]


def _halves(spark: SparkSession, sf: str, method: str = "lac") -> tuple[DataFrame, DataFrame]:
    d = scored(spark, sf).withColumn("scores", conformal.scores(F.col("probs"), method)).withColumn("own", F.element_at("scores", F.col("truth") + 1))
    first = R.shuffled("vec_id", "half") < "8"
    return d.where(first), d.where(~first)


@query(_Q + "SELECT alpha, n, round(qhat, 6) AS qhat FROM q")
def conformal_bank(spark: SparkSession, sf: str) -> DataFrame:
    return conformal.quantiles(_halves(spark, sf)[0], "own", ALPHAS).withColumn("qhat", F.round("qhat", 6))


@query(_P + f""", s AS (SELECT truth, 1.0 - p AS s FROM p WHERE k = truth AND {_CAL}),
o AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY s) AS i, count(*) OVER (PARTITION BY truth) AS n FROM s),
g AS (SELECT DISTINCT truth, n, ceil((n + 1) * 0.9::DOUBLE) AS k FROM o)
SELECT g.truth, 0.1::DOUBLE AS alpha, g.n, CASE WHEN g.k > g.n THEN 'infinity'::DOUBLE ELSE round(o.s, 6) END AS qhat FROM g LEFT JOIN o ON o.truth = g.truth AND o.i = least(g.k, g.n - 1) + 1""")
def conformal_bank_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return conformal.quantiles(_halves(spark, sf)[0], "own", [0.1], "truth").withColumn("qhat", F.round("qhat", 6))


def _sets(spark: SparkSession, sf: str, alpha: float, method: str = "lac") -> DataFrame:
    fit, test = _halves(spark, sf, method)
    qhat = conformal.quantiles(fit, "own", [alpha], None).first()["qhat"]
    return test.withColumn("set", conformal.prediction_set(F.col("scores"), F.lit(qhat)))


@query(_Q + f", t AS (SELECT p.vec_id, p.truth, v.predicted, p.k, 1.0 - p.p <= (SELECT qhat FROM q WHERE alpha = 0.2) AS inside FROM p JOIN v USING (vec_id) WHERE NOT ({_CAL})), " + """
u AS (SELECT vec_id, truth, predicted, count(*) FILTER (inside) AS size, bool_or(inside AND k = truth) AS covered FROM t GROUP BY vec_id, truth, predicted)
SELECT truth, count(*) AS n, round(avg(covered::INT), 6) AS coverage, round(avg(size), 6) AS avg_size, median(size) AS median_size, round(avg((size <> 1)::INT), 6) AS routed, round(avg((size = 1)::INT), 6) AS singleton, round(avg((size = 0)::INT), 6) AS empty,
  round(avg(CASE WHEN size = 1 THEN covered::INT END), 6) AS singleton_accuracy, round(avg(CASE WHEN predicted <> truth THEN (size <> 1)::INT END), 6) AS error_recall, round(avg(CASE WHEN size <> 1 THEN (predicted <> truth)::INT END), 6) AS routed_precision FROM u GROUP BY truth""")
def conformal_set_report(spark: SparkSession, sf: str) -> DataFrame:
    r = conformal.evaluate_sets(_sets(spark, sf, 0.2), "set", "truth", "predicted", ["truth"])
    return r.select("truth", "n", "median_size", *(F.round(c, 6).alias(c) for c in r.columns if c not in ("truth", "n", "median_size")))


@query(_P + "SELECT vec_id, k, round(sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, k ROWS UNBOUNDED PRECEDING), 6) AS score FROM p")
def aps_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("vec_id", F.posexplode(conformal.aps(F.col("probs"))).alias("k", "score")).withColumn("score", F.round("score", 6))


# --- metrics ---


@query(_P + "SELECT truth, predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY truth), 6) AS row_share FROM v GROUP BY truth, predicted")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(scored(spark, sf), "truth", "predicted").withColumn("row_share", F.round("row_share", 6))


_F1 = """, k AS (SELECT i AS class, (SELECT count(*) FROM v WHERE truth = i) AS support, (SELECT count(*) FROM v WHERE predicted = i) AS c, (SELECT count(*) FROM v WHERE predicted = i AND truth = i) AS tp FROM range(6) t(i)),
f AS (SELECT CAST(class AS INT) AS class, support, CASE WHEN c > 0 THEN tp / c ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, CASE WHEN support + c > 0 THEN 2.0 * tp / (support + c) ELSE 0.0 END AS f1 FROM k)
"""


@query(_P + _F1 + "SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    r = metrics.per_class(scored(spark, sf), "truth", "predicted")
    return r.select("class", "support", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(_P + _F1 + "SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(recall * support) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f")
def accuracy_report(spark: SparkSession, sf: str) -> DataFrame:
    r = metrics.summary(scored(spark, sf), "truth", "predicted")
    return r.select("n", *(F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")))


@query(_P + "SELECT CAST(ceil(confidence * 15) AS INT) AS bin, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(correct::INT), 6) AS accuracy FROM v GROUP BY 1")
def reliability_bins(spark: SparkSession, sf: str) -> DataFrame:
    r = metrics.reliability(scored(spark, sf), "confidence", "correct")
    return r.select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


@query(_P + ", b AS (SELECT count(*) AS n, avg(confidence) AS c, avg(correct::INT) AS a FROM v GROUP BY ceil(confidence * 15)) SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b")
def calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.calibration_error(scored(spark, sf), "confidence", "correct").select(F.round("ece", 6).alias("ece"))


@query(_P + ", t AS (SELECT a AS low, b AS tight FROM (VALUES (0.2::DOUBLE), (0.3), (0.4)) x(a), (VALUES (0.02::DOUBLE), (0.05), (0.1)) y(b)) SELECT low, tight, round(avg((confidence < low OR gap < tight)::INT), 6) AS fire_rate, round(avg(CASE WHEN NOT correct THEN (confidence < low OR gap < tight)::INT END), 6) AS error_recall, round(avg(CASE WHEN confidence < low OR gap < tight THEN (NOT correct)::INT END), 6) AS precision FROM v, t GROUP BY low, tight")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    r = metrics.threshold_sweep(scored(spark, sf), "confidence", "gap", "correct", [0.2, 0.3, 0.4], [0.02, 0.05, 0.1])
    return r.select("low", "tight", *(F.round(c, 6).alias(c) for c in ("fire_rate", "error_recall", "precision")))


@query(_P + ", x AS (SELECT count(*) AS n, avg((truth = predicted)::INT) AS po FROM v), chance AS (SELECT sum(CAST(a.n AS DOUBLE) * b.n) AS pe FROM (SELECT truth AS k, count(*) AS n FROM v GROUP BY truth) a JOIN (SELECT predicted AS k, count(*) AS n FROM v GROUP BY predicted) b USING (k)) SELECT n, round(po, 6) AS agreement, round((po - pe / (n * n)) / (1 - pe / (n * n)), 6) AS kappa FROM x, chance")
def cohen_kappa(spark: SparkSession, sf: str) -> DataFrame:
    r = metrics.kappa(scored(spark, sf), "truth", "predicted")
    return r.select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


_T = "WITH t AS (SELECT d.n_chars AS s, l.toxic = 1 AS y, d.lang FROM documents d JOIN labels l USING (doc_id)) "


def _toxic(spark: SparkSession, sf: str) -> DataFrame:
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    return d.join(labels, "doc_id").select("doc_id", F.col("n_chars").alias("s"), (F.col("toxic") == 1).alias("y"), (F.col("quality") == 1).alias("good"), "lang")


@query(_T + """, r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0 AS rk FROM t)
SELECT lang, count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives, round(CASE WHEN count(*) FILTER (y) > 0 AND count(*) FILTER (NOT y) > 0 THEN (sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)) END, 6) AS auc FROM r GROUP BY lang""")
def length_auc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.roc_auc(_toxic(spark, sf), "s", "y", ["lang"]).withColumn("auc", F.round("auc", 6))


@query(_T + """, g AS (SELECT s, count(*) AS n, count(*) FILTER (y) AS pos FROM t GROUP BY s),
c AS (SELECT pos, sum(pos) OVER w / sum(n) OVER w AS p FROM g WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(p * pos) / sum(pos), 6) AS average_precision FROM c""")
def length_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.average_precision(_toxic(spark, sf), "s", "y").withColumn("average_precision", F.round("average_precision", 6))


@query(_T + """SELECT round(avg(CASE WHEN s > 2000 THEN y::INT END), 6) AS with_signal, round(avg(CASE WHEN s <= 2000 THEN y::INT END), 6) AS without_signal, round(avg(CASE WHEN s > 2000 THEN y::INT END) / avg(CASE WHEN s <= 2000 THEN y::INT END), 6) AS lift FROM t""")
def length_lift(spark: SparkSession, sf: str) -> DataFrame:
    r = metrics.lift(_toxic(spark, sf).withColumn("signal", F.col("s") > 2000), "signal", "y")
    return r.select(*(F.round(c, 6).alias(c) for c in r.columns))


@query("""WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM c)
SELECT round(2 * sum(n / t * ln(n * t / (na * nb))) / -(sum(n / t * ln(na / t)) + sum(n / t * ln(nb / t))), 6) AS nmi FROM w""")
def flag_information(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.mutual_information(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_returnflag", "l_linestatus").select(F.round("nmi", 6).alias("nmi"))


@query(_P + ", g AS (SELECT i / 10.0 AS threshold FROM range(1, 10) t(i)), n AS (SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (confidence >= threshold AND correct) AS tp, count(*) FILTER (confidence >= threshold) AS c, count(*) FILTER (correct) AS s FROM v, g GROUP BY threshold), f AS (SELECT threshold, CASE WHEN s + c > 0 THEN 2.0 * tp / (s + c) ELSE 0.0 END AS f1 FROM n) SELECT threshold, round(f1, 6) AS f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1")
def fitted_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.fitted_threshold(scored(spark, sf), "confidence", "correct", [k / 10 for k in range(1, 10)]).withColumn("f1", F.round("f1", 6))


@query("""WITH x AS (SELECT c.c_nationkey AS t, (c.c_custkey % 25)::INT AS p FROM customer c), y AS (SELECT t = p AS leaf, a.n_regionkey = b.n_regionkey AS top FROM x JOIN nation a ON a.n_nationkey = t JOIN nation b ON b.n_nationkey = p)
SELECT count(*) AS n, round(avg(leaf::INT), 6) AS leaf_accuracy, round(avg(top::INT), 6) AS parent_accuracy, round(avg((leaf::INT + top::INT) / 2.0), 6) AS hierarchical_f1 FROM y""")
def nation_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """A guess of each customer's nation, scored with credit for the region."""
    n = spark.read.parquet(f"{sf}/nation.parquet")
    guess = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_nationkey").alias("t"), (F.col("c_custkey") % 25).cast("int").alias("p"))
    both = guess.join(n.select(F.col("n_nationkey").alias("t"), F.col("n_regionkey").alias("tr")), "t").join(n.select(F.col("n_nationkey").alias("p"), F.col("n_regionkey").alias("pr")), "p")
    r = metrics.hierarchical(both, "t", "p", "tr", "pr")
    return r.select("n", *(F.round(c, 6).alias(c) for c in r.columns if c != "n"))


@query()
def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    d = scored(spark, sf).select("vec_id", F.col("correct").alias("a"), (F.col("truth") == 0).alias("b"))
    return metrics.bootstrap_difference(d, "a", "b")


# --- labels ---

#: Category, label, strength, secondary label.
_MAP = [("1-URGENT", "hot", 0.9, "warm"), ("2-HIGH", "hot", 0.6, "warm"), ("3-MEDIUM", "warm", 0.8, None), ("5-LOW", "cold", 0.7, "warm"), ("F", "cold", 0.5, "hot"), ("O", "warm", 0.55, "cold")]


@query("""
WITH m(category, label, strength, secondary) AS (VALUES """ + ", ".join(f"('{a}', '{b}', {c}::DOUBLE, {repr(d) if d else 'NULL'})" for a, b, c, d in _MAP) + """),
o AS (SELECT o_orderkey, u.c AS category, u.i - 1 AS i FROM (SELECT o_orderkey, [o_orderpriority, o_orderstatus] AS c FROM orders) x, unnest(x.c) WITH ORDINALITY AS u(c, i)),
j AS (SELECT o_orderkey, i, CASE WHEN i = 0 THEN 2.0::DOUBLE ELSE 1.0 END AS w, m.* FROM o JOIN m USING (category)),
v AS (SELECT o_orderkey, label, w * strength AS v, 2 * i AS o FROM j UNION ALL SELECT o_orderkey, secondary, w * (1 - strength) * 0.5, 2 * i + 1 FROM j WHERE secondary IS NOT NULL),
s AS (SELECT o_orderkey, label, sum(v) AS v, min(o) AS o FROM v GROUP BY o_orderkey, label),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY v DESC, o) AS rn, sum(v) OVER (PARTITION BY o_orderkey) AS total FROM s),
g AS (SELECT a.o_orderkey, a.label, (a.v - coalesce(b.v, 0)) / a.total AS margin FROM r a LEFT JOIN r b ON a.o_orderkey = b.o_orderkey AND b.rn = 2 WHERE a.rn = 1)
SELECT o.o_orderkey, g.label, round(coalesce(g.margin, 0.0), 6) AS margin, g.label IS NULL OR g.margin < 0.25 AS ambiguous FROM orders o LEFT JOIN g USING (o_orderkey)""")
def order_votes(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.array("o_orderpriority", "o_orderstatus").alias("categories"))
    won = orders.select("o_orderkey", labelling.voted(F.col("categories"), _MAP).alias("v"))
    return won.select("o_orderkey", "v.label", F.round("v.margin", 6).alias("margin"), "v.ambiguous")


@query("""WITH a AS (SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders WHERE o_totalprice >= 300000 OR (o_totalprice >= 200000 AND o_orderstatus = 'F')) SELECT o_orderkey, o_orderpriority FROM a WHERE rn <= 50""")
def pseudo_labels(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumn("backed", F.col("o_orderstatus") == "F")
    return labelling.self_training(o, "o_orderpriority", "o_totalprice", "backed", "o_orderkey", 50, 300_000, 200_000).select("o_orderkey", "o_orderpriority")


@query("""WITH c AS (SELECT max(o_orderdate) - INTERVAL 180 DAY AS c FROM orders), t AS (SELECT o_orderkey, o_custkey FROM orders, c WHERE o_orderdate >= c)
SELECT o_orderkey FROM t WHERE o_custkey NOT IN (SELECT o_custkey FROM orders, c WHERE o_orderdate < c)""")
def temporal_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of the last 180 days whose customer never ordered before."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    cut = F.lit(o.agg(F.max("o_orderdate") - F.expr("INTERVAL 180 DAYS")).first()[0])
    return R.without(o.where(F.col("o_orderdate") >= cut), [o.where(F.col("o_orderdate") < cut)], "o_custkey").select("o_orderkey")


@query("SELECT p_partkey, p_type FROM (SELECT p_partkey, p_type, count(*) OVER (PARTITION BY p_type) AS n FROM part) WHERE n >= 15")
def supported_types(spark: SparkSession, sf: str) -> DataFrame:
    return R.min_support(spark.read.parquet(f"{sf}/part.parquet"), "p_type", 15).select("p_partkey", "p_type")


# --- reports ---


@query(_Q + f""", t AS (SELECT p.vec_id, p.truth, p.k, q.alpha, q.qhat, 1.0 - p.p <= q.qhat AS inside FROM p, q WHERE NOT ({_CAL})),
u AS (SELECT vec_id, alpha, qhat, count(*) FILTER (inside) AS size, bool_or(inside AND k = truth) AS covered FROM t GROUP BY vec_id, alpha, qhat)
SELECT alpha, round(qhat, 6) AS qhat, round(avg(covered::INT), 6) AS coverage, round(avg(size), 6) AS avg_size, round(avg((size <> 1)::INT), 6) AS routed FROM u GROUP BY alpha, qhat""")
def coverage_curve(spark: SparkSession, sf: str) -> DataFrame:
    fit, test = _halves(spark, sf)
    r = reports.coverage_curve(fit, test, "scores", "own", "truth", ALPHAS)
    return r.select("alpha", *(F.round(c, 6).alias(c) for c in r.columns if c != "alpha"))


@query(_P + "SELECT s AS section_id, count(*) AS n, round(avg(correct::INT), 6) AS recall FROM v JOIN c USING (vec_id) GROUP BY s HAVING count(*) >= 10")
def recall_by_section(spark: SparkSession, sf: str) -> DataFrame:
    r = reports.recall_by(scored(spark, sf).withColumn("section_id", F.col("vec_id") % 4), "section_id", "correct")
    return r.withColumn("recall", F.round("recall", 6))


@query(_W + """, q AS (SELECT doc, k, sum(ww * p) / sum(ww) AS q FROM x JOIN p USING (vec_id) GROUP BY doc, k),
n AS (SELECT doc, k, greatest(q, 1e-9) / sum(greatest(q, 1e-9)) OVER (PARTITION BY doc) AS p FROM q),
o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY p DESC, k) AS rn FROM n),
z AS (SELECT doc, max(CASE WHEN rn = 1 THEN k END) AS label, max(CASE WHEN rn = 1 THEN p END) AS confidence, max(CASE WHEN rn = 1 THEN p END) - max(CASE WHEN rn = 2 THEN p END) AS gap, count(*) FILTER (1.0 - p <= 0.8) AS size FROM o GROUP BY doc)
SELECT doc, label, round(confidence, 6) AS confidence, greatest(size, 1) AS set_size, size <> 1 AS routed, CASE WHEN size <> 1 THEN CASE WHEN confidence < 0.4 THEN 'LOW_CONFIDENCE' WHEN gap < 0.1 THEN 'TIGHT_GAP' ELSE 'SET' END END AS flag FROM z""")
def routed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks to documents to sets to a routing decision."""
    bank = spark.createDataFrame([(0.1, 100, 0.8), (0.3, 100, 0.5)], "alpha double, n long, qhat double")
    r = reports.route_documents(weighted(spark, sf), "doc", bank, 0.12)
    return r.select("doc", "label", F.round("confidence", 6).alias("confidence"), F.size("set").cast("long").alias("set_size"), "routed", "flag")


@query("SELECT string_agg(rn || '. ' || r_name || ': ' || r_regionkey, chr(10) ORDER BY rn) AS scope FROM (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS rn FROM region)")
def scope_prompt(spark: SparkSession, sf: str) -> DataFrame:
    r = spark.read.parquet(f"{sf}/region.parquet").withColumn("d", F.col("r_regionkey").cast("string"))
    return reports.scope_text(r, "r_name", "d", "r_regionkey")
