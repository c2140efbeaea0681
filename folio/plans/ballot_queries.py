"""Sets over ragged label spaces and routing policies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import ballots as B
from folio.operators import conformal
from folio.operators import relational as R
from folio.plans import model_queries as M

#: Groups of different size that share label 0; a label's home is its first group.
BALLOTS = [(0, 0), (0, 1), (0, 2), (1, 3), (1, 4), (2, 5), (2, 0)]
HOME = {k: min(g for g, x in BALLOTS if x == k) for k in range(M.CLASSES)}

_VALUES = ", ".join(map(str, BALLOTS))
_HOME = "CASE truth " + " ".join(f"WHEN {k} THEN {g}" for k, g in HOME.items()) + " END"
_QHAT = "SELECT {0}, n, CASE WHEN ceil((n + 1) * 0.9::DOUBLE) > n THEN 'infinity'::DOUBLE ELSE max(s) FILTER (i = least(ceil((n + 1) * 0.9::DOUBLE), n - 1) + 1) END AS qhat FROM {1} GROUP BY {0}, n"

_RAGGED = M._P + f""", ballot(grp, k) AS (VALUES {_VALUES}),
b AS MATERIALIZED (SELECT vec_id, truth, grp, k, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id, grp) AS p FROM l JOIN ballot USING (k)),
s AS (SELECT grp, s, row_number() OVER (PARTITION BY grp ORDER BY s) AS i, count(*) OVER (PARTITION BY grp) AS n FROM (SELECT grp, 1.0 - p AS s FROM b WHERE k = truth AND grp = {_HOME} AND {M._CAL})),
t AS MATERIALIZED ({_QHAT.format("grp", "s")}),
g AS MATERIALIZED (SELECT vec_id, truth, grp, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM (SELECT vec_id, truth, grp, sum(exp(z)) AS e FROM l JOIN ballot USING (k) GROUP BY vec_id, truth, grp)),
gs AS (SELECT 0 AS one, s, row_number() OVER (ORDER BY s) AS i, count(*) OVER () AS n FROM (SELECT 1.0 - p AS s FROM g WHERE grp = {_HOME} AND {M._CAL})),
gq AS ({_QHAT.format("one", "gs")}),
gr AS (SELECT *, row_number() OVER w AS r, max(p) OVER (PARTITION BY vec_id) AS best, nth_value(p, 2) OVER (PARTITION BY vec_id ORDER BY p DESC, grp ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM g WHERE NOT ({M._CAL}) WINDOW w AS (PARTITION BY vec_id ORDER BY p DESC, grp)),
cand AS MATERIALIZED (SELECT 'all' AS policy, vec_id, grp FROM gr UNION ALL SELECT 'top', vec_id, grp FROM gr WHERE r = 1 UNION ALL SELECT 'borderline', vec_id, grp FROM gr WHERE r = 1 OR r = 2 AND (best < 0.5 OR best - second < 0.1)
  UNION ALL SELECT 'set', vec_id, grp FROM gr WHERE r = 1 OR 1.0 - p <= (SELECT qhat FROM gq)),
u AS (SELECT cand.policy, cand.vec_id, count(DISTINCT cand.grp) AS n_groups, list_sort(list(DISTINCT b.k) FILTER (b.k IS NOT NULL)) AS found FROM cand LEFT JOIN (SELECT b.* FROM b JOIN t USING (grp) WHERE 1.0 - b.p <= t.qhat) b USING (vec_id, grp) GROUP BY cand.policy, cand.vec_id)
"""

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _ragged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets per policy and item of the test half, thresholds per group, and truths."""
    rows = M.scored(spark, sf).select("vec_id", F.col("truth").cast("int").alias("truth"), "logits")
    logits = rows.select("vec_id", F.posexplode("logits").alias("k", "z"))
    ballots = spark.createDataFrame(BALLOTS, "grp int, k int")
    first = R.shuffled("vec_id", "half") < "8"
    home = F.element_at(F.array(*(F.lit(HOME[k]) for k in range(M.CLASSES))), F.col("truth") + 1)
    truth = rows.select("vec_id", home.alias("grp"), F.col("truth").alias("k"))
    p = B.ballot_probabilities(logits, ballots, "vec_id", "grp", "k", "z")
    thresholds = B.ballot_thresholds(p, truth.where(first), "vec_id", "grp", "k", [0.1])
    # a group's own score: the mass of its labels
    mass = logits.join(ballots, "k").groupBy("vec_id", "grp").agg(F.sum(F.exp("z")).alias("e"))
    groups = mass.join(mass.groupBy("vec_id").agg(F.sum("e").alias("whole")), "vec_id").select("vec_id", "grp", (F.col("e") / F.col("whole")).alias("p"))
    own = groups.join(truth.where(first).select("vec_id", "grp"), ["vec_id", "grp"]).withColumn("own", 1.0 - F.col("p"))
    qhat = conformal.quantiles(own, "own", [0.1]).first()["qhat"]
    candidates = B.policies(groups.where(~first), "vec_id", "grp", "p", 0.5, 0.1, qhat)
    return B.ballot_sets(p, thresholds, candidates, "vec_id", "grp", "k"), thresholds, truth


@query(_RAGGED + "SELECT grp, 0.1::DOUBLE AS alpha, n, round(qhat, 6) AS qhat FROM t")
def ballot_bank(spark: SparkSession, sf: str) -> DataFrame:
    return _ragged(spark, sf)[1].withColumn("qhat", F.round("qhat", 6))


@query(_RAGGED + "SELECT policy, vec_id, n_groups, coalesce(array_to_string(found, ','), '') AS labels FROM u")
def ballot_sets(spark: SparkSession, sf: str) -> DataFrame:
    return _ragged(spark, sf)[0].select("policy", "vec_id", "n_groups", F.array_join(F.transform("set", lambda k: k.cast("string")), ",").alias("labels"))


@query(_RAGGED + """SELECT policy, count(*) AS n, round(avg(coalesce(list_contains(found, truth), false)::INT), 6) AS coverage, round(avg(n_groups), 6) AS groups_read, round(avg(coalesce(len(found), 0)), 6) AS avg_size,
  round(avg((coalesce(len(found), 0) = 1)::INT), 6) AS singleton, round(avg((coalesce(len(found), 0) = 0)::INT), 6) AS empty FROM u JOIN (SELECT DISTINCT vec_id, truth FROM l) x USING (vec_id) GROUP BY policy""")
def routing_policies(spark: SparkSession, sf: str) -> DataFrame:
    sets, _, truth = _ragged(spark, sf)
    r = B.policy_report(sets, truth, "vec_id", "k")
    return r.select("policy", "n", *(F.round(c, 6).alias(c) for c in r.columns if c not in ("policy", "n")))
