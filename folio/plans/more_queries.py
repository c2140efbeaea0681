"""Queries of the rules, samples, pooling and report operators, with their SQL.

Texts, ids and labels come from the driver's tables; where a rule needs wording that
their prose lacks, a phrase chosen by the row's id stands before the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import headings as H
from folio.functions import text as T
from folio.functions import vectors as V
from folio.operators import chunking, conformal, evidence, labelling, metrics, scoring
from folio.operators import relational as R
from folio.plans import model_queries as M
from folio.plans import reports
from folio.plans.text_queries import docs_of, lines_sql, parts_sql, quota_sql, quoted, re2

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def pick(phrases: list[str], by: str = "doc_id") -> Column:
    """The phrase that a row's id chooses."""
    return F.element_at(F.array(*(F.lit(x) for x in phrases)), (F.col(by) % len(phrases) + 1).cast("int"))


def pick_sql(phrases: list[str], by: str = "doc_id") -> str:
    return "[" + ", ".join(map(quoted, phrases)) + f"][{by} % {len(phrases)} + 1]"


# --- texts ---


@query(rf"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(\w)-\n(\w)', '\1\2', 'g'), '(?im)^[ \t]*({T.LEAD_INS})\s*[-—–:.]+[ \t]*', '\1' || chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS tidy_md5
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Index Terms' || chr(8212) || text WHEN doc_id % 3 = 1 THEN 'abstract: pro-' || chr(10) || 'posed' || chr(10) || chr(10) || chr(10) || text ELSE text END AS t FROM documents)""")
def tidy_texts(spark: SparkSession, sf: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Index Terms—"), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("abstract: pro-\nposed\n\n\n"), "text")).otherwise(F.col("text"))
    return docs_of(spark, sf).select("doc_id", F.md5(T.tidy(t)).alias("tidy_md5"))


_NAMES = ["Pretraining", "Author's Contributions", "Methodology", "References", "Data Availability", "Ablation Study", "Summary of Contributions", "Executive Summary", "Threats to Validity", "Related Works", "Problem Formulation", "Zebra", "Organization of the Paper", "Future Work"]


@query(rf"""WITH h AS (SELECT doc_id, (doc_id % 9 + 1) || '. ' || {pick_sql(_NAMES)} || ' ' || coalesce(regexp_extract(text, '\S+'), '') AS heading FROM documents),
k AS (SELECT doc_id, heading, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(heading)), '[\s#*_]*$', ''), '^[\s#*_]*(?:\d+[.):]?\s*)*', ''), '[^a-z\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS k FROM h)
SELECT doc_id, CASE WHEN k = '' THEN 'other' """ + " ".join(f"WHEN {re2(p)} THEN '{s}'" for s, p in T.SECTION_PATTERNS) + " ELSE 'other' END AS section FROM k")
def normalised_headings(spark: SparkSession, sf: str) -> DataFrame:
    heading = F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.lit(". "), pick(_NAMES), F.lit(" "), F.regexp_extract(F.coalesce("text", F.lit("")), r"\S+", 0))
    return docs_of(spark, sf).select("doc_id", T.normalise_heading(heading).alias("section"))


_REMARKS = ["SIAM J. Comput.", "Logical Methods in Computer Science", "Bernoulli", "L@S workshop", "code will be available soon", "survey data only", "a survey of fields", "Winter Simulation 2020", "chi squared", "position paper", "Industrial Track", "demo paper", "DIS 2021", "nothing"]


@query(f"WITH t AS (SELECT doc_id, trim(regexp_replace({pick_sql(_REMARKS)} || ' ' || coalesce(text, '') || ' || ' || coalesce(source, ''), '\\s+', ' ', 'g')) AS k FROM documents) SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {re2(p)} THEN '{n}' END" for n, p in evidence.SIGNALS.items()) + "], lambda x: x IS NOT NULL), ';') AS found FROM t")
def document_signals(spark: SparkSession, sf: str) -> DataFrame:
    flags = evidence.signals(F.concat_ws(" ", pick(_REMARKS), F.coalesce("text", F.lit(""))), F.col("source"))
    return docs_of(spark, sf).select("doc_id", F.array_join(F.filter(F.array(*(F.when(c, n) for n, c in flags.items())), lambda x: x.isNotNull()), ";").alias("found"))


_CLAIMS = ["We present Fast-R2D2, a tool", "improves accuracy by 12%", "12 % of all", "experiments show that", "we prove a regret bound of O(n log n)", "designed and implemented", "speedup of 3x", "provably good", "plain words"]


@query(rf"""WITH t AS (SELECT doc_id, {pick_sql(_CLAIMS)} || ' ' || coalesce(text, '') AS t FROM documents)
SELECT doc_id, regexp_matches(t, {quoted(labelling.NAMED_ARTEFACT)}) OR {" OR ".join(f"contains(lower(t), '{c}')" for c in labelling.IMPLEMENTATION)} AS builds, regexp_matches(t, {quoted(labelling.EXPERIMENTS)}) OR regexp_matches(t, {quoted(labelling.QUANTIFIED_GAIN)}) AS evaluates,
  regexp_matches(t, {quoted(labelling.PROOF)}) OR regexp_matches(t, {quoted(labelling.BIG_O.replace("(?<![A-Za-z])", "(?:^|[^A-Za-z])"))}) AS proves FROM t""")
def extended_facets(spark: SparkSession, sf: str) -> DataFrame:
    found = labelling.extended_evidence(F.concat_ws(" ", pick(_CLAIMS), F.coalesce("text", F.lit(""))))
    return docs_of(spark, sf).select("doc_id", *(c.alias(n) for n, c in found.items()))


@query(r"""WITH i AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lpad((doc_id % 30)::VARCHAR, 2, '0') || '07.' || lpad((doc_id % 100000)::VARCHAR, 5, '0') || 'v' || (doc_id % 4 + 1) WHEN doc_id % 3 = 1 THEN 'cs.AI/' || lpad((doc_id % 100)::VARCHAR, 2, '0') || '01' || lpad((doc_id % 1000)::VARCHAR, 3, '0') ELSE 'https://x.org/abs/' || doc_id || 'v2' END AS id FROM documents),
y AS (SELECT *, regexp_extract(id, '^(\d{2})\d{2}\.\d{4,5}', 1) AS a, regexp_extract(id, '^[a-z\-]+(?:\.[A-Z]{2})?/(\d{2})\d{5}', 1) AS b FROM i)
SELECT doc_id, CAST(CASE WHEN a <> '' THEN 2000 + a::INT WHEN b <> '' THEN b::INT + CASE WHEN b::INT > 50 THEN 1900 ELSE 2000 END END AS INT) AS year, regexp_replace(CASE WHEN contains(substring(id, 1, 4), '/') THEN id ELSE regexp_extract(id, '([^/]*)$', 1) END, 'v\d+$', '') AS bare FROM y""")
def identifier_years(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    new = F.concat(F.lpad((k % 30).cast("string"), 2, "0"), F.lit("07."), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("v"), (k % 4 + 1).cast("string"))
    old = F.concat(F.lit("cs.AI/"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("01"), F.lpad((k % 1000).cast("string"), 3, "0"))
    i = F.when(k % 3 == 0, new).when(k % 3 == 1, old).otherwise(F.concat(F.lit("https://x.org/abs/"), k.cast("string"), F.lit("v2")))
    return docs_of(spark, sf).select("doc_id", T.year_of_id(i).alias("year"), T.norm_id(i).alias("bare"))


@query(r"""SELECT doc_id, TRY_CAST(nullif(regexp_extract(t, '\b((?:19|20)\d\d)\b', 1), '') AS INT) AS year, md5(trim(coalesce(source, '') || '. ' || coalesce(text, ''))) AS joined_md5, CASE WHEN text IS NULL THEN NULL ELSE md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) END AS escaped_md5
FROM (SELECT *, 'in ' || (1880 + doc_id % 170) || ' ' || coalesce(text, '') AS t FROM documents)""")
def text_forms(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("in "), (1880 + F.col("doc_id") % 170).cast("string"), F.lit(" "), F.coalesce("text", F.lit("")))
    return docs_of(spark, sf).select("doc_id", T.first_year(t).alias("year"), F.md5(T.title_and_abstract(F.col("source"), F.col("text"))).alias("joined_md5"), F.md5(T.html_escape(F.col("text"))).alias("escaped_md5"))


@query(r"""SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN '[related work] ' ELSE '' END || CASE WHEN starts_with(lower(text), lower(substring(title, 1, 40))) THEN '' ELSE title || '. ' END || text) AS chunk_md5,
  md5(CASE WHEN starts_with(lower(text), lower(substring(title, 1, 40))) THEN '' ELSE title || '. ' END || text) AS one_md5, regexp_matches(lower(trim(path)), '\.(pdf|docx|doc|md|markdown|txt|tex|rst|html?)$') AND (contains(path, '/') OR contains(path, chr(92)) OR NOT contains(path, ' ')) AS is_path
FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN substring(text, 1, 30) ELSE source END AS title, CASE WHEN doc_id % 2 = 0 THEN 'a b/c.PDF ' ELSE 'my file.txt' END AS path FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)""")
def formatted_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = docs_of(spark, sf).where("text is not null and source is not null").withColumn("title", F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 30)).otherwise(F.col("source")))
    section, path = F.when(F.col("doc_id") % 3 == 0, "related_work").otherwise("body"), F.when(F.col("doc_id") % 2 == 0, "a b/c.PDF ").otherwise("my file.txt")
    return d.select("doc_id", F.md5(T.format_chunk(F.col("text"), section, F.col("title"))).alias("chunk_md5"), F.md5(chunking.paragraph_chunk(F.col("text"), F.col("title"))).alias("one_md5"), T.looks_like_path(path).alias("is_path"))


@query()
def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every document cut as its type asks."""
    d = docs_of(spark, sf).withColumn("title", T.guess_title(F.col("text")))
    return chunking.document_chunks(d, "doc_id").select("doc_id", "doc_type", "chunk_index", "section", "n_words", F.md5("text").alias("text_md5"))


@query(r"""WITH d AS (SELECT doc_id, 'Lead' || chr(10) || 'ABSTRACT' || chr(10) || 'short' || chr(10) || '2. Methods' || chr(10) || coalesce(text, '') || chr(10) || 'References' || chr(10) || '[1] one' AS t FROM documents), """ + lines_sql("d", "doc_id") + ", " + parts_sql("doc_id") + " SELECT doc_id, i AS section_index, heading, section, CAST(length(body) AS INT) AS n_chars FROM s WHERE body <> ''")
def text_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of documents between their heading lines; three are set before each text."""
    t = F.concat(F.lit("Lead\nABSTRACT\nshort\n2. Methods\n"), F.coalesce("text", F.lit("")), F.lit("\nReferences\n[1] one"))
    return H.plain_sections(docs_of(spark, sf).select("doc_id", t.alias("text")), "doc_id").select("doc_id", "section_index", "heading", "section", F.length("body").alias("n_chars"))


@query("""WITH t AS (SELECT p_partkey, string_split_regex(trim(p_type), '\\s+') AS c FROM part), e AS (SELECT p_partkey, lower(unnest(c)) AS x FROM t),
m AS (SELECT * FROM (VALUES ('standard', 'base'), ('small', 'base'), ('tin', 'metal'), ('steel', 'metal'), ('copper', 'metal'), ('polished', 'finish'), ('plated', 'finish')) v(topic, label)),
n AS (SELECT p_partkey, label, count(*) AS n FROM e JOIN m ON x = topic WHERE x <> 'plated' GROUP BY p_partkey, label), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, label) AS rn, lead(n) OVER (PARTITION BY p_partkey ORDER BY n DESC, label) AS next FROM n)
SELECT p.p_partkey, len(t.c) AS n_categories, CASE WHEN r.n > coalesce(r.next, 0) THEN r.label END AS label FROM part p JOIN t USING (p_partkey) LEFT JOIN r ON r.p_partkey = p.p_partkey AND rn = 1""")
def part_topics(spark: SparkSession, sf: str) -> DataFrame:
    """The label of most words of a part's type, none on a tie."""
    mapping = spark.createDataFrame([("standard", "base"), ("small", "base"), ("tin", "metal"), ("steel", "metal"), ("copper", "metal"), ("polished", "finish"), ("plated", "finish")], "topic string, label string")
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", T.split_categories(F.col("p_type")).alias("topics"))
    return evidence.topic_majority(p, "p_partkey", "topics", mapping, ["plated"]).join(p.select("p_partkey", F.size("topics").cast("long").alias("n_categories")), "p_partkey")


# --- samples and joins ---


@query("""WITH c AS (SELECT o_custkey, min(o_orderpriority) AS s FROM orders GROUP BY o_custkey), r AS (SELECT o_custkey, row_number() OVER (PARTITION BY s ORDER BY md5(o_custkey || '-split'), o_custkey) AS rn, count(*) OVER (PARTITION BY s) AS n FROM c),
s AS (SELECT o_custkey, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM r) SELECT o_orderkey, split FROM orders JOIN s USING (o_custkey)""")
def customer_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Orders split by customer: no customer is in two splits."""
    return R.item_splits(spark.read.parquet(f"{sf}/orders.parquet"), "o_custkey", "o_orderpriority").select("o_orderkey", "split")


@query("""WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), k AS (SELECT least(9, greatest(CAST(floor(greatest(median(n) * 3, sum(n) * 0.1)) AS BIGINT), 1)) AS cap FROM c),
r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey || '-fields'), p_partkey) AS rn FROM part) SELECT p_partkey, p_brand FROM r, k WHERE rn <= cap""")
def capped_brands(spark: SparkSession, sf: str) -> DataFrame:
    return labelling.cap_fields(spark.read.parquet(f"{sf}/part.parquet"), "p_brand", "p_partkey", 9, 0.1).select("p_partkey", "p_brand")


@query("""WITH t AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH'), p AS (SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('2-HIGH', '5-LOW') AND o_orderkey NOT IN (SELECT o_orderkey FROM t) AND o_orderstatus <> 'F')
SELECT o_orderkey FROM t UNION ALL (SELECT o_orderkey FROM p ORDER BY md5(o_orderkey || '-inject'), o_orderkey LIMIT (SELECT CAST(round_even(count(*) * 0.2, 0) AS BIGINT) FROM t))""")
def injected_tests(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    test, train = o.where("o_orderpriority = '2-HIGH'"), o.where("o_orderstatus = 'F' AND o_orderpriority <> '2-HIGH'")
    return R.inject(train, test, o.where("o_orderpriority IN ('2-HIGH', '5-LOW')"), "o_orderkey").select("o_orderkey")


_ORDER_LEVELS = "SELECT o_orderkey, year(o_orderdate) AS level, o_orderpriority AS g FROM orders"


@query(quota_sql(_ORDER_LEVELS, "o_orderkey", "greatest(1, 350 // (SELECT count(DISTINCT level) FROM s))", 0.4) + " SELECT o_orderkey, CAST(level AS INT) AS year, g AS o_orderpriority FROM p JOIN q USING (level, g) WHERE place <= q")
def quota_by_year(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumn("year", F.year("o_orderdate"))
    return R.quota_per_level(o, "year", "o_orderpriority", "o_orderkey", 350, 0.4).select("o_orderkey", "year", "o_orderpriority")


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def joined_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and labels whose ids are written in different ways."""
    d = docs_of(spark, sf).select(F.concat(F.lit("https://x.org/abs/"), F.col("doc_id").cast("string"), F.lit("v3")).alias("id"), "doc_id", "lang")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.concat(F.col("doc_id").cast("string"), F.lit("v1")).alias("id"), "doc_id", "quality", "toxic")
    return R.join_by_id(d, labels, "id", T.norm_id).where("doc_id = doc_id_right").select("doc_id", "lang", "quality", "toxic")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS marked FROM documents")
def marked_documents(spark: SparkSession, sf: str) -> DataFrame:
    return R.flagged(docs_of(spark, sf), "doc_id", spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1"), "marked").select("doc_id", "marked")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def good_documents(spark: SparkSession, sf: str) -> DataFrame:
    return R.only(docs_of(spark, sf), "doc_id", spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")).select("doc_id", "n_chars")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 5")
def commonest_brands(spark: SparkSession, sf: str) -> DataFrame:
    return R.most_common(spark.read.parquet(f"{sf}/part.parquet"), "p_brand", 5)


_WORDS = [("tions", 0, r"tion\w*", []), ("ers", 1, r"\w*ering|erst\w*", []), ("none", 2, r"zzzz", [])]


@query(r"""WITH f(field, i, pattern) AS (VALUES """ + ", ".join(f"('{f}', {i}, '{p}')" for f, i, p, _ in _WORDS) + r"""),
x AS (SELECT doc_id, field, i, len(list_distinct(list_concat(regexp_extract_all(lower(coalesce(source, '')), pattern), regexp_extract_all(lower(coalesce(text, '')), pattern)))) AS n FROM documents, f),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS rn FROM x) SELECT doc_id, CASE WHEN n > 0 THEN field END AS field, CAST(n AS INT) AS hits FROM r WHERE rn = 1""")
def keyword_votes(spark: SparkSession, sf: str) -> DataFrame:
    return docs_of(spark, sf).select("doc_id", labelling.keyword_vote(F.col("source"), F.col("text"), _WORDS).alias("x")).select("doc_id", "x.*")


@query("""WITH m(category, label, strength, secondary) AS (VALUES """ + ", ".join(f"('{a}', '{b}', {c}::DOUBLE, {repr(d) if d else 'NULL'})" for a, b, c, d in M._MAP) + """),
o AS (SELECT o_orderkey, u.c AS category, u.i - 1 AS i FROM (SELECT o_orderkey, [o_orderpriority, o_orderstatus] AS c FROM orders) x, unnest(x.c) WITH ORDINALITY AS u(c, i)),
j AS (SELECT o_orderkey, CASE WHEN i = 0 THEN 2.0::DOUBLE ELSE 1.0 END AS w, m.* FROM o JOIN m USING (category)),
v AS (SELECT o_orderkey, label, w * strength AS v FROM j UNION ALL SELECT o_orderkey, secondary, w * (1 - strength) * 0.5 FROM j WHERE secondary IS NOT NULL),
s AS (SELECT o_orderkey, k.label, coalesce(sum(v.v), 0) AS v FROM orders CROSS JOIN (VALUES ('hot'), ('warm'), ('cold')) k(label) LEFT JOIN v USING (o_orderkey, label) GROUP BY o_orderkey, k.label)
SELECT o_orderkey, label, round(CASE WHEN sum(v) OVER w > 0 THEN v / sum(v) OVER w ELSE 1 / 3.0::DOUBLE END, 6) AS p FROM s WINDOW w AS (PARTITION BY o_orderkey)""")
def vote_shares(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.array("o_orderpriority", "o_orderstatus").alias("categories"))
    mapping, labels = spark.createDataFrame(M._MAP, "category string, label string, strength double, secondary string"), ["hot", "warm", "cold"]
    shares = labelling.vote_distribution(orders, "o_orderkey", "categories", mapping, labels)
    named = F.inline(F.arrays_zip(F.array(*(F.lit(x) for x in labels)).alias("label"), F.col("p").alias("p")))
    return shares.select("o_orderkey", named).withColumn("p", F.round("p", 6))


# --- scores ---


@query(M._P + "SELECT vec_id, k, round(0.9 * p + 0.1 / 6, 6) AS smoothed, CASE WHEN k = truth THEN 1.0 ELSE 0.0 END AS hot, round(1 / (1 + exp(-z)), 6) AS sigmoid FROM p")
def vector_forms(spark: SparkSession, sf: str) -> DataFrame:
    d = M.scored(spark, sf)
    rows = F.arrays_zip(V.smooth(F.col("probs"), 0.1, 6).alias("smoothed"), V.one_hot(F.col("truth"), 6).alias("hot"), F.transform("logits", V.sigmoid).alias("sigmoid"))
    return d.select("vec_id", F.posexplode(rows).alias("k", "x")).select("vec_id", "k", F.round("x.smoothed", 6).alias("smoothed"), "x.hot", F.round("x.sigmoid", 6).alias("sigmoid"))


@query(M._P + ", g AS (SELECT *, 0.7 * ln(greatest(p, 1e-9)) + 0.3 * ln(CASE k WHEN 0 THEN 0.5::DOUBLE ELSE 0.1 END) AS g FROM p), w AS (SELECT *, exp(g - max(g) OVER (PARTITION BY vec_id)) AS w FROM g) SELECT vec_id, k, round(w / sum(w) OVER (PARTITION BY vec_id), 6) AS p FROM w")
def joint_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    other = F.array(*(F.lit(x) for x in (0.5, 0.1, 0.1, 0.1, 0.1, 0.1)))
    return M.long(M.scored(spark, sf).withColumn("probs", scoring.joint(F.col("probs"), other, 0.3)), "vec_id")


@query(M._P + """, b AS (SELECT vec_id, k, p, p >= 0.15 AS inside, ln(p + 1e-12) AS lp FROM p), m AS (SELECT k, avg(lp) AS m FROM b GROUP BY k),
a AS (SELECT b.*, exp(lp - m - max(lp - m) OVER (PARTITION BY vec_id)) AS a FROM b JOIN m USING (k)), q AS (SELECT *, a / sum(a) OVER (PARTITION BY vec_id) AS q FROM a), z AS (SELECT *, 0.5 * p + 0.5 * q AS s, bool_or(inside) OVER (PARTITION BY vec_id) AS has_any FROM q),
o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY CASE WHEN has_any AND NOT inside THEN -1 ELSE s END DESC, k) AS rn FROM z) SELECT vec_id, k AS label FROM o WHERE rn = 1""")
def arbitrated_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A second opinion, its prior taken out, blended in; only labels in the set may win."""
    d = M.scored(spark, sf)
    prior = scoring.mean_logs(d, "probs", 6)
    inside = F.filter(F.transform("probs", lambda p, k: F.when(p >= 0.15, k)), lambda k: k.isNotNull())
    mixed = V.blend([(F.col("probs"), 0.5), (V.without_prior(F.col("probs"), prior), 0.5)])
    return d.select("vec_id", V.masked_argmax(mixed, inside).alias("label"))


@query(M._W + ", q AS (SELECT doc, k, sum(w * p) / nullif(sum(w), 0) AS a, avg(p) AS b FROM w JOIN p USING (vec_id) WHERE s IN (0, 1) GROUP BY doc, k), n AS (SELECT doc, k, greatest(coalesce(a, b), 1e-9) AS p FROM q) SELECT doc, k, round(p / sum(p) OVER (PARTITION BY doc), 6) AS p FROM n")
def pooled_openings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by their abstract and introduction alone."""
    return M.long(scoring.pool_section(M.weighted(spark, sf), "doc", ["abstract", "introduction"]), "doc")


@query(M._P + "SELECT doc, k, round(max(p), 6) AS p FROM p JOIN c USING (vec_id) GROUP BY doc, k")
def largest_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return M.long(scoring.largest_per_class(M.scored(spark, sf), "doc", 6), "doc")


@query(M._P + """, o AS (SELECT *, CASE s WHEN 2 THEN 1 WHEN 0 THEN 2 WHEN 1 THEN 3 END AS pl FROM c), f AS (SELECT *, min(pl) OVER (PARTITION BY doc) AS first, row_number() OVER (PARTITION BY doc ORDER BY n_words DESC, chunk_index) AS rn FROM o)
SELECT doc, chunk_index, CASE first WHEN 1 THEN 'methods' WHEN 2 THEN 'abstract' WHEN 3 THEN 'introduction' ELSE 'fallback' END AS source FROM f WHERE pl = first OR (first IS NULL AND rn <= 2)""")
def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.read_order(M.scored(spark, sf), "doc").select("doc", "chunk_index", "source")


_WEIGHTS = V.simplex_grid(2, 5)


@query(M._P + ", w AS (SELECT k / 5.0::DOUBLE AS w FROM range(6) t(k)), b AS (SELECT vec_id, truth, k, w, w * p + (1 - w) * CASE WHEN k = 0 THEN 0.5::DOUBLE ELSE 0.1 END AS s FROM p, w), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id, w ORDER BY s DESC, k) AS rn FROM b) SELECT w AS weight, round(avg((k = truth)::INT), 6) AS accuracy FROM o WHERE rn = 1 GROUP BY w")
def blend_search(spark: SparkSession, sf: str) -> DataFrame:
    d = M.scored(spark, sf).withColumn("other", F.array(*(F.lit(x) for x in (0.5, 0.1, 0.1, 0.1, 0.1, 0.1))))
    curve = scoring.blend_curve(d, ["probs", "other"], "truth", _WEIGHTS)
    return curve.select(F.col("weights")[0].alias("weight"), F.round("accuracy", 6).alias("accuracy"))


@query("""WITH g AS (SELECT unnest([""" + ", ".join(repr(x) for x in V.geometric_grid(0.2, 5.0, 12)) + """]::DOUBLE[]) AS t), l AS (SELECT vec_id, label % 6 AS truth, k, t, 4.0 * CAST(embedding[k + 1] AS DOUBLE) / t AS z FROM embeddings, range(6) r(k), g),
s AS (SELECT vec_id, t, truth, max(z) AS m, ln(sum(exp(z))) AS lse, max(CASE WHEN k = truth THEN z END) AS own FROM l GROUP BY vec_id, t, truth), c AS (SELECT t, avg(lse - own) AS nll FROM s GROUP BY t) SELECT round(arg_min(t, nll), 6) AS temperature FROM c""")
def grid_temperature(spark: SparkSession, sf: str) -> DataFrame:
    curve = scoring.temperature_by_grid(M.scored(spark, sf), "logits", "truth", V.geometric_grid(0.2, 5.0, 12))
    return spark.createDataFrame([(round(scoring.fitted_temperature(curve), 6),)], "temperature double")


@query(M._KNN + """, w AS (SELECT query_id, vec_id, exp((sim - max(sim) OVER (PARTITION BY query_id)) / 0.05) AS w FROM k WHERE rank <= 10), l AS (SELECT vec_id, c, 4.0 * CAST(embedding[c + 1] AS DOUBLE) AS z FROM embeddings, range(6) r(c)),
e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM l), t AS (SELECT vec_id, CAST(c AS INT) AS c, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e) SELECT query_id, c AS k, round(sum(w * p) / sum(w), 6) AS p FROM w JOIN t USING (vec_id) GROUP BY query_id, c""")
def soft_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    targets = M.scored(spark, sf).select("vec_id", "probs")
    return M.long(scoring.soft_vote(M._nearest(spark, sf), targets, "vec_id", "probs", 6), "query_id")


@query(M._KNN + """, b AS (SELECT * FROM k WHERE rank <= 10 AND vec_id % 7 <> 0), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY sim DESC, vec_id) AS r FROM b), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS place FROM o WHERE r = 1)
SELECT query_id, vec_id, label, CAST(place AS INT) AS place FROM p WHERE place <= 3""")
def neighbour_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest vector of each of three labels, rows of a barred list left out."""
    found, v = M._nearest(spark, sf), M.vectors_of(spark, sf)
    barred = found.where("vec_id % 7 = 0").select("query_id", "vec_id")
    return scoring.examples(found, v, "vec_id", "label", 3, barred).select("query_id", "vec_id", "label", "place")


# --- sets and reports ---


@query(M._Q + f", t AS (SELECT vec_id, count(*) FILTER (1.0 - p <= (SELECT qhat FROM q WHERE alpha = 0.2)) AS size FROM p WHERE NOT ({M._CAL}) GROUP BY vec_id) SELECT CAST(size AS INT) AS set_size, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM t GROUP BY size")
def set_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return conformal.size_histogram(M._sets(spark, sf, 0.2), "set").withColumn("share", F.round("share", 6))


@query(M._P + "SELECT vec_id, k, round(sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, k ROWS UNBOUNDED PRECEDING) - ((vec_id % 10) / 10.0::DOUBLE) * p, 6) AS score FROM p")
def randomised_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = conformal.aps_randomised(F.col("probs"), (F.col("vec_id") % 10) / 10.0)
    return M.scored(spark, sf).select("vec_id", F.posexplode(s).alias("k", "score")).withColumn("score", F.round("score", 6))


_BALLOTS = [[0, 2, 4], [1, 3, 5]]
_CASCADE = M._P + """, g AS (SELECT vec_id, truth, k % 2 AS g, sum(p) AS gp FROM p GROUP BY vec_id, truth, k % 2),
d AS (SELECT vec_id, truth, truth % 2 AS gt, CASE WHEN max(CASE WHEN g = 0 THEN gp END) >= max(CASE WHEN g = 1 THEN gp END) THEN 0 ELSE 1 END AS gg, list(g ORDER BY g) FILTER (gp >= 0.4) AS gs FROM g GROUP BY vec_id, truth),
u AS (SELECT vec_id, arg_max(k, z) FILTER (k % 2 = 0) AS k0, arg_max(k, z) FILTER (k % 2 = 1) AS k1 FROM p GROUP BY vec_id),
x AS (SELECT d.*, CASE gt WHEN 0 THEN k0 ELSE k1 END AS ideal, CASE gg WHEN 0 THEN k0 ELSE k1 END AS real, k0, k1 FROM d JOIN u USING (vec_id))
"""


def _cascade(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, truth, gt, gg, gs (groups ruled in), under, ideal and real labels."""
    d = M.scored(spark, sf).select("vec_id", "truth", (F.col("truth") % 2).cast("int").alias("gt"), F.array(*(V.total(F.array(*(F.col("probs")[k] for k in own))) for own in _BALLOTS)).alias("gp"), scoring.best_under_each(F.col("logits"), _BALLOTS).alias("under"))
    d = d.withColumn("gg", V.argmax(F.col("gp"))).withColumn("gs", F.filter(F.transform("gp", lambda p, k: F.when(p >= 0.4, k)), lambda k: k.isNotNull()))
    return d.withColumn("ideal", F.element_at("under", F.col("gt") + 1)).withColumn("real", F.element_at("under", F.col("gg") + 1))


@query(_CASCADE + "SELECT gt, count(*) AS n, round(avg((gg = gt)::INT), 6) AS group_accuracy, round(avg((ideal = truth)::INT), 6) AS oracle_accuracy, round(avg((real = truth)::INT), 6) AS end_to_end_accuracy, round(avg(CASE WHEN gg = gt THEN (real = truth)::INT END), 6) AS accuracy_given_group, round(avg((ideal = truth)::INT) - avg((real = truth)::INT), 6) AS cascade_loss FROM x GROUP BY gt")
def cascade_report(spark: SparkSession, sf: str) -> DataFrame:
    r = metrics.cascade_report(_cascade(spark, sf), "gt", "gg", "truth", "ideal", "real", ["gt"])
    return r.select("gt", "n", *(F.round(c, 6).alias(c) for c in r.columns[2:]))


@query(_CASCADE + ", s AS (SELECT *, coalesce(len(gs), 0) AS size, (coalesce(list_contains(gs, 0), false) AND k0 = truth) OR (coalesce(list_contains(gs, 1), false) AND k1 = truth) AS hit FROM x) SELECT count(*) AS n, round(avg(coalesce(list_contains(gs, gt), false)::INT), 6) AS set_coverage, round(avg(hit::INT), 6) AS label_in_candidates, round(avg(size), 6) AS avg_candidates, round(avg((size <> 1)::INT), 6) AS routed, round(avg((size = 0)::INT), 6) AS empty, round(avg((size = 1)::INT), 6) AS singleton, round(avg(CASE WHEN size = 1 THEN hit::INT END), 6) AS singleton_accuracy FROM s")
def routing_report(spark: SparkSession, sf: str) -> DataFrame:
    r = metrics.routing_report(_cascade(spark, sf), "gs", "under", "truth", "gt")
    return r.select("n", *(F.round(c, 6).alias(c) for c in r.columns[1:]))


@query(M._P + "SELECT CASE WHEN predicted = truth THEN 'correct' WHEN predicted = (truth + 1) % 6 THEN 'co_listed' WHEN predicted IN ((truth + 2) % 6, (truth + 3) % 6) THEN 'adjacent' ELSE 'genuine' END AS kind, count(*) AS n FROM v GROUP BY 1")
def error_anatomy(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda k: ((F.col("truth") + k) % 6).cast("int")
    return metrics.error_kinds(M.scored(spark, sf).withColumn("allowed", F.array(t(1))).withColumn("near", F.array(t(2), t(3))), "truth", "predicted", "allowed", "near")


@query(M._P + "SELECT round(avg((confidence >= 0.3)::INT), 6) AS coverage, count(*) FILTER (confidence >= 0.3) AS n, round(avg(CASE WHEN confidence >= 0.3 THEN (predicted = truth)::INT END), 6) AS strict, round(avg(CASE WHEN confidence >= 0.3 THEN (predicted IN (truth, (truth + 1) % 6))::INT END), 6) AS co_listed FROM v")
def abstaining_agreement(spark: SparkSession, sf: str) -> DataFrame:
    d = M.scored(spark, sf).withColumn("said", F.when(F.col("confidence") >= 0.3, F.col("predicted"))).withColumn("allowed", F.array(((F.col("truth") + 1) % 6).cast("int")))
    r = metrics.abstaining_agreement(d, "truth", "said", "allowed")
    return r.select("n", *(F.round(c, 6).alias(c) for c in ("coverage", "strict", "co_listed")))


@query(M._P + "SELECT gap < 0.05 AS ambiguous, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, round(avg(confidence), 6) AS confidence FROM v GROUP BY 1")
def ambiguity_report(spark: SparkSession, sf: str) -> DataFrame:
    r = metrics.breakdown(M.scored(spark, sf).withColumn("ambiguous", F.col("gap") < 0.05), "ambiguous", "correct", "confidence")
    return r.select("ambiguous", "n", F.round("accuracy", 6).alias("accuracy"), F.round("confidence", 6).alias("confidence"))


@query("SELECT label, count(*) AS n, round(avg(((label % 6) = 0)::INT), 6) AS accuracy FROM embeddings GROUP BY label HAVING count(*) >= 10 ORDER BY accuracy, label LIMIT 8")
def weakest_labels(spark: SparkSession, sf: str) -> DataFrame:
    r = metrics.weakest(M.vectors_of(spark, sf).withColumn("correct", F.col("label") % 6 == 0), "label", "correct")
    return r.withColumn("accuracy", F.round("accuracy", 6))


@query(M._P + """, y AS (SELECT v.truth, v.predicted, c.s FROM v JOIN c USING (vec_id)), o AS (SELECT s, count(*) AS n, avg((truth = predicted)::INT) AS po FROM y GROUP BY s),
h AS (SELECT a.s, sum(CAST(a.n AS DOUBLE) * b.n) AS pe FROM (SELECT s, truth AS k, count(*) AS n FROM y GROUP BY s, truth) a JOIN (SELECT s, predicted AS k, count(*) AS n FROM y GROUP BY s, predicted) b ON a.s = b.s AND a.k = b.k GROUP BY a.s) SELECT o.s AS region, n, round(po, 6) AS agreement, round((po - pe / (n * n)) / (1 - pe / (n * n)), 6) AS kappa FROM o JOIN h ON o.s = h.s""")
def region_kappas(spark: SparkSession, sf: str) -> DataFrame:
    r = metrics.kappas(M.scored(spark, sf).withColumn("region", F.col("vec_id") % 4), "truth", "predicted", "region")
    return r.select("region", "n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query(M._P + """, c2 AS (SELECT count(*) FILTER (correct AND truth <> 0) AS b, count(*) FILTER (NOT correct AND truth = 0) AS c FROM v)
SELECT b AS first_only, c AS second_only, round((SELECT least(1.0, 2 * sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2)))) FROM range(0, least(b, c) + 1) t(k)), 6) AS p_value FROM c2""")
def mcnemar_test(spark: SparkSession, sf: str) -> DataFrame:
    d = M.scored(spark, sf).select(F.col("correct").alias("a"), (F.col("truth") == 0).alias("b"))
    r = metrics.mcnemar(d, "a", "b")
    return spark.createDataFrame([(r["first_only"], r["second_only"], round(r["p_value"], 6))], "first_only long, second_only long, p_value double")


@query(M.ORACLES["threshold_sweep"].replace("SELECT low, tight, round(", "SELECT low, tight, (", 1).replace("::INT), 6) AS fire_rate, round(", "::INT)) AS fire_rate, (").replace("END), 6) AS error_recall, round(", "END)) AS error_recall, (").replace("END), 6) AS precision FROM v, t GROUP BY low, tight", "END)) AS precision FROM v, t GROUP BY low, tight HAVING avg((confidence < low OR gap < tight)::INT) <= 0.6 ORDER BY error_recall DESC, precision DESC, low, tight LIMIT 1"))
def threshold_choice(spark: SparkSession, sf: str) -> DataFrame:
    sweep = metrics.threshold_sweep(M.scored(spark, sf), "confidence", "gap", "correct", [0.2, 0.3, 0.4], [0.02, 0.05, 0.1])
    return metrics.best_thresholds(sweep, 0.6)


@query(M.ORACLES["coverage_curve"].replace("SELECT alpha, round(qhat", "SELECT min(alpha) AS alpha FROM (SELECT alpha, round(qhat", 1) + ") WHERE routed <= 0.9")
def budgeted_alpha(spark: SparkSession, sf: str) -> DataFrame:
    fit, test = M._halves(spark, sf)
    curve = reports.coverage_curve(fit, test, "scores", "own", "truth", M.ALPHAS)
    return spark.createDataFrame([(conformal.alpha_for_budget(curve, 0.9),)], "alpha double")


@query(ORACLES["blend_search"].replace("SELECT w AS weight, round(avg((k = truth)::INT), 6) AS accuracy FROM o WHERE rn = 1 GROUP BY w", "SELECT w AS weight, round(avg((k = truth)::INT), 6) AS accuracy FROM o WHERE rn = 1 GROUP BY w ORDER BY accuracy DESC, weight LIMIT 1"))
def smallest_best_weight(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.smallest_best(blend_search(spark, sf), "weight", "accuracy")


@query(r"""SELECT doc_id, decode(from_base64(to_base64(encode(coalesce(source, ''))))) AS decoded, len(string_split_regex(coalesce(lang, ''), '[aeiou]')) AS n_parts, upper(coalesce(source, '')) = coalesce(source, '') AND lower(coalesce(source, '')) <> coalesce(source, '') AS capitals, ltrim('##' || coalesce(source, ''), '#') AS stripped,
  CASE WHEN strpos(substring('abcabc' || coalesce(lang, ''), 3), 'a') > 0 THEN strpos(substring('abcabc' || coalesce(lang, ''), 3), 'a') + 2 ELSE 0 END AS found_at, '{"lang":"' || lang || '","n":' || n_chars || '}' AS as_json, map_extract(map(['x', 'y'], [n_chars, doc_id]), 'y')[1] AS from_map FROM documents""")
def text_primitives(spark: SparkSession, sf: str) -> DataFrame:
    source, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    return docs_of(spark, sf).select(
        "doc_id", F.decode(F.unbase64(F.base64(F.encode(source, "UTF-8"))), "UTF-8").alias("decoded"), F.size(F.split(lang, "[aeiou]")).cast("long").alias("n_parts"), T.all_capitals(source).alias("capitals"), F.ltrim(F.concat(F.lit("##"), source), F.lit("#")).alias("stripped"),
        F.locate("a", F.concat(F.lit("abcabc"), lang), 3).cast("long").alias("found_at"), F.when(F.col("lang").isNotNull() & F.col("n_chars").isNotNull(), F.to_json(F.struct("lang", F.col("n_chars").alias("n")))).alias("as_json"), F.element_at(F.map_from_arrays(F.array(F.lit("x"), F.lit("y")), F.array("n_chars", "doc_id")), "y").alias("from_map"),
    )


_KIND = "CASE WHEN predicted = (truth + 1) % 6 THEN 'co_listed' WHEN predicted IN ((truth + 2) % 6, (truth + 3) % 6) THEN 'adjacent' ELSE 'genuine' END"


@query(M._P + f", k AS (SELECT {_KIND} AS kind, truth, predicted, count(*) AS n FROM v WHERE truth <> predicted GROUP BY 1, 2, 3) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, truth, predicted) AS INT) AS place FROM k) WHERE place <= 3")
def confused_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The commonest confusions of each kind."""
    t = lambda k: ((F.col("truth") + k) % 6).cast("int")
    return metrics.confused_pairs(M.scored(spark, sf).withColumn("allowed", F.array(t(1))).withColumn("near", F.array(t(2), t(3))), "truth", "predicted", "allowed", "near", 3)


@query(M._P + ", b(low, high) AS (VALUES (0.0::DOUBLE, 0.05::DOUBLE), (0.05, 0.15), (0.15, 0.4), (0.4, NULL)) SELECT low, high, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, round(avg(gap), 6) AS mean_margin FROM v JOIN b ON gap >= low AND (high IS NULL OR gap < high) GROUP BY low, high")
def margin_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy by the lead of the best label."""
    bands = metrics.margin_bands(M.scored(spark, sf), "gap", "correct", [0.0, 0.05, 0.15, 0.4])
    return bands.select("low", "high", "n", F.round("accuracy", 6).alias("accuracy"), F.round("mean_margin", 6).alias("mean_margin"))


@query("""
WITH a AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY md5(doc_id || '-rr'), doc_id) AS turn FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY turn, CASE lang WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END, lang) AS rn FROM a) SELECT doc_id, source, lang FROM b WHERE rn <= 7""")
def capped_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Seven documents of each source, in turn by language, two languages before the others."""
    return R.round_robin(docs_of(spark, sf), ["source"], "lang", "doc_id", 7, priority=["fr", "de"]).select("doc_id", "source", "lang")


@query("SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS kinds FROM part GROUP BY p_brand")
def kinds_by_brand(spark: SparkSession, sf: str) -> DataFrame:
    """What each label covers: the categories that map to it."""
    return R.members(spark.read.parquet(f"{sf}/part.parquet"), "p_brand", "p_type").select("p_brand", F.array_join("members", ",").alias("kinds"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 2000 + o_orderkey % 100 END ELSE year(o_orderdate) END AS year FROM orders""")
def submission_years(spark: SparkSession, sf: str) -> DataFrame:
    """Years of first versions; where there is none, of the identifier, which not all orders have."""
    key = F.col("o_orderkey")
    created = F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss")
    version = lambda n, c: F.struct(F.lit(n).alias("version"), c.alias("created"))
    versions = F.when(key % 7 != 0, F.array(version("v1", created), version("v2", F.lit("Mon, 2 Apr 1907 19:18:42 GMT"))))
    name = F.when(key % 2 == 0, F.format_string("%02d05.%05d", key % 100, key % 100_000))
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.coalesce(T.year_of_versions(versions), T.year_of_id(name)).cast("long").alias("year"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus || '|' || replace(o_orderpriority, ' ', '|') WHEN o_orderkey % 3 = 1 THEN o_orderstatus || '|' || o_orderpriority ELSE '' END AS categories FROM orders""")
def order_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Categories that come as one text, as a list, or not at all."""
    key = F.col("o_orderkey")
    given = F.when(key % 3 == 0, F.array(F.concat_ws(" ", "o_orderstatus", "o_orderpriority"))).when(key % 3 == 1, F.array("o_orderstatus", "o_orderpriority"))
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.array_join(T.category_list(given), "|").alias("categories"))


@query(r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '\s+')) >= 20")
def long_enough(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of at least 21 words, by their runs of spaces."""
    return docs_of(spark, sf).where(T.space_runs(F.col("text")) >= 20).select("doc_id")
