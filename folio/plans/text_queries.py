"""Queries over documents and pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import headings as H
from folio.functions import text as T
from folio.operators import chunking, evidence, labelling
from folio.operators import relational as R
from folio.scratch import written
from folio.sources.files import page_sections

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs_of(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


#: SQL: words of a text, and the share of English function words.
_WORDS = r"regexp_extract_all(text, '\S+')"
_ENGLISH = ", ".join(f"'{w}'" for w in T.ENGLISH_WORDS)
_SHARED = f"""
WITH w AS (SELECT doc_id, lang, source, text, len({_WORDS}) AS n_words FROM documents),
t AS (SELECT doc_id, lower(trim(u.x, '.,;:()[]"''')) AS x FROM (SELECT doc_id, unnest({_WORDS}) AS x FROM documents) u),
s AS (SELECT doc_id, avg(CASE WHEN x IN ({_ENGLISH}) THEN 1.0 ELSE 0.0 END) AS share FROM t GROUP BY doc_id),
d AS (SELECT w.*, s.share, CASE WHEN n_words < 20 THEN 'short' WHEN share < 0.08 THEN 'not_english' END AS warning FROM w LEFT JOIN s USING (doc_id))
"""


@query(_SHARED + """
SELECT lang, source, count(*) AS n_docs, CAST(sum(n_words) AS BIGINT) AS n_words, count(*) FILTER (n_words <= 350) AS n_paragraphs,
  count(*) FILTER (warning = 'short') AS n_short, count(*) FILTER (warning = 'not_english') AS n_not_english,
  CAST(sum(CASE WHEN n_words = 0 THEN 0 WHEN n_words <= 200 THEN 1 ELSE ceil((n_words - 200) / 160.0) + 1 END) AS BIGINT) AS n_chunks
FROM d GROUP BY lang, source""")
def document_overview(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: per language and source, sizes, types, warnings and chunks."""
    d = docs_of(spark, sf).select("lang", "source", T.word_count(F.col("text")).alias("n"), T.input_warning(F.col("text")).alias("warning"))
    return d.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_words"), F.count_if(F.col("n") <= 350).alias("n_paragraphs"),
        F.count_if(F.col("warning") == "short").alias("n_short"), F.count_if(F.col("warning") == "not_english").alias("n_not_english"),
        F.sum(F.size(chunking.windows(F.col("n")))).alias("n_chunks"),
    )


@query(r"""
SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS clean_md5,
  md5(substring(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'), 1, 160)) AS key_md5, len(regexp_extract_all(text, '\S+')) AS n_words
FROM documents""")
def clean_texts(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return docs_of(spark, sf).select("doc_id", F.md5(T.clean(t)).alias("clean_md5"), F.md5(T.norm_key(t)).alias("key_md5"), T.word_count(t).cast("long").alias("n_words"))


@query(_SHARED + "SELECT doc_id, round(share, 6) AS share, warning FROM d")
def input_warnings(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return docs_of(spark, sf).select("doc_id", F.round(T.english_share(t), 6).alias("share"), T.input_warning(t).alias("warning"))


@query(r"""
WITH l AS (SELECT doc_id, trim(u.x) AS x, u.o FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(x, o)),
m AS (SELECT *, len(regexp_extract_all(x, '\S+')) AS n FROM l WHERE x <> '')
SELECT d.doc_id, coalesce((SELECT arg_min(x, o) FROM m WHERE m.doc_id = d.doc_id AND n BETWEEN 3 AND 25 AND NOT ends_with(x, '.')),
  (SELECT CASE WHEN arg_min(n, o) <= 30 THEN substring(arg_min(x, o), 1, 200) END FROM m WHERE m.doc_id = d.doc_id)) AS title FROM documents d""")
def guessed_titles(spark: SparkSession, sf: str) -> DataFrame:
    return docs_of(spark, sf).select("doc_id", T.guess_title(F.col("text")).alias("title"))


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents),
c AS (SELECT doc_id, w, len(w) AS n, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 200 THEN 1 ELSE CAST(ceil((len(w) - 200) / 160.0) AS INT) + 1 END AS m FROM w),
s AS (SELECT doc_id, w, n, unnest(range(m)) AS k FROM c)
SELECT doc_id, CAST(k AS INT) AS chunk_index, CAST(least(k * 160 + 200, n) - k * 160 AS INT) AS n_words, md5(array_to_string(w[k * 160 + 1 : least(k * 160 + 200, n)], ' ')) AS text_md5 FROM s""")
def window_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.window_chunks(docs_of(spark, sf), "doc_id").select("doc_id", "chunk_index", "n_words", F.md5("text").alias("text_md5"))


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A condition on ``k`` in the other engine's patterns, which know no lookahead."""
    parts = {r"\bsummary\b(?!\s+of\s+contributions)": r"(len(regexp_extract_all(k, '\bsummary\b')) > len(regexp_extract_all(k, '\bsummary\s+of\s+contributions')))", r"\bsurvey\b(?! (data|respondents))": r"(len(regexp_extract_all(k, '(?i)\bsurvey\b')) > len(regexp_extract_all(k, '(?i)\bsurvey (data|respondents)')))"}
    found = []
    for special, sql in parts.items():
        if special in pattern:
            found.append(sql)
            pattern = pattern.replace("|" + special, "").replace(special + "|", "")
    return "(" + " OR ".join([f"regexp_matches(k, {quoted(pattern)})", *found]) + ")"


def key_sql(heading: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({heading})), '[\s#*_]*$', ''), '^[\s#*_]*(?:\d+[.):]?\s*)*', ''), '[^a-z\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


#: SQL: the canonical section of a heading whose key is ``k``.
SECTION_SQL = "CASE WHEN k = '' THEN 'other' " + " ".join(f"WHEN {re2(p)} THEN '{s}'" for s, p in T.SECTION_PATTERNS) + " ELSE 'other' END"
STRUCTURAL_SQL = "(" + ", ".join(f"'{s}'" for s in T.STRUCTURAL_SECTIONS) + ")"
BLANK_SQL = "' ' || chr(9) || chr(10) || chr(13)"


def tidy_sql(t: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '(\w)-\n(\w)', '\1\2', 'g'), '(?im)^[ \t]*({T.LEAD_INS})\s*[-—–:.]+[ \t]*', '\1' || chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {BLANK_SQL})"


def lines_sql(texts: str, key: str) -> str:
    """CTEs from ``texts``, a table (key, t): ``l`` its lines (o, x) with the heading h that each is, or null."""
    return rf"""
l0 AS (SELECT {key}, u.x AS x, u.o AS o, trim(regexp_extract(u.x, {quoted(H._LINE)}, 1)) AS hd FROM {texts}, unnest(string_split(coalesce(t, ''), chr(10))) WITH ORDINALITY AS u(x, o)),
l AS (SELECT {key}, x, o, CASE WHEN hd <> '' AND len(regexp_extract_all(hd, '\S+')) <= 9 AND NOT regexp_matches(hd, '[.,;:]$') AND regexp_matches(hd, '[A-Za-z]{{3,}}') AND NOT regexp_matches(hd, {quoted(H.CAPTION)})
  AND (regexp_matches({key_sql('hd')}, {quoted(H.STRICT_NAMES)}) OR regexp_matches(hd, {quoted(H.NUMBERED)}) OR regexp_matches(hd, {quoted(H._CAPITALS)})) THEN hd END AS h FROM l0)"""


def parts_sql(key: str, lead: str = "'abstract'") -> str:
    """CTEs from ``l``: ``s`` the sections (i, heading, section, body) between its headings, empty ones too."""
    return f"""
n AS (SELECT *, count(h) OVER (PARTITION BY {key} ORDER BY o) AS i FROM l),
p AS (SELECT {key}, i, max(h) AS heading, trim(coalesce(string_agg(x, chr(10) ORDER BY o) FILTER (h IS NULL), ''), {BLANK_SQL}) AS body FROM n GROUP BY {key}, i),
k AS (SELECT *, {key_sql("coalesce(heading, '')")} AS k FROM p), s AS (SELECT {key}, i, heading, body, CASE WHEN i = 0 THEN {lead} ELSE {SECTION_SQL} END AS section FROM k)"""


def type_sql(t: str, n_structural: str) -> str:
    """The type of a text, and behind it ``confidence``, as a struct."""
    words, refs, abstract = rf"len(regexp_extract_all({t}, '\S+'))", f"regexp_matches({t}, {quoted(T.REFERENCES_LINE)})", f"regexp_matches({t}, {quoted(T.ABSTRACT_LINE)})"
    score = f"((CASE WHEN {abstract} AND {refs} THEN 25 WHEN {refs} THEN 10 ELSE 0 END + CASE WHEN len(regexp_extract_all({t}, {quoted(T.CITATION)})) / greatest(1.0::DOUBLE, {words} / 1000.0::DOUBLE) >= 5 THEN 20 ELSE 0 END + CASE WHEN {words} > 3000 THEN 5 ELSE 0 END) / 100.0::DOUBLE)"
    return f"CASE WHEN {n_structural} >= {T.PAPER_SECTIONS} THEN 'paper' WHEN {words} <= {T.PARAGRAPH_WORDS} THEN 'paragraph' WHEN {score} >= {T.PAPER_SCORE} THEN 'paper' ELSE 'article' END"


def markdown_sql(html: str) -> str:
    x = html
    for tag in ("script", "style", "head"):
        x = rf"regexp_replace({x}, '(?is)<{tag}\b.*?</{tag}>', ' ', 'g')"
    for level in range(1, 7):
        x = rf"regexp_replace({x}, '(?is)<h{level}\b[^>]*>(.*?)</h{level}>', chr(10) || '{'#' * level} \1' || chr(10), 'g')"
    x = rf"regexp_replace({x}, '(?i)</?(p|div|li|ul|ol|br|tr|table|section|article|nav|body|html)\b[^>]*>', chr(10), 'g')"
    x = rf"regexp_replace({x}, '(?s)<[^>]*>', '', 'g')"
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', {quoted(mark)})"
    return rf"trim(regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'))"


_PAGES_SQL = rf"""
WITH d AS (SELECT page_id, {markdown_sql('html')} AS t FROM pages), l AS (SELECT page_id, u.x AS x, u.o AS o, nullif(regexp_extract(u.x, '^#{{1,6}}\s+(.*\S)\s*$', 1), '') AS h FROM d, unnest(string_split(coalesce(t, ''), chr(10))) WITH ORDINALITY AS u(x, o)), {parts_sql('page_id')}"""


@query()
def article_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.article_chunks(docs_of(spark, sf), "doc_id").select("doc_id", "chunk_index", "n_words", F.md5("text").alias("text_md5"))


@query(_PAGES_SQL + " SELECT page_id, i AS section_index, coalesce(heading, '') AS heading, section, CAST(length(body) AS INT) AS n_chars FROM s")
def markdown_page_sections(spark: SparkSession, sf: str) -> DataFrame:
    return page_sections(spark.read.parquet(f"{sf}/pages.parquet")).select("page_id", "section_index", "heading", "section", F.length("body").alias("n_chars"))


@query(_PAGES_SQL + rf""", w AS (SELECT page_id, i, section, len(regexp_extract_all(body, '\S+')) AS n FROM s),
c AS (SELECT *, CASE WHEN n <= {chunking.SECTION_MOST} THEN 1 ELSE CAST(ceil((n - 200) / 160.0) AS INT) + 1 END AS m FROM w WHERE n > 0),
x AS (SELECT page_id, i, section, j, CASE WHEN m = 1 THEN n ELSE least(j * 160 + 200, n) - j * 160 END AS n_words FROM (SELECT *, unnest(range(m)) AS j FROM c)),
y AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i, j) - 1 AS chunk_index, section IN ('references', 'acknowledgements') AS noise FROM x)
SELECT page_id, CAST(chunk_index AS INT) AS chunk_index, section, CAST(n_words AS INT) AS n_words FROM (SELECT *, bool_and(noise) OVER (PARTITION BY page_id) AS alone FROM y) WHERE NOT noise OR alone""")
def section_chunks(spark: SparkSession, sf: str) -> DataFrame:
    sections = page_sections(spark.read.parquet(f"{sf}/pages.parquet"))
    chunks = chunking.classifiable(chunking.section_chunks(sections, "page_id"), "page_id")
    return chunks.select("page_id", "chunk_index", "section", "n_words")


_CUES = ["the", "ing ", "tion", "queau", "xyzzy"]


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{c}') THEN '{c}' END" for c in _CUES) + "], lambda x: x IS NOT NULL), ';') AS cues FROM documents")
def matched_cues(spark: SparkSession, sf: str) -> DataFrame:
    return docs_of(spark, sf).select("doc_id", T.matched_cues(F.col("text"), _CUES).alias("cues"))


_FIELDS = [("tions", 0, r"tion\w*|thing\w*", ["src1", "src2"]), ("hands", 1, r"hand\w*|then\w*", ["src3"]), ("reads", 2, r"ered|ingth\w*", ["src4", "src5"]), ("none", 3, r"zzzz", [])]


@query(r"""
WITH f(field, i, pattern, cats) AS (VALUES """ + ", ".join(f"('{f}', {i}, '{p}', {c or '[]::VARCHAR[]'})" for f, i, p, c in _FIELDS) + r"""),
x AS (SELECT doc_id, field, i, list_contains(cats, source) AS cat, list_distinct(regexp_extract_all(lower(substring(text, 1, 80)), pattern)) AS t, list_distinct(regexp_extract_all(lower(text), pattern)) AS b FROM documents, f),
s AS (SELECT doc_id, field, i, cat, CASE WHEN cat THEN 3.0 ELSE 0.0 END + 2.0 * len(t) + len(list_filter(b, lambda v: NOT list_contains(t, v))) AS s, len(list_distinct(list_concat(t, b))) AS hits FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, i) AS rn, sum(s) OVER (PARTITION BY doc_id) AS total FROM s),
g AS (SELECT a.doc_id, a.field, a.s, a.cat, a.hits, b.field AS runner_up, CASE WHEN a.total > 0 THEN (a.s - b.s) / a.total ELSE 0.0 END AS margin FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.rn = 1 AND b.rn = 2),
v AS (SELECT *, s >= 2 AND (cat OR hits >= 2) AND margin >= 0.2 AS ok FROM g)
SELECT doc_id, CASE WHEN ok THEN field END AS field, CAST(s AS DOUBLE) AS score, round(CAST(margin AS DOUBLE), 6) AS margin, CASE WHEN NOT ok THEN 'none' WHEN cat AND hits > 0 THEN 'both' WHEN cat THEN 'category' ELSE 'keyword' END AS evidence, runner_up FROM v""")
def keyword_fields(spark: SparkSession, sf: str) -> DataFrame:
    items = docs_of(spark, sf).withColumn("title", F.substring("text", 1, 80))
    out = labelling.keyword_labels(items, "doc_id", "title", "text", "source", _FIELDS)
    return out.withColumn("margin", F.round("margin", 6))


@query()
def facet_label_model(spark: SparkSession, sf: str) -> DataFrame:
    """Three regions of each document vote on a facet; the model weighs them.

    The regions are thirds of all words, of 60 words at least: each word is in one.
    """
    d = docs_of(spark, sf).select("doc_id", T.words(F.col("text")).alias("w"))
    size = F.greatest(F.lit(60), F.ceil(F.size("w") / 3).cast("int"))
    regions = [F.array_join(F.slice("w", size * k + 1, size), " ") for k in range(3)]
    votes = d.select("doc_id", *(labelling.facet_vote(r, T.word_count(r), ["tion"], ["queau"]).cast("int").alias(f"v{k}") for k, r in enumerate(regions)))
    return labelling.label_model(votes, ["v0", "v1", "v2"])[0].select("doc_id", F.round("posterior", 6).alias("posterior"))


@query("""
SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text""")
def distinct_texts(spark: SparkSession, sf: str) -> DataFrame:
    return R.keep_first(docs_of(spark, sf).select("doc_id", "text"), ["text"], ["doc_id"]).select("doc_id", F.md5("text").alias("text_md5"))


@query(r"""
WITH k AS (SELECT DISTINCT substring(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'), 1, 160) AS k FROM benchmark)
SELECT doc_id FROM documents WHERE substring(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'), 1, 160) NOT IN (SELECT k FROM k)""")
def uncontaminated(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose opening is not that of a benchmark item."""
    seen = spark.read.parquet(f"{sf}/benchmark.parquet").select(T.norm_key(F.col("text")).alias("k"))
    return R.without(docs_of(spark, sf).withColumn("k", T.norm_key(F.col("text"))), [seen], "k").select("doc_id")


@query("""
SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY source""")
def language_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return R.crosstab(docs_of(spark, sf), "source", "lang", ["de", "en", "es", "fr"])


@query("""
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '-split'), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM r""")
def language_splits(spark: SparkSession, sf: str) -> DataFrame:
    return R.add_splits(docs_of(spark, sf), ["lang"], "doc_id").select("doc_id", "split")


@query("""
WITH r AS (SELECT doc_id, source, lang, n_chars, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '-0'), doc_id) AS rn FROM documents) SELECT doc_id, source FROM r WHERE rn <= 7""")
def source_sample(spark: SparkSession, sf: str) -> DataFrame:
    return R.sample_per_group(docs_of(spark, sf), ["source"], "doc_id", 7).select("doc_id", "source")


@query("""
WITH r AS (SELECT doc_id, lang, sum(n_chars) OVER (PARTITION BY lang ORDER BY md5(doc_id || '-cap'), doc_id ROWS UNBOUNDED PRECEDING) AS run FROM documents) SELECT doc_id, lang FROM r WHERE run <= 50000""")
def capped_by_size(spark: SparkSession, sf: str) -> DataFrame:
    return R.running_cap(docs_of(spark, sf), ["lang"], "doc_id", "n_chars", 50_000).select("doc_id", "lang")


@query("""
WITH a AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY md5(doc_id || '-rr'), doc_id) AS turn FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY turn, lang) AS rn FROM a) SELECT doc_id, source, lang FROM b WHERE rn <= 9""")
def round_robin_languages(spark: SparkSession, sf: str) -> DataFrame:
    return R.round_robin(docs_of(spark, sf), ["source"], "lang", "doc_id", 9).select("doc_id", "source", "lang")


def quota_sql(rows: str, key: str, target: str, share: float) -> str:
    """The sample of ``rows``, a table (level, g, key): the water level is tried out among all whole numbers."""
    steps = ", ".join(f"({k}, least(1.0::DOUBLE, {m}::DOUBLE * {share}::DOUBLE))" for k, m in enumerate((1.0, 1.5, 2.0))) + ", (3, 0.5::DOUBLE), (4, 0.75::DOUBLE), (5, 1.0::DOUBLE)"
    return f"""
WITH s AS (SELECT level, g, count(*) AS s FROM ({rows}) WHERE level IS NOT NULL AND g IS NOT NULL GROUP BY level, g), w AS (SELECT level, CAST(least({target}, sum(s)) AS BIGINT) AS want FROM s GROUP BY level),
c AS (SELECT level, want, step, greatest(1, CAST(floor(want * x) AS BIGINT)) AS cap FROM w, (VALUES {steps}) v(step, x)), f AS (SELECT level, step FROM s JOIN c USING (level) GROUP BY level, step, want HAVING sum(least(s, cap)) >= want),
l AS (SELECT level, g, least(s, cap) AS l, want FROM s JOIN c USING (level) WHERE (level, step) IN (SELECT level, min(step) FROM f GROUP BY level)),
t AS (SELECT level, want, unnest(range(want + 1)) AS water FROM w), h AS (SELECT level, max(water) AS water FROM (SELECT level, water FROM l JOIN t USING (level) GROUP BY level, water, t.want HAVING sum(least(l, water)) <= t.want) GROUP BY level),
q AS (SELECT level, g, least(l, water) + CASE WHEN l > water AND row_number() OVER (PARTITION BY level, l > water ORDER BY g) <= want - sum(least(l, water)) OVER (PARTITION BY level) THEN 1 ELSE 0 END AS q FROM l JOIN h USING (level)),
p AS (SELECT *, row_number() OVER (PARTITION BY level, g ORDER BY md5({key} || '-quota'), {key}) AS place FROM ({rows}))"""


@query(quota_sql("SELECT doc_id, 0 AS level, lang AS g FROM documents", "doc_id", "120", 0.3) + " SELECT doc_id, g AS lang FROM p JOIN q USING (level, g) WHERE place <= q")
def quota_sample(spark: SparkSession, sf: str) -> DataFrame:
    return R.sample_to_quota(docs_of(spark, sf), "lang", "doc_id", 120, 0.3).select("doc_id", "lang")


@query("""
SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, min(n_chars) AS least, median(n_chars) AS middle, max(n_chars) AS most, round(quantile_cont(n_chars, 0.95), 4) AS p95 FROM documents GROUP BY lang""")
def size_by_language(spark: SparkSession, sf: str) -> DataFrame:
    d = docs_of(spark, sf)
    sizes = d.groupBy("lang").agg(F.min("n_chars").alias("least"), F.median("n_chars").alias("middle"), F.max("n_chars").alias("most"), F.round(F.percentile("n_chars", 0.95), 4).alias("p95"))
    return R.value_counts(d, "lang").join(sizes, "lang").withColumn("share", F.round("share", 6))


@query("""
SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS n_turns, count(DISTINCT role) AS n_roles, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id""")
def conversation_texts(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    return c.groupBy("conv_id").agg(R.ordered_concat("text", "turn").alias("text"), F.count(F.lit(1)).alias("n_turns"), F.count_distinct("role").alias("n_roles"), F.min_by("role", "turn").alias("first_role"))


@query("WITH d AS (SELECT doc_id, text AS t FROM documents), " + lines_sql("d", "doc_id") + ", k AS (SELECT doc_id, " + key_sql("h") + f""" AS k FROM l WHERE h IS NOT NULL),
c AS (SELECT doc_id, count(DISTINCT section) AS n FROM (SELECT doc_id, {SECTION_SQL} AS section FROM k) WHERE section IN {STRUCTURAL_SQL} GROUP BY doc_id),
e AS (SELECT doc_id, coalesce(t, '') AS t, CAST(coalesce(n, 0) AS INT) AS n_structural FROM d LEFT JOIN c USING (doc_id)) SELECT doc_id, n_structural, """ + type_sql("t", "n_structural") + " AS doc_type FROM e")
def document_types(spark: SparkSession, sf: str) -> DataFrame:
    return H.typed(docs_of(spark, sf)).select("doc_id", "n_structural", "doc_type")


@query()
def quality_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out predictions of the quality label by words and word pairs."""
    from folio.plans.baselines import fit_baseline

    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").cast("double").alias("label"))
    # read by each pass of the fit
    rows = written(R.add_splits(docs_of(spark, sf).join(labels, "doc_id"), ["label"], "doc_id", 0.8, 0.0).select("doc_id", "text", "label", "split"), "labelled")
    model = fit_baseline(rows.where("split = 'train'"), "nb")
    return model.transform(rows.where("split = 'test'")).select("doc_id", "label", "prediction")
