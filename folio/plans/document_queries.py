"""Queries of structured documents: raw texts, styled paragraphs and typeset lines, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import documents
from folio.plans.text_queries import SECTION_SQL, STRUCTURAL_SQL, docs_of, key_sql, lines_sql, parts_sql, tidy_sql, type_sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def headed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a title line, a lead and two heading lines set before them, and one behind."""
    before = F.concat(F.lit("On number "), F.col("doc_id").cast("string"), F.lit(" of many\n\nabstract: pro-\nposed\n2. Methods\n"))
    return docs_of(spark, sf).select("doc_id", F.concat(before, F.coalesce("text", F.lit("")), F.lit("\nRESULTS\nnone\nReferences\n[1] one")).alias("text"))


_HEADED = "(SELECT doc_id, 'On number ' || doc_id || ' of many' || chr(10) || chr(10) || 'abstract: pro-' || chr(10) || 'posed' || chr(10) || '2. Methods' || chr(10) || coalesce(text, '') || chr(10) || 'RESULTS' || chr(10) || 'none' || chr(10) || 'References' || chr(10) || '[1] one' AS t FROM documents)"


@query(rf"""WITH d AS (SELECT doc_id, {tidy_sql("t")} AS t FROM {_HEADED}), {lines_sql("d", "doc_id")}, {parts_sql("doc_id")},
g AS (SELECT doc_id, s.*, len(regexp_extract_all(t, '\S+')) > 400 AS long FROM (SELECT doc_id, max(i) AS headings, count(*) FILTER (body <> '') AS n, count(DISTINCT section) FILTER (body <> '' AND section IN {STRUCTURAL_SQL}) AS distinct_n, string_agg(section, ',' ORDER BY i) FILTER (body <> '') AS names FROM s GROUP BY doc_id) s JOIN d USING (doc_id)),
e AS (SELECT d.doc_id, t, CASE WHEN long AND headings > 0 THEN n ELSE 0 END AS n_sections, CASE WHEN long AND headings > 0 THEN distinct_n ELSE 0 END AS n_structural, CASE WHEN long AND headings > 0 THEN names ELSE '' END AS sections FROM d JOIN g USING (doc_id)),
v AS (SELECT *, {type_sql("t", "n_structural")} AS doc_type FROM e)
SELECT doc_id, CASE WHEN doc_type <> 'paragraph' THEN 'On number ' || doc_id || ' of many' END AS title, md5(t) AS text_md5, n_sections, CAST(n_structural AS INT) AS n_structural, sections, doc_type FROM v""")
def parsed_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Raw texts as documents: tidied, typed, cut at heading lines if long."""
    d = documents.from_texts(headed(spark, sf), "doc_id")
    names = F.array_join(F.transform("sections", lambda x: x["section"]), ",")
    return d.select("doc_id", "title", F.md5("text").alias("text_md5"), F.size("sections").cast("long").alias("n_sections"), "n_structural", names.alias("sections"), "doc_type")


@query(rf"""WITH p AS (SELECT conv_id, turn, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS t, CASE WHEN turn = 0 THEN 'title' WHEN role = 'user' THEN 'heading' ELSE 'body' END AS style FROM conversations), q AS (SELECT * FROM p WHERE t <> ''),
f AS (SELECT conv_id, min(turn) AS first FROM q WHERE style = 'title' GROUP BY conv_id), r AS (SELECT q.* FROM q LEFT JOIN f USING (conv_id) WHERE first IS NULL OR turn <> first),
n AS (SELECT *, count(*) FILTER (style = 'heading') OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM r),
s AS (SELECT conv_id, i, max(t) FILTER (style = 'heading') AS h, coalesce(string_agg(t, chr(10) ORDER BY turn) FILTER (style <> 'heading'), '') AS body FROM n GROUP BY conv_id, i),
k AS (SELECT *, {key_sql("coalesce(h, '')")} AS k FROM s), z AS (SELECT conv_id, count(*) AS n_sections, sum(length(body))::BIGINT AS n_chars, count(DISTINCT section) FILTER (section IN {STRUCTURAL_SQL}) AS n_structural FROM (SELECT conv_id, body, CASE WHEN i = 0 THEN 'other' ELSE {SECTION_SQL} END AS section FROM k) WHERE body <> '' GROUP BY conv_id),
x AS (SELECT conv_id, arg_min(t, turn) FILTER (style = 'title') AS title, {tidy_sql("string_agg(t, chr(10) || chr(10) ORDER BY turn)")} AS t FROM q GROUP BY conv_id)
SELECT conv_id, md5(title) AS title_md5, md5(t) AS text_md5, coalesce(n_sections, 0) AS n_sections, coalesce(n_chars, 0) AS n_chars, {type_sql("t", "coalesce(n_structural, 0)")} AS doc_type FROM x LEFT JOIN z USING (conv_id)""")
def styled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as styled paragraphs: the first turn is the title, a user's turns are headings."""
    style = F.when(F.col("turn") == 0, "Title").when(F.col("role") == "user", "Heading 2").otherwise("Normal")
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", F.col("turn").alias("place"), style.alias("style"), "text")
    d = documents.from_paragraphs(turns, "conv_id")
    chars = F.aggregate("sections", F.lit(0).cast("long"), lambda a, x: a + F.length(x["body"]))
    return d.select("conv_id", F.md5("title").alias("title_md5"), F.md5("text").alias("text_md5"), F.size("sections").cast("long").alias("n_sections"), chars.alias("n_chars"), "doc_type")


def typeset_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as typeset lines of eight words: the first large, every fifth a little larger, three bold named ones."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+"), F.lit(0))
    line = lambda i: F.struct((i / 40).cast("int").alias("page"), (3 * i).alias("line"), F.when(i == 0, 20.0).when(i % 5 == 3, 12.0).otherwise(10.0).alias("size"), F.lit(False).alias("bold"), F.array_join(F.slice("w", i * 8 + 1, 8), " ").alias("text"))
    named = F.array(*(F.struct(F.lit(0).alias("page"), F.lit(at).alias("line"), F.lit(10.0).alias("size"), F.lit(True).alias("bold"), F.lit(name).alias("text")) for at, name in ((7, "Abstract"), (16, "3. Methods"), (25, "RESULTS"))))
    every = F.concat(F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / 8).cast("int") - 1), line), F.when(F.col("doc_id") % 2 == 0, named).otherwise(F.slice(named, 1, 1)))
    return docs_of(spark, sf).select("doc_id", words.alias("w")).where(F.size("w") > 0).select("doc_id", F.inline(every))


@query()
def typeset_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Typeset documents cut at their outlines, or at heading lines where those tell more."""
    d = documents.from_lines(typeset_lines(spark, sf), "doc_id")
    rows = d.select("doc_id", "title", "n_structural", "doc_type", F.posexplode_outer("sections").alias("section_index", "_s")).where("section_index IS NOT NULL")  # one pass: a join, or the filter that Spark puts before a plain explode, would make the documents twice
    return rows.select("doc_id", F.col("section_index").cast("long").alias("section_index"), "_s.heading", "_s.section", F.md5("_s.body").alias("body_md5"), F.md5("title").alias("title_md5"), "n_structural", "doc_type")
