"""Structured documents from texts, typeset lines and styled paragraphs.

Every function gives one row per document: key, title, text (tidied), sections (an array
of heading, section, body), n_structural (distinct structural sections), doc_type and
confidence. A document is one row in the end, so its lines are gathered by key; no other
group is. Null texts are empty paragraphs without sections; documents without lines or
paragraphs are absent; rows that repeat a key are one document where lines are gathered,
and stay apart where texts are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import headings as H
from folio.functions import text as T
from folio.operators import layout

#: Raw texts of more words are cut at heading lines, and outlines of fewer structural sections are doubted.
SEGMENTED_WORDS, TRUSTED_SECTIONS = 400, 3
SECTIONS = "array<struct<heading:string,section:string,body:string>>"
COLUMNS = ("title", "text", "sections", "n_structural", "doc_type", "confidence")


def _none() -> Column:
    return F.array().cast(SECTIONS)


def line_sections(text: Column) -> Column:
    """The sections between heading lines; the lead is the abstract; none without a heading."""

    def named(parts: Column) -> Column:
        full = F.filter(parts, lambda x: x["body"] != "")
        rows = F.transform(full, lambda x: F.struct(F.coalesce(x["heading"], F.lit("")).alias("heading"), F.when(x["heading"].isNull(), "abstract").otherwise(T.normalise_heading(x["heading"])).alias("section"), x["body"].alias("body")))
        return F.when(F.size(parts) > 1, rows).otherwise(_none())

    return T.once(H.cut_at_headings(text, lambda x: H.heading_of_line(x).isNotNull(), H.heading_of_line, keep_empty=True), named)


def n_structural(sections: Column) -> Column:
    return F.size(F.array_intersect(F.array_distinct(F.transform(sections, lambda x: x["section"])), F.array(*(F.lit(s) for s in T.STRUCTURAL_SECTIONS))))


def _typed(docs: DataFrame, key: str, guess: Column, from_pdf: bool = False) -> DataFrame:
    """The columns of a document from its title, text and sections; ``guess`` tells who gets a guessed title, by ``_v``."""
    counted = docs.withColumn("n_structural", n_structural(F.col("sections")))
    known = counted.withColumn("_v", T.document_verdict(F.col("text"), F.col("n_structural"), F.lit(True) if from_pdf else None))
    title = F.coalesce(F.when(F.btrim("title") != "", F.col("title")), F.when(guess, T.guess_title(F.col("text"))))
    return known.select(key, title.alias("title"), "text", "sections", "n_structural", F.col("_v.doc_type").alias("doc_type"), F.col("_v.confidence").alias("confidence"))


def from_texts(docs: DataFrame, key: str, text: str = "text", title: str | None = None) -> DataFrame:
    """Documents of raw texts; long ones are cut at their heading lines. Paragraphs get no guessed title."""
    own = F.lit(None).cast("string") if title is None else F.col(title)
    tidy = docs.select(key, own.alias("title"), F.coalesce(T.tidy(F.col(text)), F.lit("")).alias("text"))
    cut = tidy.withColumn("sections", F.when(T.word_count(F.col("text")) > SEGMENTED_WORDS, line_sections(F.col("text"))).otherwise(_none()))
    return _typed(cut, key, F.col("_v.doc_type") != "paragraph")


def from_lines(lines: DataFrame, key: str) -> DataFrame:
    """Documents of typeset lines (key, page, line, size, bold, text), as ``layout`` takes them.

    The text is cut at the outline's headings. If that finds too few structural sections,
    cuts at heading lines replace it, where they find strictly more.
    """
    known = layout.outlined(layout.gathered(lines, key))
    texts = known.withColumn("_t", F.array_join(F.transform("lines", lambda x: x["text"]), "\n")).withColumn("text", T.tidy(F.col("_t"))).withColumn("title", F.when(F.col(key).isNotNull(), F.col("title"))).drop("lines", "_t")
    found = texts.withColumn("_at", H.sections_at(F.col("text"), F.when(F.col(key).isNotNull(), F.col("headings"))))
    doubted = F.when(n_structural(F.col("_at")) < TRUSTED_SECTIONS, line_sections(F.col("text")))
    both = found.withColumn("_lines", doubted)
    better = F.coalesce(n_structural(F.col("_lines")) > n_structural(F.col("_at")), F.lit(False))
    return _typed(both.withColumn("sections", F.when(better, F.col("_lines")).otherwise(F.col("_at"))), key, F.lit(True), from_pdf=True)  # one shuffle of the lines


def from_paragraphs(paragraphs: DataFrame, key: str) -> DataFrame:
    """Documents of styled paragraphs (key, place, style, text) of a word processor.

    The first paragraph of a title style is the title; those of heading styles open
    sections; what comes before the first is section ``other``. Blank paragraphs don't
    count, null styles are body text, equal places follow style and text.
    """
    rows = paragraphs.select(key, "place", F.lower(F.coalesce("style", F.lit(""))).alias("style"), F.btrim("text", F.lit(" \t\n\r")).alias("t")).where("t <> ''")
    docs = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "style", "t"))).alias("_p"))
    docs = docs.withColumn("_at", F.array_position(F.transform("_p", lambda x: x["style"].startswith("title")), F.lit(True)))
    docs = docs.withColumn("_rest", F.filter("_p", lambda x, k: k + 1 != F.col("_at")))
    heads = F.filter(F.transform("_rest", lambda x, k: F.when(x["style"].startswith("heading"), k + 1)), lambda k: k.isNotNull())
    docs = docs.withColumn("_starts", F.concat(F.array(F.lit(0)), heads))

    def part(at: Column, k: Column) -> Column:
        end = F.coalesce(F.try_element_at("_starts", k + 2), F.size("_rest") + 1)
        heading = F.coalesce(F.try_element_at("_rest", F.when(at > 0, at))["t"], F.lit(""))
        body = F.array_join(F.transform(F.slice("_rest", at + 1, end - at - 1), lambda x: x["t"]), "\n")
        return F.struct(heading.alias("heading"), F.when(at == 0, "other").otherwise(T.normalise_heading(heading)).alias("section"), body.alias("body"))

    sections = F.filter(F.transform("_starts", part), lambda x: x["body"] != "")
    text = T.tidy(F.array_join(F.transform("_p", lambda x: x["t"]), "\n\n"))
    title = F.try_element_at("_p", F.when(F.col("_at") > 0, F.col("_at").cast("int")))["t"]
    return _typed(docs.select(key, title.alias("title"), text.alias("text"), sections.alias("sections")), key, F.lit(True))


def section_rows(docs: DataFrame, key: str) -> DataFrame:
    """(key, section_index, heading, section, body), the table that the chunkers take."""
    return docs.select(key, F.posexplode("sections").alias("section_index", "_s")).select(key, F.col("section_index").cast("long").alias("section_index"), "_s.heading", "_s.section", "_s.body")
