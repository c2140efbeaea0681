"""Titles and headings of typeset documents, from the size and weight of their lines.

Lines come from any extractor, a row each: key, page and line (both from 0), size, bold,
text. They are gathered once, a row per document. What is set clearly larger than the
commonest size is a heading, the largest band is the title. Null and blank lines don't
count; ties of the commonest size go to the smaller. Documents without lines are absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import headings as H
from folio.functions import text as T

#: How much larger than the body a title band and a heading have to be.
TITLE_RATIO, HEADING_RATIO = 1.15, 1.08
#: Sizes this close to the title's belong to it.
BAND = 0.5


def gathered(lines: DataFrame, key: str) -> DataFrame:
    """(key, lines): a document's lines by page and line, null texts as empty ones."""
    row = F.struct("page", "line", F.coalesce("text", F.lit("")).alias("text"), F.col("size").cast("double").alias("size"), F.coalesce("bold", F.lit(False)).alias("bold"))
    return lines.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("lines"))


def sizes(own: Column) -> Column:
    """Struct (body, title_size) of the sizes of lines: the commonest size, and the largest where it stands out, else null."""
    def found(own: Column) -> Column:
        starts = F.filter(F.transform(own, lambda x, k: F.when((k == 0) | (x != F.try_element_at(own, F.greatest(k, F.lit(1)))), k + 1)), lambda k: k.isNotNull())

        def runs(starts: Column) -> Column:
            end = lambda k: F.coalesce(F.try_element_at(starts, k + 2), F.size(own) + 1)
            return F.array_max(F.transform(starts, lambda at, k: F.struct((end(k) - at).alias("n"), (-F.try_element_at(own, at)).alias("s"), F.try_element_at(own, at).alias("size"))))["size"]

        top = F.try_element_at(own, F.lit(-1))
        return T.once(T.once(starts, runs), lambda body: F.struct(body.alias("body"), F.when(top > body * TITLE_RATIO, top).alias("title_size")))

    return T.once(F.sort_array(own), found)


def heading_of(text: Column, size: Column, bold: Column, body: Column, title_size: Column) -> Column:
    """The heading that a line is, or opens with; null for others and for lines of the title."""
    lead = F.regexp_extract(text, rf"(?i)^[ \t]*({T.LEAD_INS})\s*[-—–:.]+", 1)
    n = T.word_count(text)
    plain = (n >= 1) & (n <= 9) & ~text.rlike(r"[.,;]$") & text.rlike("[A-Za-z]{3,}") & ~text.rlike(H.CAPTION)
    capitals = (F.upper(text) == text) & (F.lower(text) != text)
    strong = bold & (H.is_strict_name(text) | text.rlike(H.NUMBERED) | capitals)
    large = size >= body * HEADING_RATIO
    heading = F.when(lead != "", lead).when((large | bold) & plain & (large | strong), text)  # nearly all lines are neither
    return F.when(title_size.isNull() | (size < title_size), heading)


def title_of(first_page: Column, title_size: Column) -> Column:
    """The first run of lines at the title's size, of (line, size, text) in order; hyphenated breaks rejoined."""
    def join(so_far: Column, t: Column) -> Column:
        broken = so_far.rlike("-$") & t.rlike(r"^\p{Ll}")
        return F.when(so_far == "", t).when(broken, F.concat(F.regexp_replace(so_far, "-$", ""), t)).otherwise(F.concat_ws(" ", so_far, t))

    def joined(run: Column) -> Column:
        texts = F.transform(run, lambda x: x["text"])
        return T.once(F.trim(F.regexp_replace(F.aggregate(texts, F.lit(""), join), r"\s+", " ")), lambda t: F.when(T.word_count(t).between(2, 40) & t.rlike("[A-Za-z]{3,}"), t))

    def first_run(at_size: Column) -> Column:
        begin = F.array_position(at_size, F.lit(True)).cast("int")
        rest = F.slice(at_size, F.greatest(begin, F.lit(1)), F.size(at_size))
        length = F.array_position(rest, F.lit(False)).cast("int")
        size = F.when(length > 0, length - 1).otherwise(F.size(rest))
        return F.when(begin > 0, joined(F.slice(first_page, begin, size)))

    return T.once(F.transform(first_page, lambda x: x["size"] >= title_size - BAND), first_run)


def outlined(docs: DataFrame) -> DataFrame:
    """Add title and headings, in order, to documents with their ``lines`` gathered; null for those without lines that count."""
    trimmed = F.transform("lines", lambda x: F.struct(x["page"].alias("page"), x["line"].alias("line"), x["size"].alias("size"), x["bold"].alias("bold"), F.btrim(x["text"], F.lit(" \t\n\r")).alias("text")))
    kept = docs.withColumn("_kept", F.filter(trimmed, lambda x: (x["text"] != "") & x["size"].isNotNull()))
    sized = kept.withColumn("_s", sizes(F.transform("_kept", lambda x: x["size"])))
    head = lambda x: F.struct(x["page"].alias("page"), x["line"].alias("line"), heading_of(x["text"], x["size"], x["bold"], F.col("_s.body"), F.col("_s.title_size")).alias("h"))
    heads = F.sort_array(F.filter(F.transform("_kept", head), lambda x: x["h"].isNotNull()))
    first = F.sort_array(F.transform(F.filter("_kept", lambda x: x["page"] == 0), lambda x: F.struct(x["line"].alias("line"), x["size"].alias("size"), x["text"].alias("text"))))
    known = sized.withColumn("_first", first).withColumn("_n", F.size("_kept")).withColumn("_heads", heads)
    there = F.col("_n") > 0
    found = known.withColumn("title", F.when(there, title_of(F.col("_first"), F.col("_s.title_size")))).withColumn("headings", F.when(there, F.transform("_heads", lambda x: x["h"])))
    return found.drop("_kept", "_s", "_first", "_n", "_heads")


def outline(lines: DataFrame, key: str) -> DataFrame:
    """(key, title, headings in order) of every document that has lines; ``sections_at`` cuts its text at them."""
    there = lines.where(F.col(key).isNotNull() & F.col("size").isNotNull() & (F.btrim("text", F.lit(" \t\n\r")) != ""))
    return outlined(gathered(there, key)).select(key, "title", "headings")
