"""Documents to chunks: word windows, sections, paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import headings as H
from folio.functions import text as T

TARGET, OVERLAP, LEAST, SECTION_MOST = 200, 40, 25, 260


def windows(n: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """Structs (start, stop) of overlapping windows over n words; none for n = 0.

    In closed form: one window up to the target, else as many strides as reach the end.
    """
    stride = target - overlap
    count = F.when(n <= target, 1).otherwise(F.ceil((n - target) / stride).cast("int") + 1)
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda k: k * stride)
    spans = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + target, n).alias("stop")))
    return F.when(n > 0, spans).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))


def window_chunks(docs: DataFrame, key: str, text: str = "text", target: int = TARGET, overlap: int = OVERLAP, most: int | None = None) -> DataFrame:
    """(key, chunk_index, n_words, text) of word windows, all or the first ``most`` of a document."""
    w = docs.select(key, T.words(F.col(text)).alias("_w"))
    every = windows(F.size("_w"), target, overlap)
    spans = w.select(key, "_w", F.posexplode(every if most is None else F.slice(every, 1, most)).alias("chunk_index", "_s"))
    size = F.col("_s.stop") - F.col("_s.start")
    return spans.select(key, "chunk_index", size.alias("n_words"), F.array_join(F.slice("_w", F.col("_s.start") + 1, size), " ").alias("text"))


def paragraph_chunk(text: Column, title: Column) -> Column:
    """The text as one chunk, behind its title unless it opens with it."""
    repeated = F.lower(text).startswith(F.lower(F.substring(title, 1, 40)))
    return F.when((F.length(F.coalesce(title, F.lit(""))) > 0) & ~repeated, F.concat(title, F.lit(". "), text)).otherwise(text)


def markdown_sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, section_index, heading, section, body) of # headings; text before the first has index 0.

    One expression over the lines of a text: none becomes a row. Null and empty texts
    have one empty section; rows that repeat a key are cut each.
    """
    pattern = r"^#{1,6}\s+(.*\S)\s*$"
    parts = H.cut_at_headings(F.col(text), lambda x: x.rlike(pattern), lambda x: F.regexp_extract(x, pattern, 1), keep_empty=True)
    rows = docs.select(key, F.inline(parts))
    section = F.when(F.col("section_index") == 0, "abstract").otherwise(T.normalise_heading(F.col("heading")))
    return rows.select(key, F.col("section_index").cast("long").alias("section_index"), F.coalesce("heading", F.lit("")).alias("heading"), "body", section.alias("section"))


def section_chunks(sections: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Sections of up to SECTION_MOST words whole, longer ones in windows; all or the first ``most`` of a document."""
    w = sections.select(key, "section_index", "section", T.words(F.col("body")).alias("_w")).where(F.size("_w") > 0)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.size("_w").alias("stop")))
    spans = F.when(F.size("_w") <= SECTION_MOST, whole).otherwise(windows(F.size("_w")))
    cut = w.select(key, "section_index", "section", "_w", F.posexplode(spans).alias("_k", "_s"))
    order = Window.partitionBy(key).orderBy("section_index", "_k")
    size = F.col("_s.stop") - F.col("_s.start")
    out = cut.select(key, "section", (F.row_number().over(order) - 1).alias("chunk_index"), size.alias("n_words"), F.array_join(F.slice("_w", F.col("_s.start") + 1, size), " ").alias("text"))
    return out if most is None else out.where(F.col("chunk_index") < most)


def classifiable(chunks: DataFrame, key: str) -> DataFrame:
    """Without noise sections, unless that leaves a document with nothing."""
    noise = F.col("section").isin(*T.NOISE_SECTIONS)
    only_noise = F.min(noise.cast("int")).over(Window.partitionBy(key)) == 1
    return chunks.withColumn("_only", only_noise).where(~noise | F.col("_only")).drop("_only")


def _spans(n: int) -> list[tuple[int, int]]:
    """The word windows of n words."""
    starts = range(0, max(n - OVERLAP, 1), TARGET - OVERLAP)
    return [(a, min(a + TARGET, n)) for a in starts] if n else []


def _pack(paragraphs: list[str]) -> list[str]:
    """Paragraphs gathered up to the target; each flush starts the next with its last words.

    A paragraph above the target is cut into windows of its own. A buffer of fewer than
    ``LEAST`` words is not flushed for a paragraph that doesn't fit, but takes it in.
    """
    out: list[str] = []
    held: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        piece = "\n\n".join(held).strip()
        if piece:
            out.append(piece)
        tail = piece.split()[-OVERLAP:]
        held, size = [" ".join(tail)] if tail else [], len(tail)

    for text in paragraphs:
        words = text.split()
        if len(words) > TARGET:
            if held:
                flush()
            out += [" ".join(words[a:b]) for a, b in _spans(len(words))]
            held, size = [], 0
            continue
        if size + len(words) > TARGET and size >= LEAST:
            flush()
        held.append(text)
        size += len(words)
    if held:
        flush()
    return out


_BLANK_LINES = re.compile(r"\n\s*\n+")


def _paragraphs(text: str | None) -> list[str]:
    return [x for x in (p.strip() for p in _BLANK_LINES.split(text or "")) if x]


def article_chunks(docs: DataFrame, key: str, text: str = "text", most: int | None = None) -> DataFrame:
    """Greedy packing of paragraphs, which blank lines part.

    What a chunk holds depends on all before it, so each document is folded in Python,
    in Arrow batches; all or the first ``most`` chunks. Null and blank texts have none.
    """
    kind = docs.schema[key].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n, len(c.split()), c) for k, t in zip(pdf[key], pdf[text], strict=True) for n, c in enumerate(_pack(_paragraphs(t))[:most])]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "n_words", "text"])

    return docs.select(key, text).mapInPandas(fold, f"{key} {kind}, chunk_index int, n_words int, text string")


def document_chunks(docs: DataFrame, key: str, text: str = "text", title: str = "title", most: int | None = None) -> DataFrame:
    """(key, doc_type, chunk_index, section, n_words, text): every document cut as its type asks.

    A paragraph is one chunk behind its title, an abstract if it reads like one. A paper
    is its title, then its sections, short ones whole and long ones in windows. An
    article, or a paper without sections, is its title and packed paragraphs. Blank
    texts have no chunks but a title's; null titles none.
    """
    kind = docs.schema[key].dataType.simpleString()
    body = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\r"))
    one = paragraph_chunk(body, F.trim(F.col(title)))
    parts = H.cut_at_headings(F.col(text), lambda x: H.heading_of_line(x).isNotNull(), H.heading_of_line)
    named = F.transform(parts, lambda x: F.struct(F.when(x["heading"].isNull(), "abstract").otherwise(T.normalise_heading(x["heading"])).alias("section"), x["body"].alias("body")))
    ready = H.typed(docs, text).select(F.col(key).alias("key"), "doc_type", F.trim(F.col(title)).alias("title"), F.col(text).alias("text"), one.alias("one"), F.when(T.looks_like_abstract(one), "abstract").otherwise("body").alias("one_section"), F.when(F.col("doc_type") == "paper", named).alias("parts"))

    def cut(row) -> list[tuple[str, str]]:
        if row.doc_type == "paragraph":
            return [(row.one_section, row.one)] if row.one else []
        out = [("title", row.title)] if row.title else []
        if row.doc_type != "paper" or row.parts is None or not len(row.parts):
            return out + [("body", x) for x in _pack(_paragraphs(row.text))]
        for part in row.parts:
            words = part["body"].split()
            short = len(words) <= SECTION_MOST
            out += [(part["section"], part["body"])] if short else [(part["section"], " ".join(words[a:b])) for a, b in _spans(len(words))]
        return out

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.key, r.doc_type, n, section, len(x.split()), x) for r in pdf.itertuples() for n, (section, x) in enumerate(cut(r)[:most])]
            yield pd.DataFrame(rows, columns=[key, "doc_type", "chunk_index", "section", "n_words", "text"])

    return ready.mapInPandas(fold, f"{key} {kind}, doc_type string, chunk_index int, section string, n_words int, text string")
