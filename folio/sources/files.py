"""Readers and sinks: documents of several formats, tolerant JSON lines, resumable appends."""

from __future__ import annotations

import importlib.util
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folio.functions import text as T
from folio.operators.chunking import markdown_sections

DOC_SCHEMA = "path string, kind string, title string, text string, error string"
KINDS = {"txt": "text", "text": "text", "md": "markdown", "markdown": "markdown", "pdf": "pdf", "docx": "docx"}


def read_shards(spark: SparkSession, *globs: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet of the first glob that has files; the others are its fallbacks."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    for k, glob in enumerate(globs):
        try:
            return reader.parquet(glob)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND" or k == len(globs) - 1:
                raise
    raise ValueError("no glob given")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, quoted line breaks allowed, under an explicit schema."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_optional_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same of a side table that may be absent: then it has no rows."""
    try:
        return read_csv(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a truncated last line is dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def append_missing(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the JSON-lines table at path lacks; returns how many there were.

    A run that was cut short is resumed by calling it again.
    """
    kind = rows.schema[key].dataType.simpleString()
    try:
        rows = rows.join(read_json_lines(rows.sparkSession, path, f"{key} {kind}").distinct(), key, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    before = rows.count()
    rows.write.mode("append").json(path)
    return before


def write_with_stats(df: DataFrame, path: str, group: str) -> DataFrame:
    """Write Parquet, and beside it as JSON the row counts of each group."""
    df.write.mode("overwrite").parquet(path)
    stats = df.sparkSession.read.parquet(path).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    stats.coalesce(1).write.mode("overwrite").json(f"{path}_stats")
    return stats


def _pdf(data: bytes) -> tuple[str | None, str]:
    if importlib.util.find_spec("fitz"):
        import fitz

        pages = [p.get_text() for p in fitz.open(stream=data, filetype="pdf")]
    elif importlib.util.find_spec("pypdf"):
        from pypdf import PdfReader

        pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]
    else:
        raise ModuleNotFoundError("reading PDF needs fitz or pypdf")
    return None, "\n".join(pages)


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_paragraphs(data: bytes) -> list[tuple[str | None, str]]:
    """(style name, text) of the paragraphs in the body of a word-processor file; those of tables are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for style in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_WORD}style"):
                name = style.find(f"{_WORD}name")
                if name is not None:
                    names[style.get(f"{_WORD}styleId")] = name.get(f"{_WORD}val")
    marks = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}
    out = []
    for p in [] if body is None else body.findall(f"{_WORD}p"):
        style = p.find(f"{_WORD}pPr/{_WORD}pStyle")
        own = None if style is None else style.get(f"{_WORD}val")
        runs = [x for r in p.iter(f"{_WORD}r") for x in r]
        out.append((names.get(own, own), "".join(x.text or "" if x.tag == f"{_WORD}t" else marks.get(x.tag, "") for x in runs)))
    return out


def _docx(data: bytes) -> tuple[str | None, str]:
    paragraphs = [((style or "").lower(), text) for style, text in docx_paragraphs(data)]
    lines = [("# " if style.startswith("heading") else "") + text for style, text in paragraphs]
    return next((text for style, text in paragraphs if style.startswith("title")), None), "\n".join(lines)


def read_styled(spark: SparkSession, path: str) -> DataFrame:
    """Word-processor files of a folder as paragraphs (path, place, style, text, error), read in parallel.

    ``documents.from_paragraphs`` makes documents of them. A file that can't be read is one row with an error.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(name, n, style, text, None) for n, (style, text) in enumerate(docx_paragraphs(bytes(data)))]
                except Exception as e:  # one bad file is a row, whatever is wrong with it
                    rows.append((name, 0, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["path", "place", "style", "text", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][oO][cC][xX]").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, place int, style string, text string, error string")


def _markdown(data: bytes) -> tuple[str | None, str]:
    text = data.decode("utf-8", "replace")
    title = re.search(r"^#\s+(.+?)\s*$", text, re.M)
    return (title[1] if title else None), text


PARSERS = {"text": lambda data: (None, data.decode("utf-8", "replace")), "markdown": _markdown, "pdf": _pdf, "docx": _docx}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder or glob as rows (path, kind, title, text, error), read in parallel.

    What can't be read is a row with an error, not a failed job.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                kind = KINDS.get(name.rpartition(".")[2].lower())
                try:
                    title, text = PARSERS[kind](bytes(data))
                    error = None if text.strip() else "no text"
                except KeyError:
                    title, text, error = None, None, "unsupported kind"
                except Exception as e:  # one bad file is a row, whatever is wrong with it
                    title, text, error = None, None, f"{type(e).__name__}: {e}"[:300]
                rows.append((name, kind, title, text, error))
            yield pd.DataFrame(rows, columns=["path", "kind", "title", "text", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInPandas(parse, DOC_SCHEMA)
    return found.withColumn("title", F.coalesce("title", T.guess_title(F.col("text"))))


def html_to_markdown(html):
    """Headings to # lines, blocks to lines, other tags and scripts away."""
    x = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>", " ")
    for level in range(1, 7):
        x = F.regexp_replace(x, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>", "\n" + "#" * level + " $1\n")
    x = F.regexp_replace(x, r"(?i)</?(p|div|li|ul|ol|br|tr|table|section|article|nav|body|html)\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", "")
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(mark))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def page_sections(pages: DataFrame) -> DataFrame:
    """Sections of web pages by their headings."""
    return markdown_sections(pages.select("page_id", html_to_markdown(F.col("html")).alias("text")), "page_id")
