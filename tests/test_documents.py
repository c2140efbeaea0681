"""Structured documents of raw texts, paragraphs and lines; word-processor files."""

import re
import zipfile

from pyspark.sql import functions as F

from folio.functions import headings as H
from folio.functions import text as T
from folio.operators import documents, layout
from folio.plans import document_queries
from folio.sources import files


def parts(row):
    return [tuple(s) for s in row.sections]


def test_raw_texts(spark):
    filler = "word " * 401
    rows = [(1, f"Title of four words\nlead\nIntroduction\n{filler}\nReferences\n[1] x"), (2, "Introduction\nshort"), (3, None), (4, filler), (5, ""), (5, "twice")]
    got = documents.from_texts(spark.createDataFrame(rows, "k long, text string").withColumn("sections", F.lit(0)), "k").collect()
    by = {r.k: r for r in got}
    assert len(got) == 6
    assert [(h, s) for h, s, _ in parts(by[1])] == [("", "abstract"), ("Introduction", "introduction"), ("References", "references")]
    assert (by[1].title, by[1].doc_type, by[1].n_structural) == ("Title of four words", "paper", 3)
    assert parts(by[2]) == parts(by[3]) == parts(by[4]) == []
    assert (by[2].doc_type, by[2].title, by[3].text, by[3].doc_type) == ("paragraph", None, "", "paragraph")
    assert documents.from_texts(spark.createDataFrame([], "k long, text string"), "k").count() == 0


PARAGRAPHS = [(0, "Normal", "before"), (1, "Title", "The Name"), (2, "Title", "second title"), (3, "Heading 1", " Methods "), (4, None, "one"), (5, "Normal", "  "), (6, "Normal", "two"), (7, "heading 2", "Empty"), (8, "Heading 1", "Results"), (9, "Normal", "three")]
SECTIONS = [("", "other", "before\nsecond title"), ("Methods", "methods", "one\ntwo"), ("Results", "results", "three")]


def test_styled_paragraphs(spark):
    rows = [(1, *p) for p in PARAGRAPHS] + [(2, 0, "Normal", "A plain line of words"), (3, 0, "Title", " "), (4, 0, "Title", "only"), (None, 1, "Normal", "no key here")]
    got = {r.k: r for r in documents.from_paragraphs(spark.createDataFrame(rows, "k long, place int, style string, text string"), "k").collect()}
    assert parts(got[1]) == SECTIONS and got[1].title == "The Name"
    assert got[1].text.startswith("before\n\nThe Name\n\nsecond title\n\nMethods\n\none\n\ntwo")
    assert parts(got[2]) == [("", "other", "A plain line of words")] and got[2].title == "A plain line of words"
    assert 3 not in got and parts(got[4]) == [] and got[4].title == "only" and None in got
    assert documents.section_rows(spark.createDataFrame([], "k long, sections " + documents.SECTIONS), "k").count() == 0


def docx(path, paragraphs):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    ids = {style: f"s{n}" for n, style in enumerate(dict.fromkeys(s for _, s, _ in paragraphs if s))}
    body = "".join(f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{ids[s]}{chr(34)}/></w:pPr>' if s else ''}<w:r><w:t>{t[:2]}</w:t></w:r><w:hyperlink><w:r><w:t>{t[2:]}</w:t></w:r></w:hyperlink></w:p>" for _, s, t in paragraphs)
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{s}"/></w:style>' for s, i in ids.items())
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {ns}>{styles}</w:styles>")


def test_word_processor_files(spark, tmp_path):
    docx(tmp_path / "a.docx", PARAGRAPHS)
    (tmp_path / "b.DOCX").write_bytes(b"no archive")
    (tmp_path / "c.txt").write_text("not one")
    rows = files.read_styled(spark, str(tmp_path))
    assert [r.error is not None for r in rows.where("path like '%b.DOCX'").collect()] == [True]
    (one,) = documents.from_paragraphs(rows.where("error is null"), "path").collect()
    assert parts(one) == SECTIONS and one.title == "The Name"
    read = {r.path.rpartition("/")[2]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert read["a.docx"].title == "The Name" and "#  Methods " in read["a.docx"].text and read["b.DOCX"].error


def test_typeset_lines_fall_back_on_heading_lines(spark):
    big, body = (12.0, False), (10.0, False)
    outlined = [(20.0, False, "Its Title in Words"), (*big, "Introduction"), (*body, "one"), (*big, "3 Results"), (*body, "two"), (*big, "Introduction"), (*body, "three"), (*big, "Discussion"), (*body, "four"), (*body, "five")]
    flat = [(*big, "Jane Doe Someone"), (*body, "Methods"), (*body, "one of them"), (*body, "RESULTS"), (*body, "two of them")]
    rows = [(k, n // 5, n, s, b, t) for k, lines in ((1, outlined), (2, flat)) for n, (s, b, t) in enumerate(lines)] + [(3, 0, 0, None, None, "no sizes"), (4, 0, 0, 9.0, True, None)]
    got = {r.k: r for r in documents.from_lines(spark.createDataFrame(rows, "k long, page int, line int, size double, bold boolean, text string"), "k").collect()}
    assert [(h, b) for h, _, b in parts(got[1])] == [("", "Its Title in Words"), ("Introduction", "one"), ("3 Results", "two\nIntroduction\nthree"), ("Discussion", "four\nfive")]
    assert parts(got[2]) == [("", "abstract", "Jane Doe Someone"), ("Methods", "methods", "one of them"), ("RESULTS", "results", "two of them")]
    assert parts(got[3]) == parts(got[4]) == [] and got[4].text == ""


def cut(text, headings):
    """A text at its headings, by plain search."""
    at, cursor, seen = [], 0, set()
    for h in headings:
        i = text.find(h, cursor)
        if h in seen or i < 0:
            continue
        at.append((i, h))
        seen.add(h)
        cursor = i + len(h)
    spans = [(h, text[i + len(h):(at[n + 1][0] if n + 1 < len(at) else len(text))].strip(" \t\n\r")) for n, (i, h) in enumerate(at)]
    lead = text[:at[0][0]].strip(" \t\n\r") if at else ""
    return [("", lead)] * bool(lead) + [s for s in spans if s[1]]


def test_typeset_documents_against_plain_search(spark):
    sf = "/root/testdata/sf0.001"
    lines = document_queries.typeset_lines(spark, sf)
    texts = {}
    for r in sorted(lines.collect(), key=lambda r: (r.doc_id, r.page, r.line)):
        texts.setdefault(r.doc_id, []).append(r.text)
    headings = {r.doc_id: r.headings for r in layout.outline(lines, "doc_id").collect()}
    found = {r.doc_id: r for r in documents.from_lines(lines, "doc_id").collect()}
    names = {h for hs in headings.values() for h in hs}
    section = dict(spark.createDataFrame([(h,) for h in names], "h string").select("h", T.normalise_heading(F.col("h"))).collect())
    by_lines = {r.k: [tuple(x) for x in r.s] for r in spark.createDataFrame([(k, found[k].text) for k in found], "k long, text string").select("k", documents.line_sections(F.col("text")).alias("s")).collect()}
    outlined = 0
    for k, row in found.items():
        plain = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", re.sub(r"(\w)-\n(\w)", r"\1\2", "\n".join(texts[k])))).strip(" \t\n\r")
        assert row.text == plain
        own = cut(plain, headings[k])
        has = any(section[h] == "abstract" for h in headings[k])
        own = [(h, ("other" if has else "abstract") if h == "" else section[h], b) for h, b in own]
        structural = lambda rows: len({s for _, s, _ in rows} & set(T.STRUCTURAL_SECTIONS))
        better = structural(own) < 3 and structural(by_lines[k]) > structural(own)
        outlined += not better
        assert parts(row) == (by_lines[k] if better else own)
    assert len(found) == len(texts) and 0 < outlined <= len(found)
    assert document_queries.typeset_documents(spark, sf).where("section_index = 0").count() > 0
    assert H.STRICT_NAMES
