"""Outlines of typeset documents."""

from folio.operators import layout

SCHEMA = "k long, page int, line int, size double, bold boolean, text string"


def rows(k, *lines):
    return [(k, 0 if n < 6 else 1, n, float(size), bold, text) for n, (size, bold, text) in enumerate(lines)]


def test_titles_and_headings(spark):
    body = (10, False, "plain words of the body run on and on")
    one = rows(
        1, (18, False, "A system for ex-"), (18, False, "traction of tables"), (12, False, "Jane Doe"), (10, False, "Abstract—The given text"), body, (10, True, "Methods"),
        (10, True, "important words here"), (12, False, "2.1"), (12, False, "3 Results"), (12, False, "Table 1."), (12, False, "It ends in a stop."), (10, True, "4. Own Names"), (10, None, "RESULTS"), body, body,
    )
    two = rows(2, (10, False, "Two sizes"), (11, False, "Larger line"), (10, False, None), (10, False, "  "), (None or 10, False, "end"))
    three = rows(3, (20, False, "7"), (10, False, "words"), (10, False, "more"))
    got = {r.k: (r.title, r.headings) for r in layout.outline(spark.createDataFrame(one + two + three, SCHEMA), "k").collect()}
    assert got[1] == ("A system for extraction of tables", ["Jane Doe", "Abstract", "Methods", "3 Results", "4. Own Names"])
    assert got[2] == (None, ["Larger line"])
    assert got[3] == (None, [])
    assert layout.outline(spark.createDataFrame([], SCHEMA), "k").count() == 0
