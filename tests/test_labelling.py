"""Votes as one expression: the rows of the joined form."""

from pyspark.sql import functions as F

from folio.operators import labelling

MAPPING = [("a", "one", 0.9, "two"), ("b", "two", 0.6, "one"), ("c", "two", 0.8, None), ("d", "three", 0.7, "three"), ("e", "one", 1.0, "two")]


def test_votes_in_place_match_joined_votes(spark):
    lists = [["a", "b"], ["b", "a"], ["c"], ["d", "d"], ["zzz"], [], None, [None, "a"], ["a", "a", "b"], ["e", "c"], ["zzz", "e", "c", "d"]]
    df = spark.createDataFrame(list(enumerate(lists)), "k long, categories array<string>")
    mapping = spark.createDataFrame(MAPPING, "category string, label string, strength double, secondary string")

    def rows(out):
        return {r.k: (r.label, round(r.margin, 9), list(r.co_listed or []), r.ambiguous) for r in out.collect()}

    joined = rows(labelling.vote_labels(df, "k", "categories", mapping))
    placed = rows(df.select("k", labelling.voted(F.col("categories"), MAPPING).alias("v")).select("k", "v.*"))
    assert placed == joined
    assert placed[0] == ("one", round((1.8 + 0.2 - 0.1 - 0.6) / 2.7, 9), ["one", "two"], False)
    assert placed[4] == placed[5] == placed[6] == (None, 0.0, [], True)
    assert df.limit(0).select(labelling.voted(F.col("categories"), MAPPING)).count() == 0


def test_keyword_scores_on_awkward_rows(spark):
    fields = [("one", 0, r"ab\w*|cd", ["x"]), ("two", 1, r"ab\w*", []), ("three", 2, "zz", ["y"])]
    rows = [(1, None, None, None), (2, "", "", "x"), (3, "ABc", "abc abd cd", None), (4, "zz", None, "y"), (5, None, "ab " * 5000, "n")]
    df = spark.createDataFrame(rows, "k long, title string, body string, c string")
    got = {r.k: r for r in labelling.keyword_labels(df, "k", "title", "body", "c", fields).collect()}
    assert [(got[k].field, got[k].score, got[k].evidence, got[k].runner_up) for k in (1, 2, 3, 4, 5)] == [
        (None, 0.0, "none", "two"), ("one", 3.0, "category", "two"), (None, 4.0, "none", "two"), ("three", 5.0, "both", "one"), (None, 1.0, "none", "two"),
    ]
    votes = {r.k: (r.v.field, r.v.hits) for r in df.select("k", labelling.keyword_vote(F.col("title"), F.col("body"), fields).alias("v")).collect()}
    assert votes == {1: (None, 0), 2: (None, 0), 3: ("one", 3), 4: ("three", 1), 5: ("one", 1)}
