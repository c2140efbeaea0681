"""Every query with SQL is held against DuckDB on the small tables."""

import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from folio.plans import ballot_queries, document_queries, facet_queries, figure_queries, model_queries, more_queries, study_queries, table_queries, term_queries, text_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = text_queries.QUERIES | model_queries.QUERIES | more_queries.QUERIES | study_queries.QUERIES | figure_queries.QUERIES | term_queries.QUERIES | table_queries.QUERIES | ballot_queries.QUERIES | facet_queries.QUERIES | document_queries.QUERIES
SQL = text_queries.ORACLES | model_queries.ORACLES | more_queries.ORACLES | study_queries.ORACLES | figure_queries.ORACLES | term_queries.ORACLES | table_queries.ORACLES | ballot_queries.ORACLES | facet_queries.ORACLES | document_queries.ORACLES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float | np.floating):
        return None if math.isnan(v) else round(float(v), 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, duck, name):
    df = OWN[name](spark, sf)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    expected = sorted((tuple(plain(r[names.index(n)]) for n in order) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[n]) for n in order) for r in df.collect()), key=repr)
    assert got == expected and got


@pytest.mark.parametrize("name", sorted(set(OWN) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert OWN[name](spark, sf).count() > 0


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["keyword_fields", "keyword_votes", "conformal_bank", "conformal_bank_by_class", "coverage_curve", "language_splits", "pooled_weighted_mean"])
def test_plans_join_no_data_crosswise(spark, sf, name, capsys):
    OWN[name](spark, sf).explain()
    plan = capsys.readouterr().out
    assert "Scan parquet" in plan or "FileScan" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_fallback_glob_is_read_only_when_needed(spark, tmp_path):
    from folio.sources.files import read_shards

    for k in range(2):
        spark.range(k + 1).write.parquet(f"{tmp_path}/set{k}")
    assert read_shards(spark, f"{tmp_path}/none*", f"{tmp_path}/set1").count() == 2
    assert read_shards(spark, f"{tmp_path}/set0", f"{tmp_path}/set1").count() == 1
