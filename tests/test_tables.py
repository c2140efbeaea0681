"""Stored datasets, resumable exports, differences of versions, observed runs, the bootstrap."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.operators import metrics, observed, snapshots
from folio.scratch import written
from folio.sources import datasets


def test_a_dataset_is_built_once_and_checked(spark, tmp_path):
    folder, built = str(tmp_path), []
    rows = spark.range(100).selectExpr("id", "id * 2 as twice")

    def build():
        built.append(1)
        return rows

    for _ in range(2):
        assert datasets.cached_dataset(spark, folder, "x", "id", build, rows.select("id").orderBy(F.desc("id"))).count() == 100
    assert len(built) == 1
    for wrong in (spark.range(99), spark.range(1, 101), spark.range(100).union(spark.range(1))):
        with pytest.raises(datasets.DatasetMismatch):
            datasets.load_dataset(spark, folder, "x", wrong)
    with pytest.raises(datasets.DatasetMismatch):
        datasets.load_dataset(spark, folder, "x", columns=["twice", "id"])
    with pytest.raises(FileNotFoundError):
        datasets.load_dataset(spark, folder, "y")
    # other ids: built again; the old version's reader still has its files
    old = datasets.load_dataset(spark, folder, "x", columns=["id", "twice"])
    assert datasets.cached_dataset(spark, folder, "x", "id", lambda: spark.range(5).selectExpr("id", "id as twice"), spark.range(5)).count() == 5
    assert old.count() == 100
    with pytest.raises(datasets.DatasetMismatch):  # what is built must fit too
        datasets.cached_dataset(spark, folder, "x", "id", lambda: rows, spark.range(7))
    assert datasets.load_dataset(spark, folder, "x", spark.range(5)).count() == 5  # and doesn't replace what is there
    assert list((tmp_path / "x").glob("*.tmp")) == []
    # files that went are noticed
    version = tmp_path / "x" / json.loads((tmp_path / "x/manifest.json").read_text())["version"]
    next(p for p in version.glob("part-*") if spark.read.parquet(str(p)).count()).unlink()
    with pytest.raises(datasets.DatasetMismatch):
        datasets.load_dataset(spark, folder, "x")


def test_an_export_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([(None if k % 10 == 0 else k, f"line\n{k}", None if k % 3 else float(k)) for k in range(200)], "id long, text string, x double")
    write, commits = datasets._Files.write, []

    def dies(self, name, text, replace):
        commits.append(name)
        if len(commits) == 6:  # the layout and four shards are there, the fifth is written but not committed
            raise RuntimeError("killed")
        return write(self, name, text, replace)

    monkeypatch.setattr(datasets._Files, "write", dies)
    with pytest.raises(RuntimeError):
        datasets.export_shards(rows, folder, "id", shards=12, at_once=3)
    monkeypatch.setattr(datasets._Files, "write", write)
    with pytest.raises(datasets.DatasetMismatch):
        datasets.import_shards(spark, folder)
    part = datasets.import_shards(spark, folder, whole=False).count()
    assert 0 < part < 200
    done = sorted(int(p.stem) for p in (tmp_path / "out/_done").glob("[0-9]*.json"))
    assert done == [0, 1, 2, 3]
    assert datasets.export_shards(rows, folder, "id", shards=12, at_once=5) == list(range(4, 12))
    assert datasets.export_shards(rows, folder, "id", shards=12) == []
    back = datasets.import_shards(spark, folder)
    assert back.schema == rows.schema and sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    with pytest.raises(datasets.DatasetMismatch):
        datasets.export_shards(rows, folder, "id", shards=13)
    with pytest.raises(FileNotFoundError):
        datasets.import_shards(spark, str(tmp_path / "none"))


def test_an_empty_export(spark, tmp_path):
    rows = spark.createDataFrame([], "id long, x string")
    assert datasets.export_shards(rows, str(tmp_path / "e"), "id", shards=3) == [0, 1, 2]
    assert datasets.import_shards(spark, str(tmp_path / "e")).count() == 0


def test_differences(spark):
    before = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "c", 3.0), (None, "n", 0.0), (5, "e", 1.0), (5, "e", 2.0), (6, "f", 1.0), (7, "g", 1.0), (7, "g", 1.0)], "k int, s string, x double")
    after = spark.createDataFrame([("a", 1, 1.0, None), ("b", 2, 2.0, None), ("n", None, 0.0, None), ("e", 5, 2.0, None), ("e", 5, 1.0, None), ("z", 6, None, "t"), ("g", 7, 1.0, None), ("y", 9, 1.0, None)], "s string, k int, x double, t string")
    got = {r.k: (r.change, r.columns) for r in snapshots.difference(before, after, ["k"]).collect()}
    assert got == {2: ("changed", ["x"]), 3: ("removed", []), 6: ("changed", ["s", "t", "x"]), 7: ("changed", ["*", "s", "x"]), 9: ("added", [])}
    assert snapshots.difference(before, before, ["k"]).count() == 0
    assert {r.change for r in snapshots.difference(before.limit(0), before, ["k", "s"]).collect()} == {"added"}


def test_observed_rows_are_exact(spark):
    calls = []
    stages = [("even", lambda d: d.where("id % 2 = 0")), ("none", lambda d: d.where("id < 0")), ("still none", lambda d: d)]
    rows, report = observed.run_observed(spark.range(1000), stages, lambda d, n: calls.append(n) or written(d, n.replace(" ", "-")), {"total": F.sum("id")})
    assert rows.count() == 0 and calls == ["even", "none", "still none"]
    assert [(r["rows_in"], r["rows"], r["total"]) for r in report] == [(None, 500, 249500), (500, 0, None), (0, 0, None)]
    assert all(r["seconds"] > 0 and r["rows_per_second"] == r["rows"] / r["seconds"] for r in report)
    assert observed.report_table(spark, report).count() == 3


def test_bootstrap_from_counts(spark):
    """The interval of 2,000 resamples of the rows themselves, within Monte Carlo error; rows don't reach the shuffle."""
    rng = np.random.default_rng(0)
    a, b = rng.random(3000) < 0.7, rng.random(3000) < 0.65
    rows = spark.createDataFrame([(bool(x), bool(y)) for x, y in zip(a, b, strict=True)] + [(None, True)], "a boolean, b boolean")
    r = metrics.bootstrap_difference(rows, "a", "b")
    d = a.astype(float) - b
    means = np.array([d[rng.integers(0, len(d), len(d))].mean() for _ in range(2000)])
    low, high = np.quantile(means, [0.025, 0.975])
    got = r.first()
    assert abs(got.low - low) < 0.003 and abs(got.high - high) < 0.003 and abs(got.mean - d.mean()) < 0.001
    assert tuple(r.first()) == tuple(got)
    assert tuple(metrics.bootstrap_difference(rows.limit(0), "a", "b").first()) == (None, None, None)
