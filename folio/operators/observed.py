"""Rows and seconds of each stage of a run, counted while its rows are written."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

REPORT_SCHEMA = "place int, stage string, rows_in long, rows long, seconds double, rows_per_second double"


def run_observed(first: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], write: Callable[[DataFrame, str], DataFrame], metrics: dict | None = None) -> tuple[DataFrame, list[dict]]:
    """The last stage's rows, and for each stage a row of the report.

    ``write(rows, name)`` stores a stage's rows and returns them read back. Counts, and
    other aggregates of ``metrics`` by name, come from that one pass: no row is read again.
    A stage's rows_in are the rows of the one before, null for the first.
    """
    rows, report, before = first, [], None
    for place, (name, stage) in enumerate(stages):
        seen = Observation(f"stage {place}")
        wanted = {"rows": F.count(F.lit(1)), **(metrics or {})}
        began = time.perf_counter()
        rows = write(stage(rows).observe(seen, *(c.alias(n) for n, c in wanted.items())), name)
        seconds = time.perf_counter() - began
        found = seen.get
        report.append({"place": place, "stage": name, "rows_in": before, "seconds": seconds, "rows_per_second": found["rows"] / max(seconds, 1e-9), **found})
        before = found["rows"]
    return rows, report


def report_table(spark: SparkSession, report: list[dict]) -> DataFrame:
    """The report, a row per stage."""
    names = [x.split()[0] for x in REPORT_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in report], REPORT_SCHEMA)
