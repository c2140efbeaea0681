"""Sessions: settings for tests, and the package's code for the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package's code, once per application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        top = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="folio-")  # the driver's own; Spark sends the file
        with zipfile.ZipFile(name := f"{folder}/folio_package.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(top.rglob("*.py")):
                z.write(path, os.path.relpath(path, top.parent))
        spark.sparkContext.addPyFile(name)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session on this machine, in UTC as the tables' timestamps have no zone."""
    conf = {
        "spark.master": f"local[{cores}]",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    return ship(SparkSession.builder.config(map=conf).getOrCreate())
