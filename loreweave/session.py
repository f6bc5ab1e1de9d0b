"""Sending the package to the executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application. Nothing to do where they find it by path."""
    package = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    found = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if app in _shipped or package.parent in found:
        return
    # Executors fetch the file whenever they start, so it stays as long as the driver.
    zipped = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{package.name}", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(zipped)
    _shipped.add(app)
