"""Make this package importable in Python workers, wherever executors run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors as a zip, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    out = tempfile.mkdtemp(prefix="siltstone-package-")  # the driver serves it as long as the application runs
    atexit.register(shutil.rmtree, out, True)
    context.addPyFile(shutil.make_archive(f"{out}/{root.name}", "zip", root.parent, root.name))
    _shipped.add(context.applicationId)
