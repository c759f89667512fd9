"""Gets this package to the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each Spark application, whatever their PYTHONPATH is."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="scorewright-py-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/scorewright.zip", "w") as z:
        for file in package.rglob("*.py"):
            z.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(f"{folder}/scorewright.zip")
    _shipped.add(app)
