"""Sends this package to the executors, so that Python workers can import it wherever they run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each application."""
    if spark.sparkContext.applicationId in _sent:
        return
    package = Path(__file__).parent.parent
    folder = tempfile.mkdtemp(prefix="matrixloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / "matrixloom.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))
    _sent.add(spark.sparkContext.applicationId)
