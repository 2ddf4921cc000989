"""Makes this package importable on executors that do not have it installed."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once per application."""
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    _done.add(app)
    top = Path(tempfile.mkdtemp(prefix="package-"))
    shutil.copytree(_PACKAGE, top / "in" / _PACKAGE.name, ignore=shutil.ignore_patterns("__pycache__"))
    archive = shutil.make_archive(str(top / _PACKAGE.name), "zip", top / "in")
    spark.sparkContext.addPyFile(archive)
