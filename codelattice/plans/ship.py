"""Sending this package to the executors, where it need not be installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application, once."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    package = Path(__file__).resolve().parent.parent
    where = os.path.join(tempfile.mkdtemp(prefix="codelattice-src-"), "codelattice.zip")
    with zipfile.ZipFile(where, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(where)
    _SENT.add(app)
