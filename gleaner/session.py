"""Makes this package importable on the executors of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors unless their Python path has it (once for each application)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == root or root.endswith(".zip"):
        return
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    at = os.path.join(tempfile.mkdtemp(), "gleaner.zip")  # the driver's file server sends it
    with zipfile.ZipFile(at, "w") as z:
        for d, _, names in os.walk(os.path.join(root, "gleaner")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), root))
    spark.sparkContext.addPyFile(at)
