"""Make the package importable in Python workers that would not find it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, unless the program runs in the repository or has it on PYTHONPATH."""
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if app in _done or ROOT in paths or os.getcwd() == ROOT:
        return
    file = os.path.join(tempfile.mkdtemp(), "atlasforge.zip")
    with zipfile.ZipFile(file, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "atlasforge")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, ROOT))
    spark.sparkContext.addPyFile(file)
    _done.add(app)
