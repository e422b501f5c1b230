"""The package on the executors: a zip of its sources goes to them once per application."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package, wherever they run and whatever their own path is."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.realpath(__file__))
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="weftgraph-")), "weftgraph-source.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.join("weftgraph", os.path.relpath(path, package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
