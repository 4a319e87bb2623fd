"""This package on the executors of a cluster that has no copy of it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def archive(folder: str) -> str:
    """A zip file, in folder, of the modules of this package."""
    here = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(folder, "locutio.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), os.path.dirname(here)))
    return out


def ship(spark: SparkSession) -> None:
    """Send this package to all executors, present and future; Spark serves the file from the driver."""
    spark.sparkContext.addPyFile(archive(tempfile.mkdtemp(prefix="package-")))
