"""Pandas and Arrow functions that are declared without a session, and the package's way to the
executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def _later(make, ddl: str):
    def declare(f):
        def apply(*columns):
            return make(f, ddl)(*columns)

        apply.__doc__, apply.__name__ = f.__doc__, f.__name__
        return apply

    return declare


def pandas_function(ddl: str):
    """As pandas_udf(ddl), but made when it is first applied."""
    return _later(F.pandas_udf, ddl)


def arrow_function(ddl: str):
    """As arrow_udf(ddl), but made when it is first applied."""
    return _later(F.arrow_udf, ddl)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="ship")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch it while the driver lives
    path = os.path.join(folder, "lithoscope-engine.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
