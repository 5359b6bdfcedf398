"""Makes this library importable on the executors."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

import clusterlens

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the library's source to the executors of this application, once.

    The archive lies in the driver's temporary folder, from which Spark serves it.
    """
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    package = os.path.dirname(os.path.abspath(clusterlens.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="clusterlens-"), "clusterlens-source")
    context.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package)))
    _done.add(context.applicationId)
