"""Session construction and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from functools import cache

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "clusterlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans of this library count on.

    All of them are Spark defaults or safe on any cluster; ``conf`` wins.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables and streaming checkpoints.

    It lies under the shared folder named by ``spark.checkpoint.dir``.  Only a local master may do
    without that: it gets a temporary folder, which goes when the process ends.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    token = os.urandom(8).hex()
    if root:
        return f"{root.rstrip('/')}/clusterlens/{name}-{token}"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    return f"{_own_folder()}/{name}-{token}"


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="clusterlens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder
