"""Tables written to the shared folder, and names for columns of any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens.session import scratch_dir


def stage(frame: DataFrame, name: str) -> DataFrame:
    """Write the rows to a fresh shared folder and read them again."""
    spark = frame.sparkSession
    folder = scratch_dir(spark, name)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def column(name: str) -> Column:
    """The column of exactly that name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, with underscores before it until no column is called so (case does not distinguish columns)."""
    known = {name.lower() for name in taken}
    while wanted.lower() in known:
        wanted = "_" + wanted
    return wanted
