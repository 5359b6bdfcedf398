"""From raw documents to packed training batches, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run` writes each result as
Parquet to the shared folder and gives it to the next stage.  All but the last return the columns of ``documents``.

1. Quality rules drop documents that break an adaptive limit.
2. Of each group of documents that near-duplicate links connect (SimHash over three-word shingles, at most three
   differing bits), the document of the smallest id stays.
3. Word sequences of 13 words and more that an earlier document also holds are cut out.
4. Words of benchmark items are cut out; documents mostly made of them go.
5. What is left is packed into batches of equal padded length.

``n_chars``, where present, follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm import decontamination, packing, quality_rules, recompression, simhash
from clusterlens.llm.ship import ship
from clusterlens.llm.staging import stage


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.deduplicate(docs, shingle=3, budget=3)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _recounted(recompression.deduplicate(docs))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return _recounted(decontamination.clean(docs, benchmark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_passages),
    ("packing", packed),
]

# Components of near copies and the choice of bucket bounds have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
