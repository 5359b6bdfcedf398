"""Queries of the quality and toxicity classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.llm import quality_classifier, toxicity
from clusterlens.llm.language import fold
from clusterlens.llm.queries import query


@query("op7_quality_classifier")
def op7(read) -> DataFrame:
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    found = quality_classifier.classify(read("documents"), read("labels"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op8_toxicity")
def op8(read) -> DataFrame:
    documents = read("documents").select("doc_id", "text")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.learn(documents, read("labels"), ~held_out)
    return toxicity.score(documents.withColumn("held_out", held_out), model)
