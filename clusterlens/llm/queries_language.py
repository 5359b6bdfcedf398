"""Query of language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.llm.language import fold, identify, learn_table
from clusterlens.llm.queries import query


@query("op3_language")
def op3(read) -> DataFrame:
    documents = read("documents")
    profiles = learn_table(documents.where(fold(F.col("doc_id"), 5) != 0))
    rows = documents.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "text")
    return identify(rows, profiles)
