"""Query of periodic run detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.llm.periodic_runs import find_runs, with_planted_runs
from clusterlens.llm.queries import query


@query("op11_periodic_runs")
def op11(read) -> DataFrame:
    documents = read("documents").select("doc_id", with_planted_runs(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_runs(documents)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words", "n_dropped")
