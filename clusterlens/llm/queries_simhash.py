"""Query of SimHash near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clusterlens.llm.queries import query
from clusterlens.llm.simhash import near_duplicates


@query("op6_simhash")
def op6(read) -> DataFrame:
    return near_duplicates(read("documents"))
