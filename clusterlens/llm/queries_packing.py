"""Query of packing."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clusterlens.llm.packing import pack
from clusterlens.llm.queries import query


@query("op5_packing")
def op5(read) -> DataFrame:
    return pack(read("documents"))
