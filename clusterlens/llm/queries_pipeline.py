"""The pipeline as a query."""

from __future__ import annotations

import corpus_pipeline

from clusterlens.llm.queries import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
