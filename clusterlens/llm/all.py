"""Collects the queries of all operators."""

from clusterlens.llm import (  # noqa: F401  (they register their queries)
    queries_chat,
    queries_classifiers,
    queries_contamination,
    queries_language,
    queries_packing,
    queries_pipeline,
    queries_quality,
    queries_repeats,
    queries_runs,
    queries_secrets,
    queries_simhash,
    queries_tokens,
)
from clusterlens.llm.queries import ORACLES, QUERIES  # noqa: F401
