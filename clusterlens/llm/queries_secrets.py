"""Query of the secret scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens.llm.queries import query
from clusterlens.llm.secret_scan import BASE, MORE, scan, span_list


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_FOUND = " UNION ALL ".join(
    f"SELECT doc_row, {place} AS place, '{rule.kind}' AS kind, regexp_extract_all(text, {_quoted(rule.pattern)}) AS m,"
    f" regexp_extract_all(text, {_quoted(rule.pattern)}, {rule.group}) AS j, string_split_regex(text, {_quoted(rule.pattern)}) AS b, {rule.least} AS least"
    f" FROM d WHERE regexp_matches(text, {_quoted(rule.pattern)})"
    for place, rule in enumerate((*BASE, *MORE))
)
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS doc_row, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({_FOUND}),
e AS (
  SELECT doc_row, place, kind, m, j, b, least, unnest(range(1, len(m) + 1)) AS i FROM f
),
s AS (
  SELECT doc_row, place, kind, length(array_to_string(b[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS pos, length(m[i]) AS n
  FROM e WHERE length(j[i]) >= least
),
g AS (
  SELECT doc_row, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
    string_agg(kind || ':' || pos || ':' || (pos + n), ',' ORDER BY pos, place) FILTER (place < {len(BASE)}) AS base,
    string_agg(kind || ':' || pos || ':' || (pos + n), ',' ORDER BY pos, place) AS spans
  FROM s GROUP BY doc_row
)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
  CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_row)
"""


@query("op12_secret_scan", SQL)
def op12(read) -> DataFrame:
    found = scan(read("documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(rule.kind) for rule in BASE]
    base = F.filter("spans", lambda s: s["place"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))
