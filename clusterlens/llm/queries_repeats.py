"""Queries of the two operators that remove repeated passages."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clusterlens.llm import recompression, suffix_arrays
from clusterlens.llm.queries import query

WORDS_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(0, 13)) AS k FROM later)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS kept
  FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op10_recompression", WORDS_SQL)
def op10(read) -> DataFrame:
    return recompression.removals(read("documents")).drop("spans")


BYTES_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n_bytes FROM d),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 99)) AS i FROM n WHERE n_bytes >= 100)),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1
),
marks AS (
  SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 100 AS fresh FROM later
),
spans AS (
  SELECT doc_id, s, min(i) AS a, max(i) + 100 AS b
  FROM (SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM marks) GROUP BY doc_id, s
),
parts AS (
  SELECT doc_id, a AS upto, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans
  UNION ALL
  SELECT n.doc_id, n.n_bytes, coalesce(max(b), 0) FROM n LEFT JOIN spans USING (doc_id) GROUP BY n.doc_id, n.n_bytes
),
kept AS (
  SELECT doc_id, string_agg(substr(h, CAST(2 * since + 1 AS BIGINT), CAST(2 * (upto - since) AS BIGINT)), '' ORDER BY since, upto) AS k
  FROM parts JOIN n USING (doc_id) GROUP BY doc_id
),
sizes AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM n JOIN kept USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


@query("op1_suffix_arrays", BYTES_SQL)
def op1(read) -> DataFrame:
    return suffix_arrays.removals(read("documents")).drop("spans")
