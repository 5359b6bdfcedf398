"""Query of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clusterlens.llm.quality_rules import MEASURES, judge
from clusterlens.llm.queries import query

_VALUES = " UNION ALL ".join(
    f"SELECT doc_id, lang, source, '{m.name}' AS measure, ({m.scale} * {m.above}) // greatest({m.below}, 1) AS v,"
    f" {m.slack} AS slack, {str(m.both).upper()} AS both_sides FROM c"
    for m in MEASURES
)
SQL = f"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines
  FROM documents
),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i : i + 7], ' ')) AS times
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)
),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 8)) AS k FROM g WHERE times > 1) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)
),
v AS ({_VALUES}),
b AS (
  SELECT *, CASE WHEN length(bin(v)) > 8 THEN (v >> (length(bin(v)) - 8)) << (length(bin(v)) - 8) ELSE v END AS bucket FROM v
),
quartiles AS (
  SELECT level, kl, ks, measure, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3, count(*) AS n FROM (
    SELECT 2 AS level, lang AS kl, source AS ks, measure, bucket FROM b
    UNION ALL SELECT 1, lang, NULL, measure, bucket FROM b
    UNION ALL SELECT 0, NULL, NULL, measure, bucket FROM b
  ) GROUP BY ALL
),
chosen AS (
  SELECT b.doc_id, b.measure, b.v, b.slack, b.both_sides,
    CASE WHEN s.n >= 200 THEN s.q1 WHEN l.n >= 200 THEN l.q1 ELSE a.q1 END AS q1,
    CASE WHEN s.n >= 200 THEN s.q3 WHEN l.n >= 200 THEN l.q3 ELSE a.q3 END AS q3
  FROM b
  JOIN quartiles s ON s.level = 2 AND s.kl IS NOT DISTINCT FROM b.lang AND s.ks IS NOT DISTINCT FROM b.source AND s.measure = b.measure
  JOIN quartiles l ON l.level = 1 AND l.kl IS NOT DISTINCT FROM b.lang AND l.measure = b.measure
  JOIN quartiles a ON a.level = 0 AND a.measure = b.measure
),
bad AS (
  SELECT doc_id, bool_or(v > q3 + 3 * (q3 - q1) + slack OR (both_sides AND v < q1 - 3 * (q3 - q1) - slack)) AS bad FROM chosen GROUP BY doc_id
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR bad) AS kept
FROM c JOIN bad USING (doc_id)
"""


@query("op9_quality_rules", SQL)
def op9(read) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(read("documents")).select(*columns)
