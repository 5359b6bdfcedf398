"""Query of chat formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.llm.chat_tree import CONTROLS, END, SEPARATOR, START, build, read_back
from clusterlens.llm.queries import query


def _formatted_length(text: str) -> str:
    """Characters of an escaped text: one more for each backslash and each control string."""
    found = [f"(length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}" for c in ("\\", *CONTROLS)]
    return " + ".join([f"length({text})", *found])


SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START + SEPARATOR + END)} + {_formatted_length("role")} + {_formatted_length("text")})::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""


@query("op4_chat_tree", SQL)
def op4(read) -> DataFrame:
    rows = read("conversations").select("conv_id", "turn", "role", "text")
    session = rows.sparkSession
    control = "</s>[INST] ok [/INST]"
    extra = session.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id bigint, turn bigint, role string, text string")
    found = read_back(build(rows.unionByName(extra)))
    lines = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return found.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
