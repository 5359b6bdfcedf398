"""Query of cross-tokenizer alignment."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from clusterlens.llm.queries import query
from clusterlens.llm.token_links import align

TOKENIZERS = "/opt/tokenizers"


def tokenizer_files(folder: str = TOKENIZERS) -> tuple[str, bytes]:
    """The content of the byte-level tokenizer and of the sentence-piece model in a folder of the driver."""
    with open(os.path.join(folder, "byte_bpe_50k.json"), encoding="utf-8") as one, open(os.path.join(folder, "piece_bpe_32k.model"), "rb") as two:
        return one.read(), two.read()


@query("op13_token_links")
def op13(read) -> DataFrame:
    return align(read("documents"), *tokenizer_files())
