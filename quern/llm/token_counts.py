"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers")
# Fixed value: how the public byte-level vocabularies split text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=4)
def encoder(path: str):
    """Function from a text to its token ids, by the kind of the file; loaded once in each process."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda text: t.encode(text, add_special_tokens=False).ids
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    raise ValueError(f"no tokenizer file: {path}")


def token_count(text: str | Column, tokenizer: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> Column:
    """Tokens of each whole text; null and empty texts have 0."""
    path = f"{folder}/{tokenizer}"

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(path)
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)
