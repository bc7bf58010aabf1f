"""Token counts of a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the vocabulary lies by default, and the splitting pattern that goes with it (a fixed value of that tokenizer).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(path: str = VOCABULARY):
    with open(path, "rb") as f:
        return _encoding(f.read())


def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of the whole text; 0 for null and empty texts. Special tokens in a text are ordinary text. The vocabulary file is read
    on the driver and sent along (about a megabyte); executors need no copy of it."""
    with open(path, "rb") as f:
        vocabulary = f.read()

    @F.pandas_udf("long")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(vocabulary).encode_ordinary
        for s in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in s], dtype="int64")

    return f(text)
