"""Token counts and offsets by a public tokenizer, loaded once per Python worker."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the vocabulary files; the same path must exist on every executor.
TOKENIZER_DIR = os.environ.get("VOCATA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenization pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(folder: str = TOKENIZER_DIR, name: str = VOCABULARY):
    """The tokenizer of a vocabulary file."""
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> Column:
    """Number of tokens of a text; null texts have 0."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(folder, name)
        return pd.Series(np.fromiter((len(enc.encode_ordinary(t)) if t else 0 for t in texts), np.int32, len(texts)))

    return count(text)
