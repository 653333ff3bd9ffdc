"""Sizes of texts in tokens of a public tokenizer. The vocabulary is read from a path and never kept here."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame

#: A byte-level vocabulary in ranks: one line a token, base64 and rank. Every executor reads it from here.
VOCABULARY = os.environ.get("RANGELOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how this vocabulary's pieces are cut before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@cache
def encoder(vocabulary: str = VOCABULARY):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY) -> DataFrame:
    """The ``keep`` columns and ``tokens`` of every document; whole texts are encoded. Null and empty texts have 0 tokens."""
    rows = documents.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", tokens bigint"

    def sized(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary).encode_ordinary
        for frame in frames:
            sizes = [len(encode(t)) if t else 0 for t in frame.pop("text")]
            yield frame.assign(tokens=sizes)

    return rows.mapInPandas(sized, schema)
