"""Sizes of texts in tokens of a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; every operator takes another file as a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of that vocabulary.
SPLIT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[str, object] = {}


def encoder(vocabulary: str = VOCABULARY):
    """The encoder of a rank file, loaded once per worker process."""
    if vocabulary not in _LOADED:
        import tiktoken

        if not os.path.exists(vocabulary):
            raise FileNotFoundError(f"no vocabulary file at {vocabulary}")
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _LOADED[vocabulary] = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[vocabulary]


def _count(vocabulary: str):
    def run(batches):
        for batch in batches:
            code = encoder(vocabulary)
            sizes = [0 if not t else len(code.encode_ordinary(t)) for t in batch.column("__text").to_pylist()]
            names = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sizes, pa.int64())], names=[*names, "tokens"])

    return run


def with_tokens(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and ``tokens`` BIGINT, the size of ``text``; null and empty texts have size 0.

    The text itself goes to the Python worker but not beyond it.
    """
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInArrow(_count(vocabulary), f"{schema}, tokens bigint")
