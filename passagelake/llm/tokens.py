"""Token counts with a public tokenizer whose file is given by path; nothing is trained or copied here."""

from __future__ import annotations

import os
from base64 import b64decode
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE vocabularies of this family cut a text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, Callable[[list[str]], list[int]]] = {}


def token_counter(path: str = DEFAULT_TOKENIZER) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens, loaded once a worker. Special tokens' strings count as ordinary text.

    path: a vocabulary as ranks (.tiktoken), or a tokenizer's definition (.json).
    """
    if path not in _LOADED:
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            t.no_truncation()
            t.no_padding()
            _LOADED[path] = lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            e = tiktoken.Encoding("counts", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
            _LOADED[path] = lambda texts: [len(e.encode_ordinary(x)) for x in texts]
    return _LOADED[path]


def with_token_counts(df: DataFrame, keep: list[str], text: str | Column, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Columns `keep` of `df` and n_tokens (long) of `text`; null and empty texts have 0. Only these columns reach Python."""
    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField("n_tokens", T.LongType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(path)
        for b in it:
            texts = b.column(b.num_columns - 1)
            n = np.zeros(b.num_rows, np.int64)
            at, some, size = [], [], 0
            for i in range(b.num_rows):
                s = texts[i].as_py()
                if s:
                    at.append(i)
                    some.append(s)
                    size += len(s)
                if some and (size > 500_000 or i == b.num_rows - 1):
                    n[at] = count(some)
                    at, some, size = [], [], 0
            if some:
                n[at] = count(some)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n)], names=[*keep, "n_tokens"])

    col = F.col(text) if isinstance(text, str) else text
    return df.select(*keep, col.alias("_text")).mapInArrow(run, schema)
