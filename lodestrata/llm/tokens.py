"""Text sizes in tokens of a public tokenizer, whose rank file is read from a folder given by the caller."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import spread

FOLDER = os.environ.get("LODESTRATA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"


# Fixed value: the public pattern that splits text before the merges of such rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoding(folder: str, vocabulary: str, pattern: str = PATTERN):
    """One encoding a process. Nothing of the folder but the rank file is read."""
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> int:
    return len(encoding(folder, vocabulary).encode_ordinary(text)) if text else 0


def with_tokens(df: DataFrame, *, text: str, keep: list[str], folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the tokens of the whole text (0 for null). The text itself goes no further."""
    schema = df.select(*keep).withColumn("n_tokens", F.lit(0)).schema

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(folder, vocabulary)
        for b in batches:
            n = np.fromiter((len(e.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()), dtype=np.int32, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n)], names=[*b.schema.names[:-1], "n_tokens"])

    return spread(df.select(*keep, F.col(text).alias("_text"))).mapInArrow(op, schema)
