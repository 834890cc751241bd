"""Vector arithmetic in double precision, and vectors as bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a norm is zero; null where either is null."""
    n = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(dot(a, b) / n)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def stub_embedding(text: Column, dim: int) -> Column:
    """Deterministic vector of a text: the first byte of the SHA-256 of text and position, scaled to -1..1."""
    byte = lambda i: F.conv(F.substring(F.sha2(F.concat(text, i.cast("string")), 256), 1, 2), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: byte(i) / 127.5 - 1)


@F.pandas_udf(T.BinaryType())
def to_bytes(v: pd.Series) -> pd.Series:
    """32-bit floats, little-endian; null for a null vector."""
    return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_bytes(v: pd.Series) -> pd.Series:
    """The vector of such bytes; null for null bytes and for a length that isn't a multiple of four."""
    return v.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, dtype="<f4"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
