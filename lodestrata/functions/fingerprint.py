"""64-bit SimHash of texts, and near-duplicates by it."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def simhash_of(text: str | None, width: int = 4) -> int | None:
    """Bit b is set where more character shingles' hashes have it than not; shingles are of the lowered word characters,
    their hash is the first half of the MD5, and repeats count. The value is the signed form of the 64 bits."""
    if text is None:
        return None
    s = "".join(re.findall(r"[a-z0-9_]+", text.lower()))
    h = [int.from_bytes(hashlib.md5(s[i : i + width].encode()).digest()[:8], "big") for i in range(max(len(s) - width + 1, 1))]
    bits = np.unpackbits(np.array(h, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    up = bits.sum(axis=0, dtype=np.int64) * 2 > len(h)
    return int(np.packbits(up).view(">u8")[0].astype(np.uint64).view(np.int64))


@F.pandas_udf(T.LongType())
def simhash(text: pd.Series) -> pd.Series:
    return pd.Series([simhash_of(t) for t in text], dtype="Int64")


def similar_fingerprints(rows: DataFrame, *, key: str, fingerprint: str, distance: int = 3) -> DataFrame:
    """``key_a, key_b, distance``: pairs within ``distance`` bits. The 64 bits are cut into distance + 1 bands: two within the
    distance agree in one band at least, so only equal bands are joined. Equal fingerprints are joined as one value and
    reported once for each pair of keys."""
    n = distance + 1
    width = -(-64 // n)
    one = rows.where(F.col(key).isNotNull() & F.col(fingerprint).isNotNull()).select(F.col(key).alias("k"), F.col(fingerprint).cast("long").alias("f")).distinct()
    values = one.select("f").distinct()
    band = lambda i: F.shiftrightunsigned(F.shiftleft(F.col("f"), i * width), 64 - min(width, 64 - i * width))
    bands = values.select("f", F.posexplode(F.array(*[band(i) for i in range(n)])).alias("i", "b"))
    x, y = bands.alias("x"), bands.alias("y")
    d = F.bit_count(F.col("x.f").bitwiseXOR(F.col("y.f")))
    near = x.join(y, (F.col("x.i") == F.col("y.i")) & (F.col("x.b") == F.col("y.b")) & (F.col("x.f") < F.col("y.f"))).where(d <= distance).select(F.col("x.f").alias("fa"), F.col("y.f").alias("fb"), d.alias("distance")).distinct()
    same = values.select(F.col("f").alias("fa"), F.col("f").alias("fb"), F.lit(0).alias("distance"))
    both = near.unionByName(same).join(one.select(F.col("k").alias("ka"), F.col("f").alias("fa")), "fa").join(one.select(F.col("k").alias("kb"), F.col("f").alias("fb")), "fb")
    return both.where("ka <> kb and (fa <> fb or ka < kb)").select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"), "distance").distinct()
