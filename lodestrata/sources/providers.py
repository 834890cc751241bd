"""Seams for what runs outside of Spark: embedding models, judges of link candidates, call-graph servers.

Each is a protocol with a deterministic stand-in, so that pipelines and tests run without it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class StubEmbedder:
    """The first byte of the SHA-256 of text and position, scaled to -1..1."""

    def __init__(self, dim: int = 16) -> None:
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.array([[hashlib.sha256(f"{t}{i}".encode()).digest()[0] / 127.5 - 1 for i in range(self.dim)] for t in texts], dtype=np.float32).reshape(-1, self.dim)


def embed(df: DataFrame, text: str, embedder: Embedder, *, into: str = "embedding", batch: int = 50) -> DataFrame:
    """``df`` with a vector a row (null for a null text); the model is loaded once a worker and fed in batches."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            out: list = [None] * len(p)
            have = [i for i, t in enumerate(p) if t is not None]
            for at in range(0, len(have), batch):
                ix = have[at : at + batch]
                for i, v in zip(ix, embedder.encode([p.iloc[k] for k in ix])):
                    out[i] = v.tolist()
            yield pd.Series(out)

    return df.withColumn(into, run(text))


def reembed(chunks: DataFrame, vectors: DataFrame, embedder: Embedder) -> DataFrame:
    """``chunk_id, embedding`` of all chunks: stored vectors of the right length are kept, the rest are computed. A run that
    broke off is carried on by running it again."""
    one = chunks.dropDuplicates(["chunk_id"]).select("chunk_id", "text")
    kept = vectors.where(F.size("embedding") == embedder.dim).dropDuplicates(["chunk_id"]).join(one.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "embedding")
    rest = one.join(kept.select("chunk_id"), "chunk_id", "left_anti")
    return kept.unionByName(embed(rest, "text", embedder).select("chunk_id", "embedding"))


class Judge(Protocol):
    def complete(self, payload: str) -> str: ...


def judge(payloads: DataFrame, model: Judge) -> DataFrame:
    """``batch_no, response``: a batch that fails has a null response, so the others aren't lost."""

    @F.pandas_udf("string")
    def run(p: pd.Series) -> pd.Series:
        def one(x: str) -> str | None:
            try:
                return model.complete(x)
            except Exception:  # noqa: BLE001
                return None

        return p.map(one)

    return payloads.select("batch_no", run("payload").alias("response"))


RESPONSE = "array<struct<pair_id:string,should_link:boolean,link_type:string,confidence:double>>"


def responses(raw: DataFrame) -> DataFrame:
    """Responses taken apart; what is no such JSON gives nothing."""
    return raw.select(F.explode(F.from_json("response", RESPONSE)).alias("r")).select("r.*")


def call_edges(answers: DataFrame) -> DataFrame:
    """``src, dst`` from a server's answers (``caller, callee, kind``): calls, inherited and imported definitions."""
    return answers.where(F.col("kind").isin("call", "inherits", "imports")).select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()


def subclasses(answers: DataFrame) -> DataFrame:
    """``base, subclass`` from answers of kind extends, each place once."""
    return answers.where("kind = 'extends'").select(F.col("callee").alias("base"), F.col("caller").alias("subclass")).distinct()
