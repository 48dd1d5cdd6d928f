"""Where activations come from: a store, a function of a document, or a scorer of batches, behind one protocol.

``lookup(docs)`` takes ``doc_id, text, n`` and gives ``doc_id, hit, values``
with one row of channels a token; a document without them has exact zeros.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store as A
from .joins import join_store

VALUES = T.ArrayType(T.ArrayType(T.FloatType()))
_ARROW = pa.list_(pa.list_(pa.float32()))


class Source(Protocol):
    channels: int

    def lookup(self, docs: DataFrame) -> DataFrame: ...


class StoreSource:
    """``store(doc_hash, n, values)`` by content and token count, with seeded noise on rows that are not zero."""

    def __init__(self, store: DataFrame, channels: int, sigma: float = 0.0, seed: int = 0):
        self.store, self.channels, self.sigma, self.seed = store, channels, sigma, seed

    def lookup(self, docs: DataFrame) -> DataFrame:
        keyed = docs.select("doc_id", "n", A.content_hash("text").alias("doc_hash"))
        out = join_store(keyed, self.store, "doc_hash", "n", {"values": A.zeros(F.col("n"), self.channels)})
        if self.sigma > 0:
            out = out.withColumn("values", A.seeded_noise(self.seed, self.sigma)("values", "doc_hash"))
        return out.select("doc_id", "hit", "values")


class FnSource:
    """``fn(text, n)`` gives an (n, channels) array; another shape is an error. Free of noise."""

    def __init__(self, fn: Callable[[str, int], np.ndarray], channels: int):
        self.fn, self.channels = fn, channels

    def lookup(self, docs: DataFrame) -> DataFrame:
        fn, channels = self.fn, self.channels
        return BatchSource(lambda texts, counts: [fn(t, n) for t, n in zip(texts, counts, strict=True)], channels).lookup(docs)


class BatchSource:
    """``score(texts, counts)`` gives an (n, channels) array for each of a batch of texts, as a model does."""

    def __init__(self, score: Callable[[list[str], list[int]], list[np.ndarray]], channels: int):
        self.score, self.channels = score, channels

    def lookup(self, docs: DataFrame) -> DataFrame:
        score, channels = self.score, self.channels

        @F.arrow_udf(VALUES)
        def values(texts: pa.Array, counts: pa.Array) -> pa.Array:
            t, n = [x or "" for x in texts.to_pylist()], counts.to_pylist()
            out = [np.asarray(v, np.float32) for v in score(t, n)]
            for v, rows in zip(out, n, strict=True):
                if v.shape != (rows, channels):
                    raise ValueError(f"values of the shape {v.shape}, not {(rows, channels)}")
            return pa.array([v.tolist() for v in out], _ARROW)

        return docs.select("doc_id", F.lit(True).alias("hit"), values("text", "n").alias("values"))


def statistics(source: Source, docs: DataFrame) -> DataFrame:
    """channel, rms, nonzero over all tokens of ``docs`` that the source has."""
    token = source.lookup(docs).where("hit").select(F.explode("values").alias("row"))
    x = token.select(F.posexplode("row").alias("channel", "x")).withColumn("x", F.col("x").cast("double"))
    return x.groupBy("channel").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.avg((F.col("x") != 0).cast("double")).alias("nonzero"))


def option_losses(rows: DataFrame, loss: Callable[[list[list[int]]], list[np.ndarray]]) -> DataFrame:
    """``rows(item, option, ids, s, e)``: mean loss over each option's span by a model's ``loss``, and ``picked``, the first option with the least."""

    @F.arrow_udf(T.DoubleType())
    def mean(ids: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        return pa.array([float(np.mean(v[s:e])) for v, s, e in zip(loss(ids.to_pylist()), starts.to_pylist(), ends.to_pylist(), strict=True)], pa.float64())

    scored = rows.select("item", "option", mean("ids", "s", "e").alias("loss"))
    return scored.groupBy("item").agg(F.min_by("option", F.struct("loss", "option")).alias("picked"), F.min("loss").alias("loss"))
