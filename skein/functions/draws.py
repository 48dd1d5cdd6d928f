"""Draws of Python's seeded generator (Mersenne Twister), row by row from an index.

Each row seeds a generator of its own, so that results hang on the index alone
and not on partitions. Draws give places and marks; texts are put together by
column expressions. A permutation is one sequence of draws: a task makes it as
numbers, one integer of eight bytes a row, and rows of any size join it by their rank.
"""

from __future__ import annotations

import random
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def others(seed: int, k: int) -> Callable[[Column, Column], Column]:
    """A function of a row's index and the number of rows: ``Random(seed + index).sample`` of ``k`` of the other indices.

    Where there are fewer than ``k`` others, all of them in the order drawn. Null for a null index.
    """

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(index: pa.Array, rows: pa.Array) -> pa.Array:
        out = []
        for i, n in zip(index.to_pylist(), rows.to_pylist(), strict=True):
            if i is None:
                out.append(None)
                continue
            drawn = random.Random(seed + i).sample(range(n - 1), min(k, n - 1))
            out.append([j + (j >= i) for j in drawn])
        return pa.array(out, pa.list_(pa.int64()))

    return run


def choice(seed: int) -> Callable[[Column, Column], Column]:
    """A function of an index and a number of items: the place that ``Random(seed + index).choice`` takes first; null where there is no item."""

    @F.arrow_udf(T.LongType())
    def run(index: pa.Array, items: pa.Array) -> pa.Array:
        pairs = zip(index.to_pylist(), items.to_pylist(), strict=True)
        return pa.array([random.Random(seed + i).randrange(n) if i is not None and n else None for i, n in pairs], pa.int64())

    return run


SPELLING = T.StructType([
    T.StructField("letter", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("lower", T.BooleanType()),
    T.StructField("letter_quote", T.StringType()), T.StructField("word_quote", T.StringType()), T.StructField("mark", T.BooleanType()),
])
QUOTES = ("", "'", '"')
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def spelling_draws(seed: int, templates: int) -> Callable[[Column, Column, Column], Column]:
    """A function of an index, the number of words and the word that the index drew: what is drawn after the word.

    The letter is one of the word nine times in ten; three templates in ten are in lower case. An empty word has no letter and a null result.
    """

    @F.arrow_udf(SPELLING)
    def run(index: pa.Array, words: pa.Array, word: pa.Array) -> pa.Array:
        out = []
        for i, n, w in zip(index.to_pylist(), words.to_pylist(), word.to_pylist(), strict=True):
            if i is None or not w:
                out.append(None)
                continue
            rng = random.Random(seed + i)
            rng.randrange(n)
            letter = rng.choice(w if rng.random() < 0.9 else LETTERS)
            row = {"letter": letter, "template": rng.randrange(templates), "lower": rng.random() < 0.3}
            out.append(row | {"letter_quote": rng.choice(QUOTES), "word_quote": rng.choice(QUOTES), "mark": rng.random() < 0.5})
        return pa.array(out, pa.struct([("letter", pa.string()), ("template", pa.int32()), ("lower", pa.bool_()), ("letter_quote", pa.string()), ("word_quote", pa.string()), ("mark", pa.bool_())]))

    return run


PERSONA = T.StructType([T.StructField(n, T.StringType()) for n in ("topic", "persona", "dynamic", "first_message_examples")])


def diversity(topics: dict[str, list[str]], personas: list[str], dynamics: list[str], openers: dict[str, list[str]], seed: int = 0) -> Callable[[Column], Column]:
    """A function of an index: a topic of a drawn category, a persona, a dynamic, and openers of up to three kinds, a line each."""

    @F.arrow_udf(PERSONA)
    def run(index: pa.Array) -> pa.Array:
        out = []
        for i in index.to_pylist():
            if i is None:
                out.append(None)
                continue
            rng = random.Random(seed + i)
            topic = rng.choice(topics[rng.choice(list(topics))])
            persona, dynamic = rng.choice(personas), rng.choice(dynamics)
            kinds = rng.sample(list(openers), min(3, len(openers)))
            lines = "\n".join(f"- {rng.choice(openers[k])}" for k in kinds)
            out.append({"topic": topic, "persona": persona, "dynamic": dynamic, "first_message_examples": lines})
        return pa.array(out, pa.struct([(n, pa.string()) for n in PERSONA.names]))

    return run


def permutation(spark: SparkSession, n: int, seed: int, rows: int = 1 << 16) -> DataFrame:
    """place, index: ``Random(seed).shuffle`` of ``range(n)`` puts ``index`` at ``place``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in range(batch.num_rows):
                items = array("q", range(n))
                random.Random(seed).shuffle(items)
                for at in range(0, n, rows):
                    part = items[at : at + rows]
                    yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.int64())], names=["place", "index"])

    return spark.range(1).mapInArrow(run, "place long, index long")


def shuffled(indexed: DataFrame, index: str, seed: int) -> DataFrame:
    """``indexed``, whose column ``index`` numbers its rows from 0 without a gap, with ``place``: where the seeded shuffle puts each row."""
    order = permutation(indexed.sparkSession, indexed.count(), seed).select("place", F.col("index").alias("_index"))
    return indexed.join(order, indexed[index] == F.col("_index")).drop("_index")
