"""Whole-text counts that the quality classifier and the rule learner use.

All are exact integers over the complete text. Words are longest runs without
ASCII white space; null texts have no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fresh

NAMES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "top_count", "n_adjacent", "n_trigrams", "n_upper", "n_lower",
    "n_digits", "n_exclaims", "n_pipes", "n_stops", "n_lines", "n_bytes", "n_wide", "max_word", "n_quotes",
)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_STOPS = np.frombuffer(b".,;:?", np.uint8)
_QUOTES = np.frombuffer(b"\"'=@/", np.uint8)


def stats(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n = len(words)
    chars = len(raw) - int(by_byte[128:192].sum())  # continuation bytes are no code points
    white = int(by_byte[32] + by_byte[9:14].sum())
    lines = raw.split(b"\n")
    full = [x for x in lines if x.strip()]
    distinct = top = adjacent = repeat = trigrams = longest = 0
    if n:
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
        distinct = len(known)
        top = int(np.bincount(ids).max())
        adjacent = int((ids[1:] == ids[:-1]).sum())
        longest = max(map(len, known))
        if n > 2:
            two = ids[:-1] * distinct + ids[1:]
            if distinct > 2_000_000:  # keys of three words would not fit 64 bits
                two = np.unique(two, return_inverse=True)[1]
            _, back, counts = np.unique(two[:-1] * distinct + ids[2:], return_inverse=True, return_counts=True)
            again = (counts > 1)[back]
            hit = np.zeros(n, dtype=bool)
            hit[:-2] |= again
            hit[1:-1] |= again
            hit[2:] |= again
            repeat, trigrams = int(hit.sum()), len(counts)
    return (
        n, chars - white, int(by_byte[_SYMBOLS].sum()), len(full) - len(set(full)), repeat, distinct, top, adjacent, trigrams, int(by_byte[65:91].sum()), int(by_byte[97:123].sum()),
        int(by_byte[48:58].sum()), int(by_byte[33]), int(by_byte[124]), int(by_byte[_STOPS].sum()), len(full), len(raw), int(by_byte[192:].sum()), longest, int(by_byte[_QUOTES].sum()),
    )


@F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in NAMES]))
def _stats(texts: pa.Array) -> pa.Array:
    rows = np.array([stats(t.as_py()) for t in texts], dtype=np.int64).reshape(-1, len(NAMES))
    return pa.StructArray.from_arrays([pa.array(rows[:, j]) for j in range(len(NAMES))], names=list(NAMES))


def text_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and one long column per name in ``NAMES``."""
    bounded_batches(docs.sparkSession)
    held = fresh(docs, "_stats")
    return docs.select(*keep, _stats(F.col("text").cast("string")).alias(held)).select(*keep, *(F.col(f"{held}.{n}").alias(n) for n in NAMES))


def with_stats(docs: DataFrame, held: str) -> DataFrame:
    """``docs`` with a struct column ``held`` of all counts."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(held, _stats(F.col("text").cast("string")))


def features(get=F.col) -> dict[str, Column]:
    """Length-free measures of a text as JVM expressions over its counts."""

    def share(a: str, b: str) -> Column:
        return get(a) / F.greatest(get(b), F.lit(1)).cast("double")

    letters = F.greatest(get("n_upper") + get("n_lower"), F.lit(1)).cast("double")
    return {
        "log_words": F.log1p(get("n_words").cast("double")),
        "word_length": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "n_words"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "distinct": share("n_distinct", "n_words"),
        "top": share("top_count", "n_words"),
        "adjacent": share("n_adjacent", "n_words"),
        "trigrams": share("n_trigrams", "n_words"),
        "upper": get("n_upper") / letters,
        "digits": share("n_digits", "n_bytes"),
        "exclaims": share("n_exclaims", "n_words"),
        "pipes": share("n_pipes", "n_words"),
        "stops": share("n_stops", "n_words"),
        "line_words": F.log1p(share("n_words", "n_lines")),
        "wide": share("n_wide", "n_bytes"),
        "max_word": F.log1p(get("max_word").cast("double")),
        "quotes": share("n_quotes", "n_words"),
    }
