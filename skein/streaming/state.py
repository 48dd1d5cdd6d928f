"""Stateful operators: bounded runs as ordered groups, endless ones as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PREFILL, RUNNING, REBUFFER = "prefill", "running", "rebuffer"


def next_phase(phase: str, depth: float, prefill: float, rebuffer: float, dry: float) -> str:
    """Hysteresis: fill to ``prefill``, run until below ``dry``, then fill to ``rebuffer``."""
    if phase == RUNNING:
        return REBUFFER if depth < dry else RUNNING
    return RUNNING if depth >= (prefill if phase == PREFILL else rebuffer) else phase


def phases(depths: DataFrame, prefill: float, rebuffer: float, dry: float) -> DataFrame:
    """``depths(key, ord, depth)`` with the phase after each reading."""
    if not 0 <= dry < rebuffer <= prefill:
        raise ValueError("need 0 <= dry < rebuffer <= prefill")

    def run(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phase = PREFILL
        for f in frames:
            out = []
            for x in f["depth"]:
                phase = next_phase(phase, x, prefill, rebuffer, dry)
                out.append(phase)
            yield f.assign(phase=out)

    schema = ", ".join(f"{n} {t}" for n, t in depths.select("key", "ord", "depth").dtypes) + ", phase string"
    return depths.select("key", "ord", "depth").repartition("key").sortWithinPartitions("key", "ord").groupBy("key").applyInPandas(run, schema)


def stream_phases(depths: DataFrame, prefill: float, rebuffer: float, dry: float) -> DataFrame:
    """The same over a stream; the phase is kept per key between micro-batches."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase = state.get[0] if state.exists else PREFILL
        for f in frames:
            out = []
            for x in f.sort_values("ord")["depth"]:
                phase = next_phase(phase, x, prefill, rebuffer, dry)
                out.append(phase)
            yield f.sort_values("ord")[["key", "ord", "depth"]].assign(phase=out)
        state.update((phase,))

    kinds = dict(depths.dtypes)
    schema = f"key {kinds['key']}, ord {kinds['ord']}, depth {kinds['depth']}, phase string"
    return depths.groupBy("key").applyInPandasWithState(run, schema, "phase string", "append", GroupStateTimeout.NoTimeout)


def complete_utf8(held: bytes) -> tuple[str, bytes]:
    """Text of all whole characters, and the bytes that may still become one; invalid bytes are U+FFFD."""
    for k in range(1, min(4, len(held) + 1)):
        lead = held[-k]
        if lead & 0xC0 != 0x80:
            need = 4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2 if lead >= 0xC0 else 1
            if need > k:
                return held[:-k].decode("utf-8", "replace"), held[-k:]
            break
    return held.decode("utf-8", "replace"), b""


def stream_text(tokens: DataFrame) -> DataFrame:
    """``tokens(session, ord, piece binary)`` as text that never splits a character."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = bytes(state.get[0]) if state.exists else b""
        for f in frames:
            rows = []
            for o, p in f.sort_values("ord")[["ord", "piece"]].itertuples(index=False):
                text, held = complete_utf8(held + bytes(p))
                rows.append((key[0], o, text))
            yield pd.DataFrame(rows, columns=["session", "ord", "text"])
        state.update((held,))

    return tokens.groupBy("session").applyInPandasWithState(run, f"session {dict(tokens.dtypes)['session']}, ord long, text string", "held binary", "append", GroupStateTimeout.NoTimeout)


def read_documents(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A file stream of document shards with bounded micro-batches; the checkpoint is the resume point."""
    return spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def char_totals(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
