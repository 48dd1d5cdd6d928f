"""Tool use in sampled token logs, as state per sample.

A sample's tokens come in order. Tokens between the call marks are collected;
at the end of a call the calculator's answer is put in their place of the next
tokens (forced, mask 0), and the sampled ones follow. A sample ends at the
reply's end mark or the start mark; later tokens are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from ..functions.text import calculate
from ..functions.tokens import BYTE_SPECIALS
from ..session import dealt


class ToolUse:
    """The state of one sample in the byte vocabulary."""

    def __init__(self, special: dict[str, int] = BYTE_SPECIALS):
        self.special, self.call, self.done = special, None, False

    def feed(self, token: int) -> list[tuple[int, int]]:
        """(token, mask) of what the sample goes on with: the sampled token, then what it forces."""
        if self.done:
            return []
        s, out = self.special, [(token, 1)]
        if token in (s["<|assistant_end|>"], s["<|bos|>"]):
            self.done = True
        if token == s["<|python_start|>"]:
            self.call = []
        elif token == s["<|python_end|>"] and self.call is not None:
            said = bytes(t for t in self.call if t < 256).decode("utf-8", "replace")
            answer = calculate(said) if self.call else None
            if answer is not None:
                out += [(t, 0) for t in (s["<|output_start|>"], *answer.encode(), s["<|output_end|>"])]
            self.call = None
        elif self.call is not None:
            self.call.append(token)
        return out


def continued(log: DataFrame) -> DataFrame:
    """``log(sample, step, token)`` -> sample, place, token, mask, done: each sample as its cache sees it. ``done`` marks the row that ends a sample.

    Samples follow one another through a task's Arrow batches, with the state carried from batch to batch. Only marks and
    first tokens are looked at one by one; the runs between them are kept, dropped or collected whole.
    """
    schema = f"sample {log.schema['sample'].dataType.simpleString()}, place long, token int, mask int, done boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, place, last = ToolUse(), 0, None
        marks = [state.special[k] for k in ("<|assistant_end|>", "<|bos|>", "<|python_start|>", "<|python_end|>")]
        for batch in batches:
            samples, tokens, n = batch.column(0), batch.column(2), batch.num_rows
            if not n:
                continue
            if tokens.null_count:
                raise ValueError("a token is null")
            tokens = tokens.to_numpy()
            codes = pa.concat_arrays([samples[:1] if last is None else last, samples]).dictionary_encode("encode").indices.to_numpy()
            new = codes[1:] != codes[:-1]
            new[0] |= last is None
            last = samples[n - 1 :]
            kept, ends, forced, counts = np.ones(n, bool), np.zeros(n, bool), [], np.ones(n, np.int64)
            events = np.flatnonzero(new | np.isin(tokens, marks)).tolist()
            for at, following in zip([-1, *events], [*events, n], strict=True):
                if at >= 0:
                    if new[at]:
                        state = ToolUse()
                    out = state.feed(int(tokens[at]))
                    kept[at], ends[at] = bool(out), bool(out) and state.done
                    if len(out) > 1:
                        forced += [t for t, _ in out[1:]]
                        counts[at] = len(out)
                if state.done:
                    kept[at + 1 : following] = False
                elif state.call is not None:
                    state.call += tokens[at + 1 : following].tolist()
            counts[~kept] = 0
            first = np.cumsum(counts) - counts
            of = np.repeat(np.arange(n), counts)
            begins = np.concatenate([[-place], first[new]])[np.cumsum(new)]
            sampled = np.zeros(len(of), bool)
            sampled[first[kept]] = True
            said = np.empty(len(of), np.int32)
            said[sampled], said[~sampled] = tokens[kept], forced
            places = np.arange(len(of)) - begins[of]
            place = int(counts.sum() - begins[-1])
            yield pa.RecordBatch.from_arrays([samples.take(pa.array(of)), pa.array(places), pa.array(said), pa.array(sampled.astype(np.int32)), pa.array(ends[of])], names=["sample", "place", "token", "mask", "done"])

    return dealt(log.select("sample", "step", "token"), "sample", "step").mapInArrow(run, schema)


class ToolUseProcessor(StatefulProcessor):
    """``ToolUse`` of one sample after another as a stream's state: its place and marks as a value, the tokens of an open call as a list.

    With ``idle_ms`` a timer ends a sample for which no token has come for that long: its last row has no token.
    """

    def __init__(self, idle_ms: int = 0):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.use = handle.getValueState("use", "place long, calling boolean, done boolean, step long")
        self.call = handle.getListState("call", "token int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        place, calling, done, last = self.use.get() if self.use.exists() else (0, False, False, -1)
        state = ToolUse()
        state.done, state.call = done, [int(t) for (t,) in self.call.get()] if calling else None
        tokens = pd.concat(list(rows)).sort_values("step")
        out = []
        for step, token in tokens[["step", "token"]].itertuples(index=False):
            if step <= last:
                raise ValueError(f"step {step} of sample {key[0]} comes after step {last}")
            last = step
            out += state.feed(int(token))
        self.use.update((int(place + len(out)), state.call is not None, state.done, int(last)))
        self.call.clear()
        if state.call:
            self.call.put([(t,) for t in state.call])
        if self.idle_ms:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if not state.done:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self.rows(key, place, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        place, _, done, last = self.use.get()
        if not done:
            self.use.update((int(place + 1), False, True, int(last)))
            self.call.clear()
            yield self.rows(key, place, [(None, 0)])

    def rows(self, key, place: int, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame({"sample": [key[0]] * len(out), "place": range(place, place + len(out)), "token": [t for t, _ in out], "mask": [m for _, m in out]})
        return frame.astype({"place": "int64", "token": "Int32", "mask": "int32"})

    def close(self) -> None:
        pass


def stream_continued(log: DataFrame, idle_ms: int = 0) -> DataFrame:
    """``continued`` of a streaming ``log(sample, step, token)``: sample, place, token, mask as tokens come.

    However the log is cut into micro-batches, the rows are those of the whole. The state store has to be
    RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    schema = f"sample {log.schema['sample'].dataType.simpleString()}, place long, token int, mask int"
    mode = "ProcessingTime" if idle_ms else "None"
    return log.select("sample", "step", "token").groupBy("sample").transformWithStateInPandas(ToolUseProcessor(idle_ms), schema, "Append", mode)
