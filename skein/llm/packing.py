"""Best-fit packing by histogram patterns and non-negative least squares.

Documents become token pieces of at most ``capacity`` tokens. Only the
histogram of piece lengths (at most ``capacity`` rows, whatever the corpus
size) reaches the driver. There, patterns of up to three pieces that fill a
sequence exactly are enumerated, their repeat counts are fitted to the
histogram by non-negative least squares, rounded, and what they leave over is
packed best-fit over the same histogram. The plan is a list of intervals
"the pieces of length L numbered a..b go to sequences s.. at offset o", so
placing a piece is a binary search in a table whose size does not grow with
the data.

Edge cases: a null text is the empty text; an empty document is one piece that
holds only the end id; an empty table gives an empty result; repeated rows are
packed once each; null ``doc_id`` values are kept; other columns are ignored. A text of any length is
encoded whole in its own task. Pieces of one length are alike to the plan: which of them goes where follows their place in the scan.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bounded_batches, cut, table

END_ID = 2
WEIGHT = 4.0
#: Shares of the fitted counts that are tried: the residual packs tighter when it holds some of the easy pieces too.
SHARES = (1.0, 0.8, 0.6, 0.4, 0.2)
CAPACITY = 1024
_ENCODERS: dict[str, object] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """The encoder of a byte-level vocabulary file, one per worker process.

    ``*.json`` vocabularies are run through the rank file of the same name where
    it lies beside them: both hold the same merges and give the same ids, and
    the rank form is about five times as fast. The end-of-text string in a text
    is its special id, as the json form has it.
    """
    if path not in _ENCODERS:
        import os

        ranks_path = path.removesuffix(".json") + ".tiktoken"
        if path.endswith(".json") and os.path.exists(ranks_path):
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {"<|endoftext|>": len(ranks)}
            enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

            def encode(text: str) -> list[int]:
                if "<|endoftext|>" in text:
                    return enc.encode(text, allowed_special="all")
                return enc.encode_ordinary(text)
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)

            def encode(text: str) -> list[int]:
                return tok.encode(text, add_special_tokens=False).ids

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``n`` tokens; the first may be shorter."""
    head = n % capacity
    out = [(0, head)] if head else []
    return out + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenize and cut. ``part`` and ``nth`` number the pieces of a length within a task."""
    id_type = docs.schema["doc_id"].dataType
    fields = [
        T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.LongType()), T.StructField("nth", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows: list[int] = []
            cols: list[list] = [[] for _ in range(5)]
            all_ids: list[np.ndarray] = []
            for i, text in enumerate(batch.column(1)):
                ids = np.array(encode(text.as_py() or "") + [end_id], dtype="<u4")
                for k, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    piece = ids[start : start + length]
                    rows.append(i)
                    for col, v in zip(cols, (k, start, length, zlib.crc32(piece.tobytes()), int(seen[length])), strict=True):
                        col.append(v)
                    seen[length] += 1
                    if with_ids:
                        all_ids.append(piece.astype(np.int32))
            k, start, length, crc, nth = cols
            arrays = [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([part] * len(rows), pa.int64()), pa.array(nth, pa.int64())]
            if with_ids:
                arrays.append(pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, T.StructType(fields))


# ---------------------------------------------------------------- the plan


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All multisets of two or three of ``lengths`` that sum to ``capacity``; 0 pads pairs."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths] = True
    have[0] = True
    out = []
    for a in sorted((int(x) for x in lengths), reverse=True):  # a >= b >= c, a + b + c = capacity
        rest = capacity - a
        b = np.arange(max(1, (rest + 1) // 2), min(a, rest) + 1)
        c = rest - b
        ok = have[b] & have[c]
        out.append(np.stack([np.full(int(ok.sum()), a), b[ok], c[ok]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)


def fit_counts(hist: np.ndarray, pats: np.ndarray, steps: int = 30_000) -> np.ndarray:
    """min ||W (A x - hist)||, x >= 0, by greedy coordinate descent.

    A column of A holds how often its pattern uses each length, so a step
    changes at most three residuals; it solves for the coordinate whose step
    lowers the objective most. W weighs long pieces more: short ones that are
    left over fill gaps later, long ones each open a sequence. Steps are
    bounded, hence so is the work on the driver.
    """
    x = np.zeros(len(pats))
    if not len(pats):
        return x
    a, b, c = pats.T
    w = (np.arange(len(hist)) / (len(hist) - 1.0)) ** WEIGHT
    w[0] = 0.0
    norm = w[a] * (1.0 + (a == b) + (a == c)) + w[b] * (1.0 + (b == a) + (b == c)) + w[c] * (1.0 + (c == a) + (c == b))
    resid = hist.astype(float).copy()
    resid[0] = 0.0
    order = np.concatenate([a, b, c])
    which = np.tile(np.arange(len(pats)), 3)
    by = np.argsort(order, kind="stable")
    ends = np.searchsorted(order[by], np.arange(len(hist) + 1))
    touching = [which[by[ends[v] : ends[v + 1]]] for v in range(len(hist))]
    grad = w[a] * resid[a] + w[b] * resid[b] + w[c] * resid[c]
    root = np.sqrt(norm)
    for _ in range(steps):
        step = np.maximum(grad / norm, -x)
        j = int(np.argmax(np.abs(step) * root))
        if abs(step[j]) < 0.25:
            break
        x[j] += step[j]
        for v in (a[j], b[j], c[j]):
            if v:
                resid[v] -= step[j]
                np.subtract.at(grad, touching[v], w[v] * step[j])
    return x


def rounded(hist: np.ndarray, pats: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole repeat counts that use no length more often than it occurs."""
    left = hist.astype(np.int64).copy()
    out = np.zeros(len(pats), dtype=np.int64)
    for j in np.argsort(-x, kind="stable"):
        want = int(np.floor(x[j] + 0.5))
        if want <= 0:
            break
        lens, uses = np.unique(pats[j][pats[j] > 0], return_counts=True)
        n = min(want, *(int(left[v] // u) for v, u in zip(lens, uses, strict=True)))
        if n > 0:
            out[j] = n
            left[lens] -= n * uses
    return out


def pack_residual(left: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing over a histogram: (sequences alike, [(length, repeats)])."""
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}  # by free space
    done: list[tuple[int, list[tuple[int, int]]]] = []

    def close(space: int, n: int, held: list[tuple[int, int]]) -> None:
        (open_.setdefault(space, []) if space else done).append((n, held))

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            space = min((s for s in open_ if s >= length), default=0)
            if space:
                m, held = open_[space].pop()
                if not open_[space]:
                    del open_[space]
            else:
                space, held = capacity, []
                m = -(-n // (capacity // length))
            fit = space // length
            if n >= m:
                r = min(fit, n // m)
                close(space - r * length, m, [*held, (length, r)])
                n -= r * m
            else:
                close(space - length, n, [*held, (length, 1)])
                close(space, m - n, held) if held else None
                n = 0
    return done + [x for xs in open_.values() for x in xs]


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Intervals of (length, number within the length) with the place each gets."""
    hist = hist.astype(np.int64).copy()
    hist[0] = hist[capacity] = 0  # full pieces are sequences of their own
    pats = patterns(np.flatnonzero(hist), capacity)
    counts = rounded(hist, pats, fit_counts(hist, pats))
    best = None
    for share in SHARES:
        kept = (counts * share).astype(np.int64)
        left = hist.copy()
        np.subtract.at(left, pats.ravel(), np.repeat(kept, 3))
        left[0] = 0
        rest = pack_residual(left, capacity)
        total = int(kept.sum()) + sum(n for n, _ in rest)
        if best is None or total < best[0]:
            best = (total, kept, rest)
    _, kept, rest = best
    groups: list[tuple[int, list[tuple[int, int]]]] = []
    for j in np.flatnonzero(kept):
        lens, uses = np.unique(pats[j][pats[j] > 0], return_counts=True)
        groups.append((int(kept[j]), [(int(v), int(u)) for v, u in zip(lens, uses, strict=True)]))
    groups += rest

    used = np.zeros(capacity + 1, dtype=np.int64)
    rows, seq = [], 0
    for n, held in groups:
        at = 0
        for length, r in held:
            rows.append((length, int(used[length]), n, seq, at))
            used[length] += n * r
            at += length * r
        seq += n
    assert (used == hist).all()
    rows.sort()
    names = ("length", "first", "alike", "sequence", "offset")
    cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(names, cols, strict=True)) | {"sequences": np.int64(seq)}


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Place every piece of ``docs(doc_id, text)``: one row per piece.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    found = cut(pieces(docs, path or tokenizer_path(), capacity, end_id))
    short = found.where(F.col("length") < capacity)
    per_task = short.groupBy("part", "length").agg(F.count("*").alias("n"))
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        hist[r["length"]] = r["n"]
    p = plan(hist, capacity)
    shift = np.int64(1) << 50
    keys = p["length"] * shift + p["first"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            k = np.searchsorted(keys, length * shift + number, side="right") - 1
            nth = number - p["first"][k]
            sequence = p["sequence"][k] + nth % p["alike"][k]
            offset = p["offset"][k] + nth // p["alike"][k] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    schema = T.StructType([*found.select(names[:5]).schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = short.join(starts, ["part", "length"]).select(*names[:5], (F.col("nth") + F.col("before")).alias("number"))
    full = found.where(F.col("length") == capacity).select(*names[:5], (-1 - (F.col("part") * (1 << 36) + F.col("nth"))).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return numbered.mapInArrow(place, schema).unionByName(full)


def sequences(docs: DataFrame, placed: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed ids themselves: sequence_id, ids array<int>. ``placed`` comes from ``pack(docs)``; doc_id must be unique."""
    tokens = pieces(docs, path or tokenizer_path(), capacity, end_id, with_ids=True).select("doc_id", "piece", "ids")
    joined = placed.select("doc_id", "piece", "sequence_id", "offset").join(tokens, ["doc_id", "piece"])
    members = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most `capacity` members
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(members, lambda m: m["ids"])).alias("ids"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
