"""Activation and score files as Spark data sources.

Two layouts are read where they lie. A *store* is one folder with ``meta.json``,
``index.npy`` (hash, offset and number of tokens of each document) and
``activations.int8``, rows of ``r`` channels one after another. *Scores* are
shards: ``docs_<shard>.jsonl`` (a start and a number of tokens a document, in
row order, and which document it is) beside ``scores_<shard>.npy`` (tokens x layers x concepts), with
``columns.json``, ``quant.json`` and ``corpus_stats.json`` for all. Executors
read byte ranges of their own; the driver reads metadata and headers alone.
Shards and hashes that are asked for are options of the read, and nothing else
is opened. They are no pushed filters on purpose: with Spark 4.1 the filters
that one use of a frame pushes into a Python source stay for its other uses,
which then miss rows. Paths are what pyarrow's file systems read, the same on all nodes.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import dealt

STORE_FORMAT = "activation-store-v2"
#: Kinds of source that a store may name (fixed values).
SOURCE_KINDS = ("qwen-encoder", "probe-scores")
#: Documents of a store and bytes of values that one batch holds at most (a longer document is a batch of its own).
BATCH_DOCS, BATCH_BYTES = 1024, 16 << 20
INDEX = np.dtype([("hash", "<u8"), ("off", "<i8"), ("n", "<i4")])


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _bytes(path: str) -> bytes:
    system, at = _files(path)
    with system.open_input_stream(at) as f:
        return f.read()


def _json(path: str) -> dict:
    return json.loads(_bytes(path))


def _npy(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and the place of the first value of a file of one array, from its header."""
    system, at = _files(path)
    with system.open_input_file(at) as f:
        head = io.BytesIO(f.read_at(min(f.size(), 1 << 14), 0))
    version = np.lib.format.read_magic(head)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if fortran:
        raise ValueError(f"{path} is not stored row by row")
    return shape, kind, head.tell()


def _rows(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list array of flat values, one list a document."""
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0), kind))


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _StoreReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.per_task = options["path"].rstrip("/"), int(options.get("docsPerTask", 1 << 16))
        meta = _json(f"{self.path}/meta.json")
        if meta.get("format") != STORE_FORMAT:
            raise ValueError(f"{self.path}: format {meta.get('format')!r} is not {STORE_FORMAT!r}")
        kinds = [k for k in options.get("kinds", ",".join(SOURCE_KINDS)).split(",") if k]
        if meta.get("source_kind") not in kinds:
            raise ValueError(f"{self.path}: source_kind {meta.get('source_kind')!r} is none of {kinds}")
        self.r, self.scale = int(meta["r"]), np.float32(meta["scale"])
        self.wanted = np.array(json.loads(options["hashes"]), np.int64) if "hashes" in options else None
        (self.docs,), self.kind, self.at = _npy(f"{self.path}/index.npy")

    def partitions(self) -> list[_Range]:
        return [_Range(k, min(k + self.per_task, self.docs)) for k in range(0, self.docs, self.per_task)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        system, at = _files(f"{self.path}/index.npy")
        with system.open_input_file(at) as f:
            raw = f.read_at((partition.last - partition.first) * self.kind.itemsize, self.at + partition.first * self.kind.itemsize)
        index = np.frombuffer(raw, self.kind)
        hashes = np.ascontiguousarray(index["hash"]).view("<i8")
        if self.wanted is not None:
            mine = np.isin(hashes, self.wanted)
            index, hashes = index[mine], hashes[mine]
        if not len(index):
            return
        system, at = _files(f"{self.path}/activations.int8")
        with system.open_input_file(at) as f:
            for k, last in _groups(index["n"] * self.r):
                part = index[k:last]
                parts = [np.frombuffer(f.read_at(int(n) * self.r, int(off) * self.r), np.int8).astype(np.float32) * self.scale for off, n in zip(part["off"], part["n"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[k:last]), pa.array(part["n"], pa.int32()), _rows(parts, pa.float32())], names=["doc_hash", "n", "values"])


def _groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring documents of bounded number and bytes."""
    first, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > first and (k - first >= BATCH_DOCS or held + size > BATCH_BYTES):
            yield first, k
            first, held = k, 0
        held += size
    yield first, len(sizes)


class ActivationStore(DataSource):
    """``doc_hash``, ``n`` and ``values`` (``n`` rows of ``r`` channels, one after another) of each document of a store."""

    @classmethod
    def name(cls) -> str:
        return "skein_store"

    def schema(self) -> str:
        return "doc_hash long, n int, values array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _StoreReader(self.options)


class _ScoreReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        columns, quant, stats = (_json(f"{self.path}/{n}.json") for n in ("columns", "quant", "corpus_stats"))
        layers, names = list(columns["layers"]), list(columns["concepts"])
        layer = int(options["layer"])
        if layer not in layers:
            raise ValueError(f"layer {layer} is none of {layers}")
        asked = [c for c in options.get("concepts", "").split(",") if c] or names
        if missing := [c for c in asked if c not in names]:
            raise ValueError(f"concepts {missing} are not in the store")
        self.layer, self.at = layers.index(layer), [names.index(c) for c in asked]
        pick = lambda table, key: np.asarray(table[key], np.float32)[self.layer][self.at]
        self.zero, self.scale, self.mean, self.std = pick(quant, "zero"), pick(quant, "scale"), pick(stats, "mean"), pick(stats, "std")
        self.shards = sorted({int(s) for s in options["shards"].split(",") if s})

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(shard) for shard in self.shards] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        shard = partition.value
        if shard is None:
            return
        (_, layers, concepts), kind, begin = _npy(f"{self.path}/scores_{shard:05d}.npy")
        row_bytes = layers * concepts * kind.itemsize
        system, scores_at = _files(f"{self.path}/scores_{shard:05d}.npy")
        _, docs_at = _files(f"{self.path}/docs_{shard:05d}.jsonl")
        with system.open_input_file(scores_at) as scores, system.open_input_stream(docs_at) as docs:
            for first, lines in _lines(docs):
                names = [_named(x.get("doc")) for x in lines]
                starts, ns = (np.array([int(x[key]) for x in lines], np.int64) for key in ("start", "n"))
                for k, last in _groups(ns * row_bytes):
                    raw = b"".join(_together(scores, shard, begin, row_bytes, starts[k:last], ns[k:last]))
                    q = np.frombuffer(raw, kind).reshape(-1, layers, concepts)[:, self.layer][:, self.at].astype(np.float32)
                    values = pa.array(((q * self.scale + self.zero - self.mean) / self.std).ravel(), pa.float32())
                    ends = pa.array(np.concatenate([[0], np.cumsum(ns[k:last])]) * len(self.at), pa.int32())
                    m = last - k
                    cols = [pa.array([shard] * m, pa.int32()), pa.array(range(first + k, first + last), pa.int64()), pa.array(names[k:last], pa.string()), pa.array(ns[k:last], pa.int32()), pa.ListArray.from_arrays(ends, values)]
                    yield pa.RecordBatch.from_arrays(cols, names=["shard", "row", "doc", "n", "values"])


def _together(file, shard: int, begin: int, row_bytes: int, starts: np.ndarray, ns: np.ndarray) -> Iterator[bytes]:
    """The documents' bytes; neighbours in the file are one read."""
    cuts = np.flatnonzero(starts[1:] != starts[:-1] + ns[:-1]) + 1
    for k, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ns)], strict=True):
        start, n = int(starts[k]), int(ns[k:last].sum())
        raw = file.read_at(n * row_bytes, begin + start * row_bytes)
        if len(raw) != n * row_bytes:
            raise ValueError(f"shard {shard} has no {n} scores at {start}")
        yield raw


def _named(doc) -> str | None:
    return doc if doc is None or isinstance(doc, str) else json.dumps(doc)


def _lines(stream) -> Iterator[tuple[int, list[dict]]]:
    """Row numbers and lines of a file of JSON lines, some thousand lines at a time."""
    row, held, rest = 0, [], b""
    while chunk := stream.read(1 << 20):
        lines = (rest + chunk).split(b"\n")
        rest = lines.pop()
        held = [json.loads(x) for x in lines if x]
        if held:
            yield row, held
            row += len(held)
    if rest.strip():
        yield row, [json.loads(rest)]


class ProbeScores(DataSource):
    """``shard``, ``row``, ``doc``, ``n`` and ``values`` (``n`` rows of standardised scores of one layer's concepts) of each document of score shards.

    ``doc`` is what the document's line says of it, as text; null if it says nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "skein_scores"

    def schema(self) -> str:
        return "shard int, row long, doc string, n int, values array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _ScoreReader(self.options)


def _reading(spark: SparkSession, source: type[DataSource]):
    spark.dataSource.register(source)
    return spark.read.format(source.name())


def read_store(spark: SparkSession, path: str, hashes: list[int] | None = None, kinds: tuple[str, ...] = SOURCE_KINDS, docs_per_task: int = 1 << 16) -> DataFrame:
    """A store's documents, or only those of a list of ``hashes``. Another format or kind is an error before anything is read."""
    reading = _reading(spark, ActivationStore).option("path", path).option("kinds", ",".join(kinds)).option("docsPerTask", docs_per_task)
    return (reading if hashes is None else reading.option("hashes", json.dumps(hashes))).load()


def read_scores(spark: SparkSession, path: str, shards: list[int], layer: int, concepts: list[str] | None = None) -> DataFrame:
    """Standardised scores of ``shards``, of which each is a task's; no other file is opened. An unknown layer or concept is an error before anything is read."""
    reading = _reading(spark, ProbeScores).option("path", path).option("layer", layer).option("shards", ",".join(map(str, shards)))
    return reading.option("concepts", ",".join(concepts or [])).load()


def write_scores(rows: DataFrame, path: str, layers: list[int], concepts: list[str], quant: dict, stats: dict) -> list[int]:
    """``rows(shard, row, n, q)``, ``q`` the int8 values of ``n`` tokens, as score shards, and the three descriptions. The shards written, in order.

    A task writes whole shards, in row order, under other names and moves them when they are
    complete, so that one that is run again leaves the same files. Rows of a shard have to be 0, 1, 2 and so on.
    With a column ``doc`` in place of ``row``, documents are whatever it calls them, with gaps, repeats or null:
    they lie in its order, and their lines name them.
    """
    width = len(layers) * len(concepts)
    named = "row" not in rows.columns
    key = "doc" if named else "row"
    sized = rows.groupBy("shard").agg(F.sum("n").cast("long").alias("_tokens"))  # a row a shard
    counted = rows.join(F.broadcast(sized), "shard").select("shard", key, "n", "_tokens", F.col("q").cast("array<tinyint>").alias("q"))
    ordered = dealt(counted, "shard", key, "n", "q")  # so that documents of one name lie in the same order if a task is run again
    system, at = _files(path)
    system.create_dir(at)
    for name, value in (("columns", {"layers": layers, "concepts": concepts}), ("quant", quant), ("corpus_stats", stats)):
        with system.open_output_stream(f"{at}/{name}.json") as f:
            f.write(json.dumps(value).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, at = _files(path)
        now, mark, open_files, row_due, start = None, uuid.uuid4().hex, [], 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            for f in open_files:
                f.close()
            if now is not None:
                for name in (f"scores_{now:05d}.npy", f"docs_{now:05d}.jsonl"):
                    system.move(f"{at}/.{mark}.{name}", f"{at}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32())], names=["shard"])

        for batch in batches:
            shards, ns = (batch.column(i).to_numpy() for i in (0, 2))
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), batch.num_rows]
            for k, last in zip(cuts[:-1], cuts[1:], strict=True):
                if k == last:
                    continue
                if shards[k] != now:
                    yield from close()
                    now, row_due, start = int(shards[k]), 0, 0
                    open_files = [system.open_output_stream(f"{at}/.{mark}.scores_{now:05d}.npy"), system.open_output_stream(f"{at}/.{mark}.docs_{now:05d}.jsonl")]
                    head = io.BytesIO()
                    np.lib.format.write_array_header_1_0(head, {"descr": "|i1", "fortran_order": False, "shape": (batch.column(3)[k].as_py(), len(layers), len(concepts))})
                    open_files[0].write(head.getvalue())
                n, q, docs = ns[k:last].astype(np.int64), batch.column(4).slice(k, last - k), batch.column(1).slice(k, last - k).to_pylist()
                found = q.value_lengths().fill_null(-1).to_numpy()
                due = docs if named else range(row_due, row_due + len(docs))
                wrong = [i for i, (x, y, same) in enumerate(zip(docs, due, found == n * width, strict=True)) if x != y or not same]
                if wrong:
                    i = wrong[0]
                    raise ValueError(f"row {docs[i]} of shard {now}: expected row {due[i]} of {n[i] * width} values, found {found[i]}")
                values = q.flatten()
                if values.null_count:
                    raise ValueError(f"rows of shard {now} hold values that are null")
                open_files[0].write(np.ascontiguousarray(values.to_numpy(), np.int8).tobytes())
                starts = (start + np.cumsum(n) - n).tolist()
                lines = ({"start": s, "n": m} for s, m in zip(starts, n.tolist(), strict=True))
                if named:
                    lines = ({"doc": doc} | x for doc, x in zip(docs, lines, strict=True))
                open_files[1].write("".join(json.dumps(x) + "\n" for x in lines).encode())
                row_due, start = row_due + len(docs), start + int(n.sum())
        yield from close()

    return sorted(r["shard"] for r in ordered.mapInArrow(run, "shard int").collect())  # a number a shard
