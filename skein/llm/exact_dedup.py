"""Grace hash deduplication on complete content.

Records are partitioned by a digest of their normalised text (A-Z lowered).
Each task first folds its own rows into an open-addressing table, so that a
text that fills a third of the corpus leaves a task once per table and not
once per row. The shuffle is the first level of the partitioning; a bucket
whose records exceed ``memory_bytes`` is split into spill files by the next
bits of the digest, again and again until a part fits the table. The table
compares whole contents; two different texts under one digest raise an error
and are never merged. Spill files are scratch of the one task that writes and
reads them, like Spark's own spills: they go when the task ends, and a task
that is run again after a lost executor writes its own. The shuffle cuts buckets
of about ``bucket_bytes`` (16 MB) and a table holds ``memory_bytes`` (48 MB), so
spill files are for buckets that the digests fill unevenly or that a caller's
smaller ``memory_bytes`` asks for.

Defined results: null text counts as empty; of equal texts the row with the
largest doc_id stays (a null id is smallest), and of wholly equal rows exactly
one; an empty table gives an empty result; other columns are ignored. Texts of any length are compared
whole; one that is larger than a table fills one by itself.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, fresh, lower_ascii, stored, table

MEMORY_BYTES = 48 << 20
FANOUT = 16
Record = tuple[bytes, bytes, int]  # digest, content, rows


class OpenTable:
    """Linear probing; a slot holds the index of an entry, an entry whole content."""

    def __init__(self, slots: int = 1024):
        self.slots = [-1] * slots
        self.entries: list[list] = []
        self.bytes = 0

    def add(self, digest: bytes, content: bytes, rows: int) -> None:
        mask = len(self.slots) - 1
        i = int.from_bytes(digest[8:16], "little") & mask
        while (e := self.slots[i]) >= 0:
            known = self.entries[e]
            if known[1] == content:
                known[2] += rows
                return
            if known[0] == digest:
                raise ValueError("two different texts have one digest")
            i = (i + 1) & mask
        self.slots[i] = len(self.entries)
        self.entries.append([digest, content, rows])
        self.bytes += len(content) + 200
        if 3 * len(self.entries) > 2 * len(self.slots):
            self.grow()

    def grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for e, (digest, _, _) in enumerate(self.entries):
            i = int.from_bytes(digest[8:16], "little") & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = e


def fold(records: Iterable[Record], memory_bytes: int = MEMORY_BYTES) -> Iterator[Record]:
    """Combine what fits in memory; a full table is emitted and begun anew."""
    t = OpenTable()
    for r in records:
        t.add(*r)
        if t.bytes > memory_bytes:
            yield from map(tuple, t.entries)
            t = OpenTable()
    yield from map(tuple, t.entries)


def grace(records: Iterable[Record], memory_bytes: int = MEMORY_BYTES, level: int = 0) -> Iterator[Record]:
    """One record per distinct content, with its total of rows."""
    t = OpenTable()
    it = iter(records)
    for r in it:
        t.add(*r)
        if t.bytes > memory_bytes and len(t.entries) > 1:
            break
    else:
        yield from map(tuple, t.entries)
        return
    if level >= 16:
        raise ValueError("digest bits are used up")
    with tempfile.TemporaryDirectory(prefix="grace-") as scratch:
        files = [open(os.path.join(scratch, str(k)), "w+b") for k in range(FANOUT)]  # noqa: SIM115

        def spill(r: Record) -> None:
            half = r[0][16 + level // 2]
            pickle.dump(r, files[(half >> 4 if level % 2 else half) & 15], protocol=5)

        for e in t.entries:
            spill(tuple(e))
        del t
        for r in it:
            spill(r)
        for f in files:
            f.seek(0)
            yield from grace(_loaded(f), memory_bytes, level + 1)
            f.close()
            os.unlink(f.name)


def _loaded(f) -> Iterator[Record]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


_SCHEMA = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("content", T.BinaryType()), T.StructField("n", T.LongType())])
_CLASS = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("group_size", T.LongType())])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[Record]:
    for batch in batches:
        for d, c, n in zip(*(batch.column(i) for i in range(3)), strict=True):
            yield d.as_py(), c.as_py(), n.as_py()


def _batches(rows: Iterable[tuple], schema: T.StructType, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    kinds = {"binary": pa.binary(), "bigint": pa.int64()}
    types = [kinds[f.dataType.simpleString()] for f in schema]
    held: list[tuple] = []
    size = 0

    def made() -> pa.RecordBatch:
        cols = zip(*held, strict=True) if held else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=schema.names)

    for r in rows:
        held.append(r)
        size += 32 + (len(r[1]) if isinstance(r[1], bytes) else 0)
        if size > limit:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def classes(texts: DataFrame, parts: int, memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """``texts(digest, content, n)`` -> one row per distinct content: digest, group_size."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(fold(_records(batches), memory_bytes), _SCHEMA)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((d, n) for d, _, n in grace(_records(batches), memory_bytes)), _CLASS)

    return texts.mapInArrow(folded, _SCHEMA).repartition(parts, "digest").mapInArrow(merged, _CLASS)


def verdicts(docs: DataFrame, memory_bytes: int = MEMORY_BYTES, bucket_bytes: int = 16 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, row (its number in the scan), keep_id, group_size, kept, digest."""
    spark, docs = docs.sparkSession, stored(docs)
    bounded_batches(spark)
    text = lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    norm = docs.select("doc_id", text.alias("content"))
    sha = F.unhex(F.sha2("content", 256))
    rows = cut(norm.select("doc_id", sha.alias("digest"), F.octet_length("content").alias("bytes")).withColumn("row", F.monotonically_increasing_id()))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    found = classes(norm.select(sha.alias("digest"), F.col("content").cast("binary").alias("content"), F.lit(1).cast("long").alias("n")), parts, memory_bytes)
    stays = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("stays"))
    # a row per class, stored: Spark can then split the rows of a text that very many have in the join with them
    named = cut(found.join(stays, "digest"))
    out = rows.select("doc_id", "row", "digest").join(named, "digest")
    return out.select("doc_id", "row", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"), "digest")


def dedup(docs: DataFrame, memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    return verdicts(docs, memory_bytes).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_documents(docs: DataFrame, memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are matched by their place in the scan of a stored table.
    """
    docs = stored(docs)
    row = fresh(docs, "_row")
    stay = verdicts(docs, memory_bytes).where("kept").select(F.col("row").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(stay, row, "left_semi").select(*docs.columns)


def op4_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       text_sha256
FROM t
"""
