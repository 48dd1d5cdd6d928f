"""Ordered best-fit packers over a bounded buffer, one sequence of rows per rank.

The pick depends on what the buffer holds at the time, so a rank's documents
are packed in order by one task; ranks are the unit of parallelism. Ids ride
with whatever payload the caller zips to them before packing.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


class Buffer:
    """Documents by length, then arrival: largest that fits and shortest in log time."""

    def __init__(self) -> None:
        self.keys: list[tuple[int, int]] = []  # (length, -arrival): the first of equal lengths is the last key
        self.docs: dict[int, object] = {}
        self.n = 0

    def __len__(self) -> int:
        return len(self.keys)

    def add(self, length: int, doc: object) -> None:
        insort(self.keys, (length, -self.n))
        self.docs[self.n] = doc
        self.n += 1

    def take_largest(self, room: int):
        i = bisect_right(self.keys, (room, 0)) - 1
        return None if i < 0 else self._take(i)

    def take_shortest(self):
        length = self.keys[0][0]
        return self._take(bisect_right(self.keys, (length, 0)) - 1)

    def _take(self, i: int):
        length, arrival = self.keys.pop(i)
        return length, self.docs.pop(-arrival)


def pack_stream(docs: Iterator[tuple[int, object]], capacity: int, buffer_size: int, mode: str) -> Iterator[list[tuple[object, int]]]:
    """Rows as lists of (document, tokens used). ``crop`` fills rows and drops a cropped document's tail; ``pad`` leaves room.

    ``pad`` cuts documents above ``capacity`` to their first part, which fills a
    row, and places every document. The source is bounded: near its end the
    buffer runs down, and a last row that ``crop`` cannot fill is not emitted.
    Documents without tokens have no place; ``accounting`` counts whatever has none.
    """
    buffer, source, more = Buffer(), iter(docs), True
    while True:
        row: list[tuple[object, int]] = []
        room = capacity
        while room:
            while more and len(buffer) < buffer_size:
                nxt = next(source, None)
                if nxt is None:
                    more = False
                elif nxt[0] > 0:
                    buffer.add(min(nxt[0], capacity) if mode == "pad" else nxt[0], nxt[1])
            if not len(buffer):
                break
            got = buffer.take_largest(room)
            if got is None:
                if mode == "pad":
                    break
                length, doc = buffer.take_shortest()
                got = (room, doc)
            row.append((got[1], got[0]))
            room -= got[0]
        if not row or (room and mode == "crop"):
            return
        yield row


#: Documents that a rank packs, about.
RANK_DOCS = 1 << 16


def ranks(docs: DataFrame, order: str, least: int = 8, row_group: int = 1024) -> DataFrame:
    """Adds ``rank``: row groups in turn, one rank for about ``RANK_DOCS`` documents and ``least`` at least."""
    world = max(least, -(-docs.count() // RANK_DOCS))
    return docs.withColumn("rank", F.pmod(F.floor(F.col(order) / row_group), F.lit(world)).cast("int"))


def packed(docs: DataFrame, capacity: int, buffer_size: int = 1000, mode: str = "crop") -> DataFrame:
    """``docs(rank, ord, doc_id, n)`` -> rank, row, slot, doc_id, start, used, n: where each document went, and its tokens.

    ``used`` below ``n`` is a document that was cut. A null ``n`` is none. Rows of one id are
    documents of their own. A rank is one task's work and its buffer that task's memory, so ranks have
    to grow with the data; ``ranks`` deals row groups to them as readers do.
    """
    schema = "rank int, row long, slot int, doc_id long, start int, used int, n long"

    def group(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def stream() -> Iterator[tuple[int, object]]:
            for f in frames:
                yield from ((int(n), (d, int(n))) for d, n in zip(f["doc_id"].astype("Int64"), f["n"], strict=True))

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["rank", "row", "slot", "doc_id", "start", "used", "n"]).astype({"doc_id": "Int64"})

        out = []
        for k, row in enumerate(pack_stream(stream(), capacity, buffer_size, mode)):
            at = 0
            for slot, ((doc, n), used) in enumerate(row):
                out.append((key[0], k, slot, doc, at, used, n))
                at += used
            if len(out) > 20_000:
                yield frame(out)
                out = []
        yield frame(out)

    sized = F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")
    ordered = docs.select("rank", "ord", "doc_id", sized).repartition("rank").sortWithinPartitions("rank", "ord", "doc_id", "n")
    return ordered.groupBy("rank").applyInPandas(group, schema)


class PackRows:
    """``packed`` as a table function: one partition is one rank, whose rows come in order.

    A rank's ids and lengths are held until its last row has come; ranks are bounded as for ``packed``.
    """

    def __init__(self) -> None:
        self.docs: list[tuple[int, object]] = []
        self.options: tuple[int, int, str] | None = None
        self.rank: int | None = None

    def eval(self, row: Row, capacity: int, buffer_size: int, mode: str) -> Iterator[tuple]:
        if mode not in ("crop", "pad"):
            raise ValueError(f"mode is crop or pad, not {mode!r}")
        self.rank, self.options = row["rank"], (capacity, buffer_size, mode)
        n = int(row["n"] or 0)
        self.docs.append((n, (row["doc_id"], n)))
        yield from ()

    def terminate(self) -> Iterator[tuple]:
        if self.options is None:
            return
        for k, placed in enumerate(pack_stream(iter(self.docs), *self.options)):
            at = 0
            for slot, ((doc, n), used) in enumerate(placed):
                yield self.rank, k, slot, doc, at, used, n
                at += used


def register_packers(spark: SparkSession) -> None:
    """Lets SQL call ``pack_rows(TABLE(docs) PARTITION BY rank ORDER BY ord, capacity, buffer_size, mode)`` over docs(rank, ord, doc_id, n)."""
    spark.udtf.register("pack_rows", F.udtf(PackRows, returnType="rank int, row long, slot int, doc_id long, start int, used int, n long"))


def padded(places: DataFrame, docs: DataFrame, capacity: int, fill: int) -> DataFrame:
    """Packed rows of ``docs(doc_id, ids)``: rank, row, consumed (documents of the rank by the row's end), ids filled to ``capacity``, targets with -1 where the next id is filling."""
    from pyspark.sql.window import Window

    part = F.struct("start", F.slice("ids", F.lit(1), F.col("used")).alias("ids"))
    rows = places.join(docs.select("doc_id", "ids"), "doc_id").groupBy("rank", "row").agg(F.array_sort(F.collect_list(part)).alias("p"))  # a row's documents
    body = F.flatten(F.transform("p", lambda x: x["ids"]))
    r = rows.select("rank", "row", F.size("p").alias("n"), body.alias("body"))
    ids = F.concat("body", F.array_repeat(F.lit(fill), capacity - F.size("body")))
    targets = F.concat(F.slice("body", F.lit(2), F.greatest(F.size("body") - 1, F.lit(0))), F.array_repeat(F.lit(-1), capacity - F.greatest(F.size("body") - 1, F.lit(0))))
    done = F.sum("n").over(Window.partitionBy("rank").orderBy("row"))
    return r.select("rank", "row", done.alias("consumed"), ids.alias("ids"), targets.alias("targets"))


def accounting(places: DataFrame, docs: DataFrame, capacity: int) -> DataFrame:
    """rows, utilisation, cropped and padded shares of a packing of ``docs(n)``, and n_documents, n_truncated, n_unplaced.

    ``cropped`` is the share of all documents' tokens that no row holds: the ends of those that
    were cut, and the documents that found no place. Shares of nothing are null.
    """
    rows = places.agg(F.countDistinct("rank", "row").alias("rows"), F.coalesce(F.sum("used"), F.lit(0)).alias("used"), F.count("*").alias("placed"), F.count_if(F.col("used") < F.col("n")).alias("n_truncated"))
    whole = docs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("n_documents"))
    both = rows.crossJoin(whole)  # one row each
    full = F.col("rows") * capacity
    return both.select(
        "rows", F.try_divide("used", full).alias("utilisation"), F.try_divide(F.col("tokens") - F.col("used"), "tokens").alias("cropped"), F.try_divide(full - F.col("used"), full).alias("padded"),
        "n_documents", "n_truncated", (F.col("n_documents") - F.col("placed")).alias("n_unplaced"),
    )


def length_batches(docs: DataFrame, budget: int, group: str) -> DataFrame:
    """Greedy batches in order of length with n * longest <= ``budget``: adds ``batch`` within ``group``."""
    schema = "doc_id long, n long, " + group + " " + docs.schema[group].dataType.simpleString() + ", batch long"

    def run(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, held = 0, 0
        for f in frames:
            out = []
            for n in f["n"]:
                if held and (held + 1) * n > budget:
                    batch, held = batch + 1, 0
                held += 1
                out.append(batch)
            yield pd.DataFrame({"doc_id": f["doc_id"], "n": f["n"], group: key[0], "batch": out})

    d = docs.select("doc_id", F.col("n").cast("long").alias("n"), group).repartition(group).sortWithinPartitions(group, "n", "doc_id")
    return d.groupBy(group).applyInPandas(run, schema)
