"""An endless, resumable scan of corpus shards by one of several readers, as a stream.

The stream itself carries tickets, a row group each: its place and its epoch.
Tasks read the groups they name, so text never passes the driver, and the
offset (shard, group and epoch of the next group) is what Spark writes to the checkpoint:
a restarted query goes on with the group after the last committed batch, and a
batch that is run again reads the same groups. Shards are taken in name order, the last one
is the ``val`` split; a reader takes each ``world``-th group of a shard from ``rank`` on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..sources.stores import _files

TICKET = "path string, pq_idx int, rg_idx int, epoch int"
ROWS = "pq_idx int, rg_idx int, epoch int, row int, text string"


def resumed(state: dict, rank: int, world: int) -> dict:
    """The offset behind a loader's state (pq_idx and rg_idx of the last group read, and its epoch): the reader's first group beyond that stride."""
    return {"pq_idx": int(state["pq_idx"]), "rg_idx": (int(state["rg_idx"]) // world + 1) * world + rank, "epoch": int(state.get("epoch", 1))}


class Tickets(SimpleDataSourceStreamReader):
    """Offsets name the next group. Footers are read once a shard, when it is entered."""

    def __init__(self, options: dict):
        self.rank, self.world = int(options["rank"]), int(options["world"])
        self.per_batch, self.epochs = int(options["groupsPerBatch"]), int(options.get("epochs", 0))
        self.resume = json.loads(options["resume"]) if options.get("resume") else None
        from pyarrow import fs

        self.system, at = _files(options["path"])
        found = sorted(f.path for f in self.system.get_file_info(fs.FileSelector(at)) if f.is_file and f.path.endswith(".parquet"))
        if not found:
            raise FileNotFoundError(f"no shards under {options['path']}")
        self.shards = found[-1:] if options["split"] == "val" else found[:-1]
        self.groups: dict[int, int] = {}

    def width(self, shard: int) -> int:
        if shard not in self.groups:
            import pyarrow.parquet as pq

            with self.system.open_input_file(self.shards[shard]) as f:
                self.groups[shard] = pq.ParquetFile(f).num_row_groups
        return self.groups[shard]

    def at_group(self, offset: dict) -> dict | None:
        """The first offset from ``offset`` on that names a group of this reader; None where the last epoch is over, or no shard has one."""
        shard, group, epoch = offset["pq_idx"], offset["rg_idx"], offset["epoch"]
        for _ in range(2 * len(self.shards) + 1):
            if self.epochs and epoch > self.epochs:
                return None
            if shard < len(self.shards) and group < self.width(shard):
                return {"pq_idx": shard, "rg_idx": group, "epoch": epoch}
            shard, group = shard + 1, self.rank
            if shard >= len(self.shards):
                shard, epoch = 0, epoch + 1
        return None

    def after(self, offset: dict) -> dict:
        return offset | {"rg_idx": offset["rg_idx"] + self.world}

    def ticket(self, at: dict) -> tuple:
        return self.shards[at["pq_idx"]], at["pq_idx"], at["rg_idx"], at["epoch"]

    def initialOffset(self) -> dict:
        return self.resume or {"pq_idx": 0, "rg_idx": self.rank, "epoch": 1}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        out, now = [], start
        while len(out) < self.per_batch and (at := self.at_group(now)):
            out.append(self.ticket(at))
            now = self.after(at)
        return iter(out), now

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        now = start
        while now != end and (at := self.at_group(now)):
            yield self.ticket(at)
            now = self.after(at)

    def commit(self, end: dict) -> None:
        pass


class CorpusTickets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skein_corpus_tickets"

    def schema(self) -> str:
        return TICKET

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return Tickets(self.options)


def read_groups(tickets: DataFrame, text: str = "text", rows: int = 1024) -> DataFrame:
    """The texts of the groups that ``tickets`` name, with their rows' numbers in the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for t in batch.to_pylist():
                system, at = _files(t["path"])
                with system.open_input_file(at) as f:
                    place = 0
                    for part in pq.ParquetFile(f).iter_batches(rows, row_groups=[t["rg_idx"]], columns=[text]):
                        n = part.num_rows
                        same = [pa.array([t[k]] * n, pa.int32()) for k in ("pq_idx", "rg_idx", "epoch")]
                        yield pa.RecordBatch.from_arrays([*same, pa.array(range(place, place + n), pa.int32()), part.column(0).cast(pa.string())], names=["pq_idx", "rg_idx", "epoch", "row", "text"])
                        place += n

    return tickets.mapInArrow(run, ROWS)


def stream_corpus(spark: SparkSession, path: str, rank: int = 0, world: int = 1, split: str = "train", groups_per_batch: int = 64, epochs: int = 0, resume: dict | None = None, tasks: int = 8) -> DataFrame:
    """pq_idx, rg_idx, epoch, row and text of one reader's groups, ``groups_per_batch`` a micro-batch, for ``epochs`` (0: without end).

    ``resume`` is a loader's state, for a query that has no checkpoint yet.
    """
    if split not in ("train", "val"):
        raise ValueError(f"split is train or val, not {split!r}")
    spark.dataSource.register(CorpusTickets)
    reading = spark.readStream.format(CorpusTickets.name()).option("path", path).option("split", split).option("rank", rank).option("world", world)
    reading = reading.option("groupsPerBatch", groups_per_batch).option("epochs", epochs).option("resume", json.dumps(resumed(resume, rank, world)) if resume else "")
    return read_groups(reading.load().repartition(tasks))
