"""A sink of server-sent events: texts of sessions as ``data:`` lines, each micro-batch once.

Tasks write files under a folder that is no result; a commit moves them to the
folder of their batch, and an abort deletes them. A batch that is
run again after its commit finds its folder and leaves it, so no line is
there twice. Upstream, ``state.stream_text`` holds bytes back until a character is whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from ..sources.stores import _files


@dataclass
class Written(WriterCommitMessage):
    path: str | None


def event(text: str | None, done: bool | None, **more: object) -> str:
    """The events of a row: its text with what else it says, then the end of the stream; nothing for a row that has neither."""
    said = f"data: {json.dumps({'token': text, **more}, ensure_ascii=False)}\n\n" if text else ""
    return said + ("data: " + json.dumps({"done": True}) + "\n\n" if done else "")


class EventWriter(DataSourceStreamWriter):
    def __init__(self, options: dict):
        self.path, self.run = options["path"].rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        system, at = _files(self.path)
        place, out = f"{at}/_writing/{uuid.uuid4().hex}", None
        try:
            for r in iterator:
                if out is None:
                    system.create_dir(f"{at}/_writing")
                    out = system.open_output_stream(place)
                row = r.asDict()
                more = {k: v for k, v in row.items() if k not in ("text", "done", "ord") and v is not None}
                out.write(event(row.get("text"), row.get("done"), **more).encode())
        finally:
            if out is not None:
                out.close()
        return Written(place if out is not None else None)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        from pyarrow import fs

        system, at = _files(self.path)
        paths = sorted(m.path for m in messages if m is not None and m.path)
        final, fresh = f"{at}/batch={batchId:012d}", f"{at}/_writing/batch-{batchId}-{uuid.uuid4().hex}"
        if system.get_file_info(final).type != fs.FileType.NotFound:
            self._drop(system, paths)  # a batch that was committed before
            return
        system.create_dir(fresh)
        for k, p in enumerate(paths):
            system.move(p, f"{fresh}/part-{k:05d}.txt")
        system.move(fresh, final)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        system, _ = _files(self.path)
        self._drop(system, [m.path for m in messages if m is not None and m.path])

    @staticmethod
    def _drop(system, paths: list[str]) -> None:
        for p in paths:
            system.delete_file(p)


class Events(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skein_events"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return EventWriter(self.options)


def write_events(rows: DataFrame, path: str, checkpoint: str, **trigger: object):
    """Start a query that writes ``rows(text, done, ..)`` as events under ``path``; columns besides ``text``, ``done`` and ``ord`` are part of each event."""
    rows.sparkSession.dataSource.register(Events)
    return rows.writeStream.format(Events.name()).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """batch and value of each event that was committed."""
    from pyspark.sql import functions as F

    lines = spark.read.option("lineSep", "\n\n").text(path)
    return lines.where("value <> ''").select(F.col("batch").cast("long").alias("batch"), F.substring("value", F.lit(7), F.length("value")).alias("value"))
