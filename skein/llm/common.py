"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Byte table that lower-cases A-Z and leaves every other UTF-8 byte alone.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 256) -> None:
    """Keep Arrow batches small: a few long documents must not fill a worker.

    This is a setting of the session and stays: frames are lazy, and it is read
    when they run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Only where that is unset (a local test
    session) a temporary one is used.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="skein-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder and return it."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


class Tables:
    """Tables in the shared folder, compressed and in columns, that go when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Tables:
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written and read again."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few longs that may be broadcast: 2**19 of them are about 16 MB.
BROADCAST_ROWS = 1 << 19


def few(df: DataFrame) -> DataFrame:
    """``df``, a stored table of a few longs a row, marked for a broadcast if it has few rows; else it is joined by a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


#: Plan nodes that give the same rows in the same order whenever they run (fixed names).
_STEADY = frozenset("Project Filter Relation LogicalRDD LocalRelation Range SubqueryAlias".split())


def stored(docs: DataFrame) -> DataFrame:
    """``docs`` where its rows come straight out of a scan, else a checkpoint of it: operators that name rows by their place read it more than once."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    nodes = {m[1] for line in plan.splitlines() if (m := re.match(r"[\s:+\-!'*()\d]*(\w+)", line))}
    return docs if nodes <= _STEADY else cut(docs)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def n_words(text: Column) -> Column:
    """Words of a text as a JVM expression; null counts as none."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(marks, SPACE, "")).cast("long")
