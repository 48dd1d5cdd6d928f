"""Session with the settings the queries are written for."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC time; ``conf`` has dots as double underscores."""
    b = SparkSession.builder.appName("skein").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session without that setting gets a temporary one."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="skein-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stable(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder.

    For frames whose partitioning carries meaning: later uses must all see one evaluation.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, key: str, *order: str) -> DataFrame:
    """``df`` with all rows of a ``key`` in one partition, sorted by key and ``order``: for functions of partitions.

    Rows are dealt by a struct of the key. Spark leaves a deal by the bare column out where a join before it deals by that
    column, and may then split the join's partitions, and with them a key's rows, over several tasks.
    """
    return df.repartition(F.struct(key)).sortWithinPartitions(key, *order)
