"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters the records by seeded hashes into buckets of about
``bucket_bytes``; pass two reads each bucket whole, shuffles it
(``shuffle`` is Spark's seeded Fisher-Yates) and lays the buckets of a shard
one after the other. The shard is a function of doc_id and the shard count
(rendezvous hashing), so that one more shard takes rows only into itself.
Buckets hash the record's id and its place in the scan together with the seed,
so the copies of one record spread like any others; their number follows the
bytes of each shard, so that each bucket fits a task, however many rows one id has.
A table that is not a stored one is stored first, as scans of it may not give the same places.

Edge cases: a null text has size 1 and checksum 0; null ids hash like any
value; an empty table gives an empty result; repeated rows are kept, each with
its own slot; other columns are ignored. Rows whose marks tie go by their place in the scan; a text of any length
is one row, and a bucket that it overfills holds it alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

BUCKET_BYTES = 4 << 20
SEED = 20240611


def rendezvous(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose hash with ``key`` is largest."""
    marks = F.array(*(F.xxhash64(key, F.lit(seed + i)) for i in range(shards)))
    return (F.array_position(marks, F.array_max(marks)) - 1).cast("int")


def scattered(docs: DataFrame, shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """Pass one: records with doc_id, text, size, shard, mark (orders a bucket) and bucket, and the number of buckets."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = stored(docs).select("doc_id", F.col("text").cast("string").alias("text")).withColumn("size", size)
    rows = rows.withColumn("shard", rendezvous(F.col("doc_id"), shards, seed))
    held_bytes = {r["shard"]: r["bytes"] for r in rows.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}  # a row a shard
    each = [max(1, math.ceil(held_bytes.get(k, 0) / bucket_bytes)) for k in range(shards)]
    base = [sum(each[:k]) for k in range(shards)]

    def of(values: list[int]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("shard") + 1)

    rows = rows.withColumn("mark", F.xxhash64("doc_id", F.monotonically_increasing_id(), F.lit(seed)))
    return rows.withColumn("bucket", (of(base) + F.pmod(F.col("mark"), of(each))).cast("int")), sum(each)


def shuffled(docs: DataFrame, shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Records with their place: doc_id, text, size, shard, slot, grown_shard. A bucket has about ``bucket_bytes``, or one longer record."""
    rows, buckets = scattered(docs, shards, seed, bucket_bytes)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))

    held = rows.repartition(buckets, "bucket").groupBy("bucket", "shard").agg(F.collect_list(F.struct("mark", "doc_id", "size", "text")).alias("held"))
    # rows of a bucket and buckets of a task in one order before the shuffle, so that a task that runs again draws the same
    ordered = held.select("bucket", "shard", F.sort_array("held").alias("held")).sortWithinPartitions("bucket")
    mixed = ordered.select("bucket", "shard", F.shuffle("held", F.lit(seed)).alias("held"))
    out = mixed.join(starts, "bucket").select("shard", "first", F.posexplode("held").alias("pos", "r"))
    return out.select(
        "r.doc_id", "r.text", "r.size", "shard", (F.col("first") + F.col("pos")).alias("slot"),
        rendezvous(F.col("r.doc_id"), shards + 1, seed).alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = SEED) -> None:
    """Write the shards as ``path/shard=N/`` in slot order within each file."""
    out = shuffled(docs, shards, seed).select("shard", "slot", "doc_id", "text")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)


def op2_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shuffled(table(spark, sf_dir, "documents"), 8)
    return placed.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        "shard", "slot", "grown_shard",
    )
