"""Readers with declared schemas, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import stable

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_shards(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """``text`` of every Parquet shard with its shard name and row index in the file."""
    df = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    return df.select(text, F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("row_index"))


def as_shards(docs: DataFrame, shard: str = "source", order: str = "doc_id", row_group: int = 16) -> DataFrame:
    """Number the rows of each shard and group them: adds ``shard``, ``row`` and ``rg``.

    Rows are numbered through over all shards, by range partitions, and counted
    from their shard's first: no task holds a whole shard. ``order`` has to be
    unique and neither column null. Parquet shards have their row numbers
    already: ``corpus_shards`` reads them.
    """
    n = running_total(docs, [shard, order], F.lit(1).cast("long"), "_n")
    first = n.groupBy(shard).agg(F.min("_n").alias("_first"))  # a row a shard
    row = n.join(first, shard).select(shard, order, (F.col("_n") - F.col("_first")).alias("row"))
    out = docs.join(row, [shard, order])
    return out.withColumn("shard", F.col(shard)).withColumn("rg", F.floor(F.col("row") / row_group).cast("long"))


def with_split(shards: DataFrame, shard: str = "shard") -> DataFrame:
    """The last shard in name order is ``val``, the others are ``train``."""
    last = shards.agg(F.max(shard).alias("_last"))
    return shards.crossJoin(F.broadcast(last)).withColumn("split", F.when(F.col(shard) == F.col("_last"), "val").otherwise("train")).drop("_last")  # one row


def strided(shards: DataFrame, start: int, step: int) -> DataFrame:
    """The row groups of one of ``step`` readers."""
    return shards.where((F.col("rg") >= start) & (F.pmod(F.col("rg") - start, F.lit(step)) == 0))


def epoch_scan(shards: DataFrame, rank: int, world: int, epochs: int, resume: tuple[int, int, int] | None = None) -> DataFrame:
    """A bounded form of the endless scan: rows with ``pq_idx`` and ``epoch``, after a resume point.

    ``resume`` is (pq_idx, rg_idx, epoch) of the last group read. The scan goes
    on with the reader's first group beyond that stride; earlier shards of that
    epoch are past.
    """
    files = shards.groupBy("shard").agg(F.max("rg").alias("last_rg"))
    pq_idx = F.row_number().over(Window.orderBy("shard")) - 1  # one row per file
    files = files.withColumn("pq_idx", pq_idx.cast("int"))
    mine = shards.where(F.pmod(F.col("rg"), F.lit(world)) == rank).join(F.broadcast(files.select("shard", "pq_idx")), "shard")
    first_epoch = resume[2] if resume else 1
    out = mine.withColumn("epoch", F.explode(F.sequence(F.lit(first_epoch), F.lit(first_epoch + epochs - 1))))
    if resume:
        at, rg, epoch = resume
        from_rg = (rg // world + 1) * world + rank
        later = (F.col("epoch") > epoch) | (F.col("pq_idx") > at) | ((F.col("pq_idx") == at) & (F.col("rg") >= from_rg))
        out = out.where(later)
    return out


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """The ``order`` columns, ``value`` as ``_v`` and its exclusive running sum over all rows in order.

    No task sees all rows: they are range-partitioned by the order, summed
    within their partition, and shifted by the totals of the partitions before
    (one small row a partition). Only these few columns are moved; ``order``
    has to be unique.
    """
    parts = stable(df.select(*order, value.alias("_v")).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    within = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumn(name, F.coalesce(F.sum("_v").over(within), F.lit(0)))
    totals = parts.groupBy("_p").agg(F.sum("_v").alias("_t"))
    before = totals.select("_p", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return local.join(before, "_p").withColumn(name, F.col(name) + F.col("_b")).drop("_p", "_b")


def shared_words(a: str, b: str) -> int:
    """How many words, split at blanks, two texts have in common at their heads."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # the longest common head, by halves
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    ends = all(lo == len(x) or x[lo] == " " for x in (a, b))
    return a.count(" ", 0, lo) + ends


def shared_with_next(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``key`` and n: the words that each text shares at its head with the next one in the order of (text, key).

    Texts are moved once, into range partitions, and compared as they stream by
    in order; the ends of partitions meet afterwards, in a join of the last of each with
    the first of the next. Null texts are empty.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("p", T.IntegerType()), T.StructField("end", T.IntegerType()), rows.schema["key"], T.StructField("n", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        p, last = TaskContext.get().partitionId(), None
        kinds = None

        def made(out):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=schema.names)

        for batch in batches:
            kinds = kinds or [pa.int32(), pa.int32(), batch.schema.types[0], pa.int64(), pa.string()]
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py()
                out.append((p, 0, None, None, t) if last is None else (p, None, last[0], shared_words(last[1], t), None))
                last = k, t
            yield made(out)
        if last is not None:
            yield made([(p, 1, last[0], None, last[1])])

    found = stable(rows.repartitionByRange("text", "key").sortWithinPartitions("text", "key").mapInArrow(run, schema))
    ends = found.where("end IS NOT NULL")
    firsts = ends.where("end = 0").select(F.col("p").alias("_next"), F.col("text").alias("_text"))
    lasts = ends.where("end = 1").select("p", "key", "text")
    following = lasts.select("p", F.lead("p").over(Window.orderBy("p")).alias("_next"))  # a number a partition

    @F.arrow_udf(T.LongType())
    def shared(mine, others):
        import pyarrow as pa

        return pa.array([None if b is None else shared_words(a, b) for a, b in zip(mine.to_pylist(), others.to_pylist(), strict=True)], pa.int64())

    edge = lasts.join(following, "p").join(firsts, "_next", "left").select("key", shared("text", "_text").alias("n"))
    return found.where("end IS NULL").select("key", "n").union(edge).select(F.col("key").alias(key), F.col("n").cast("int").alias("n"))


def budgeted(docs: DataFrame, cap_chars: int, max_chars: int, order: str = "doc_id") -> DataFrame:
    """Crop texts to ``cap_chars``; keep rows until ``max_chars`` are passed, the crossing ones too, with ``chars_before``.

    Ids and lengths alone are ranged and summed. The id that crosses (one row to the driver) then
    limits the scan, so that texts beyond it are neither read nor moved. Rows of one id stay together; null ids come first; a null text has no character.
    """
    chars = F.coalesce(F.least(F.length("text"), F.lit(cap_chars)), F.lit(0)).cast("long")
    sizes = docs.groupBy(order).agg(F.sum(chars).alias("_chars"))
    within = running_total(sizes, [order], F.col("_chars"), "chars_before").where(F.col("chars_before") <= max_chars).drop("_v")
    last = within.agg(F.max(order).alias("last")).first()["last"]
    kept = docs.where(F.col(order).isNull() | (F.col(order) <= F.lit(last)) if last is not None else F.col(order).isNull())
    return kept.withColumn("text", F.substring("text", 1, cap_chars)).join(within.withColumnRenamed(order, "_id"), F.col(order).eqNullSafe(F.col("_id"))).drop("_id")


def placed(docs: DataFrame, name: str = "place") -> DataFrame:
    """A table's rows with a number each, the same whenever the table is read: for joins of rows whose ids may repeat. ``docs`` has to come straight from files."""
    return docs.withColumn(name, F.monotonically_increasing_id())


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """Padded ``Task, Accuracy, Centered`` files."""
    schema = "Task string, Accuracy double, Centered double"
    return spark.read.csv(path, header=True, schema=schema, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def scrape_metrics(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Last value of each metric in log files: ``pattern`` has groups name and number; commas are dropped."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("run"), F.monotonically_increasing_id().alias("line"))
    hit = lines.where(F.col("value").rlike(pattern)).select("run", "line", F.regexp_extract("value", pattern, 1).alias("metric"), F.replace(F.regexp_extract("value", pattern, 2), F.lit(","), F.lit("")).cast("double").alias("number"))
    return hit.groupBy("run", "metric").agg(F.max_by("number", "line").alias("number"))


def first_at_least(values: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets(key, at)`` with ``found``: the least ``place`` of ``values(place, at)`` whose ``at`` is no less than the target's; null where there is none.

    ``at`` may not fall as ``place`` rises. Both sides are ranged together by ``at``; a range whose targets lie behind its last value takes the first one of the ranges after it.
    """
    kinds = [values.select("at", F.lit(1).alias("_kind"), "place", F.lit(None).cast("long").alias("key")), targets.select("at", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("place"), "key")]
    both = stable(kinds[0].unionByName(kinds[1]).repartitionByRange("at", "_kind", "place", "key").withColumn("_p", F.spark_partition_id()))
    falling = [F.col(c).desc() for c in ("at", "_kind", "place", "key")]
    within = Window.partitionBy("_p").orderBy(*falling).rowsBetween(Window.unboundedPreceding, 0)  # a frame that follows is made anew for each row
    heads = both.groupBy("_p").agg(F.min("place").alias("_head"))  # a row a range
    later = heads.select("_p", F.min("_head").over(Window.orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    found = F.coalesce(F.last("place", ignorenulls=True).over(within), F.col("_later"))
    return both.join(later, "_p").select("_kind", "key", "at", found.alias("found")).where("_kind = 0").drop("_kind")


def chained(jumps: DataFrame, start: int = 0) -> DataFrame:
    """``a`` of all places that ``jumps(a, b)`` leads to from ``start``, itself included; ``b`` is null where a chain ends.

    Each round doubles how far a jump goes, so rounds grow with the logarithm of the chain's length and no task walks along it.
    """
    spark = jumps.sparkSession
    reached = spark.createDataFrame([(start,)], "a long")
    while True:
        new = reached.join(jumps, "a").where("b IS NOT NULL").select(F.col("b").alias("a"))
        grown = stable(reached.union(new))
        if not new.limit(1).count():
            return reached
        reached = grown
        jumps = stable(jumps.join(jumps.select(F.col("a").alias("b"), F.col("b").alias("_c")), "b", "left").select("a", F.col("_c").alias("b")))


def shard_bounds(keys: DataFrame, shard_chars: int, group: int) -> list[tuple]:
    """First keys (h, id, place) of the shards of ``keys(h, id, place, chars)`` in order, and behind them that of the tail that is no shard.

    A shard ends with the first whole group of ``group`` rows at which it has ``shard_chars``. Lengths and keys alone are sorted; what
    comes to the driver is a key a shard, 24 bytes for ``shard_chars`` characters.
    """
    place = running_total(keys, ["h", "id", "place"], F.col("chars"), "before")
    number = running_total(keys, ["h", "id", "place"], F.lit(1).cast("long"), "_n")
    rows = place.join(number.select(F.col("place").alias("_place"), F.floor(F.col("_n") / group).alias("g")), F.col("place") == F.col("_place"))
    first = F.min(F.struct("h", "id", "place"))
    groups = stable(rows.groupBy("g").agg(F.min("before").alias("at"), F.count("*").alias("n"), F.sum("_v").alias("chars"), first.alias("first")))
    total = groups.where(F.col("n") == group).agg(F.max("g").alias("g"), F.max(F.col("at") + F.col("chars")).alias("at")).first()
    if total["g"] is None:
        return []
    ends = groups.where(F.col("n") == group).select((F.col("g") + 1).alias("place"), (F.col("at") + F.col("chars")).alias("at"))
    jumps = first_at_least(ends, groups.select(F.col("g").alias("key"), (F.col("at") + shard_chars).alias("at")))
    starts = chained(stable(jumps.select(F.col("key").alias("a"), F.col("found").alias("b"))))
    found = starts.join(groups.select(F.col("g").alias("a"), "first"), "a", "left").orderBy("a").collect()
    return [tuple(r["first"]) if r["first"] else None for r in found]


def repackaged(docs: DataFrame, shard_chars: int, group: int, seed: int = 42) -> DataFrame:
    """Shuffle and cut into shards of at least ``shard_chars`` at whole groups of ``group`` documents: adds ``shard``.

    The order is that of a seeded hash of the id. The tail that never meets both conditions is dropped. A document finds
    its shard among the shards' first keys, in its own task, so no text is moved until the shards are written. Null texts
    count as empty; rows with one id are documents of their own. ``docs`` has to come straight from files.
    """
    h = F.xxhash64(F.lit(seed), "doc_id")
    marked = placed(docs, "_place").withColumn("_h", h).withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("long"))
    chars = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    bounds = shard_bounds(marked.select(F.col("_h").alias("h"), F.col("_id").alias("id"), F.col("_place").alias("place"), chars.alias("chars")), shard_chars, group)
    tail = bounds[-1] if bounds else None
    shards = len(bounds) - 1

    @F.arrow_udf(T.LongType())
    def shard_of(hs, ids, places):
        import pyarrow as pa
        from bisect import bisect_right

        known = bounds if tail else bounds[:-1]
        out = (bisect_right(known, key) - 1 for key in zip(hs.to_pylist(), ids.to_pylist(), places.to_pylist(), strict=True))
        return pa.array([k if k < shards else None for k in out], pa.int64())

    if shards < 1:
        return marked.where("false").withColumn("shard", F.lit(0).cast("long")).drop("_h", "_id", "_place")
    return marked.withColumn("shard", shard_of("_h", "_id", "_place")).where("shard IS NOT NULL").drop("_h", "_id", "_place")


def write_corpus(df: DataFrame, path: str, row_group: int = 1024) -> None:
    """zstd shards without dictionaries or statistics, ``row_group`` rows a group."""
    w = df.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", "3")
    w.option("parquet.block.row.count.limit", str(row_group)).option("parquet.enable.dictionary", "false").option("parquet.column.statistics.enabled", "false").parquet(path)


def results_lines(results: DataFrame, core: DataFrame) -> DataFrame:
    """``results(task, accuracy, centered)`` and ``core(core)`` as padded lines: (place, value), heading first, score last."""
    line = F.format_string("%-35s, %-10s, %-10s", "task", F.format_string("%.6f", "accuracy"), F.format_string("%.6f", "centered"))
    head = results.sparkSession.createDataFrame([(0, f"{'Task':<35}, {'Accuracy':<10}, {'Centered':<10}")], "place int, value string")
    last = core.select(F.lit(2).alias("place"), F.format_string("%-35s, %-10s, %-10s", F.lit("CORE"), F.lit(""), F.format_string("%.6f", "core")).alias("value"))
    return head.union(results.select(F.lit(1), line)).union(last)


def write_results_csv(results: DataFrame, core: DataFrame, path: str) -> None:
    """One file of ``results_lines``, tasks in name order; a row a task."""
    results_lines(results, core).coalesce(1).sortWithinPartitions("place", "value").select("value").write.mode("overwrite").text(path)


def append_runs(runs: DataFrame, path: str) -> None:
    """Add the rows of a sweep to its CSV files."""
    runs.write.mode("append").csv(path, header=True)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A word a line, without white space at its ends; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")


TASKS = "label string, icl_task_type string, dataset_uri string, num_fewshot array<int>, continuation_delimiter string"


def read_bundle(spark: SparkSession, tasks: str, baselines: str) -> DataFrame:
    """Evaluation tasks (JSON lines) with their random baseline in percent (CSV with the columns ``Eval Task`` and ``Random baseline``)."""
    base = spark.read.csv(baselines, header=True, inferSchema=False).select(F.col("Eval Task").alias("label"), F.col("Random baseline").cast("double").alias("baseline"))
    return spark.read.schema(TASKS).json(tasks).join(F.broadcast(base), "label", "left")  # a row a task


def newest(files: DataFrame, tag: str = r"^d(\d+)", step: str = r"_(\d+)\.pt") -> DataFrame:
    """``files(folder, name, modified)`` of checkpoints -> folder and last step of the deepest model; without tags, of the one changed last."""
    depth = F.regexp_extract("folder", tag, 1).try_cast("int")
    by = files.groupBy("folder").agg(F.max(F.coalesce(depth, F.lit(-1))).alias("depth"), F.max(F.regexp_extract("name", step, 1).try_cast("long")).alias("step"), F.max("modified").alias("modified"))
    return by.orderBy(F.col("depth").desc(), F.col("modified").desc(), "folder").limit(1).select("folder", "step")


def scan_in_order(shards: DataFrame, shard: str, column: str, *more: str) -> DataFrame:
    """One column of one shard in the order of its rows."""
    return shards.where(F.col("shard") == shard).orderBy("row").select("row", column, *more)


def heads(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group in order; Spark keeps ``n`` a group and task before it deals them."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def rebased(spans: DataFrame) -> DataFrame:
    """``spans(shard, start, n, ...)`` with starts moved behind the shards that come before in name order."""
    total = spans.groupBy("shard").agg(F.sum("n").alias("_t"))  # a row a shard
    base = total.select("shard", F.coalesce(F.sum("_t").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return spans.join(base, "shard").withColumn("start", F.col("start") + F.col("_base")).drop("_base")
