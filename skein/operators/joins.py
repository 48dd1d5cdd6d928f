"""Joins of token streams: by content, by place, as of an offset, by overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spans import overlaps


def join_store(docs: DataFrame, store: DataFrame, key: str, n: str, values: dict[str, Column]) -> DataFrame:
    """Left join on content key and token count; a count that differs is a miss.

    ``values`` maps each column of the store to what a miss gives for it: exact
    zeros for activations (``F.lit(0)``, or an array of zeros by ``n``).
    """
    s = store.select(F.col(key).alias("_k"), F.col(n).alias("_n"), *(F.col(v).alias(f"_{v}") for v in values))
    out = docs.join(s, (docs[key] == F.col("_k")) & (docs[n] == F.col("_n")), "left").withColumn("hit", F.col("_k").isNotNull())
    out = out.withColumns({v: F.when(F.col("hit"), F.col(f"_{v}")).otherwise(zero) for v, zero in values.items()})
    return out.drop("_k", "_n", *(f"_{v}" for v in values))


def join_positions(rows: DataFrame, spans: DataFrame, n: str = "n") -> DataFrame:
    """Left join on (shard, row) with a status: ok, miss_shard, miss_row or drift."""
    known = spans.select("shard").distinct().withColumn("_has", F.lit(True))
    s = spans.select("shard", "row", F.col("start"), F.col(n).alias("_n"))
    out = rows.join(s, ["shard", "row"], "left").join(F.broadcast(known), "shard", "left")  # a row a shard
    status = F.when(F.col("_has").isNull(), "miss_shard").when(F.col("_n").isNull(), "miss_row").when(F.col("_n") != F.col(n), "drift").otherwise("ok")
    return out.withColumn("status", status).drop("_n", "_has")


def with_baseline(results: DataFrame, baselines: DataFrame, key: str, base: str) -> DataFrame:
    """Results with the baseline of their task; a task that has none is an error, not a row less."""
    out = results.join(F.broadcast(baselines.select(key, base)), key, "left")  # a row a task
    missing = F.concat(F.lit("no baseline for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return out.withColumn(base, F.when(F.col(base).isNull(), F.raise_error(missing).cast("double")).otherwise(F.col(base)))


def last_wins(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """One row per key: the value of the last row in order. In an order by one column, rows that are null there have no place, and a key without others has a null value."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order) if len(order) > 1 else F.col(order[0])).alias(value))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Each left row's last right ``value`` with ``right.at <= left.at``, else -1; one shuffle, no inequality join.

    Both sides are one ordered stream per ``by``; at equal offsets the right side comes first.
    """
    r = right.select(by, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_pos"), F.col(value).alias("_v"))
    l = left.select(by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.col("pos").alias("_pos"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    w = Window.partitionBy(by).orderBy("_at", "_side", "_pos").rowsBetween(Window.unboundedPreceding, 0)
    return r.unionByName(l).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(by, F.col("_pos").alias("pos"), F.coalesce("_last", F.lit(-1)).alias(value))


def overlap(targets: DataFrame, sources: DataFrame, by: str, how: str = "mean") -> DataFrame:
    """Each target span's ``mean`` or ``last`` of the values of source spans that overlap it; 0 where none does.

    For sides that come as rows (``by``, pos, s, e and the sources' value): one
    text's spans are gathered into a row, in order of ``pos``, and searched there
    (``spans.overlaps`` states nulls, NaN, equal and nested spans). Where both
    cuts come from one text, ``spans.overlaps`` over its own columns needs no shuffle.
    """
    def lists(df: DataFrame, *fields: str) -> DataFrame:
        return df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("p"))  # one text's spans

    t = lists(targets, "s", "e").withColumnRenamed("p", "t")
    both = t.join(lists(sources, "s", "e", "value"), by, "left")
    found = overlaps(how)(*(F.col(c).cast("array<bigint>") for c in ("t.s", "t.e", "p.s", "p.e")), F.col("p.value").cast("array<double>"))
    rows = both.select(by, F.explode(F.arrays_zip(F.col("t.pos").alias("pos"), found.alias("value"))).alias("x"))
    return rows.select(by, F.col("x.pos").cast("long").alias("pos"), "x.value")


def gather(amap: Column, values: Column, zero: Column) -> Column:
    """``values`` at the indices of ``amap``; ``zero`` for index -1."""
    return F.transform(amap, lambda i: F.when(i < 0, zero).otherwise(F.element_at(values, (i + 1).cast("int"))))


def differences(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer diagnostics of two versions of a value: rows, missing on either side, largest difference."""
    x = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full")
    return x.agg(F.count("*").alias("rows"), F.count_if(F.col("_a").isNull()).alias("only_right"), F.count_if(F.col("_b").isNull()).alias("only_left"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs"))
