"""Scans, budgets, splits, windows of a corpus, and mixtures of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import draws as D
from ..sources import tables as S
from .registry import query

_SHARDS = """shards AS (
  SELECT *, source AS shard, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row,
         (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 16 AS rg
  FROM documents)"""


def _shards(spark: SparkSession, d: str) -> DataFrame:
    return S.as_shards(S.table(spark, d, "documents"))


@query("shard_list", "SELECT source AS shard, count(*) AS docs, sum(length(text))::BIGINT AS chars, source = (SELECT max(source) FROM documents) AS is_val FROM documents GROUP BY source")
def shard_list(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents").groupBy(F.col("source").alias("shard")).agg(F.count("*").alias("docs"), F.sum(F.length("text")).cast("long").alias("chars"))
    return S.with_split(docs).select("shard", "docs", "chars", (F.col("split") == "val").alias("is_val"))


@query("train_split", "SELECT doc_id, source FROM documents WHERE source < (SELECT max(source) FROM documents)")
def train_split(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents").select("doc_id", "source")
    return S.with_split(docs, "source").where("split = 'train'").select("doc_id", "source")


@query("row_group_stride", f"WITH {_SHARDS} SELECT doc_id, shard, row, rg FROM shards WHERE rg >= 1 AND (rg - 1) % 3 = 0")
def row_group_stride(spark: SparkSession, d: str) -> DataFrame:
    return S.strided(_shards(spark, d), 1, 3).select("doc_id", "shard", "row", "rg")


@query(
    "epoch_scan_resume",
    f"""WITH {_SHARDS}, files AS (SELECT shard, (row_number() OVER (ORDER BY shard) - 1)::INT AS pq_idx FROM (SELECT DISTINCT shard FROM shards))
    SELECT doc_id, pq_idx, rg, epoch::INT AS epoch FROM shards JOIN files USING (shard) CROSS JOIN (VALUES (2), (3)) e(epoch)
    WHERE rg % 2 = 1 AND (epoch > 2 OR pq_idx > 4 OR (pq_idx = 4 AND rg >= 3))""",
)
def epoch_scan_resume(spark: SparkSession, d: str) -> DataFrame:
    return S.epoch_scan(_shards(spark, d), rank=1, world=2, epochs=2, resume=(4, 1, 2)).select("doc_id", "pq_idx", "rg", F.col("epoch").cast("int").alias("epoch"))


@query(
    "row_group_offsets",
    f"""WITH {_SHARDS}, g AS (SELECT shard, rg, count(*) AS n_rows FROM shards GROUP BY shard, rg)
    SELECT shard, rg, n_rows, coalesce(sum(n_rows) OVER (PARTITION BY shard ORDER BY rg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_row FROM g""",
)
def row_group_offsets(spark: SparkSession, d: str) -> DataFrame:
    g = _shards(spark, d).groupBy("shard", "rg").agg(F.count("*").alias("n_rows"))
    w = Window.partitionBy("shard").orderBy("rg").rowsBetween(Window.unboundedPreceding, -1)
    return g.withColumn("first_row", F.coalesce(F.sum("n_rows").over(w), F.lit(0)))


@query(
    "budget_sample",
    """WITH c AS (SELECT doc_id, substr(text, 1, 10000) AS t FROM documents),
    s AS (SELECT doc_id, length(t)::BIGINT AS chars, coalesce(sum(length(t)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chars_before FROM c)
    SELECT * FROM s WHERE chars_before <= 500000""",
)
def budget_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.budgeted(S.table(spark, d, "documents").select("doc_id", "text"), 10_000, 500_000).select("doc_id", F.length("text").cast("long").alias("chars"), "chars_before")


@query("repackaged_corpus")
def repackaged_corpus(spark: SparkSession, d: str) -> DataFrame:
    return S.repackaged(S.table(spark, d, "documents").select("doc_id", "text"), 100_000, 16).groupBy("shard").agg(F.count("*").alias("docs"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(
    "task_slice",
    """WITH t AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM benchmark)
    SELECT item_id, (idx - 3) // 4 AS idx FROM t WHERE idx >= 3 AND idx < 35 AND (idx - 3) % 4 = 0""",
)
def task_slice(spark: SparkSession, d: str) -> DataFrame:
    t = S.running_total(S.table(spark, d, "benchmark").select("item_id"), ["item_id"], F.lit(1).cast("long"), "idx")
    return t.where("idx >= 3 AND idx < 35 AND (idx - 3) % 4 = 0").select("item_id", F.expr("(idx - 3) div 4").alias("idx"))


@query(
    "task_sequence",
    """WITH a AS (SELECT 0 AS task, doc_id AS item, row_number() OVER (ORDER BY doc_id) - 1 AS local FROM documents WHERE lang = 'en'),
    b AS (SELECT 1, item_id, row_number() OVER (ORDER BY item_id) - 1 FROM benchmark)
    SELECT task, item, local, local + CASE task WHEN 1 THEN (SELECT count(*) FROM a) ELSE 0 END AS idx FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
)
def task_sequence(spark: SparkSession, d: str) -> DataFrame:
    a = S.table(spark, d, "documents").where("lang = 'en'").select(F.lit(0).alias("task"), F.col("doc_id").alias("item"))
    b = S.table(spark, d, "benchmark").select(F.lit(1).alias("task"), F.col("item_id").alias("item"))
    parts = [S.running_total(x, ["task", "item"], F.lit(1).cast("long"), "local") for x in (a, b)]
    both = parts[0].unionByName(parts[1])
    sizes = both.groupBy("task").agg(F.count("*").alias("n"))
    offset = sizes.select("task", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return both.join(F.broadcast(offset), "task").select("task", "item", "local", (F.col("local") + F.col("offset")).alias("idx"))


@query("task_mixture")
def task_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Tasks one after another, one of them listed twice, in the order of a seeded shuffle of all their examples."""
    docs = S.table(spark, d, "documents").where("lang = 'es'")
    a = docs.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("task"), F.col("doc_id").alias("item"))
    b = S.table(spark, d, "benchmark").select(F.lit(2).alias("task"), F.col("item_id").alias("item"))
    listed = S.running_total(a.unionByName(b), ["task", "item"], F.lit(1).cast("long"), "idx")
    return D.shuffled(listed, "idx", 42).select("place", "task", "item")


@query("duplicate_contents", "SELECT count(*) AS groups, sum(n)::BIGINT AS docs FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def duplicate_contents(spark: SparkSession, d: str) -> DataFrame:
    h = S.table(spark, d, "documents").groupBy(F.sha2("text", 256)).agg(F.count("*").alias("n")).where("n > 1")
    return h.agg(F.count("*").alias("groups"), F.sum("n").alias("docs"))


@query(
    "shard_spec",
    """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 7 AS a FROM supplier), ids AS (SELECT k, unnest(list_sort(list_distinct(list_concat(list_concat(range(a, a + 4), [a + 10]), [a + 2, a + 3, a + 20])))) AS shard FROM s)
    SELECT k AS s_suppkey, shard::INT AS shard, ((row_number() OVER (PARTITION BY k ORDER BY shard) - 1) % 3)::INT AS pod FROM ids""",
)
def shard_spec(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's list of shards such as ``0-3,10,2-3,20`` as sorted ids without repeats, dealt to three pods in turn."""
    a = F.col("s_suppkey") % 7
    spec = F.format_string("%d-%d,%d,%d-%d,%d", a, a + 3, a + 10, a + 2, a + 3, a + 20)
    part = F.transform(F.split(spec, ","), lambda p: F.split(p, "-"))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform(part, lambda e: F.sequence(e[0].cast("int"), F.element_at(e, -1).cast("int"))))))
    rows = S.table(spark, d, "supplier").select("s_suppkey", F.posexplode(ids).alias("place", "shard"))
    return rows.select("s_suppkey", "shard", F.pmod("place", F.lit(3)).alias("pod"))


@query(
    "missing_shards",
    "SELECT s::INT AS shard FROM generate_series(0, 24) g(s) WHERE 'src' || s NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)",
)
def missing_shards(spark: SparkSession, d: str) -> DataFrame:
    expected = spark.range(25).select(F.col("id").cast("int").alias("shard"), F.concat(F.lit("src"), F.col("id")).alias("source"))
    return expected.join(S.table(spark, d, "documents").select("source").distinct(), "source", "left_anti").select("shard")


@query("max_tag", "SELECT max(CAST(substr(source, 4) AS INT)) AS tag, max_by(source, CAST(substr(source, 4) AS INT)) AS name FROM documents")
def max_tag(spark: SparkSession, d: str) -> DataFrame:
    tag = F.regexp_extract("source", r"^src(\d+)$", 1).try_cast("int")
    return S.table(spark, d, "documents").agg(F.max(tag).alias("tag"), F.max_by("source", tag).alias("name"))


@query("task_heads", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('1337:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5")
def task_heads(spark: SparkSession, d: str) -> DataFrame:
    """The first five of each task in a seeded order."""
    docs = S.table(spark, d, "documents").select("doc_id", "lang", F.md5(F.concat(F.lit("1337:"), F.col("doc_id").cast("string")).cast("binary")).alias("k"))
    return S.heads(docs, "lang", ["k", "doc_id"], 5).select("doc_id", "lang")


@query("ordered_scan", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row, length(text)::BIGINT AS chars FROM documents WHERE source = 'src9'")
def ordered_scan(spark: SparkSession, d: str) -> DataFrame:
    """One shard's texts with their place in it."""
    return S.scan_in_order(_shards(spark, d), "src9", "text", "doc_id").select("doc_id", "row", F.length("text").cast("long").alias("chars"))


@query(
    "rebased_offsets",
    """WITH r AS (SELECT source AS shard, doc_id, length(text)::BIGINT AS n, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM documents),
    t AS (SELECT shard, coalesce(sum(sum(n)) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM r GROUP BY shard)
    SELECT doc_id, shard, start + base AS start, n FROM r JOIN t USING (shard)""",
)
def rebased_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Spans of all shards in one store: each shard's own offsets moved behind the shards before it."""
    docs = S.table(spark, d, "documents").select(F.col("source").alias("shard"), "doc_id", F.length("text").cast("long").alias("n"))
    total = S.running_total(docs, ["shard", "doc_id"], F.col("n"), "before")
    first = total.groupBy("shard").agg(F.min("before").alias("first"))
    own = total.join(first, "shard").select("shard", "doc_id", (F.col("before") - F.col("first")).alias("start"), F.col("_v").alias("n"))
    return S.rebased(own).select("doc_id", "shard", "start", "n")
