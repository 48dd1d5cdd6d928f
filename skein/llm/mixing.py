"""Mix sources to target weights by Sainte-Lague apportionment.

Targets: every source gets its weight's share of all words, but at most
``max_epochs`` times its own words; what exceeds that is shared again by
weight among the others until none is above (a water level, found in closed
form over the sources in order of cap to weight).

Seats are equal blocks of ``block_words`` words. A party's seats are all its
quotients target / (block * (k - 1/2)) above a common threshold; instead of
handing seats out one by one, two thresholds that bracket the right one give
the certain seats and at most three undecided ones per party, and only those
are ranked. Seats go to sources first and then, within a source, to its
shards: hash parts of bounded size (``shard_words``, and at most ``MAX_SHARDS``
in all). A shard's documents stand in a seeded order; the mix takes its quota
of blocks from that order, passing over it again where the quota is more than
one pass. A document is taken as often as passes cover it, and in part where
the last block ends inside it. Sources are ranked and levelled as a table of a
row each, in one task: some millions of sources are its bound.

Edge cases: null text has no words; a null source is a source, last in order;
rows with equal ids are ordered by size and are otherwise alike; an empty
table, or one without words, takes nothing; other columns are ignored. Texts of any length are counted
whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh, n_words, stored, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 8
SHARD_WORDS = 32768
MAX_SHARDS = 65536
SEED = "mix-1"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources(source, source_size)``: one row each, with ``target`` and ``total`` added."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cyc = F.array(*(F.lit(float(w)) for w in weights))
    s = sources.withColumn("weight", F.element_at(cyc, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", (F.lit(max_epochs) * F.col("source_size")).cast("double"))
    s = s.withColumn("total", F.sum("source_size").over(everything))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("cap").over(rising), F.lit(0.0))
    weighed = F.coalesce(F.sum("weight").over(rising), F.lit(0.0))
    s = s.withColumn("level", (F.col("total") - capped) / (F.sum("weight").over(everything) - weighed))
    free = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    s = s.withColumn("level", F.max(free).over(everything))  # levels fall again past the first free source
    return s.select("source", "source_size", "total", F.least(F.col("cap"), F.col("weight") * F.coalesce("level", F.lit(0.0))).alias("target"))


def apportion(parties: DataFrame, group: list[str], order: list[Column], votes: str, seats: Column) -> DataFrame:
    """Sainte-Lague: adds ``quota``, so that the quotas of a group sum to its ``seats``.

    ``votes`` names a double column; parties without votes get no seat. Ties go
    to the party that comes first in ``order``.
    """
    w = Window.partitionBy(*group)
    p = parties.withColumn("_seats", seats).withColumn("_votes", F.sum(votes).over(w)).withColumn("_parties", F.count("*").over(w))
    low = F.when(F.col("_seats") > F.col("_parties"), F.floor(F.col(votes) * (F.col("_seats") - F.col("_parties")) / F.col("_votes") + 0.5)).otherwise(F.lit(0))
    high = F.floor(F.col(votes) * (F.col("_seats") + F.col("_parties")) / F.col("_votes") + 0.5)
    p = p.withColumn("_low", F.when(F.col(votes) > 0, low).otherwise(0).cast("long")).withColumn("_high", F.when(F.col(votes) > 0, high).otherwise(0).cast("long"))
    p = p.withColumn("_left", F.col("_seats") - F.sum("_low").over(w))
    open_ = p.select("*", F.explode(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high"))).otherwise(F.array(F.lit(0).cast("long")))).alias("_seat"))
    first = Window.partitionBy(*group).orderBy((F.col("_seat") == 0).asc(), (F.col(votes) / (2.0 * F.col("_seat") - 1.0)).desc(), *order, F.col("_seat"))
    won = open_.withColumn("_won", ((F.row_number().over(first) <= F.col("_left")) & (F.col("_seat") > 0)).cast("long"))
    keep = parties.columns
    return won.groupBy(*keep).agg((F.max("_low") + F.sum("_won")).alias("quota"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken, and the ``keep`` columns."""
    mark = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    d = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), mark.alias("mark"), *keep))
    sources = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    seats = F.floor(F.col("total") / block_words + 0.5).cast("long")
    s = apportion(sources, [], [F.col("source").asc_nulls_last()], "target", seats).withColumnRenamed("quota", "source_quota")
    width = F.greatest(F.lit(SHARD_WORDS), F.ceil(F.col("total") / MAX_SHARDS))
    s = cut(s.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / width)).cast("long")))

    d = d.join(s.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its"))).drop("its")
    d = d.withColumn("shard", F.conv(F.substring("mark", 1, 8), 16, 10).cast("long") % F.col("shards"))
    key = ["source", "shard"]
    shards = d.groupBy(*key).agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    shards = shards.withColumn("votes", F.col("shard_size").cast("double"))
    quotas = apportion(shards, ["source"], [F.col("shard")], "votes", F.col("source_quota"))
    words = F.least(F.col("quota") * block_words, max_epochs * F.col("shard_size"))
    quotas = quotas.select(F.col("source").alias("its"), F.col("shard").alias("part"), "shard_size", words.alias("words"))

    before = Window.partitionBy(*key).orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    d = d.join(quotas, F.col("source").eqNullSafe(F.col("its")) & (F.col("shard") == F.col("part")))
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0)
    rest = F.col("words") - passes * F.col("shard_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("at")))
    return d.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"), *keep)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns.

    Where the last block ends inside a document, that copy holds the text's
    first words only, up to there; a documents' column ``n_chars`` follows the
    text. Rows are matched by their place in the scan of a stored table.
    """
    row, times = fresh(docs, "_row"), fresh(docs, "_times")
    docs = stored(docs)
    marked = docs.withColumn(row, F.monotonically_increasing_id())
    plan = mix(marked.select("doc_id", "source", "text", F.col(row).alias("row")), keep=("row",)).where("taken > 0")
    plan = plan.select(F.col("row").alias(row), F.struct("size", "taken").alias(times))
    d = marked.join(plan, row)
    size, taken = F.col(times)["size"], F.col(times)["taken"]
    whole = F.floor(taken / size).cast("int")
    part = (taken % size).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    d = d.withColumn(times, F.explode(copies))
    head = head_words(F.col("text"), F.col(times))
    d = d.withColumn("text", F.when(F.col(times) > 0, head).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col(times) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return d.select(*docs.columns)


def head_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, white space as it stands."""
    tokens = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(tokens, F.lit(1), n), "")


def op9_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS mark
  FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT source, source_size, (sum(source_size) OVER ())::BIGINT AS total, ({MAX_EPOCHS} * source_size)::DOUBLE AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM s0
), s2 AS (
  SELECT *, (total - coalesce(sum(cap) OVER rising, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER rising, 0)) AS level
  FROM s1 WINDOW rising AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (
  SELECT source, source_size, total, cap, weight, max(level) FILTER (level <= cap / weight) OVER () AS level FROM s2
), s4 AS (
  SELECT source, source_size, total, least(cap, weight * coalesce(level, 0)) AS target,
         floor(total / {BLOCK_WORDS}::DOUBLE + 0.5)::BIGINT AS seats, greatest({SHARD_WORDS}, ceil(total / {MAX_SHARDS}::DOUBLE)) AS width,
         greatest(1, ceil(source_size / greatest({SHARD_WORDS}, ceil(total / {MAX_SHARDS}::DOUBLE))))::BIGINT AS shards
  FROM s3
), a1 AS (
  SELECT *, sum(target) OVER () AS votes, count(*) OVER () AS parties FROM s4
), a2 AS (
  SELECT *, CASE WHEN target > 0 AND seats > parties THEN floor(target * (seats - parties) / votes + 0.5) ELSE 0 END::BIGINT AS low,
         CASE WHEN target > 0 THEN floor(target * (seats + parties) / votes + 0.5) ELSE 0 END::BIGINT AS high
  FROM a1
), a3 AS (
  SELECT source, target, unnest(generate_series(low + 1, high)) AS seat, seats - (sum(low) OVER ()) AS undecided FROM a2
), a4 AS (
  SELECT source, row_number() OVER (ORDER BY target / (2.0::DOUBLE * seat - 1) DESC, source NULLS LAST, seat) <= undecided AS won FROM a3
), a5 AS (
  SELECT source, count(*) FILTER (won) AS won FROM a4 GROUP BY source
), q AS (
  SELECT a2.source, a2.source_size, a2.target, a2.shards, low + coalesce(won, 0) AS source_quota
  FROM a2 LEFT JOIN a5 ON a2.source IS NOT DISTINCT FROM a5.source
), p AS (
  SELECT d.*, q.source_size, q.target, q.source_quota, ('0x' || substr(mark, 1, 8))::BIGINT % q.shards AS shard
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), h AS (
  SELECT source, shard, sum(size)::BIGINT AS shard_size, any_value(source_quota) AS seats FROM p GROUP BY source, shard
), b1 AS (
  SELECT *, shard_size::DOUBLE AS v, sum(shard_size::DOUBLE) OVER w AS votes, count(*) OVER w AS parties FROM h WINDOW w AS (PARTITION BY source)
), b2 AS (
  SELECT *, CASE WHEN v > 0 AND seats > parties THEN floor(v * (seats - parties) / votes + 0.5) ELSE 0 END::BIGINT AS low,
         CASE WHEN v > 0 THEN floor(v * (seats + parties) / votes + 0.5) ELSE 0 END::BIGINT AS high
  FROM b1
), b3 AS (
  SELECT source, shard, v, unnest(generate_series(low + 1, high)) AS seat, undecided
  FROM (SELECT *, seats - (sum(low) OVER (PARTITION BY source)) AS undecided FROM b2)
), b4 AS (
  SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY v / (2.0::DOUBLE * seat - 1) DESC, shard, seat) <= undecided AS won FROM b3
), b5 AS (
  SELECT source, shard, count(*) FILTER (won) AS won FROM b4 GROUP BY source, shard
), z AS (
  SELECT b2.source, b2.shard, b2.shard_size, least((low + coalesce(won, 0)) * {BLOCK_WORDS}, {MAX_EPOCHS} * b2.shard_size)::BIGINT AS words
  FROM b2 LEFT JOIN b5 ON b2.source IS NOT DISTINCT FROM b5.source AND b2.shard = b5.shard
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY mark, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM p
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (CASE WHEN shard_size > 0 THEN (words // shard_size) * size + greatest(0, least(size, words % shard_size - ahead)) ELSE 0 END)::BIGINT AS taken
FROM placed JOIN z ON placed.source IS NOT DISTINCT FROM z.source AND placed.shard = z.shard
"""
