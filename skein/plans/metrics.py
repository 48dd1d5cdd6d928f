"""Evaluation metrics, moments, fits and pivots as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators import metrics as M
from ..sources import tables as S
from .registry import query


@query("bits_per_byte", "SELECT l_returnflag, round(sum(CASE WHEN l_linenumber > 1 THEN l_extendedprice ELSE 0 END) / (ln(2) * sum(CASE WHEN l_linenumber > 1 THEN l_quantity ELSE 0 END)), 6)::DOUBLE AS bpb FROM lineitem GROUP BY l_returnflag")
def bits_per_byte(spark: SparkSession, d: str) -> DataFrame:
    """Prices stand for nats and quantities for byte lengths; first lines are special tokens."""
    t = S.table(spark, d, "lineitem").withColumn("bytes", F.when(F.col("l_linenumber") > 1, F.col("l_quantity").cast("double")).otherwise(0.0))
    return t.groupBy("l_returnflag").agg(F.round(M.bits_per_byte(F.col("l_extendedprice").cast("double"), F.col("bytes")), 6).alias("bpb"))


@query("task_accuracy", "SELECT lang, avg(quality)::DOUBLE AS accuracy, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def task_accuracy(spark: SparkSession, d: str) -> DataFrame:
    t = S.table(spark, d, "labels").join(S.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return t.groupBy("lang").agg(F.avg("quality").alias("accuracy"), F.count("*").alias("n"))


@query(
    "pass_at_k",
    """WITH f AS (SELECT l_orderkey AS example, min(CASE WHEN l_quantity > 40 THEN l_linenumber END) AS first FROM lineitem GROUP BY l_orderkey)
    SELECT k::INT AS k, avg(CASE WHEN first <= k THEN 1.0 ELSE 0.0 END)::DOUBLE AS pass_rate FROM f CROSS JOIN generate_series(1, 4) g(k) GROUP BY k""",
)
def pass_at_k(spark: SparkSession, d: str) -> DataFrame:
    s = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("example"), (F.col("l_linenumber") - 1).alias("sample"), (F.col("l_quantity") > 40).alias("correct"))
    return M.pass_at_k(s, 4)


@query("advantages", "SELECT l_orderkey, l_linenumber, round(l_quantity - avg(l_quantity) OVER (PARTITION BY l_orderkey), 9)::DOUBLE AS advantage FROM lineitem")
def advantages(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("double")
    return S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(q - F.avg(q).over(Window.partitionBy("l_orderkey")), 9).alias("advantage"))


@query("first_argmax", "SELECT l_orderkey, arg_max(l_linenumber, (l_quantity, -l_linenumber)) AS picked FROM lineitem GROUP BY l_orderkey")
def first_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The option with the largest value; of ties the first."""
    return S.table(spark, d, "lineitem").groupBy("l_orderkey").agg(M.first_max("l_linenumber", F.col("l_quantity"), -F.col("l_linenumber")).alias("picked"))


@query("span_loss", "SELECT vec_id, round(list_avg(list_transform(embedding[3:10], lambda x: x::DOUBLE)), 6) AS loss FROM embeddings")
def span_loss(spark: SparkSession, d: str) -> DataFrame:
    """Mean loss over an answer's span."""
    span = F.slice("embedding", 3, 8)
    total = F.aggregate(span, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return S.table(spark, d, "embeddings").select("vec_id", F.round(total / F.size(span), 6).alias("loss"))


@query("span_match", "SELECT vec_id, list_transform(embedding[1:4], lambda x: x > 0) = list_transform(embedding[5:8], lambda x: x > 0) AS same FROM embeddings")
def span_match(spark: SparkSession, d: str) -> DataFrame:
    sign = lambda a, n: F.transform(F.slice("embedding", a, n), lambda x: x > 0)
    return S.table(spark, d, "embeddings").select("vec_id", (sign(1, 4) == sign(5, 4)).alias("same"))


@query("merged_moments", "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6)::DOUBLE AS mean, round(stddev_pop(l_quantity), 6)::DOUBLE AS std FROM lineitem GROUP BY l_returnflag")
def merged_moments(spark: SparkSession, d: str) -> DataFrame:
    """Moments of parts (by line status) merged to those of the whole."""
    q = F.col("l_quantity").cast("double")
    parts = S.table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(q).alias("n"), F.avg(q).alias("mean"), (F.var_pop(q) * F.count(q)).alias("m2"))
    return M.merged_moments(parts, "l_returnflag").select("l_returnflag", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("channel_rms", "SELECT (i - 1)::INT AS channel, round(sqrt(avg(x * x)), 6) AS rms, round(avg(CASE WHEN x <> 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS nonzero FROM (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY i")
def channel_rms(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "embeddings").select(F.posexplode("embedding").alias("channel", "x")).withColumn("x", F.col("x").cast("double"))
    return e.groupBy("channel").agg(F.round(F.sqrt(F.avg(F.col("x") * F.col("x"))), 6).alias("rms"), F.round(F.avg((F.col("x") != 0).cast("double")), 6).alias("nonzero"))


@query(
    "quantized_channels",
    """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS channel, unnest(embedding)::DOUBLE AS x FROM embeddings)
    SELECT vec_id, channel::INT AS channel, least(greatest(round_even(x / 0.05, 0), -127), 127)::TINYINT AS q FROM e""",
)
def quantized_channels(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("channel", "x"))
    return e.select("vec_id", "channel", M.quantized(F.col("x").cast("double"), F.lit(0.05)).alias("q"))


@query("dequantized_scores", "SELECT vec_id, pos::INT AS pos, round((least(greatest(round_even(embedding[pos + 1]::DOUBLE / 0.05, 0), -127), 127) * 0.05 + 0.5 - 0.25) / 2.0, 6) AS z FROM embeddings CROSS JOIN generate_series(0, 63) g(pos)")
def dequantized_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scale, shift and standardise stored scores."""
    x = S.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    q = M.quantized(F.col("x").cast("double"), F.lit(0.05)).cast("double")
    return x.select("vec_id", "pos", F.round((q * 0.05 + 0.5 - 0.25) / 2.0, 6).alias("z"))


@query("coverage", "SELECT count(*) AS docs, count(l.doc_id) AS covered, count(*) - count(l.doc_id) AS missing, round(sum(CASE WHEN l.doc_id IS NULL THEN 0 ELSE n_chars END) / sum(n_chars), 9)::DOUBLE AS token_coverage FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    x = S.table(spark, d, "documents").join(S.table(spark, d, "labels").select("doc_id").distinct().withColumn("hit", F.lit(1)), "doc_id", "left")
    n = F.count("*")
    return x.agg(n.alias("docs"), F.count("hit").alias("covered"), (n - F.count("hit")).alias("missing"), F.round(F.sum(F.when(F.col("hit") == 1, F.col("n_chars")).otherwise(0)) / F.sum("n_chars"), 9).alias("token_coverage"))


@query("first_values", "SELECT o_custkey, min_by(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'O')::DOUBLE AS first_open, min_by(o_orderkey, o_orderkey) FILTER (o_orderkey % 3 = 0) AS first_third FROM orders GROUP BY o_custkey")
def first_values(spark: SparkSession, d: str) -> DataFrame:
    """Per column, the first value that is there."""
    key = F.col("o_orderkey")
    price, third = F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice").cast("double")), F.when(key % 3 == 0, key)
    return S.table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by(price, F.when(price.isNotNull(), key)).alias("first_open"), F.min(third).alias("first_third"))


@query("row_of_minimum", "SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey, min(o_totalprice)::DOUBLE AS price FROM orders GROUP BY o_custkey")
def row_of_minimum(spark: SparkSession, d: str) -> DataFrame:
    best = F.min_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", "o_orderkey"))
    return S.table(spark, d, "orders").groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey", F.col("b.o_totalprice").cast("double").alias("price"))


@query("power_law", "SELECT l_returnflag, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS slope, round(regr_intercept(ln(l_extendedprice), ln(l_quantity)), 6) AS intercept, round(stddev_samp(l_extendedprice / l_quantity), 4)::DOUBLE AS ratio_std FROM lineitem GROUP BY l_returnflag")
def power_law(spark: SparkSession, d: str) -> DataFrame:
    q, p = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")
    return S.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope(F.log(p), F.log(q)), 6).alias("slope"), F.round(F.regr_intercept(F.log(p), F.log(q)), 6).alias("intercept"), F.round(F.stddev_samp(p / q), 4).alias("ratio_std"))


@query("simple_fit", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 9) AS r2 FROM lineitem")
def simple_fit(spark: SparkSession, d: str) -> DataFrame:
    q, p = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")
    return S.table(spark, d, "lineitem").agg(F.round(F.regr_slope(p, q), 6).alias("slope"), F.round(F.regr_intercept(p, q), 4).alias("intercept"), F.round(F.regr_r2(p, q), 9).alias("r2"))


@query("ridge_fit")
def ridge_fit(spark: SparkSession, d: str) -> DataFrame:
    """Ridge coefficients for some penalties from one Gram matrix."""
    g, m = M.gram(S.table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    rows = [(a, *map(float, M.ridge(g, m, a))) for a in (0.0, 0.01, 0.1, 1.0)]
    return spark.createDataFrame(rows, "alpha double, intercept double, quantity double, discount double, tax double")


@query(
    "quadratic_optimum",
    """WITH p AS (SELECT o_orderstatus, log10(o_custkey % 9 + 1) AS x, avg(o_totalprice)::DOUBLE AS y FROM orders GROUP BY o_orderstatus, o_custkey % 9 + 1),
    c AS (SELECT o_orderstatus, avg(x) AS mx FROM p GROUP BY o_orderstatus),
    m AS (SELECT o_orderstatus, mx, sum(x - mx) AS s1, sum((x - mx) ** 2) AS s2, sum((x - mx) ** 3) AS s3, sum((x - mx) ** 4) AS s4, count(*) AS n, sum(y) AS t0, sum((x - mx) * y) AS t1, sum((x - mx) ** 2 * y) AS t2, min(y) AS low, arg_min(x, y) AS lowx FROM p JOIN c USING (o_orderstatus) GROUP BY o_orderstatus, mx),
    q AS (SELECT *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM m),
    k AS (SELECT *, (n * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / det AS a, (n * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / det AS b,
      (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / det AS c FROM q)
    SELECT o_orderstatus, round(CASE WHEN a > 0 THEN pow(10, mx - b / (2 * a)) ELSE pow(10, lowx) END, 4) AS best_x, round(CASE WHEN a > 0 THEN c - b * b / (4 * a) ELSE low END, 3) AS best_y, a > 0 AS fitted FROM k""",
)
def quadratic_optimum(spark: SparkSession, d: str) -> DataFrame:
    p = S.table(spark, d, "orders").groupBy("o_orderstatus", (F.col("o_custkey") % 9 + 1).alias("x")).agg(F.avg(F.col("o_totalprice").cast("double")).alias("y"))
    return M.quadratic_optimum(p, "o_orderstatus", "x", "y").select("o_orderstatus", F.round("best_x", 4).alias("best_x"), F.round("best_y", 3).alias("best_y"), "fitted")


@query("budget_best", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, min(o_totalprice)::DOUBLE AS best FROM orders WHERE o_totalprice > 0 GROUP BY o_orderstatus")
def budget_best(spark: SparkSession, d: str) -> DataFrame:
    """Valid runs only: a metric that is there and above zero."""
    o = S.table(spark, d, "orders").where(F.col("o_totalprice").isNotNull() & (F.col("o_totalprice") > 0))
    return o.groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("customers"), F.min(F.col("o_totalprice").cast("double")).alias("best"))


@query("stage_pivot", "SELECT lang AS metric, coalesce(max(CASE WHEN quality = 0 THEN n END)::VARCHAR, '-') AS bad, coalesce(max(CASE WHEN quality = 1 THEN n END)::VARCHAR, '-') AS good FROM (SELECT lang, quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang, quality) GROUP BY lang")
def stage_pivot(spark: SparkSession, d: str) -> DataFrame:
    t = S.table(spark, d, "labels").join(S.table(spark, d, "documents").select("doc_id", F.col("lang").alias("metric")), "doc_id")
    p = t.groupBy("metric").pivot("quality", [0, 1]).agg(F.count(F.lit(1)))
    return p.select("metric", F.coalesce(F.col("0").cast("string"), F.lit("-")).alias("bad"), F.coalesce(F.col("1").cast("string"), F.lit("-")).alias("good"))


@query("zero_share", "SELECT source, count(*) AS docs, sum(n_chars)::BIGINT AS tokens, round(avg(CASE WHEN n_chars < 300 THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) AS short_share FROM documents GROUP BY source")
def zero_share(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("tokens"), F.round(F.avg((F.col("n_chars") < 300).cast("double")), 9).alias("short_share"))


@query("any_and_all", "SELECT user_id, bool_or(value > 90) AS any_high, max(value) AS highest, count(DISTINCT event_type) = 1 AS one_type FROM events GROUP BY user_id")
def any_and_all(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("value") > 90).alias("any_high"), F.max("value").alias("highest"), (F.countDistinct("event_type") == 1).alias("one_type"))


@query("top_values", "SELECT vec_id, k::INT AS k, round(list_sort(embedding, 'DESC')[k + 1]::DOUBLE, 6) AS x, (list_position(embedding, list_max(embedding)) - 1)::INT AS first_max FROM embeddings CROSS JOIN generate_series(0, 4) g(k)")
def top_values(spark: SparkSession, d: str) -> DataFrame:
    first = (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("first_max")
    e = S.table(spark, d, "embeddings").select("vec_id", first, F.posexplode(F.slice(F.sort_array("embedding", asc=False), 1, 5)).alias("k", "x"))
    return e.select("vec_id", "k", F.round(F.col("x").cast("double"), 6).alias("x"), "first_max")


@query("structured_channels", "SELECT vec_id, round(list_sum([embedding[i]::DOUBLE * cos(2 * pi() * (i - 1) / 12) for i in range(1, 13)]), 6) AS c, round(list_sum([embedding[i]::DOUBLE * sin(2 * pi() * (i - 1) / 12) for i in range(1, 13)]), 6) AS s FROM embeddings")
def structured_channels(spark: SparkSession, d: str) -> DataFrame:
    """Twelve cyclic channels as the two sums of scores times cosine and sine of their place in the year."""
    import math

    e = F.col("embedding")
    term = lambda f: sum(F.element_at(e, i + 1).cast("double") * f(2 * math.pi * i / 12) for i in range(12))
    return S.table(spark, d, "embeddings").select("vec_id", F.round(term(math.cos), 6).alias("c"), F.round(term(math.sin), 6).alias("s"))


@query("ring_points", "SELECT p_partkey, (p_partkey % 12)::INT AS i, round(cos(2 * pi() * (p_partkey % 12) / 12), 9) AS x, round(sin(2 * pi() * (p_partkey % 12) / 12), 9) AS y FROM part")
def ring_points(spark: SparkSession, d: str) -> DataFrame:
    """Each part's point among twelve on a ring."""
    i = F.col("p_partkey") % 12
    angle = F.lit(2.0) * F.pi() * i / 12
    return S.table(spark, d, "part").select("p_partkey", i.cast("int").alias("i"), F.round(F.cos(angle), 9).alias("x"), F.round(F.sin(angle), 9).alias("y"))


@query("helix_points", "SELECT p_partkey, i::INT AS i, round(cos(0.7 * i) / sqrt(1 + (i / 20.0) * (i / 20.0)), 6) AS x, round(sin(0.7 * i) / sqrt(1 + (i / 20.0) * (i / 20.0)), 6) AS y, round((i / 20.0) / sqrt(1 + (i / 20.0) * (i / 20.0)), 6) AS z FROM (SELECT p_partkey, p_partkey % 20 AS i FROM part)")
def helix_points(spark: SparkSession, d: str) -> DataFrame:
    """Each part's point among twenty of a helix, at length one."""
    i = F.col("p_partkey") % 20
    z = i / 20.0
    norm = F.sqrt(1 + z * z)
    return S.table(spark, d, "part").select("p_partkey", i.cast("int").alias("i"), F.round(F.cos(0.7 * i) / norm, 6).alias("x"), F.round(F.sin(0.7 * i) / norm, 6).alias("y"), F.round(z / norm, 6).alias("z"))


@query("principal_axes")
def principal_axes(spark: SparkSession, d: str) -> DataFrame:
    """Two principal axes of all channels from one aggregate; the largest loading is positive."""
    axes = M.principal_axes(S.table(spark, d, "embeddings"), "embedding", 2)
    return spark.createDataFrame(list(enumerate(axes)), T.StructType([T.StructField("axis", T.IntegerType()), T.StructField("loadings", T.ArrayType(T.DoubleType()))]))


@query("projected")
def projected(spark: SparkSession, d: str) -> DataFrame:
    """Rows along the two axes, as they are and not centred."""
    e = S.table(spark, d, "embeddings")
    axes = M.principal_axes(e, "embedding", 2) or [[], []]  # no row, no axis
    along = lambda axis: F.aggregate(F.zip_with("embedding", F.array(*map(F.lit, axis)), lambda x, a: x.cast("double") * a), F.lit(0.0), lambda t, x: t + x)
    return e.select("vec_id", along(axes[0]).alias("x"), along(axes[1]).alias("y"))


@query(
    "budget_points",
    """WITH o AS (SELECT o_orderstatus AS budget, o_custkey % 9 + 1 AS depth, avg(o_totalprice)::DOUBLE AS loss, count(*) AS tokens FROM orders WHERE o_totalprice > 0 GROUP BY ALL)
    SELECT budget, depth, round(loss, 6) AS loss, (SELECT count(DISTINCT depth) FROM o)::BIGINT AS depths, round(exp(avg(ln(tokens)) OVER (PARTITION BY budget)), 6) AS mean_tokens FROM o QUALIFY row_number() OVER (PARTITION BY budget ORDER BY loss, depth) = 1""",
)
def budget_points(spark: SparkSession, d: str) -> DataFrame:
    """The best depth of each budget, the depths there are, and the geometric mean of a budget's tokens."""
    o = S.table(spark, d, "orders").where("o_totalprice > 0").groupBy(F.col("o_orderstatus").alias("budget"), (F.col("o_custkey") % 9 + 1).alias("depth")).agg(F.avg(F.col("o_totalprice").cast("double")).alias("loss"), F.count("*").alias("tokens"))
    best = o.groupBy("budget").agg(F.min_by(F.struct("depth", "loss"), F.struct("loss", "depth")).alias("b"), F.exp(F.avg(F.log("tokens"))).alias("m"))
    depths = o.agg(F.countDistinct("depth").alias("depths"))
    return best.crossJoin(F.broadcast(depths)).select("budget", "b.depth", F.round("b.loss", 6).alias("loss"), "depths", F.round("m", 6).alias("mean_tokens"))  # one row


@query(
    "shard_totals",
    """WITH e AS (SELECT label, vec_id, list_transform(embedding, lambda x: CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE x::DOUBLE END) AS v FROM embeddings)
    SELECT label, count(*) AS rows, count(*) FILTER (len(list_filter(v, lambda x: x <> 0)) = 0) AS zero_rows, round(sum(len(list_filter(v, lambda x: abs(x / 0.001) > 127))) / sum(len(v)), 9)::DOUBLE AS clipped FROM e GROUP BY label""",
)
def shard_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows, rows of zeros and the share of values that quantisation clips."""
    v = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 7 == 0, 0.0).otherwise(x.cast("double")))
    e = S.table(spark, d, "embeddings").select("label", v.alias("v"))
    return e.groupBy("label").agg(*M.quantisation_totals(F.col("v"), 0.001))


@query(
    "stage_report",
    """WITH t AS (SELECT lang AS metric, quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL UNION ALL SELECT 'CORE', quality, count(*) FROM labels GROUP BY quality UNION ALL SELECT 'ChatCORE', 1, count(*) FROM labels),
    p AS (SELECT metric, coalesce(max(CASE WHEN quality = 0 THEN n END)::VARCHAR, '-') AS bad, coalesce(max(CASE WHEN quality = 1 THEN n END)::VARCHAR, '-') AS good FROM t GROUP BY metric)
    SELECT *, (row_number() OVER (ORDER BY metric <> 'CORE', metric = 'ChatCORE', metric) - 1)::INT AS place FROM p""",
)
def stage_report(spark: SparkSession, d: str) -> DataFrame:
    """A row a metric and a column a stage, a dash where a stage has none, the score over tasks first and that over chats last."""
    l = S.table(spark, d, "labels")
    t = l.join(S.table(spark, d, "documents").select("doc_id", F.col("lang").alias("metric")), "doc_id").select("metric", "quality")
    rows = t.union(l.select(F.lit("CORE"), "quality")).union(l.select(F.lit("ChatCORE"), F.lit(1)))
    p = rows.groupBy("metric").pivot("quality", [0, 1]).agg(F.count(F.lit(1)).alias("n"))
    dash = lambda c: F.coalesce(F.when(F.col(c) > 0, F.col(c)).cast("string"), F.lit("-"))
    place = F.row_number().over(Window.orderBy(F.col("metric") != "CORE", F.col("metric") == "ChatCORE", "metric")) - 1  # a row a metric
    return p.select("metric", dash("0").alias("bad"), dash("1").alias("good"), place.alias("place"))
