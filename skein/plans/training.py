"""Schedules, training logs and windows as queries; events stand for logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import metrics as M
from ..sources import tables as S
from .registry import query

_LOG = "log AS (SELECT user_id AS run, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step FROM events)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return S.table(spark, d, "events").select(F.col("user_id").alias("run"), "event_id", "value", (F.row_number().over(w) - 1).cast("long").alias("step"))


def _so_far() -> object:
    return Window.partitionBy("run").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)


@query(
    "smoothed_loss",
    f"""WITH {_LOG}, p AS (SELECT a.run, a.event_id, a.step, sum(0.1 * pow(0.9, a.step - b.step) * b.value) AS v FROM log a JOIN log b ON a.run = b.run AND b.step <= a.step GROUP BY a.run, a.event_id, a.step)
    SELECT event_id, round(v / (1 - pow(0.9, step + 1)), 6) AS loss FROM p""",
)
def smoothed_loss(spark: SparkSession, d: str) -> DataFrame:
    return M.debiased_ema(_log(spark, d), "value", "run", "event_id", "loss").select("event_id", F.round("loss", 6).alias("loss"))


@query("running_time", f"WITH {_LOG} SELECT event_id, round(sum(CASE WHEN step > 2 THEN value ELSE 0 END) OVER w, 6) AS spent, min(value) OVER w AS best, max(step) OVER w AS reached FROM log WINDOW w AS (PARTITION BY run ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running_time(spark: SparkSession, d: str) -> DataFrame:
    w = _so_far()
    return _log(spark, d).select("event_id", F.round(F.sum(F.when(F.col("step") > 2, F.col("value")).otherwise(0.0)).over(w), 6).alias("spent"), F.min("value").over(w).alias("best"), F.max("step").over(w).alias("reached"))


@query("blocked_share", f"WITH {_LOG}, s AS (SELECT event_id, sum(value * (step % 3)) OVER w / sum(value * 3 + 1) OVER w AS share, count(*) OVER w AS seen, step FROM log WINDOW w AS (PARTITION BY run ORDER BY event_id ROWS 4 PRECEDING)) SELECT event_id, round(share, 6) AS share, share > 0.15 AND seen >= 5 AND step % 5 = 4 AS warns FROM s")
def blocked_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of waiting in the last five steps; warns above 15 percent, at each fifth step and not before five are seen."""
    w = Window.partitionBy("run").orderBy("event_id").rowsBetween(-4, 0)
    share = F.sum(F.col("value") * (F.col("step") % 3)).over(w) / F.sum(F.col("value") * 3 + 1).over(w)
    t = _log(spark, d).select("event_id", "step", share.alias("share"), F.count("*").over(w).alias("seen"))
    return t.select("event_id", F.round("share", 6).alias("share"), ((F.col("share") > 0.15) & (F.col("seen") >= 5) & (F.col("step") % 5 == 4)).alias("warns"))


@query("record_deltas", f"WITH {_LOG}, b AS (SELECT *, min(value) OVER (PARTITION BY run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM log) SELECT event_id, round(value - held, 6) AS delta FROM b WHERE held IS NOT NULL AND value < held")
def record_deltas(spark: SparkSession, d: str) -> DataFrame:
    before = Window.partitionBy("run").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    b = _log(spark, d).withColumn("held", F.min("value").over(before))
    return b.where("held IS NOT NULL AND value < held").select("event_id", F.round(F.col("value") - F.col("held"), 6).alias("delta"))


@query("next_values", f"WITH {_LOG} SELECT event_id, value, lead(value) OVER (PARTITION BY run ORDER BY event_id) AS target FROM log")
def next_values(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).select("event_id", "value", F.lead("value").over(Window.partitionBy("run").orderBy("event_id")).alias("target"))


@query(
    "schedules",
    """SELECT event_id, i AS step, CASE WHEN i < 40 THEN (i + 1) / 40.0::DOUBLE WHEN i <= 800 THEN 1.0 ELSE (1000 - i) / 200.0::DOUBLE + (1 - (1000 - i) / 200.0::DOUBLE) * 0.05 END::DOUBLE AS lr,
    CASE WHEN i < 400 THEN (1 - i / 400.0::DOUBLE) * 0.85 + i / 400.0::DOUBLE * 0.97 WHEN i >= 800 THEN 0.97 * (1 - (i - 800) / 200.0::DOUBLE) + 0.90 * ((i - 800) / 200.0::DOUBLE) ELSE 0.97 END::DOUBLE AS momentum,
    round(0.2 * 0.5 * (1 + cos(pi() * i / 1000)), 9) AS decay FROM (SELECT event_id, event_id % 1000 AS i FROM events)""",
)
def schedules(spark: SparkSession, d: str) -> DataFrame:
    """Learning rate, momentum and weight decay at the step of each event, in runs of 1000 steps."""
    total, warm, down = 1000, 40, 200
    i = F.col("event_id") % total
    left = (total - i) / float(down)
    lr = F.when(i < warm, (i + 1) / float(warm)).when(i <= total - down, 1.0).otherwise(left + (1 - left) * 0.05)
    late = (i - (total - down)) / float(down)
    momentum = F.when(i < 400, (1 - i / 400.0) * 0.85 + i / 400.0 * 0.97).when(i >= total - down, 0.97 * (1 - late) + 0.90 * late).otherwise(0.97)
    return S.table(spark, d, "events").select("event_id", i.alias("step"), lr.alias("lr"), momentum.alias("momentum"), F.round(0.2 * 0.5 * (1 + F.cos(F.pi() * i / total)), 9).alias("decay"))


@query("auto_batch", "SELECT c_custkey, pow(2, round_even(log2(524288 * pow((4 + 2 * (c_custkey % 29)) / 12.0::DOUBLE, 0.383)), 0))::BIGINT AS batch FROM customer")
def auto_batch(spark: SparkSession, d: str) -> DataFrame:
    """The power of two next to a batch that grows with the depth of each customer's model."""
    depth = 4 + 2 * (F.col("c_custkey") % 29)
    return S.table(spark, d, "customer").select("c_custkey", F.pow(F.lit(2.0), F.rint(F.log2(524288 * F.pow(depth / 12.0, F.lit(0.383))))).cast("long").alias("batch"))


@query(
    "forecast",
    """SELECT event_id, least(1.0, (value + 1) / 50.0)::DOUBLE AS duty, CASE WHEN (value + 1) / 50.0 < 1 THEN 'short' WHEN (value + 1) / 50.0 < 1.5 THEN 'marginal' ELSE 'enough' END AS state,
    least(greatest(ceil(8.7e9 / ((value + 1) * 1e6) / 50.0), 1), 8)::INT AS streams FROM events""",
)
def forecast(spark: SparkSession, d: str) -> DataFrame:
    """Duty cycle of a source that makes value + 1 for a consumer of 50, and how many streams a shard needs."""
    ratio = (F.col("value") + 1) / 50.0
    need = F.ceil(F.lit(8.7e9) / ((F.col("value") + 1) * 1e6) / 50.0)
    return S.table(spark, d, "events").select(
        "event_id", F.least(F.lit(1.0), ratio).alias("duty"), F.when(ratio < 1, "short").when(ratio < 1.5, "marginal").otherwise("enough").alias("state"),
        F.least(F.greatest(need, F.lit(1)), F.lit(8)).cast("int").alias("streams"),
    )


@query("ring_task", "SELECT c_custkey, t, ((c_custkey % 12 + 5 * t) % 12)::INT AS token FROM customer, (SELECT unnest(generate_series(0, 16)) AS t)")
def ring_task(spark: SparkSession, d: str) -> DataFrame:
    """Seventeen steps of five on a ring of twelve, from where each customer starts."""
    t = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(16).cast("long"))).alias("t")
    return S.table(spark, d, "customer").select("c_custkey", t).withColumn("token", F.pmod(F.col("c_custkey") % 12 + 5 * F.col("t"), F.lit(12)).cast("int"))


@query(
    "buffer_phases",
    f"""WITH RECURSIVE {_LOG}, r AS (SELECT run AS key, step AS ord, value AS depth, CASE WHEN value >= 60 THEN 'running' ELSE 'prefill' END AS phase FROM log WHERE step = 0
      UNION ALL SELECT log.run, log.step, log.value, CASE WHEN r.phase = 'running' THEN CASE WHEN log.value < 15 THEN 'rebuffer' ELSE 'running' END WHEN log.value >= CASE WHEN r.phase = 'prefill' THEN 60 ELSE 40 END THEN 'running' ELSE r.phase END
      FROM r JOIN log ON log.run = r.key AND log.step = r.ord + 1) SELECT key, ord, depth, phase FROM r""",
)
def buffer_phases(spark: SparkSession, d: str) -> DataFrame:
    """Prefill, running and rebuffer phases of each user's event values taken as depths."""
    from ..streaming.state import phases

    return phases(_log(spark, d).select(F.col("run").alias("key"), F.col("step").alias("ord"), F.col("value").alias("depth")), prefill=60.0, rebuffer=40.0, dry=15.0)


@query("price_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2)::DOUBLE AS revenue, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def price_summary(spark: SparkSession, d: str) -> DataFrame:
    t = S.table(spark, d, "lineitem")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).cast("double").alias("revenue"), F.count("*").alias("n"))


@query("nation_revenue", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2)::DOUBLE AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def nation_revenue(spark: SparkSession, d: str) -> DataFrame:
    t = S.table(spark, d, "lineitem").join(S.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(S.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    t = t.join(S.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return t.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).cast("double").alias("revenue"))


@query(
    "run_plans",
    """WITH d AS (SELECT c_custkey, depth, depth * 12.0::DOUBLE * pow(64 * depth, 2) + 32768.0::DOUBLE * 64 * depth AS p, 12 * 12.0::DOUBLE * pow(768, 2) + 32768.0::DOUBLE * 768 AS ref FROM (SELECT c_custkey, 4 + 2 * (c_custkey % 29) AS depth FROM customer)),
    t AS (SELECT *, floor(p * 8.0) AS target, pow(2, round_even(log2(524288 * pow(floor(p * 8.0) / (ref * 8.0), 0.383)), 0)) AS b FROM d)
    SELECT c_custkey, depth, target::BIGINT AS target_tokens, b::BIGINT AS batch, round(sqrt(b / 524288), 9) AS lr_scale, round(0.2 * sqrt(b / 524288) * (ref * 8.0 / target), 9) AS weight_decay,
      (CASE WHEN depth % 6 = 0 THEN 500 WHEN depth % 6 = 2 THEN round_even(1e18 / (6 * p * b), 0) ELSE floor(target / b) END)::BIGINT AS iterations FROM t""",
)
def run_plans(spark: SparkSession, d: str) -> DataFrame:
    """Horizon, batch, scales and steps of each customer's model by its depth; some depths are given their steps, some a budget of operations."""
    depth = 4 + 2 * (F.col("c_custkey") % 29)
    params = depth * 12.0 * F.pow(depth * 64.0, F.lit(2.0)) + depth * (32768.0 * 64)
    given, budget = F.when(depth % 6 == 0, 500), F.when(depth % 6 == 2, 1e18)
    plan = M.run_plan(params, F.lit(12 * 12.0 * 768**2 + 32768.0 * 768), 8.0, 0.2, 6 * params, given, budget)
    out = S.table(spark, d, "customer").select("c_custkey", depth.alias("depth"), *(c.alias(n) for n, c in plan.items()))
    return out.withColumn("lr_scale", F.round("lr_scale", 9)).withColumn("weight_decay", F.round("weight_decay", 9))


@query(
    "smoothed_tuning_loss",
    f"""WITH {_LOG}, p AS (SELECT a.run, a.event_id, a.step, sum(0.1 * pow(0.9, a.step - b.step) * b.value) AS v FROM log a JOIN log b ON a.run = b.run AND b.step <= a.step GROUP BY a.run, a.event_id, a.step)
    SELECT event_id, round(v / (1 - pow(0.9, step + 2)), 6) AS loss FROM p""",
)
def smoothed_tuning_loss(spark: SparkSession, d: str) -> DataFrame:
    """The mean of logs that count a step before they are corrected."""
    return M.debiased_ema(_log(spark, d), "value", "run", "event_id", "loss", step_offset=1).select("event_id", F.round("loss", 6).alias("loss"))
