"""Evaluation and log metrics as column expressions and aggregates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def quantisation_totals(v: Column, scale: float) -> list[Column]:
    """Aggregates over rows of values: rows, zero_rows, and clipped: the share of values beyond what ``scale`` holds."""
    beyond = F.size(F.filter(v, lambda x: F.abs(x / scale) > 127))
    return [F.count("*").alias("rows"), F.count_if(F.forall(v, lambda x: x == 0)).alias("zero_rows"), F.round(F.sum(beyond) / F.sum(F.size(v)), 9).alias("clipped")]


def bits_per_byte(nats: Column, n_bytes: Column) -> Column:
    """Sum of nats over ln 2 times the sum of bytes; tokens of no bytes do not count; infinite without bytes."""
    total = F.sum(F.when(n_bytes > 0, n_bytes).otherwise(0))
    return F.when(total > 0, F.sum(F.when(n_bytes > 0, nats).otherwise(0.0)) / (math.log(2) * total)).otherwise(F.lit(float("inf")))


def centered(accuracy: Column, baseline: Column) -> Column:
    """Accuracy above a baseline in percent, as a share of what was left."""
    return (accuracy - 0.01 * baseline) / (1.0 - 0.01 * baseline)


def first_max(value: str, *rank: Column) -> Column:
    """The value with the largest rank; of ties the first."""
    return F.max_by(value, F.struct(*rank))


def pass_at_k(samples: DataFrame, k: int) -> DataFrame:
    """``samples(example, sample, correct)`` -> k, pass_rate: any of the first k samples right."""
    first = samples.groupBy("example").agg(F.min(F.when(F.col("correct"), F.col("sample"))).alias("first"))
    ks = first.select(F.explode(F.sequence(F.lit(1), F.lit(k))).alias("k"), F.coalesce((F.col("first") < F.col("k")).cast("double"), F.lit(0.0)).alias("ok"))
    return ks.groupBy("k").agg(F.avg("ok").alias("pass_rate"))


def merged_moments(parts: DataFrame, by: str) -> DataFrame:
    """``parts(by, n, mean, m2)`` merged: n, mean and population deviation."""
    total = parts.groupBy(by).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum("m2").alias("_within"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("_squares"))
    m2 = F.col("_within") + F.col("_squares") - F.col("n") * F.col("mean") * F.col("mean")
    return total.select(by, "n", "mean", F.sqrt(F.greatest(m2, F.lit(0.0)) / F.col("n")).alias("std"))


def quantized(x: Column, scale: Column) -> Column:
    """Half-even rounded to -127..127; zero stays zero."""
    return F.least(F.greatest(F.rint(x / scale), F.lit(-127.0)), F.lit(127.0)).cast("tinyint")


def debiased_ema(df: DataFrame, value: str, by: str, order: str, name: str, beta: float = 0.9, step_offset: int = 0) -> DataFrame:
    """Adds ``name``: the exponential mean of ``value`` so far, corrected for its start; all rows count.

    ``step_offset`` is 1 for logs whose correction counts a step more than were seen.

    Runs are cut into blocks so long that a block's last row has a weight of
    1e-100 at its end. A row's mean is its block's running sum and the whole sum
    of the block before; what lies further back is beneath double precision.
    Two window sorts a run, however long it is.
    """
    size = max(1, int(100 / -math.log10(beta)))
    n, block, at = "_n", "_block", "_at"
    d = df.withColumn(n, F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)
    d = d.withColumn(block, F.floor(F.col(n) / size)).withColumn(at, (F.col(n) % size).cast("double"))
    b = F.lit(float(beta))
    x = F.col(value).cast("double")
    here = F.sum(x * F.pow(b, -F.col(at))).over(Window.partitionBy(by, block).orderBy(n).rowsBetween(Window.unboundedPreceding, 0))
    before = F.sum(x * F.pow(b, size - 1 - F.col(at))).over(Window.partitionBy(by).orderBy(block).rangeBetween(-1, -1))
    mean = (1 - b) * (F.pow(b, F.col(at)) * here + F.pow(b, F.col(at) + 1) * F.coalesce(before, F.lit(0.0)))
    return d.withColumn(name, mean / (1 - F.pow(b, F.col(n) + 1 + step_offset))).drop(n, block, at)


def quadratic_optimum(points: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Per group, the vertex of the parabola through log10(x), y; where it opens downward, the lowest point.

    A group is the few points of one budget. ``best_y`` at a vertex outside of
    the points is the parabola's; ``interp_y`` is what straight lines between
    the points give there, the end points beyond them.
    """
    schema = T.StructType([points.schema[by], T.StructField("best_x", T.DoubleType()), T.StructField("best_y", T.DoubleType()), T.StructField("fitted", T.BooleanType()), T.StructField("interp_y", T.DoubleType())])

    def fit(key, f):
        import pandas as pd

        lx = np.log10(f[x].to_numpy(float))
        yy = f[y].to_numpy(float)
        out = (10 ** lx[yy.argmin()], yy.min(), False)
        if len(np.unique(lx)) >= 3:
            a, b, c = np.polyfit(lx, yy, 2)
            if a > 0:
                v = -b / (2 * a)
                out = (10**v, a * v * v + b * v + c, True)
        order = np.argsort(lx)
        return pd.DataFrame([(key[0], *out, float(np.interp(np.log10(out[0]), lx[order], yy[order])))], columns=schema.names)

    return points.select(by, x, y).groupBy(by).applyInPandas(fit, schema)


def ridge(gram: np.ndarray, moment: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients with an unpenalised intercept, first in the design's Gram matrix."""
    penalty = alpha * np.eye(len(gram))
    penalty[0, 0] = 0.0
    return np.linalg.solve(gram + penalty, moment)


def gram(df: DataFrame, xs: list[str], y: str) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y with an intercept, in one aggregate of (k + 1)(k + 2) sums."""
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in xs)]
    k = len(cols)
    sums = [F.sum(cols[i] * cols[j]) for i in range(k) for j in range(i, k)] + [F.sum(c * F.col(y).cast("double")) for c in cols]
    row = list(df.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first())
    g = np.zeros((k, k))
    at = 0
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[at]
            at += 1
    return g, np.array(row[at:], dtype=float)


def principal_axes(rows: DataFrame, vector: str, k: int) -> list[list[float]]:
    """The first ``k`` principal axes of a column of vectors; the largest loading of each is positive.

    Each task sums its rows' outer products, one small matrix a task; these are added up by place.
    """
    schema = "i int, j int, v double"

    def run(batches):
        import pyarrow as pa

        total = None
        for b in batches:
            x = np.array([v for v in b.column(0).to_pylist() if v is not None], float)
            if len(x):
                x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "v"])

    cells = rows.select(vector).mapInArrow(run, schema).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # channels squared
    if not cells:
        return []
    size = 1 + max(c["i"] for c in cells)
    g = np.zeros((size, size))
    for c in cells:
        g[c["i"], c["j"]] = c["v"]
    mean = g[0, 1:] / g[0, 0]
    _, vec = np.linalg.eigh(g[1:, 1:] / g[0, 0] - np.outer(mean, mean))
    return [[float(v) for v in a * np.sign(a[np.abs(a).argmax()])] for a in vec[:, ::-1][:, :k].T]


def mean_if_complete(results: DataFrame, baselines: DataFrame, key: str) -> DataFrame:
    """``score``: the mean over ``baselines(key, base)`` of (accuracy - base) / (1 - base); null unless every one of them has a result."""
    held = baselines.join(results.select(key, "accuracy"), key, "left")
    mean = F.avg((F.col("accuracy") - F.col("base")) / (1.0 - F.col("base")))
    return held.agg(F.when(F.count("accuracy") == F.count("*"), mean).alias("score"))


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def top_k_draw(rows: DataFrame, key: str, logits: str, k: int, temperature: float, seed: int) -> DataFrame:
    """key, greedy (the first largest) and drawn: a draw from the softmax of the ``k`` largest logits.

    The draw depends on the seed and the key alone. At temperature 0 it is the greedy choice.
    """
    top = F.slice(F.array_sort(F.transform(logits, lambda x, i: F.struct((-x.cast("double")).alias("minus"), i.alias("i")))), 1, k)
    t = rows.select(key, top.alias("top"))
    greedy = F.col("top")[0]["i"]
    if temperature <= 0:
        return t.select(key, greedy.alias("greedy"), greedy.alias("drawn"))
    weights = F.transform("top", lambda x: F.exp((F.col("top")[0]["minus"] - x["minus"]) / temperature))
    t = t.withColumn("w", weights).withColumn("total", F.aggregate("w", F.lit(0.0), lambda a, x: a + x))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["n"] + (a["sum"] + x <= u * F.col("total")).cast("int")).alias("n"))
    below = F.aggregate("w", F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), step)["n"]
    return t.select(key, greedy.alias("greedy"), F.element_at("top", F.least(below, F.size("top") - 1) + 1)["i"].alias("drawn"))


def run_rates(log: DataFrame, run: str, order: str, tokens: int, flops_per_token: float, peak: float, steps: int, warm: int = 10) -> DataFrame:
    """``log(run, order, step, dt)`` with tokens_per_second, mfu and progress in percent and eta_minutes, null for the first ``warm`` steps."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(F.when(F.col("step") > warm, F.col("dt")).otherwise(0.0)).over(w)
    rate = tokens / F.col("dt")
    eta = F.when(F.col("step") > warm, spent / (F.col("step") - warm) * (steps - F.col("step")) / 60)
    return log.select("*", rate.alias("tokens_per_second"), (100 * flops_per_token * rate / peak).alias("mfu"), (100.0 * F.col("step") / steps).alias("percent"), eta.alias("eta_minutes"))


def progress(depth: Column, target: Column, rate: Column) -> tuple[Column, Column]:
    """(percent, seconds left) of filling to ``target``; no seconds without a rate."""
    percent = 100 * F.least(F.greatest(depth / F.greatest(target, F.lit(1)), F.lit(0.0)), F.lit(1.0))
    return percent, F.when(rate > 0, F.greatest(target - depth, F.lit(0)) / rate)


def cover_seconds(tokens: Column, rate: Column, world: int) -> Column:
    """Seconds that a shard of ``tokens`` lasts for ``world`` consumers of ``rate``."""
    return tokens / F.greatest(rate * max(world, 1), F.lit(1e-9))


#: Tokens of the reference batch, and the power that batches grow with (fixed values).
REFERENCE_BATCH, BATCH_POWER = 1 << 19, 0.383


def run_plan(params: Column, reference: Column, ratio: float, decay: float, flops_per_token: Column, iterations: Column | None = None, target_flops: Column | None = None) -> dict[str, Column]:
    """The plan of a run by its scaling parameters and those of the reference model.

    target_tokens, batch (the nearest power of two), lr_scale, weight_decay and
    iterations: those given, else those of ``target_flops``, else those of the
    tokens that ``ratio`` asks for.
    """
    target, held = F.floor(params * ratio), reference * ratio
    batch = F.pow(F.lit(2.0), F.rint(F.log2(REFERENCE_BATCH * F.pow(target / held, F.lit(BATCH_POWER)))))
    steps = F.floor(target / batch)
    if target_flops is not None:
        steps = F.when(target_flops > 0, F.rint(target_flops / (flops_per_token * batch))).otherwise(steps)
    if iterations is not None:
        steps = F.when(iterations > 0, iterations).otherwise(steps)
    scale = F.sqrt(batch / REFERENCE_BATCH)
    return {"target_tokens": target.cast("long"), "batch": batch.cast("long"), "lr_scale": scale, "weight_decay": decay * scale * (held / target), "iterations": steps.cast("long")}
