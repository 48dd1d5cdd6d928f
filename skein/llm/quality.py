"""Quality scores from Bradley-Terry pairwise ranking.

Pairs of a good and a bad labelled text give feature differences; a logistic
loss on the weighted difference learns the weights of a document score. The
score's threshold is a quantile of the training scores: the share of bad
labels. Scores are mapped to 0..1 so that the threshold is ``CUT``.

Counts come from whole texts; the weights become one JVM expression over
them. At most ``MAX_LABELLED`` labelled rows,
chosen by a hash of their id, are fitted on, and of the pairs of a good and a bad one ``PAIRS`` (60,000)
are drawn; nothing else is bounded.

Edge cases: null and empty texts get the score of a text without words; null
labels are not used, contradictory ones all are; without labels of both kinds
every score is one half; repeated rows are scored each; an empty table gives
an empty result; other columns are ignored, and kept by ``keep_good``. Texts of any length are counted whole; equal
scores stand on the same side of the threshold, which belongs to the good ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table
from .textstats import features, text_stats, with_stats

MAX_LABELLED = 20_000
PAIRS = 60_000
CUT = 0.3
QUANTILES = (0.02, 0.05, 0.1, 0.2, 0.5, 0.8, 0.9, 0.95, 0.98)


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % by


class Ranker:
    """A linear score over features and over steps at their quantiles."""

    def __init__(self, names: list[str]):
        self.names = names
        self.mean = self.scale = np.zeros(len(names))
        self.steps: list[tuple[int, float]] = []
        self.weights = np.zeros(0)
        self.tau = 0.0
        self.fitted = False

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.concatenate([z] + [(x[:, [k]] > t).astype(float) for k, t in self.steps], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, rounds: int = 300, seed: int = 7) -> Ranker:
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        for k in range(x.shape[1]):
            self.steps += [(k, float(t)) for t in np.unique(np.quantile(x[:, k], QUANTILES))]
        d = self.design(x)
        rng = np.random.default_rng(seed)
        i, j = rng.choice(good, pairs), rng.choice(bad, pairs)
        w, m, v = np.zeros(d.shape[1]), np.zeros(d.shape[1]), np.zeros(d.shape[1])
        batch = 4096
        for t in range(1, rounds + 1):
            at = rng.integers(0, pairs, batch)
            diff = d[i[at]] - d[j[at]]
            p = 1 / (1 + np.exp(diff @ w))  # chance that the bad one is ranked first
            g = -(diff * p[:, None]).mean(0) + 1e-3 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.weights, self.fitted = w, True
        self.tau = float(np.quantile(d @ w, len(bad) / len(y)))
        return self

    def expression(self, feats: dict[str, Column]) -> Column:
        """The score in 0..1 of the threshold ``CUT``."""
        if not self.fitted:
            return F.lit(0.5)
        total = F.lit(float(np.log(CUT / (1 - CUT)) - self.tau))
        names, n = self.names, len(self.names)
        for k, name in enumerate(names):
            z = F.greatest(F.lit(-5.0), F.least(F.lit(5.0), (feats[name] - float(self.mean[k])) / float(self.scale[k])))
            total = total + z * float(self.weights[k])
            for s, (kk, t) in enumerate(self.steps):
                if kk == k:
                    total = total + F.when(feats[name] > t, float(self.weights[n + s])).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """``docs(doc_id, text)`` of at most ``limit`` labelled ids, those of the lowest hashes, with their label.

    The ids are broadcast: ``limit`` bounds them, whatever the corpus. Of rows
    that share an id and label one stays (that of the smallest text), so the
    rows are at most ``limit`` as well.
    """
    l = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").distinct()
    l = l.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(l), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit_ranker(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Ranker:
    feats = features()
    rows = text_stats(labelled(docs, labels, "quality", limit), ["doc_id", "label"]).select("doc_id", "label", *(c.alias(n) for n, c in feats.items())).toPandas()
    rows = rows.sort_values(list(rows.columns))
    return Ranker(list(feats)).fit(rows[list(feats)].to_numpy(float), rows["label"].to_numpy())


def score(docs: DataFrame, labels: DataFrame, name: str = "score", train: Column | None = None) -> DataFrame:
    """``docs`` with the column ``name``: the score of each whole text.

    ``train`` selects the ids whose labels may be learned from.
    """
    ranker = fit_ranker(docs, labels if train is None else labels.where(train))
    held = fresh(docs, "_stats")
    return with_stats(docs, held).withColumn(name, ranker.expression(features(lambda n: F.col(held)[n]))).drop(held)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    name = fresh(docs, "_score")
    return score(docs, labels, name).where(F.col(name) >= CUT).select(*docs.columns)


def op5_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = score(docs, labels, train=remainder(F.col("doc_id"), 5) != 0)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
