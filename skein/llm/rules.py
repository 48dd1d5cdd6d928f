"""Quality rules as a learned decision list.

Sequential covering: a rule is grown as a conjunction of threshold conditions
by information gain on two thirds of the labelled rows, pruned from its end on
the other third, and kept while it is right more often than not there; the
rows it covers leave, and the next rule is learned from the rest. The list
becomes one ordered Spark conditional expression over whole-text counts.

At most ``MAX_LABELLED`` labelled rows, chosen by a hash of their id, are
learned from, and a list has at most ``MAX_RULES`` (12) rules of ``MAX_CONDITIONS`` (4)
conditions; nothing else is bounded.

Edge cases: null and empty texts have no words and fail the base rule; null
labels are not used; without labels of both kinds the list is empty and keeps
all that pass the base rule; repeated rows each give a row; an empty table
gives an empty result; other columns are ignored. Texts of any length are counted whole; the first rule that holds
decides, and of conditions of one gain the first in the order of the counts is taken.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table
from .quality import labelled
from .textstats import features, text_stats, with_stats

MAX_LABELLED = 20_000
MAX_RULES = 12
MAX_CONDITIONS = 4
MIN_COVER = 4


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        col = x[:, names.index(self.feature)]
        return col > self.threshold if self.above else col <= self.threshold

    def column(self, feats: dict[str, Column]) -> Column:
        return feats[self.feature] > self.threshold if self.above else feats[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.holds(x, names)
    return out


def grow(x: np.ndarray, bad: np.ndarray, names: list[str], candidates: list[Condition]) -> Rule:
    rule: list[Condition] = []
    here = np.ones(len(x), dtype=bool)
    while len(rule) < MAX_CONDITIONS:
        p0, n0 = int((here & bad).sum()), int((here & ~bad).sum())
        if not n0 or not p0:
            break
        base = np.log2(p0 / (p0 + n0))
        best, gain = None, 1e-9
        for c in candidates:
            now = here & c.holds(x, names)
            p = int((now & bad).sum())
            if p >= MIN_COVER:
                g = p * (np.log2(p / int(now.sum())) - base)
                if g > gain:
                    best, gain = c, g
        if best is None:
            break
        rule.append(best)
        here &= best.holds(x, names)
    return tuple(rule)


def worth(rule: Rule, x: np.ndarray, bad: np.ndarray, names: list[str]) -> float:
    now = covers(rule, x, names)
    p, n = int((now & bad).sum()), int((now & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 11) -> list[Rule]:
    """An ordered list of rules that reject; ``y`` is 1 for good rows."""
    bad = y == 0
    if not bad.any() or bad.all():
        return []
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    left = np.ones(len(x), dtype=bool)
    candidates = []
    for k, name in enumerate(names):
        values = np.unique(np.quantile(x[:, k], np.linspace(0, 1, 41)))
        inner = np.unique(np.quantile(x[bad, k], np.linspace(0, 1, 21)))
        points = np.unique(np.concatenate([values, inner]))
        for t in (points[:-1] + points[1:]) / 2:
            candidates += [Condition(name, True, float(t)), Condition(name, False, float(t))]
    while len(rules) < MAX_RULES and (left & bad).sum() >= MIN_COVER:
        growing = rng.random(len(x)) < 2 / 3
        g, v = left & growing, left & ~growing
        rule = grow(x[g], bad[g], names, candidates)
        if not rule:
            break
        shorter = [rule[:k] for k in range(len(rule), 0, -1)]
        rule = max(shorter, key=lambda r: worth(r, x[v], bad[v], names))
        if worth(rule, x[v], bad[v], names) <= 0.5:
            break
        rules.append(rule)
        left &= ~covers(rule, x, names)
    return rules


def kept_expression(rules: list[Rule], feats: dict[str, Column]) -> Column:
    """WHEN rule 1 THEN false WHEN rule 2 THEN false ... ELSE true."""
    out = F
    for rule in rules:
        condition = F.lit(True)
        for c in rule:
            condition = condition & c.column(feats)
        out = out.when(condition, False)
    return out.otherwise(True) if rules else F.lit(True)


def fit_rules(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> list[Rule]:
    feats = features()
    rows = text_stats(labelled(docs, labels, "quality", limit), ["doc_id", "label"]).select("doc_id", "label", *(c.alias(n) for n, c in feats.items())).toPandas()
    rows = rows.sort_values(list(rows.columns))
    return learn(rows[list(feats)].to_numpy(float), rows["label"].to_numpy(), list(feats))


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row."""
    held = fresh(docs, "_stats")

    def get(name: str) -> Column:
        return F.col(held)[name]

    d = with_stats(docs.select("doc_id", "text"), held)
    failed = (get("n_words") < 50) | (100 * get("n_repeat_words") > 50 * get("n_words"))
    return d.select(
        "doc_id", *(get(n).alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        failed.alias("base_failed"), (~failed & kept_expression(rules, features(get))).alias("kept"),
    )


def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return apply_rules(docs, fit_rules(docs, labels))
