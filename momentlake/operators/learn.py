"""A score learned from votes: feature vectors, fitting, scoring, ranking quality."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

L2, STEPS, RATE, FOLDS = 1.0, 800, 0.5, 5
MIN_VOTES = 6


def feature_map(numbers: Sequence[str], flags: Sequence[str] = (), kinds: Sequence[str] = ()) -> Column:
    """Numbers under their names (a null one as ``missing:name`` instead), true flags, and ``column=value`` for kinds."""
    entry = lambda k, v: F.struct(k.alias("key"), v.cast("double").alias("value"))
    parts = [F.when(F.col(c).isNull(), entry(F.lit(f"missing:{c}"), F.lit(1.0))).otherwise(entry(F.lit(c), F.col(c))) for c in numbers]
    parts += [F.when(F.col(c), entry(F.lit(c), F.lit(1.0))) for c in flags]
    parts += [F.when(F.col(c).isNotNull(), entry(F.concat(F.lit(f"{c}="), F.col(c).cast("string")), F.lit(1.0))) for c in kinds]
    return F.map_from_entries(F.filter(F.array(*parts), lambda e: e.isNotNull()))


def linear_score(features: Column, weights: dict[str, float], bias: float) -> Column:
    """Logistic score of a feature map; features without a weight say nothing."""
    total = F.lit(float(bias))
    for name, w in sorted(weights.items()):
        total = total + F.coalesce(F.try_element_at(features, F.lit(name)), F.lit(0.0)) * F.lit(float(w))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Chance that a positive row scores over a negative one, ties half: from average ranks."""
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("double")).alias("_p"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_rank", F.coalesce(F.sum("_n").over(w), F.lit(0)) + (F.col("_n") + 1) / 2)
    p, n = F.sum("_p"), F.sum(F.col("_n") - F.col("_p"))
    return ranked.groupBy(*by).agg(F.try_divide(F.sum(F.col("_rank") * F.col("_p")) - p * (p + 1) / 2, p * n).alias("auc"), p.cast("long").alias("positives"), n.cast("long").alias("negatives"))


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, l2: float = L2) -> dict[str, np.ndarray | float]:
    """L2 logistic regression on standardised columns by full-batch steps. Votes are some hundreds of rows, so this is the driver's."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    w = np.ones(len(y)) if w is None else np.asarray(w, float)
    mean, std = x.mean(0), x.std(0)
    std = np.where(std < 1e-9, 1.0, std)
    z, coef, bias, total = (x - mean) / std, np.zeros(x.shape[1]), 0.0, w.sum()
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ coef + bias, -30, 30)))
        err = w * (p - y) / total
        coef, bias = coef - RATE * (z.T @ err + l2 * coef / total), bias - RATE * err.sum()
    return {"coef": coef, "bias": bias, "mean": mean, "std": std}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip((np.asarray(x, float) - model["mean"]) / model["std"] @ model["coef"] + model["bias"], -30, 30)))


def cross_validate(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, folds: int = FOLDS, seed: int = 0) -> np.ndarray:
    """Each row's score from a model that hasn't seen it."""
    order = np.random.default_rng(seed).permutation(len(y))
    out = np.full(len(y), 0.5)
    for k in range(folds):
        held = np.zeros(len(y), bool)
        held[order[k::folds]] = True
        if held.any() and not held.all():
            out[held] = predict(fit(x[~held], y[~held], None if w is None else w[~held]), x[held])
    return out


def explain(model: dict, names: Sequence[str], top: int = 12) -> list[tuple[str, float]]:
    """The weightiest features."""
    return sorted(zip(names, map(float, model["coef"])), key=lambda p: (-abs(p[1]), p[0]))[:top]
