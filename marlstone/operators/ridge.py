"""Ridge models from Gram aggregates.

Spark sums the products of each group; what is solved afterwards is a matrix of features by features per group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Models that are sent to every task; more are met in a shuffle.
BROADCAST_ROWS = 100_000


def gram(rows: DataFrame, keys: list[str], x: list[str], y: list[str]) -> DataFrame:
    """Count, sums and sums of products per key, in one aggregation; rows with a null are left out."""
    cols = [*x, *y]
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    sums = [F.sum(c).alias(f"s_{c}") for c in cols]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"s_{a}__{b}") for i, a in enumerate(cols) for b in cols[i:]]
    return rows.where(ok).groupBy(*keys).agg(F.count("*").alias("n"), *sums, *products)


def solve(g: dict[str, float], x: list[str], y: str, penalty: float, standardised: bool, zero_deviation: str = "one") -> tuple[list[float], float, float]:
    """Weights, intercept and residual mean square from one row of ``gram``.

    Standardised and centred: (Z'Z + penalty I) w = Z'(y - mean), scaled back. Otherwise a free intercept beside raw
    features. A constant feature has deviation 1 ("one"), weight 0 ("zero"), or is an error ("error").
    """
    n = g["n"]
    mean = np.array([g[f"s_{c}"] for c in x]) / n
    xx = np.array([[g[f"s_{min(a, b, key=x.index)}__{max(a, b, key=x.index)}"] for b in x] for a in x])
    xy = np.array([g[f"s_{a}__{y}"] for a in x])
    my, yy = g[f"s_{y}"] / n, g[f"s_{y}__{y}"]
    cxx, cxy = xx - n * np.outer(mean, mean), xy - n * mean * my
    if standardised:
        dev = np.sqrt(np.maximum(np.diag(cxx) / n, 0))
        flat = dev <= 1e-12 * np.maximum(1, np.abs(mean))
        if flat.any() and zero_deviation == "error":
            raise ValueError("a feature is constant")
        scale = np.where(flat, 1.0, dev)
        z = cxx / np.outer(scale, scale)
        w = np.linalg.solve(z + penalty * np.eye(len(x)), cxy / scale)
        w = np.where(flat & (zero_deviation == "zero"), 0.0, w) / scale
    else:
        w = np.linalg.solve(cxx + penalty * np.eye(len(x)), cxy)
    rest = yy - n * my * my - 2 * w @ cxy + w @ cxx @ w
    return w.tolist(), float(my - mean @ w), float(max(rest, 0) / n)


def fit(rows: DataFrame, keys: list[str], x: list[str], y: list[str], penalty: float = 1.0, standardised: bool = True, zero_deviation: str = "one") -> DataFrame:
    """One model per key and target: target, n, weights, intercept, mse. Solving happens in Spark, per row of sums."""
    sums = gram(rows, keys, x, y)
    kinds = dict(sums.dtypes)
    names = [c for c in sums.columns if c not in keys]

    def work(parts):
        for pdf in parts:
            out = []
            for r in pdf.to_dict("records"):
                g = {k: float(r[k]) for k in names}
                for target in y:
                    if g["n"] > len(x):
                        w, b, mse = solve(g, x, target, penalty, standardised, zero_deviation)
                        out.append((*(r[k] for k in keys), target, int(g["n"]), w, b, mse))
            yield pd.DataFrame(out, columns=[*keys, "target", "n", "weights", "intercept", "mse"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + (", " if keys else "")
    return sums.mapInPandas(work, schema + "target string, n long, weights array<double>, intercept double, mse double")


def predicted(rows: DataFrame, models: DataFrame, keys: list[str], x: list[str], target: str) -> DataFrame:
    """``rows`` with ``prediction``: null where a key has no model or a feature is missing."""
    own = models.where(F.col("target") == target).select(*keys, "weights", "intercept")
    dot: Column = F.col("intercept")
    for i, c in enumerate(x):
        dot = dot + F.col("weights")[i] * F.col(c)
    own = written(own, "models")
    own = F.broadcast(own) if own.count() <= BROADCAST_ROWS else own  # few keys of many rows aren't shuffled by key
    return rows.join(own, keys, "left").withColumn("prediction", dot).drop("weights", "intercept")


def neutral_threshold(rows: DataFrame, keys: list[str], prediction: str, share: float = 0.6) -> DataFrame:
    """Nearest-rank quantile of the absolute predictions per key."""
    return rows.groupBy(*keys).agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY abs({prediction}))").alias("threshold"))


def robust_scale(rows: DataFrame, keys: list[str], x: str, least: int) -> DataFrame:
    """Median and 1.4826 times the median absolute deviation per key with at least ``least`` rows."""
    middle = rows.groupBy(*keys).agg(F.median(x).alias("location"), F.count(x).alias("n")).where(F.col("n") >= least)
    return rows.join(middle, keys).groupBy(*keys, "n", "location").agg((1.4826 * F.median(F.abs(F.col(x) - F.col("location")))).alias("scale"))
