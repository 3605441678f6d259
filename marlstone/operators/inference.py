"""Statistical inference on return series: HAC means, bootstraps, stepdown, overfitting, power.

A series is a set of rows; sums run in Spark. Resamples are independent tasks: row r of the stationary bootstrap comes
from the generator advanced by 2 n r draws, so any task can make it. The observed series is shipped with each task and
has a stated largest length.
"""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Observations of a series that a resampling task holds.
MOST_OBSERVATIONS = 1_000_000


def newey_west(rows: DataFrame, keys: list[str], order: str, x: str, lag: int) -> DataFrame:
    """Mean, long-run variance with Bartlett weights, and standard error of the mean per key; autocovariances over n.

    ``status`` is OK, DEGENERATE (a variance within rounding of zero, which becomes zero), NEGATIVE (below that) or
    TOO_SHORT (no more rows than ``lag``); the last two have no standard error.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    mean = F.avg(x).over(Window.partitionBy(*keys))
    c = rows.withColumn("_c", F.col(x) - mean)
    c = c.select(*keys, x, "_c", *(F.lag("_c", j).over(w).alias(f"_l{j}") for j in range(1, lag + 1)))
    n = F.count("*")
    lrv = F.sum(F.col("_c") * F.col("_c")) / n
    for j in range(1, lag + 1):
        lrv = lrv + 2 * (1 - j / (lag + 1)) * F.coalesce(F.sum(F.col("_c") * F.col(f"_l{j}")), F.lit(0.0)) / n
    out = c.groupBy(*keys).agg(n.alias("n"), F.avg(x).alias("mean"), lrv.alias("long_run_variance"), (F.sum(F.col("_c") * F.col("_c")) / n).alias("_g0"))
    found = F.col("long_run_variance")
    near = F.abs(found) <= _rounding(F.greatest(F.lit(1.0), F.abs("_g0")), lag)
    status = F.when(F.col("n") <= lag, "TOO_SHORT").when(near, "DEGENERATE").when(found < 0, "NEGATIVE").otherwise("OK")
    out = out.withColumn("status", status).withColumn("long_run_variance", F.when(near, 0.0).otherwise(found))
    se = F.when(F.col("status").isin("OK", "DEGENERATE"), F.sqrt(F.col("long_run_variance") / F.col("n")))
    return out.withColumn("standard_error", se).drop("_g0")


def _rounding(scale, lag: int):
    """What a long-run variance may differ from zero by rounding alone."""
    return scale * (2.220446049250313e-16 * max(1, 2 * lag + 1) * 64.0)


def bootstrap_indices(restarts: np.ndarray, starts: np.ndarray, block: float) -> np.ndarray:
    """Indices of one stationary resample: a new start where the uniform is under 1 / block, else one on, cyclically."""
    n = len(restarts)
    new = restarts < 1 / block
    new[0] = True
    first = np.minimum((starts * n).astype(np.int64), n - 1)
    at = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return (first[at] + np.arange(n) - at) % n


def resample(n: int, block: float, seed: int, row: int) -> np.ndarray:
    bits = np.random.PCG64(seed)
    bits.advance(2 * n * row)
    draws = np.random.Generator(bits).random(2 * n)
    return bootstrap_indices(draws[:n], draws[n:], block)


def hac_t(x: np.ndarray, lag: int, null: float = 0.0) -> float:
    """The t value of a mean; a lag that isn't below the number of rows, and a series without variance, are errors."""
    n = len(x)
    if lag >= n:
        raise ValueError(f"a lag of {lag} needs more than {n} rows")
    c = x - x.mean()
    first = float(c @ c / n)
    lrv = first + sum(2 * (1 - j / (lag + 1)) * (c[j:] @ c[:-j]) / n for j in range(1, lag + 1))
    if lrv <= _rounding(max(1.0, abs(first)), lag):
        raise ValueError("the long-run variance is negative" if lrv < -_rounding(max(1.0, abs(first)), lag) else "the series has no variance")
    return (x.mean() - null) / math.sqrt(lrv / n)


def bootstrap_statistics(spark: SparkSession, series: np.ndarray, resamples: int, block: float, seed: int, lag: int) -> DataFrame:
    """(row, column, t): null-centred HAC t of every column of ``series`` (n x columns) in each resample."""
    if series.shape[0] > MOST_OBSERVATIONS:
        raise ValueError("the series is too long for one task")
    centre = series - series.mean(axis=0)

    def work(parts):
        for pdf in parts:
            out = [(int(r), j, hac_t(part[:, j], lag)) for r in pdf["id"] for part in [centre[resample(len(centre), block, seed, int(r))]] for j in range(part.shape[1])]
            yield pd.DataFrame(out, columns=["row", "column", "t"])

    return spark.range(resamples).mapInPandas(work, "row long, column int, t double")


def bootstrap_means(spark: SparkSession, series: np.ndarray, resamples: int, blocks: list[int], seed: int) -> DataFrame:
    """(block, row, mean) of stationary resamples with each expected length of a block."""
    if len(series) > MOST_OBSERVATIONS:
        raise ValueError("the series is too long for one task")

    def work(parts):
        for pdf in parts:
            yield pd.DataFrame({"block": pdf["block"], "row": pdf["id"], "mean": [float(series[resample(len(series), b, seed + b, r)].mean()) for b, r in zip(pdf["block"].tolist(), pdf["id"].tolist(), strict=True)]})

    rows = spark.range(resamples).withColumn("block", F.explode(F.array(*map(F.lit, blocks))))
    return rows.mapInPandas(work, "block int, row long, mean double")


def romano_wolf(statistics: DataFrame, observed: list[float], resamples: int) -> list[float]:
    """Adjusted p-values by stepdown: (1 + exceedances of the maximum over what remains) / (B + 1), never falling.

    The maxima and their counts are aggregated in Spark, for all steps in one pass.
    """
    order = sorted(range(len(observed)), key=lambda j: (-abs(observed[j]), j))
    ranks = {j: i for i, j in enumerate(order)}
    rank = F.create_map(*[F.lit(v) for pair in ranks.items() for v in pair])[F.col("column")]
    wide = statistics.groupBy("row").agg(*(F.max(F.when(rank >= i, F.abs("t"))).alias(f"m{i}") for i in range(len(order))))
    counts = wide.agg(*(F.sum((F.col(f"m{i}") >= abs(observed[j])).cast("long")).alias(f"c{i}") for i, j in enumerate(order))).first()
    out, most = [0.0] * len(observed), 0.0
    for i, j in enumerate(order):
        most = max(most, (1 + counts[f"c{i}"]) / (resamples + 1))
        out[j] = most
    return out


def cscv(blocks: DataFrame, strategies: list[str], n_blocks: int) -> DataFrame:
    """Combinatorially symmetric cross-validation: for every half of the blocks, the winner in it and its rank outside.

    ``blocks`` (block, strategy, total) has one row per block and strategy. Columns: combination, winner, rank, logit,
    tied. The probability of overfitting is the share of combinations whose logit isn't positive.
    """
    spark = blocks.sparkSession
    halves = [[i in half for i in range(n_blocks)] for half in combinations(range(n_blocks), n_blocks // 2)]
    plan = spark.createDataFrame([(i, h) for i, h in enumerate(halves)], "combination int, inside array<boolean>")
    joined = blocks.crossJoin(F.broadcast(plan)).withColumn("_in", F.col("inside")[F.col("block")])
    sums = joined.groupBy("combination", "strategy").agg(F.sum(F.when(F.col("_in"), F.col("total")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("_in"), 0.0).otherwise(F.col("total"))).alias("b"))
    best = F.row_number().over(Window.partitionBy("combination").orderBy(F.desc("a"), "strategy"))
    ranked = sums.withColumn("_best", best).withColumn("rank", F.rank().over(Window.partitionBy("combination").orderBy("b")))
    top = F.max("a").over(Window.partitionBy("combination"))
    ranked = ranked.withColumn("tied", F.sum((F.col("a") == top).cast("int")).over(Window.partitionBy("combination")) > 1)
    share = F.col("rank") / (len(strategies) + 1)
    return ranked.where("_best = 1").select("combination", F.col("strategy").alias("winner"), "rank", F.log(share / (1 - share)).alias("logit"), "tied")


def deflated_sharpe(sharpe: float, n: int, skew: float, kurtosis: float, trial_variance: float, trials: int) -> float:
    """Chance that the Sharpe ratio beats the largest one expected among so many trials."""
    z = NormalDist().inv_cdf
    gamma = 0.5772156649015329
    expected = math.sqrt(trial_variance) * ((1 - gamma) * z(1 - 1 / trials) + gamma * z(1 - 1 / (trials * math.e))) if trials > 1 else 0.0
    return NormalDist().cdf((sharpe - expected) * math.sqrt(n - 1) / math.sqrt(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2))


def smallest_effect(long_run_variance: float, n: int, alpha: float = 0.05, power: float = 0.8, two_sided: bool = True) -> float:
    """Smallest mean that n observations detect with the given size and power."""
    z = NormalDist().inv_cdf
    return (z(1 - alpha / (2 if two_sided else 1)) + z(power)) * math.sqrt(long_run_variance / n)


def bootstrap_power(spark: SparkSession, training: np.ndarray, effect: float, resamples: int, block: float, seed: int, lag: int, critical: float) -> DataFrame:
    """(row, rejected) for resamples of the training series moved by ``effect``."""
    if len(training) > MOST_OBSERVATIONS:
        raise ValueError("the series is too long for one task")
    centre = training - training.mean() + effect

    def work(parts):
        for pdf in parts:
            yield pd.DataFrame({"row": pdf["id"], "rejected": [hac_t(centre[resample(len(centre), block, seed, int(r))], lag) > critical for r in pdf["id"]]})

    return spark.range(resamples).mapInPandas(work, "row long, rejected boolean")


def rolled_blocks(rows: DataFrame, keys: list[str], order: str, x: str, block: int, offset: int) -> DataFrame:
    """Negative control: values shifted cyclically inside blocks of ``block`` rows by ``offset``."""
    w = Window.partitionBy(*keys).orderBy(order)
    placed = rows.select(*keys, order, x, (F.row_number().over(w) - 1).alias("_i")).withColumn("_b", F.floor(F.col("_i") / block))
    sized = placed.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "_b"))).withColumn("_k", F.col("_i") % block)
    moved = sized.select(*keys, "_b", ((F.col("_k") + offset) % F.col("_n")).alias("_k"), F.col(x).alias("control"))
    return sized.join(moved, [*keys, "_b", "_k"]).select(*keys, order, x, "control")
