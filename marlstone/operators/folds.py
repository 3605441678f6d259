"""Chronological folds and purges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(sessions: DataFrame, keys: list[str], session: str) -> DataFrame:
    """Each key's sessions, numbered from 1 in order."""
    return sessions.select(*keys, session).distinct().withColumn("session_no", F.row_number().over(Window.partitionBy(*keys).orderBy(session)))


def expanding(sessions: DataFrame, folds: int, fit: int, step: int, evaluate: int, embargo: int = 1) -> DataFrame:
    """Role of each numbered session in each fold: FIT up to fit + step * fold, then EMBARGO, then EVALUATE."""
    each = sessions.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    each = each.withColumn("_fit", F.lit(fit) + step * F.col("fold"))
    n = F.col("session_no")
    role = F.when(n <= F.col("_fit"), "FIT").when(n <= F.col("_fit") + embargo, "EMBARGO").when(n <= F.col("_fit") + embargo + evaluate, "EVALUATE")
    return each.withColumn("role", role).where("role is not null").drop("_fit")


def equal(sessions: DataFrame, keys: list[str], folds: int) -> DataFrame:
    """Folds of equal size, the first ones one larger where it doesn't come out even."""
    return sessions.withColumn("fold", F.ntile(folds).over(Window.partitionBy(*keys).orderBy("session_no")))


def purged(samples: DataFrame, windows: DataFrame, embargo: int) -> DataFrame:
    """Samples (sample, decision, label_start, label_end, label_known) that may train each window (fold, start, end).

    Strictly past: decision before start less the embargo and label known before start. Half-open label intervals must
    not overlap the window, nor the decision lie in the embargo after it. ``windows`` has a handful of rows.
    """
    s, w = samples, F.broadcast(windows)
    past = (F.col("decision") < F.col("start") - embargo) & (F.col("label_known") < F.col("start"))
    overlap = (F.col("label_start") < F.col("end")) & (F.col("label_end") > F.col("start"))
    after = (F.col("decision") >= F.col("end")) & (F.col("decision") < F.col("end") + embargo)
    return s.crossJoin(w).where(past & ~overlap & ~after).select("fold", "sample")


def best_training_windows(days: DataFrame, complete: str, train: int, embargo: int, evaluate: int) -> DataFrame:
    """Complete sessions of the training and evaluation part of every sliding window over numbered sessions."""
    w = Window.orderBy("session_no")
    part = lambda a, b: F.sum(F.col(complete).cast("long")).over(w.rowsBetween(a, b))
    whole = F.count("*").over(w.rowsBetween(0, train + embargo + evaluate - 1))
    out = days.select(F.col("session_no").alias("first_session"), part(0, train - 1).alias("training"), part(train + embargo, train + embargo + evaluate - 1).alias("evaluation"), whole.alias("_n"))
    return out.where(F.col("_n") == train + embargo + evaluate).drop("_n")
