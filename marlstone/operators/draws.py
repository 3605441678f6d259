"""Bootstraps whose generator draws whole chunks of starts, then whole chunks of restarts, replayed chunk by chunk.

A chunk's place in the generator's stream depends on the chunks before, as bounded integers come from halves of its
words and some halves are rejected. Which halves are rejected depends on the half alone. So tasks look for rejected
halves in the stretch that each chunk can reach, the few that there are tell where every chunk begins, and then the
chunks are independent tasks. Row by row a chunk needs one series, not a matrix.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .inference import MOST_OBSERVATIONS

#: Words beyond its nominal stretch that a chunk is searched for rejected halves, at first.
SLACK = 64


def rejected_halves(seed: int, first: int, words: int, n: int) -> np.ndarray:
    """Numbers of the 32-bit halves, low before high, among ``words`` words from ``first`` on that a draw below n rejects."""
    bits = np.random.PCG64(seed)
    bits.advance(first)
    raw = bits.random_raw(words)
    halves = np.empty(2 * words, np.uint64)
    halves[0::2], halves[1::2] = raw & np.uint64(0xFFFFFFFF), raw >> np.uint64(32)
    low = (halves * np.uint64(n)) & np.uint64(0xFFFFFFFF)
    return 2 * first + np.flatnonzero(low < np.uint64((1 << 32) % n))


def chunk_starts(cells: list[int], rejected: list[int]) -> list[tuple[int, int, int]]:
    """For each chunk of so many cells: the word that its integers begin at, the half left over before (-1: none), the word of its doubles."""
    word, left, out = 0, -1, []
    bad = sorted(rejected)
    for k in cells:
        begin, over = word, left
        if left >= 0:  # the high half of an earlier word comes first
            i = bisect_left(bad, left)
            k_left = k - (not (i < len(bad) and bad[i] == left))
            left = -1
        else:
            k_left = k
        start, end = 2 * word, 2 * word + k_left
        while (more := start + k_left + bisect_left(bad, end) - bisect_left(bad, start)) != end:
            end = more
        if k_left:
            word, left = (end + 1) // 2, end if end % 2 else -1
        out.append((begin, over, word))
        word += k
    return out


def planned(spark: SparkSession, n: int, cells: list[int], seed: int) -> list[tuple[int, int, int]]:
    """Where each chunk stands, for draws below n; the driver gets the rejected halves only, some n / 2**32 of all."""
    if n == 1:  # no draw is made for a single value
        return [(sum(cells[:i]), -1, sum(cells[:i])) for i in range(len(cells))]
    slack = SLACK
    while True:
        nominal, at = [], 0
        for k in cells:
            nominal.append((at, (k + 1) // 2 + slack))
            at += k // 2 + k
        tasks = spark.createDataFrame([(a, w) for a, w in nominal], "first long, words long").repartition(min(len(cells), 200))

        def work(parts, n=n, seed=seed):
            for pdf in parts:
                found = [rejected_halves(seed, max(0, a - 1), w + 1, n) for a, w in pdf.itertuples(index=False)]
                yield pd.DataFrame({"half": np.concatenate(found) if found else np.zeros(0, np.int64)})

        bad = [r[0] for r in tasks.mapInPandas(work, "half long").distinct().collect()]
        starts = chunk_starts(cells, bad)
        ends = [d for _, _, d in starts]
        if all(end <= a + w and begin >= max(0, a - 1) for (begin, _, _), end, (a, w) in zip(starts, ends, nominal, strict=True)):
            return starts
        slack *= 4


def chunk_rows(n: int, m: int, count: int, block: float, seed: int, start: tuple[int, int, int]):
    """The index rows of one chunk: ``count`` of m observations out of n, as they come."""
    word, left, doubles = start
    first, second = np.random.PCG64(seed), np.random.PCG64(seed)
    first.advance(word)
    second.advance(doubles)
    if left >= 0:
        held = np.random.PCG64(seed)
        held.advance(left // 2)
        state = first.state
        state["has_uint32"], state["uinteger"] = 1, int(held.random_raw()) >> 32
        first.state = state
    starts, restarts = np.random.Generator(first), np.random.Generator(second)
    for _ in range(count):
        begin, new = starts.integers(0, n, size=m, dtype=np.int64), restarts.random(m) < 1 / block
        new[0] = True
        at = np.maximum.accumulate(np.where(new, np.arange(m), 0))
        yield (begin[at] + np.arange(m) - at) % n


def _resampled(spark: SparkSession, series: np.ndarray, m: int, resamples: int, chunk: int, block: float, seed: int, statistic) -> DataFrame:
    """(row, value): the statistic of every resample, in the order of the chunks."""
    if max(len(series), m) > MOST_OBSERVATIONS:
        raise ValueError("the series is too long for one task")
    counts = [min(chunk, resamples - a) for a in range(0, resamples, chunk)]
    starts = planned(spark, len(series), [c * m for c in counts], seed)
    tasks = spark.createDataFrame([(i * chunk, c, *s) for i, (c, s) in enumerate(zip(counts, starts, strict=True))], "row long, count long, word long, half long, doubles long").repartition(len(counts))

    def work(parts):
        for pdf in parts:
            for row, count, *start in pdf.itertuples(index=False, name=None):
                values = [statistic(series[at]) for at in chunk_rows(len(series), m, count, block, seed, tuple(start))]
                yield pd.DataFrame({"row": np.arange(row, row + count), "value": values})

    return tasks.mapInPandas(work, "row long, value double")


def power(spark: SparkSession, training: np.ndarray, planned_observations: int, effect: float, resamples: int = 5_000, block: float = 10, seed: int = 0, chunk: int = 500) -> DataFrame:
    """(row, value): the t value of every resample of the centred series, moved by ``effect``; minus infinity without spread."""
    centre = training - float(np.mean(training)) + effect

    def t(x: np.ndarray) -> float:
        error = float(np.std(x, ddof=1)) / math.sqrt(len(x))
        return float(np.mean(x)) / error if error > 0 else -math.inf

    return _resampled(spark, centre, planned_observations, resamples, chunk, block, seed, t)


def means(spark: SparkSession, series: np.ndarray, resamples: int = 10_000, block: int = 10, seed: int = 0, chunk: int = 500) -> DataFrame:
    """(row, value): the mean of every resample of the series' own length; the generator's seed is ``seed + block``."""
    return _resampled(spark, series, len(series), resamples, chunk, block, seed + block, lambda x: float(np.mean(x)))
