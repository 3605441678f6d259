"""Nearest neighbours and top inner products of a stated query set against all rows, in blocks of rows.

Rows are dealt by the hash of their id into blocks of bounded size; the queries go to every block and stream past it,
so no task holds more than one block. Each block gives its best k for each query, and the best k of those are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import written

ROWS_PER_BLOCK = 50_000

Found = tuple[np.ndarray, np.ndarray]  # places in the block, scores; best first


def usable(vector: str, zero: bool = True) -> Column:
    """Whether a vector has components, all of them finite; with ``zero`` the zero vector will do."""
    v = F.col(vector)
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok if zero else ok & F.exists(v, lambda x: x != 0), F.lit(False))


def in_blocks(rows: DataFrame, index: Callable[[np.ndarray, np.ndarray, np.ndarray], Callable[[int, np.ndarray], Found]], k: int, score: str, ascending: bool, rows_per_block: int) -> DataFrame:
    """``rows`` (id, vector, asks; each usable) searched for its queries: query_id, rank, vec_id, score.

    ``index`` gets row numbers, ids and vectors of a block and returns the search for one query's row number and vector.
    Rows are told apart by their numbers, so rows of one id are candidates of each other, and each query row has its
    own result. Vectors of different lengths are never compared.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, numbers, vectors, search = None, [], [], [], None
        for b in batches:  # sorted by block, its rows before the queries
            group = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            asks = b.column(2).to_pylist()
            own, row = b.column(3).to_numpy(), b.column(4).to_numpy()
            lists = b.column(5)
            at = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            out: tuple[list, list, list, list] = ([], [], [], [])
            i = 0
            while i < len(own):
                j = i + 1
                while j < len(own) and group[j] == group[i] and asks[j] == asks[i]:
                    j += 1
                part = flat[at[i] : at[j]].reshape(j - i, -1).astype(np.float64)
                if group[i] != now:
                    now, ids, numbers, vectors, search = group[i], [], [], [], None
                if not asks[i]:
                    ids.append(own[i:j])
                    numbers.append(row[i:j])
                    vectors.append(part)
                elif ids or search:
                    if search is None:
                        known = np.concatenate(ids)
                        search = (known, index(np.concatenate(numbers), known, np.concatenate(vectors)))
                        ids, numbers, vectors = [], [], []
                    for q, r, v in zip(own[i:j].tolist(), row[i:j].tolist(), part, strict=True):
                        found, scores = search[1](r, v)
                        out[0].extend([r] * len(found))
                        out[1].extend([q] * len(found))
                        out[2].extend(search[0][found].tolist())
                        out[3].extend(scores.tolist())
                i = j
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64() if score == "double" else pa.int64())], ["asked", "query_id", "vec_id", "score"])

    spark = rows.sparkSession
    n = rows.count()
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // rows_per_block))
    base = written(rows.select(F.col("id").cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col("vector").cast("array<double>").alias("vector"), "asks"), "vectors")
    cols = [F.size("vector").alias("dim"), "ask", "id", "row", "vector"]
    all_rows = base.withColumn("ask", F.lit(False)).select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), *cols)
    queries = base.where("asks").withColumn("ask", F.lit(True)).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), *cols)
    dealt = all_rows.union(queries).repartition(blocks, "block").sortWithinPartitions("block", "dim", "ask")
    found = dealt.mapInArrow(work, f"asked long, query_id long, vec_id long, score {score}")
    order = F.row_number().over(Window.partitionBy("asked").orderBy(F.asc("score") if ascending else F.desc("score"), "vec_id"))
    return found.withColumn("rank", order.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def chi_square_quantile(p: float, dims: int) -> float:
    """Of the chi-square law with an even number of degrees of freedom."""
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    low, high = 0.0, 10.0 * dims + 100
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - tail(mid) < p else (low, mid)
    return high


def kd_leaves(points: np.ndarray, most: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Leaves of a kd-tree, cut at the median of the widest axis, with the bounds of each."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        own = todo.pop()
        if len(own) <= most:
            leaves.append(own)
            continue
        axis = int(np.argmax(np.ptp(points[own], axis=0)))
        half = len(own) // 2
        cut = own[np.argpartition(points[own, axis], half)]
        todo += [cut[half:], cut[:half]]
    return leaves, np.array([points[x].min(axis=0) for x in leaves]), np.array([points[x].max(axis=0) for x in leaves])


def _best(keys: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least keys, ties to smaller ids."""
    if len(keys) > 4 * k:
        near = np.flatnonzero(keys <= np.partition(keys, k - 1)[k - 1])
        return near[np.lexsort((ids[near], keys[near]))[:k]]
    return np.lexsort((ids, keys))[:k]


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 8, confidence: float = 0.98, leaf: int = 128, seed: int = 20, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The k nearest rows in Euclidean distance for each query: query_id, rank, vec_id, score.

    Vectors are projected on ``dims`` directions with normal (2-stable) components; a kd-tree holds the projections of
    each block. Leaves are taken in the order of their projected distance from the query, and points in them verified
    on the original vectors. Projected over true distance, squared, has the chi-square law with ``dims`` degrees, so
    the search ends where the next projected distance squared exceeds its ``confidence`` quantile times the kth true
    distance squared: a nearer row is then still unseen with a chance of at most 1 - confidence.

    Vectors that are null, empty, zero or hold null or non-finite components take no part; rows of
    one id are told apart; null ids take no part; fewer candidates give fewer rows; an empty table gives an empty one.
    """
    if dims % 2:
        raise ValueError("dims is even")
    quantile = chi_square_quantile(confidence, dims)

    def index(rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Callable[[int, np.ndarray], Found]:
        base = np.random.default_rng(seed).standard_normal((x.shape[1], dims))
        low = x @ base
        leaves, least, most = kd_leaves(low, leaf)

        def search(q: int, v: np.ndarray) -> Found:
            p = v @ base
            bound = (np.maximum(np.maximum(least - p, p - most), 0) ** 2).sum(axis=1)
            order = np.argsort(bound, kind="stable")
            at, dist = np.zeros(0, np.int64), np.zeros(0)
            radius, step, i = math.inf, 1, 0
            while i < len(order) and bound[order[i]] <= quantile * radius:
                own = np.concatenate([leaves[j] for j in order[i : i + step] if bound[j] <= quantile * radius])
                own = own[(((low[own] - p) ** 2).sum(axis=1) <= quantile * radius * (1 + 1e-12)) & (rows[own] != q)]
                at = np.concatenate([at, own])
                dist = np.concatenate([dist, ((x[own] - v) ** 2).sum(axis=1)])
                keep = _best(dist, ids[at], k)
                at, dist = at[keep], dist[keep]
                radius = dist[-1] if len(dist) == k else math.inf
                i += step
                step = min(2 * step, 64)
            return at, np.sqrt(dist)

        return search

    rows = vectors.where(usable(vector_col, zero=False) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), is_query.alias("asks"))
    return in_blocks(rows, index, k, "double", True, rows_per_block)


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The k rows of highest integer inner product for each query, exactly: query_id, rank, vec_id, score.

    Components are floor(scale * x). Fagin's threshold algorithm runs in each block: each dimension has its rows
    sorted, and a query reads all lists from the end that its sign prefers. A row that shows up is scored at once. The
    threshold, the score of a row that would have the values where the lists stand, bounds all unseen rows; the search
    stops when it is below the kth score (not at it, since ties go to smaller ids). Lists are read in growing steps.

    Vectors that are null, empty or hold null or non-finite components take no part; zero vectors do. Rows of
    one id are told apart; null ids take no part.
    """

    def index(rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Callable[[int, np.ndarray], Found]:
        lists = np.argsort(x, axis=0, kind="stable").T.copy()
        n, d = x.shape
        exact = float(np.abs(x).max(initial=0)) ** 2 * d < 2**53
        whole = x if exact else x.astype(np.int64)

        def search(q: int, v: np.ndarray) -> Found:
            use = np.flatnonzero(v)
            up = v[use] > 0
            weight = v if exact and float(np.abs(v).max(initial=0)) * float(np.abs(x).max(initial=0)) * d < 2**53 else v.astype(np.int64)
            seen = rows == q
            at, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
            depth, step = 0, 8
            while depth < n:
                end = min(n, depth + step)
                read = np.concatenate([lists[j, n - end : n - depth] if u else lists[j, depth:end] for j, u in zip(use, up, strict=True)]) if len(use) else np.arange(n)
                new = np.zeros(n, bool)
                new[read] = True
                own = np.flatnonzero(new & ~seen)
                seen[own] = True
                at = np.concatenate([at, own])
                score = np.concatenate([score, (whole[own] @ weight).astype(np.int64)])
                keep = _best(-score, ids[at], k)
                at, score = at[keep], score[keep]
                depth, step = end, 2 * step
                if not len(use) or depth == n:
                    break
                edge = np.where(up, x[lists[use, n - depth], use], x[lists[use, depth - 1], use])
                if len(score) == k and float(edge @ v[use]) < score[-1]:
                    break
            return at, score

        return search

    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), whole.alias("vector"), is_query.alias("asks"))
    return in_blocks(rows, index, k, "long", False, rows_per_block)
