import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import vectors

ROW = "vec_id long, embedding array<float>"


def made(spark, n=400, d=16, seed=0, extra=()):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    x = (centres[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, d))).astype(np.float32)
    x[50:80] = x[50]  # one common vector
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame([*rows, *extra], ROW), x.astype(float)


def test_chi_square_quantile():
    assert vectors.chi_square_quantile(0.95, 2) == pytest.approx(5.991464547)
    assert vectors.chi_square_quantile(0.95, 8) == pytest.approx(15.50731306)


BAD = ((1000, None), (1001, []), (1002, [None] * 16), (1003, [float("nan")] * 16), (1004, [float("inf")] + [0.0] * 15), (1005, [0.0] * 16), (1006, [1.0, 2.0]), (None, [1.0] * 16))


@pytest.mark.parametrize("per_block", [50_000, 30])
def test_neighbours_recall_and_ties(spark, per_block):
    df, x = made(spark, extra=BAD)
    got = vectors.nearest(df, F.col("vec_id") % 20 == 0, rows_per_block=per_block).toPandas()
    hits = total = 0
    for q in range(0, 400, 20):
        dist = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        dist[q] = np.inf
        want = np.lexsort((np.arange(400), dist))[:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert np.allclose(own["score"], dist[own["vec_id"]])
        hits += len(set(own["vec_id"]) & set(want.tolist()))
        total += 10
        if q == 60:
            assert own["vec_id"].tolist() == [i for i in range(50, 61) if i != 60]
    assert hits / total >= 0.95
    assert not set(got["query_id"]) & {1000, 1001, 1002, 1003, 1004, 1005}


@pytest.mark.parametrize("per_block", [50_000, 30])
def test_top_products_are_exact(spark, per_block):
    df, x = made(spark, extra=BAD)
    whole = np.vstack([np.floor(256 * x).astype(np.int64), np.zeros((1, 16), np.int64)])
    ids = np.array([*range(400), 1005])
    got = vectors.top_products(df, F.col("vec_id") % 10 == 0, rows_per_block=per_block).toPandas()
    for q in (i for i in range(401) if ids[i] % 10 == 0):
        s = whole @ whole[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:5]
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert own["vec_id"].tolist() == ids[order].tolist()
        assert own["score"].tolist() == s[order].tolist()


def test_few_rows(spark):
    none = spark.createDataFrame([], ROW)
    assert vectors.nearest(none, F.col("vec_id") % 2 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0])], ROW).selectExpr("*", "1 AS id", "2 AS vector", "3 AS block")
    assert [tuple(r) for r in vectors.top_products(few, F.col("vec_id") % 2 == 0).collect()] == [(0, 1, 1, 0)]
    assert [r["vec_id"] for r in vectors.nearest(few, F.col("vec_id") % 2 == 0).collect()] == [1]


def test_rows_of_one_id_are_candidates_of_each_other(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (2, [0.0, 1.0])], ROW)
    got = sorted(tuple(r) for r in vectors.nearest(rows, F.col("vec_id") == 0).collect())
    assert got == [(0, 1, 0, 0.0)] * 2 + [(0, 2, 2, 2**0.5)] * 2
    assert sorted(tuple(r) for r in vectors.top_products(rows, F.col("vec_id") == 0).collect()) == [(0, 1, 0, 256 * 256)] * 2 + [(0, 2, 2, 0)] * 2


def test_neighbours_recall_on_the_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(i, np.array(v, float)) for i, v in ((r["vec_id"], r["embedding"]) for r in table.collect()) if v]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got = vectors.nearest(table, F.col("vec_id") % 20 == 0).toPandas().groupby("query_id")["vec_id"].apply(set)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        dist = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        dist[q] = np.inf
        want = set(ids[np.lexsort((ids, dist))[:10]].tolist())
        hits, total = hits + len(want & got[ids[q]]), total + 10
    assert total >= 200 and hits / total >= 0.9
