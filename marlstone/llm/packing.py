"""Optimal length buckets and token-budget batches.

Lengths up to the token budget have at most that many values, so their histogram is bounded by a parameter. Dynamic
programming over the whole histogram chooses the bucket bounds with the least padding. Batches fill up inside each
bucket: rows are numbered within blocks of about sqrt(rows) rows, and the counts of the blocks before are added, so no
task holds a bucket.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import written

WORDS = r"[^\x20\x09-\x0D]+"
#: Tokens of a batch, padding included; a longer document is a batch of its own.
TOKEN_BUDGET = 8192
BUCKETS = 8


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of ``buckets`` length classes (fewer lengths: one each) with the least padding; ties: lower bounds first."""
    order = np.argsort(lengths)
    size, number = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    n = len(size)
    rows, total = np.cumsum(np.concatenate([[0], number])), np.cumsum(np.concatenate([[0], number * size]))
    cost = size * rows[1:] - total[1:]  # of one class up to each length
    back = []
    for _ in range(min(buckets, n) - 1):
        best, arg = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        for j in range(len(back) + 1, n):
            k = np.arange(len(back), j)
            c = cost[k] + size[j] * (rows[j + 1] - rows[k + 1]) - (total[j + 1] - total[k + 1])
            i = int(np.argmin(c))
            best[j], arg[j] = c[i], k[i]
        back.append(arg)
        cost = best
    out, j = [], n - 1
    for arg in reversed(back):
        out.append(int(size[j]))
        j = int(arg[j])
    return [*([int(size[j])] if n else []), *reversed(out)]


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = TOKEN_BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """Each row's place: id_col, n_tokens, bucket, bucket_tokens (its padded length), batch, place (from 0).

    A token is a word without ASCII white space. A batch of bucket b has budget div bucket_tokens rows, the last one of
    a bucket may have fewer; padded, it has at most ``budget`` tokens. A document over the budget has bucket -1, its
    own length as bucket_tokens and a batch of its own. Blank and null texts have 0 tokens and are packed as well;
    rows of one id each have a place; an empty table gives an empty one; other columns are left out.
    """
    lens = written(docs.select(F.col(id_col).alias("id"), F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).alias("n")), "lengths")
    seen = lens.groupBy(F.when(F.col("n") <= budget, F.col("n")).alias("n")).count().collect()  # bounded by the budget
    fits = [(r["n"], r["count"]) for r in seen if r["n"] is not None]
    blocks = max(1, math.ceil(math.sqrt(sum(r["count"] for r in seen))))
    bounds = best_bounds(np.array([n for n, _ in fits]), np.array([c for _, c in fits]), buckets) if fits else []
    bucket = F.lit(-1)
    for i in reversed(range(len(bounds))):
        bucket = F.when(F.col("n") <= bounds[i], i).otherwise(bucket)
    bound = F.when(F.col("bucket") < 0, F.col("n"))
    for i, b in enumerate(bounds):
        bound = bound.when(F.col("bucket") == i, b)
    block = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % blocks
    rows = lens.withColumn("bucket", bucket).withColumn("size", bound).withColumn("block", block)
    counts = rows.groupBy("bucket", "block").count()
    before = F.sum("count").over(Window.partitionBy("bucket").orderBy("block")) - F.col("count")
    at = rows.withColumn("row", F.row_number().over(Window.partitionBy("bucket", "block").orderBy("id", "n")))
    place = F.col("row") - 1 + F.col("before")
    placed = at.join(counts.withColumn("before", before).drop("count"), ["bucket", "block"])
    room = F.when(F.col("bucket") < 0, 1).otherwise(F.floor(F.lit(budget) / F.greatest("size", F.lit(1)))).cast("long")
    out = placed.select("id", F.col("n").cast("long").alias("n_tokens"), F.col("bucket").cast("long").alias("bucket"), F.col("size").cast("long").alias("bucket_tokens"), F.floor(place / room).cast("long").alias("batch"), (place % room).cast("long").alias("place"))
    return out.withColumnRenamed("id", id_col)


def oracle(budget: int = TOKEN_BUDGET, buckets: int = BUCKETS) -> str:
    """The same in DuckDB SQL, for texts without repeated ids."""
    layers = [f"""s0 AS MATERIALIZED (SELECT j, size * rows - total AS cost, [size] AS bounds FROM h)"""]
    for k in range(1, buckets):
        layers.append(
            f"""m{k} AS MATERIALIZED (SELECT b.j, min((p.cost + b.size * (b.rows - a.rows) - (b.total - a.total))::HUGEINT * 100000 + a.j) AS c
  FROM h b JOIN h a ON a.j < b.j JOIN s{k - 1} p ON p.j = a.j GROUP BY b.j),
s{k} AS MATERIALIZED (SELECT m.j, (m.c // 100000)::BIGINT AS cost, list_append(p.bounds, b.size) AS bounds FROM m{k} m
  JOIN s{k - 1} p ON p.j = m.c % 100000 JOIN h b ON b.j = m.j)"""
        )
    last = " UNION ALL ".join(f"SELECT {k} AS k, bounds FROM s{k} WHERE j = (SELECT max(j) FROM h)" for k in range(buckets))
    return f"""WITH lens AS MATERIALIZED (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n FROM documents),
g AS (SELECT n AS size, count(*) AS c FROM lens WHERE n <= {budget} GROUP BY n),
h AS MATERIALIZED (SELECT size, row_number() OVER (ORDER BY size) AS j, (sum(c) OVER (ORDER BY size))::BIGINT AS rows, (sum(c * size) OVER (ORDER BY size))::BIGINT AS total FROM g),
{', '.join(layers)},
chosen AS MATERIALIZED (SELECT bounds FROM ({last}) ORDER BY k DESC LIMIT 1),
b AS (SELECT unnest(bounds) AS size, generate_subscripts(bounds, 1) - 1 AS bucket FROM chosen),
r AS (SELECT l.doc_id, l.n, coalesce((SELECT min(bucket) FROM b WHERE b.size >= l.n), -1) AS bucket FROM lens l),
z AS (SELECT r.*, CASE WHEN r.bucket < 0 THEN r.n ELSE b.size END AS size,
  ('0x' || substr(md5(r.doc_id::VARCHAR), 1, 8))::BIGINT % (SELECT ceil(sqrt(count(*)))::BIGINT FROM lens) AS block FROM r LEFT JOIN b USING (bucket)),
q AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY block, doc_id) - 1 AS p,
  CASE WHEN bucket < 0 THEN 1 ELSE {budget} // greatest(size, 1) END AS room FROM z)
SELECT doc_id, n AS n_tokens, bucket::BIGINT AS bucket, size::BIGINT AS bucket_tokens, (p // room)::BIGINT AS batch, (p % room)::BIGINT AS place FROM q"""
