"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's ``spark.checkpoint.dir``.

    A folder of its own is made only where that setting is missing and driver and executors are one process, as in
    tests; on a cluster no executor would see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = _local_root()
    return root.rstrip("/")


@lru_cache(1)
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="marlstone-")


def written(df: DataFrame, name: str, most_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it again.

    This cuts the lineage like checkpoint(), but computes ``df`` only once. Where a bound on its rows is known, a small
    table is written by few tasks.
    """
    spark = df.sparkSession
    if most_rows is not None:
        df = df.coalesce(max(1, most_rows // 20_000))
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once all that was read from them has been written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Shuffle partitions for ``rows`` rows: at least the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


#: Narrow rows that may be broadcast; more are joined by shuffles.
BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if its ``rows``, as counted, are few enough; else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return off - off[0], body


def sliced(batches: Iterator[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``most`` bytes of ``text``, or one row."""
    at = None
    for batch in batches:
        at = batch.schema.get_field_index(text) if at is None else at
        off, _ = utf8(batch.column(at))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(off, off[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the graph with edges a-b: each node that isn't its component's least, and that least node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, root), root the least node; nodes that are roots included.

    Alternates large-star and small-star rounds as DataFrame joins; each round is written to the shared scratch
    folder, so that a lost executor costs one round. Links are aggregated per node before any join, so a node with
    very many links is summed up on the map side. Null ends are left out. An empty table gives an empty table.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["a"]

    def files(links: int) -> int:
        return max(1, links // 100_000)

    def told(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def starred(e: DataFrame, large: bool, links: int) -> tuple[DataFrame, DataFrame]:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:  # only towards smaller neighbours
            both = both.where("b < a")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = written(least.coalesce(files(links)), "least")  # on its own, so that a node with very many links can be split
        joined = both.join(bounded(least, least.count()), "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b"), least

    def kept(e: DataFrame, links: int) -> DataFrame:
        """Written in few files where there are few links, so that small graphs run as few tasks."""
        return written(e.distinct().coalesce(files(links)), "edges")

    now = written(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "links")
    was = told(now)
    for _ in range(most_rounds):
        if not was[0]:
            break
        half, large = starred(now, True, was[0])
        both, small = starred(half, False, was[0])
        after = kept(both, was[0])
        found = told(after)
        dropped(now, large, small)
        now = after
        if found == was:
            break
        was = found
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    member = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return member.union(member.select(F.col("root").alias("node"), "root")).distinct().select(F.col("node").cast(kind), F.col("root").cast(kind))
