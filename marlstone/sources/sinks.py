"""Sinks: create-only writes, manifests last, upserts, retention."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sets
from . import readers


def parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), order_by: tuple[str, ...] = (), rows_per_file: int = 0) -> None:
    """Create-only zstd Parquet, sorted within files; an existing path is an error."""
    out = df.sortWithinPartitions(*order_by) if order_by else df
    w = out.write.mode("errorifexists").option("compression", "zstd")
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    """CSV with a header: nested columns as JSON, nulls as empty strings."""
    nested = [c for c, kind in df.dtypes if kind.startswith(("struct", "array", "map"))]
    df.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns)).write.mode("errorifexists").options(header=True, nullValue="", emptyValue="").csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def append(df: DataFrame, path: str) -> None:
    """One more part of a run ledger."""
    df.write.mode("append").parquet(path)


def checkpointed(df: DataFrame, path: str, part: str, only: list | None = None) -> None:
    """Write ``df`` in one folder for each value of ``part``, leaving those that are finished alone.

    A folder counts as finished once its success marker stands, so a run that broke off is taken up where it ended.
    The values of ``part`` are few, as each is a folder; ``only`` names some of them.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    todo = only if only is not None else [r[0] for r in df.select(part).distinct().orderBy(part).collect()]
    for value in todo:
        folder = f"{path}/{part}={value}"
        marker = hadoop.Path(f"{folder}/_SUCCESS")
        if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
            df.where(F.col(part) == value).drop(part).write.mode("overwrite").parquet(folder)


def manifest(df: DataFrame, keys: list[str], columns: list[str], sources: list[str], metadata: dict[str, str]) -> dict:
    """Content-addressed description of a table: its fingerprints by key, and an id over their canonical JSON."""
    parts = [r.asDict() for r in sets.fingerprint(df, keys, columns).orderBy(*keys).collect()]  # one row for each key
    body = {"parts": parts, "sources": sorted(sources), "metadata": metadata}
    text = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=True, default=str)
    return body | {"release_id": hashlib.sha256(text.encode()).hexdigest()}


def published(df: DataFrame, path: str, keys: list[str], columns: list[str], sources: list[str], metadata: dict[str, str]) -> dict:
    """Data first, its manifest last, as a one-row table beside it: without the manifest there's no release."""
    parquet(df, f"{path}/data")
    spark = df.sparkSession
    m = manifest(spark.read.parquet(f"{path}/data"), keys, columns, sources, metadata)
    spark.createDataFrame([(m["release_id"], json.dumps(m, default=str))], "release_id string, body string").write.mode("errorifexists").json(f"{path}/manifest")
    return m


def verified(spark: SparkSession, path: str, keys: list[str], columns: list[str]) -> DataFrame:
    """A published table, after its fingerprints have been held against the manifest."""
    body = json.loads(spark.read.schema("release_id string, body string").json(f"{path}/manifest").first()["body"])
    df = spark.read.parquet(f"{path}/data")
    again = manifest(df, keys, columns, body["sources"], body["metadata"])
    if again["release_id"] != body["release_id"]:
        raise readers.SourceError(f"{path}: the data differ from the manifest")
    return df


def merged_intervals(intervals: list[DataFrame], at: str) -> DataFrame:
    """Interval tables in order, as one; an interval that begins before the last one ended is an error."""
    last, out = None, None
    for df in intervals:
        first, end = df.agg(F.min(at), F.max(at)).first()
        if last is not None and first is not None and first <= last:
            raise readers.SourceError(f"intervals overlap at {first}")
        last = end if end is not None else last
        out = df if out is None else out.unionByName(df)
    return out


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: str, version: int) -> DataFrame:
    """Version ``version`` of a table: the one before with new rows won over old ones; versions are create-only."""
    old = spark.read.parquet(f"{path}/version={version - 1}") if version else None
    out = sets.upserted(old, new, keys, order) if old is not None else sets.upserted(new.limit(0), new, keys, order)
    parquet(out, f"{path}/version={version}")
    return spark.read.parquet(f"{path}/version={version}")


def retained(df: DataFrame, keys: list[str], at: str, oldest: int, most_rows: int) -> DataFrame:
    """Rows not older than ``oldest``, of each key at most the newest ``most_rows``."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at)))
    return df.where(F.col(at) >= oldest).withColumn("_n", n).where(F.col("_n") <= most_rows).drop("_n")
