"""Sources: scans that check what they read and fail closed."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.clock import floor_div


class SourceError(ValueError):
    """A source isn't what its contract says."""


def exact(spark: SparkSession, path: str, schema: StructType, schema_id: str | None = None) -> DataFrame:
    """Parquet whose schema must be ``schema``: names, types and order, and its id, which the first field's metadata holds."""
    found = spark.read.parquet(path).schema
    if schema_id is not None and (found[0].metadata or {}).get("schema_id") != schema_id:
        raise SourceError(f"{path}: schema id is {(found[0].metadata or {}).get('schema_id')}, not {schema_id}")
    if [(f.name, f.dataType) for f in found] != [(f.name, f.dataType) for f in schema]:
        raise SourceError(f"{path}: schema is {found.simpleString()}, not {schema.simpleString()}")
    return spark.read.schema(schema).parquet(path)


def projected(spark: SparkSession, path: str, columns: list[str], not_empty: bool = True) -> DataFrame:
    """Only the named columns of Parquet files; one that is missing, or no row at all, is an error."""
    df = spark.read.parquet(path)
    if missing := [c for c in columns if c not in df.columns]:
        raise SourceError(f"{path}: no column {', '.join(missing)}")
    out = df.select(*columns)
    if not_empty and out.isEmpty():
        raise SourceError(f"{path}: no rows")
    return out


def without_prices(spark: SparkSession, path: str, forbidden: tuple[str, ...] = ("open", "high", "low", "close", "price", "value", "volume")) -> DataFrame:
    """Identity and time columns alone; columns whose name begins with a forbidden word are never read."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in df.columns if not c.lower().startswith(forbidden)])


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, by a given schema; a line that doesn't fit fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def split_bytes(size: int, least: int = 8_192, most: int = 128 << 20, splits: int = 64) -> int:
    """Bytes of a split that cut files of ``size`` bytes into some ``splits``; their number grows with ``size`` only beyond ``most`` bytes each."""
    return min(most, max(least, -(-size // splits)))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files: file, ``line_number`` from 1 in its file, value; the same for any size of splits.

    A split numbers its own lines as it reads them. How many lines stand before it is the sum of the counts of its
    file's splits before, and only these counts, one a split, are put in order.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        for b in batches:
            ends = np.flatnonzero([*(x != y for x, y in pairwise(zip(*(b.column(i).to_pylist() for i in (0, 1)), strict=True))), True]) + 1
            local, start = np.empty(b.num_rows, np.int64), 0
            for end in ends.tolist() if b.num_rows else []:
                key = (b.column(0)[start].as_py(), b.column(1)[start].as_py())
                if key != now:
                    now, n = key, 0
                local[start:end] = np.arange(n, n + end - start)
                n, start = n + end - start, end
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local)], [*b.schema.names, "local"])

    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.text(path)
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.select(*split).groupBy("file", "start").agg(F.count("*").alias("n")).select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    local = lines.select(*split, "value").mapInArrow(work, "file string, start long, value string, local long")
    return local.join(counts, ["file", "start"]).select("file", (F.col("before") + F.col("local") + 1).alias("line_number"), "value")


def numbered_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parsed lines with file, line_number, line_sha256, state and record.

    A line is BLANK, INVALID (no object of that schema, with a null record), DUPLICATE (its file has the same line
    before) or OK; none is left out.
    """
    lines = numbered_lines(spark, path).withColumn("line_sha256", F.sha2(F.col("value").cast("binary"), 256))
    lines = lines.withColumn("parsed", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    firsts = lines.groupBy("file", "line_sha256").agg(F.min("line_number").alias("line_number")).withColumn("first", F.lit(True))
    met = lines.join(firsts, ["file", "line_sha256", "line_number"], "left")
    bad = F.col("parsed").isNull() | F.col("parsed._corrupt").isNotNull()
    state = F.when(F.trim("value") == "", "BLANK").when(bad, "INVALID").when(F.col("first").isNull(), "DUPLICATE").otherwise("OK")
    return met.select("file", "line_number", "line_sha256", state.alias("state"), F.when(~bad, F.col("parsed").dropFields("_corrupt")).alias("record"))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(header=True, mode="FAILFAST").csv(path)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, length, time and SHA-256 of whole files."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return b.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def time_range(df: DataFrame, at: str, start: int, end: int | None = None) -> DataFrame:
    """Rows of [start, end) in order of time; the range reaches the scan as a filter."""
    kept = df.where(F.col(at) >= start)
    return (kept if end is None else kept.where(F.col(at) < end)).orderBy(at)


def overlapping(df: DataFrame, start_col: str, end_col: str, start: int, end: int) -> DataFrame:
    """Intervals that overlap the half-open range."""
    return df.where((F.col(start_col) < end) & (F.col(end_col) > start))


def nullified(df: DataFrame, sentinels: dict[str, int]) -> DataFrame:
    """Sentinels as nulls, each with a column ``<name>_state`` that says DEFINED or UNDEFINED; unsigned decimals become longs."""
    out = {}
    for name, sentinel in sentinels.items():
        defined = F.col(name) != F.lit(str(sentinel)).cast("decimal(20,0)")
        out[name] = F.when(defined, F.col(name)).cast("long")
        out[f"{name}_state"] = F.when(defined, "DEFINED").otherwise("UNDEFINED")
    return df.withColumns(out)


def audit(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Rows of each key and UTC day: what a raw scan has to account for."""
    return df.groupBy(*keys, floor_div(at, 86_400_000_000_000).alias("day")).agg(F.count("*").alias("n"))


def resolved(catalog: DataFrame, market: str, year: int, purpose: str) -> str:
    """The one path of a market and year that is open to a purpose; anything but one is an error."""
    open_to = catalog.where((F.col("market") == market) & (F.col("year") == year) & F.array_contains("purposes", purpose))
    paths = [r["path"] for r in open_to.select("path").limit(2).collect()]
    if len(paths) != 1:
        raise SourceError(f"{market} {year} for {purpose}: {len(paths) or 'no'} entries")
    return paths[0]
