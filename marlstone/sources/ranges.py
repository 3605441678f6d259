"""Fixed-width binary records read by ranges: a Python data source whose partitions are stretches of records of a file.

Where there are many short ranges, a task reads several, one after the other, so that tasks grow with bytes. A file is a header and whole little-endian records. Each range also reads the record before its first one, so that the
order is checked across seams without any task seeing two ranges. Files are listed by Spark; tasks open them through
Arrow's file systems, which know local paths and those remote ones that Arrow was built for. Compressed files can't be
entered in the middle: ``binary.records`` reads them whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import binary
from .readers import SourceError

NAME = "marlstone_records"
_ROWS = 65_536
#: Ranges share tasks where there are more than so many, and more than the bytes of all need at so many a task.
TASKS, TASK_BYTES = 64, 16 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _kind(fields: dict[str, str]) -> np.dtype:
    return np.dtype([(n, "<" + k) for n, k in fields.items()])


@dataclass
class Range:
    path: str
    first: int
    count: int


@dataclass
class Ranges(InputPartition):
    ranges: list[Range]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.fields, self.files = json.loads(options["fields"]), json.loads(options["files"])
        self.header, self.ordered_by = bytes.fromhex(options.get("header", "")), options.get("ordered_by") or None
        self.rows = int(options["rows"])

    def partitions(self) -> list[Ranges]:
        size = _kind(self.fields).itemsize
        out = []
        for path, length in self.files:
            n, rest = divmod(length - len(self.header), size)
            if n < 0 or rest:
                raise SourceError(f"{path}: {length} bytes aren't a header and whole records")
            out += [Range(path, i, min(self.rows, n - i)) for i in range(0, n, self.rows)] or [Range(path, 0, 0)]
        each = -(-len(out) // max(TASKS, -(-sum(length for _, length in self.files) // TASK_BYTES)))
        return [Ranges(out[i : i + each]) for i in range(0, len(out), max(1, each))]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for part in partition.ranges:
            yield from self._range(part)

    def _range(self, part: Range) -> Iterator[pa.RecordBatch]:
        kind = _kind(self.fields)
        where, path = _opened(part.path)
        with where.open_input_file(path) as f:
            if part.first == 0 and f.read(len(self.header)) != self.header:
                raise SourceError(f"{part.path}: another header")
            at = part.first - (part.first > 0)  # the record before tells whether the order holds across the seam
            f.seek(len(self.header) + at * kind.itemsize)
            last, end = None, part.first + part.count
            while at < end:
                got = np.frombuffer(f.read(min(_ROWS, end - at) * kind.itemsize), kind)
                if not len(got):
                    raise SourceError(f"{part.path}: a record is cut off")
                if self.ordered_by:
                    key = got[self.ordered_by]
                    if (key[1:] < key[:-1]).any() or (last is not None and key[0] < last):
                        raise SourceError(f"{part.path}: {self.ordered_by} falls in records {at} to {at + len(got)}")
                    last = key[-1]
                ordinal = np.arange(at, at + len(got))
                own = ordinal >= part.first
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(kind.itemsize), int(own.sum()), [None, pa.py_buffer(got[own].tobytes())]).cast(pa.binary())
                columns = [pa.array(got[n][own]).cast(_ARROW[k]) for n, k in self.fields.items()]
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * int(own.sum()), pa.string()), pa.array(ordinal[own]), *columns, raw], ["file", "ordinal", *self.fields, "raw"])
                at += len(got)


_ARROW = {"i1": pa.int8(), "i2": pa.int16(), "i4": pa.int32(), "i8": pa.int64(), "u1": pa.int16(), "u2": pa.int32(), "u4": pa.int64(), "f4": pa.float32(), "f8": pa.float64()}


@dataclass
class _Written(WriterCommitMessage):
    made: str
    records: int


class _Writer(DataSourceArrowWriter):
    """A file for each task that has records; files get their names only once all tasks have succeeded."""

    def __init__(self, options: dict[str, str]):
        self.path, self.fields, self.header = options["path"], json.loads(options["fields"]), bytes.fromhex(options.get("header", ""))

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        where, path = _opened(self.path)
        where.create_dir(path)
        made, n = f"{path}/.{uuid.uuid4().hex}", 0
        kind = _kind(self.fields)
        with where.open_output_stream(made) as f:
            f.write(self.header)
            for b in batches:
                out = np.empty(b.num_rows, kind)
                for name in self.fields:
                    out[name] = b.column(name).to_numpy(zero_copy_only=False)
                f.write(out.tobytes())
                n += b.num_rows
        return _Written(made, n)

    def commit(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m is not None:
                where, _ = _opened(self.path)
                folder, name = m.made.rsplit("/.", 1)
                where.move(m.made, f"{folder}/{name}.bin") if m.records else where.delete_file(m.made)

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m is not None:
                _opened(self.path)[0].delete_file(m.made)


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        fields = json.loads(self.options["fields"])
        return "file string, ordinal long, " + ", ".join(f"`{n}` {binary._KINDS[k]}" for n, k in fields.items()) + ", raw binary"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def ranged_records(spark: SparkSession, path: str, fields: dict[str, str], ordered_by: str | None = None, header: bytes = b"", rows: int = 1_000_000) -> DataFrame:
    """Records of all files under ``path``, in ranges of ``rows``, of which a task may read several: file, ordinal in the file, the fields, and the raw bytes.

    A file must begin with ``header``, hold whole records and, if asked for, not fall in ``ordered_by``; else reading
    fails with its name. Null values don't exist in such files; sentinels are the caller's to name.
    """
    spark.dataSource.register(RecordSource)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path", "length").orderBy("path").collect()
    options = {"fields": json.dumps(fields), "files": json.dumps([[r["path"], r["length"]] for r in listed]), "header": header.hex(), "ordered_by": ordered_by or "", "rows": str(rows)}
    return spark.read.format(NAME).options(**options).load()


def write_records(df: DataFrame, path: str, fields: dict[str, str], header: bytes = b"") -> None:
    """Write ``df`` as such files, one for each of its partitions that has rows, in their order; a null is an error."""
    kinds = {n: F.col(n).cast(binary._KINDS[k]) for n, k in fields.items()}
    whole = df.select(*(F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"{n} is null"))).alias(n) for n, c in kinds.items()))
    df.sparkSession.dataSource.register(RecordSource)
    whole.write.format(NAME).mode("append").options(path=path, fields=json.dumps(fields), header=header.hex()).save()


def counters(records: DataFrame, groups: list[str], identity: str, at: str, sentinels: dict[str, int], span: int = 100_000) -> DataFrame:
    """What a decode has to account for, per group: records, bytes, repeated raw records, undefined values, identities, and rolls.

    A roll is a record of another identity than the one before it in its file. Files are cut into blocks of ``span``
    records for that, so the counts come from all parts of a file at once.
    """
    from ..operators import scans

    met = scans.previous(records, ["file"], ["ordinal"], {identity: "_was"}, span)
    undefined: Column = sum((F.col(n) == v).cast("long") for n, v in sentinels.items()) if sentinels else F.lit(0)
    own = met.groupBy(*groups).agg(
        F.count("*").alias("records"), F.sum(F.length("raw")).alias("bytes"), F.sum(undefined).alias("undefined"), F.count_distinct(identity).alias("identities"),
        F.count_if(F.col("_was").isNotNull() & (F.col("_was") != F.col(identity))).alias("rolls"), F.min(at).alias("first"), F.max(at).alias("last"))
    repeats = records.groupBy(*groups, F.sha2("raw", 256).alias("_h")).count().groupBy(*groups).agg(F.sum(F.col("count") - 1).alias("repeated"))
    return own.join(repeats, groups)


def decoded_to_parquet(records: DataFrame, path: str, most_bytes: int, keep: list[str]) -> DataFrame:
    """Write ``keep`` of the records to ``path`` if their raw bytes don't exceed ``most_bytes``, and read them again; too many are an error before anything is written."""
    size = records.agg(F.coalesce(F.sum(F.length("raw")), F.lit(0)).alias("n")).first()["n"]
    if size > most_bytes:
        raise SourceError(f"{size} bytes of records exceed the budget of {most_bytes}")
    records.select(*keep).write.mode("error").parquet(path)
    return records.sparkSession.read.parquet(path)
