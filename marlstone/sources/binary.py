"""Fixed-width binary records in whole files, zstandard-compressed or not, decoded in columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import SourceError

_KINDS = {"i1": "byte", "i2": "short", "i4": "int", "i8": "long", "u1": "short", "u2": "int", "u4": "long", "f4": "float", "f8": "double"}


def records(spark: SparkSession, path: str, fields: dict[str, str], ordered_by: str | None = None, header: bytes = b"", rows: int = 65_536) -> DataFrame:
    """Records of all files under ``path``: file hash, ordinal in the file, and the little-endian fields.

    ``fields`` maps names to NumPy kinds (i8, u4, ...); u8 isn't among them, as no column holds it. A file must begin
    with ``header``, hold whole records and, if asked for, not fall in ``ordered_by``. Each file is one task's work,
    given on in batches of ``rows``.
    """
    kind = np.dtype([(n, "<" + k) for n, k in fields.items()])
    schema = "file_sha256 string, ordinal long, " + ", ".join(f"`{n}` {_KINDS[k]}" for n, k in fields.items())

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import zstandard

        for pdf in parts:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                digest = hashlib.sha256(content).hexdigest()
                body = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content)) if content[:4] == b"\x28\xb5\x2f\xfd" else io.BytesIO(content)
                if body.read(len(header)) != header:
                    raise SourceError(f"{name}: another header")
                at, last = 0, None
                while chunk := body.read(rows * kind.itemsize):
                    while len(chunk) % kind.itemsize and (more := body.read(kind.itemsize - len(chunk) % kind.itemsize)):
                        chunk += more
                    if len(chunk) % kind.itemsize:
                        raise SourceError(f"{name}: a record is cut off")
                    got = np.frombuffer(chunk, kind)
                    if ordered_by:
                        key = got[ordered_by]
                        if (key[1:] < key[:-1]).any() or last is not None and key[0] < last:
                            raise SourceError(f"{name}: {ordered_by} falls")
                        last = key[-1]
                    out = pd.DataFrame({n: got[n] for n in fields})
                    out.insert(0, "ordinal", np.arange(at, at + len(got)))
                    out.insert(0, "file_sha256", digest)
                    at += len(got)
                    yield out

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(work, schema)


def with_row_ids(df: DataFrame) -> DataFrame:
    """``df`` with ``row_sha256``: over the file's hash, the ordinal and the record's own fields."""
    own = F.to_json(F.struct(*[c for c in df.columns if c not in ("file_sha256", "ordinal")]), {"ignoreNullFields": "false"})
    return df.withColumn("row_sha256", F.sha2(F.concat_ws("|", "file_sha256", F.col("ordinal").cast("string"), own), 256))
