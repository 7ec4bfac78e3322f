"""A flat vector index in one binary file, as a Spark data source that reads and writes it by ranges of bytes.

The layout is that of the public flat-index files: a mark of four letters, the dimension, the number of vectors, two unused
numbers, a flag and the metric, the number of floats, then the floats of all vectors in order. As every vector has the same
width, the byte at which a row begins follows from its number: tasks read ranges of rows, and write theirs at their own place.

A write goes to a file of its own name that gets its full size first; each task reports how many rows it wrote where, and the
commit moves the file into place only if every row was written once. The folder must be one that all machines mount.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Fixed values of the layout: marks by metric, and the numbers of the metrics.
MARKS = {"inner_product": b"IxFI", "l2": b"IxF2"}
METRICS = {"inner_product": 0, "l2": 1}

_HEAD = struct.Struct("<4siqqqBi")
_FLOATS = struct.Struct("<Q")
_UNUSED = 1 << 20

#: Where the first vector begins.
START = _HEAD.size + _FLOATS.size


def local_path(path: str) -> str:
    """The mounted place of a path; other schemes are refused, as tasks open the file themselves."""
    where = urlparse(path)
    if where.scheme not in ("", "file"):
        raise ValueError(f"{path}: a flat index must lie in a folder that all machines mount")
    return where.path


@dataclass(frozen=True)
class FlatHead:
    dim: int
    count: int
    metric: str

    def packed(self) -> bytes:
        return _HEAD.pack(MARKS[self.metric], self.dim, self.count, _UNUSED, _UNUSED, 1, METRICS[self.metric]) + _FLOATS.pack(self.dim * self.count)


def head_of(path: str) -> FlatHead:
    """The facts of a file; one of another kind, and one that is shorter or longer than they say, are refused."""
    place = local_path(path)
    with open(place, "rb") as f:
        raw = f.read(START)
    if len(raw) < START:
        raise ValueError(f"{path}: too short for a flat index")
    mark, dim, count, _, _, trained, metric = _HEAD.unpack(raw[: _HEAD.size])
    name = next((m for m, x in MARKS.items() if x == mark), None)
    if name is None or METRICS[name] != metric or not trained or dim <= 0 or count < 0 or _FLOATS.unpack(raw[_HEAD.size :])[0] != dim * count:
        raise ValueError(f"{path}: not a flat index")
    size, want = os.path.getsize(place), START + 4 * dim * count
    if size != want:
        raise ValueError(f"{path}: {size} bytes, and its facts say {want}")
    return FlatHead(dim, count, name)


@dataclass
class _Rows(InputPartition):
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows, self.head = path, rows, head_of(path)

    def partitions(self) -> list[InputPartition]:
        return [_Rows(i, min(i + self.rows, self.head.count)) for i in range(0, self.head.count, self.rows)] or [_Rows(0, 0)]

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        dim = self.head.dim
        with open(local_path(self.path), "rb") as f:
            f.seek(START + 4 * dim * part.first)
            for at in range(part.first, part.last, 4096):
                n = min(4096, part.last - at)
                raw = f.read(4 * dim * n)
                if len(raw) != 4 * dim * n:
                    raise ValueError(f"{self.path}: rows {at} to {at + n} are cut short")
                values = pa.array(np.frombuffer(raw, dtype="<f4"))
                ends = pa.array(np.arange(0, dim * n + 1, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n, dtype=np.int64)), pa.ListArray.from_arrays(ends, values)], names=["row", "embedding"])


@dataclass
class _Written(WriterCommitMessage):
    rows: int
    total: int  # of row numbers: with the count, it tells repeated rows from all rows


class _Writer(DataSourceWriter):
    def __init__(self, path: str, head: FlatHead, overwrite: bool):
        place = local_path(path)
        if os.path.exists(place) and not overwrite:
            raise FileExistsError(f"{path} exists already")
        self.place, self.head, self.own = place, head, f"{place}.{uuid.uuid4().hex}.part"
        os.makedirs(os.path.dirname(place) or ".", exist_ok=True)
        with open(self.own, "wb") as f:
            f.write(head.packed())
            f.truncate(START + 4 * head.dim * head.count)

    def write(self, iterator) -> WriterCommitMessage:
        dim, rows, total = self.head.dim, 0, 0
        with open(self.own, "r+b") as f:
            for x in iterator:
                if len(x["embedding"]) != dim or not 0 <= x["row"] < self.head.count:
                    raise ValueError(f"row {x['row']} has {len(x['embedding'])} numbers; {dim} are expected, and rows below {self.head.count}")
                f.seek(START + 4 * dim * x["row"])
                f.write(np.asarray(x["embedding"], dtype="<f4").tobytes())
                rows, total = rows + 1, total + x["row"]
            f.flush()
            os.fsync(f.fileno())
        return _Written(rows, total)

    def commit(self, messages) -> None:
        done, n = [m for m in messages if m is not None], self.head.count
        if sum(m.rows for m in done) != n or sum(m.total for m in done) != n * (n - 1) // 2:
            self.abort(messages)
            raise ValueError(f"{sum(m.rows for m in done)} rows were written, and {n} different ones are expected")
        os.replace(self.own, self.place)

    def abort(self, messages) -> None:
        if os.path.exists(self.own):
            os.remove(self.own)


class FlatVectors(DataSource):
    """``flat_vectors``: rows ``(row long, embedding array<float>)`` of one file. Options: ``rows`` of a reading task; ``dim``,
    ``count`` and ``metric`` of a file to be written."""

    @classmethod
    def name(cls) -> str:
        return "flat_vectors"

    def schema(self) -> str:
        return "row long, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("rows", 100_000)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        head = FlatHead(int(self.options["dim"]), int(self.options["count"]), self.options.get("metric", "inner_product"))
        return _Writer(self.options["path"], head, overwrite)


def save_flat_index(vectors: DataFrame, path: str, row: str = "row", embedding: str = "embedding", metric: str = "inner_product", overwrite: bool = False) -> FlatHead:
    """SRC-37: write numbered vectors into one file. ``row`` numbers them from 0 without gaps; vectors of different lengths,
    null ones, and numbers that repeat or are missing fail the write, and an existing file stays unless told otherwise."""
    spark = vectors.sparkSession
    facts = vectors.agg(F.count("*").alias("n"), F.min(F.size(embedding)).alias("least"), F.max(F.size(embedding)).alias("most"), F.count(embedding).alias("known"), F.max(row).alias("last")).first()
    if facts["n"] and (facts["known"] < facts["n"] or facts["least"] != facts["most"]):
        raise ValueError("vectors must be there and have one length")
    if facts["n"] and facts["last"] != facts["n"] - 1:
        raise ValueError("rows must be numbered from 0 without gaps")
    spark.dataSource.register(FlatVectors)
    head = FlatHead(facts["most"] or 1, facts["n"], metric)
    rows = vectors.select(F.col(row).cast("long").alias("row"), F.col(embedding).cast("array<float>").alias("embedding"))
    rows.write.format("flat_vectors").mode("overwrite" if overwrite else "append").options(dim=head.dim, count=head.count, metric=metric).save(path)
    return head


def load_flat_index(spark: SparkSession, path: str, rows: int = 100_000) -> DataFrame:
    """SRC-38: the numbered vectors of a file, ``rows`` of them to a task."""
    spark.dataSource.register(FlatVectors)
    head_of(path)
    return spark.read.format("flat_vectors").option("rows", rows).load(path)
