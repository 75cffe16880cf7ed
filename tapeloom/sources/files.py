"""Files written from ordered rows.

One output file is one sequential stream by nature. Its rows are brought together and
sorted by Spark, then written as they arrive: a task never holds a file's content.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WRITTEN_DDL = "path string, byte_count bigint"


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a URI or a plain local path."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), path[len("file:"):].replace("///", "/", 1) if path.startswith("file:///") else path[len("file:"):]
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class _Sink:
    """One file at a time, under a temporary name until it is complete."""

    def __init__(self):
        self.path = self.out = None

    def start(self, path: str):
        self.path, self.size = path, 0
        self.files, self.inner = open_path(path)
        self.files.create_dir(os.path.dirname(self.inner), recursive=True)
        self.temporary = f"{self.inner}.{os.urandom(6).hex()}.tmp"
        self.out = self.files.open_output_stream(self.temporary)

    def add(self, data: bytes):
        self.out.write(data)
        self.size += len(data)

    def finish(self):
        if self.out is None:
            return []
        self.out.close()
        self.files.move(self.temporary, self.inner)
        self.out = None
        return [{"path": self.path, "byte_count": self.size}]


def _write(batches):
    schema = pa.schema([("path", pa.string()), ("byte_count", pa.int64())])
    sink = _Sink()
    for batch in batches:
        done = []
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if path != sink.path:
                done += sink.finish()
                sink.start(path)
            sink.add(data.as_buffer())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
    last = sink.finish()
    if last:
        yield pa.RecordBatch.from_pylist(last, schema=schema)


def write_files(rows: DataFrame) -> DataFrame:
    """Write ``(path, part, data BINARY)`` rows, in ``part`` order, to the files they name.

    Runs at once; returns one row per file. A repeated task writes under a new temporary
    name and replaces the file.
    """
    done = (
        rows.select("path", "part", "data")
        # by a hash of the key: Spark drops an exchange by the key itself below a join on it, and
        # adaptive reads may then split a key
        .repartition(F.xxhash64("path"))
        .sortWithinPartitions("path", "part")
        .select("path", "data")
        .mapInArrow(_write, WRITTEN_DDL)
    )
    from tapeloom.plans.stage import written

    return written(done, "files")
