"""Log files that another process appends to, as a stream of lines.

Spark's file stream takes a file once and never looks at it again. This source remembers how many
bytes of each file were taken, so a log that grows in place brings only its new lines. A range of
bytes owns the lines whose *end* lies in it: a line that was half written when a batch was planned
belongs whole to the batch that sees its end, and ranges can be cut anywhere, so a long log is read
by many tasks and each line once, also after a restart from a checkpoint.

The driver lists files and sizes; bytes are read by the tasks. An offset holds one number per file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tapeloom.functions.ids import is_uuid
from tapeloom.schemas import struct_type
from tapeloom.sources.event_log import owner_of, parse_log_lines
from tapeloom.sources.files import open_path

#: ``at_byte``: where the line starts in its file.
LINES_DDL = "path string, at_byte bigint, value string"
#: Bytes of a file that one task takes, and that it looks back over at once for the start of a line.
RANGE_BYTES, LOOK_BACK = 16 << 20, 64 << 10
#: What opening a file counts as, in bytes, when a task is given its ranges.
OPEN_BYTES = 64 << 10
#: Lines of one Arrow batch.
LINES = 4_096


@dataclass
class _Ranges(InputPartition):
    """(path, start, end) of what one task reads: many short logs, or a part of a long one."""

    ranges: list[tuple[str, int, int]]


def line_start(source, at: int) -> int:
    """Where the line that byte ``at`` belongs to starts."""
    while at > 0:
        low = max(0, at - LOOK_BACK)
        source.seek(low)
        found = source.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def lines_ended_in(source, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(start, content) of each line whose newline is one of the bytes ``start`` to ``end``, end excluded."""
    at = line_start(source, start)
    source.seek(at)
    held, position = b"", at
    while position < end:
        data = source.read(min(RANGE_BYTES, end - position))
        if not data:
            return
        position += len(data)
        *whole, held = (held + data).split(b"\n")
        for line in whole:
            yield at, line
            at += len(line) + 1


class _Reader(DataSourceStreamReader):
    def __init__(self, root: str, name: str):
        self.root, self.name, self.sizes = root, name, {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        store, inner = open_path(self.root)
        found = store.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
        for info in found:
            if info.type == fs.FileType.File and info.base_name == self.name:
                # a log only grows; one that was cut would repeat lines, so its taken bytes stay taken
                self.sizes[info.path] = max(info.size, self.sizes.get(info.path, 0))
        return {"files": dict(sorted(self.sizes.items()))}

    def partitions(self, start: dict, end: dict) -> list[_Ranges]:
        tasks, room = [], 0
        for path, size in end["files"].items():
            at = start["files"].get(path, 0)
            while at < size:
                to = min(size, (at // RANGE_BYTES + 1) * RANGE_BYTES)
                cost = to - at + OPEN_BYTES
                if not tasks or cost > room:
                    tasks.append(_Ranges([]))
                    room = RANGE_BYTES + OPEN_BYTES
                tasks[-1].ranges.append((path, at, to))
                room -= cost
                at = to
        return tasks

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = open_path(self.root)
        schema = pa.schema([("path", pa.string()), ("at_byte", pa.int64()), ("value", pa.string())])
        held, size = [], 0
        for path, start, end in partition.ranges:
            with store.open_input_file(path) as source:
                for at, line in lines_ended_in(source, start, end):
                    held.append((path, at, line.decode(errors="replace")))
                    size += len(line)
                    if len(held) == LINES or size >= RANGE_BYTES:
                        yield _batch(held, schema)
                        held, size = [], 0
        if held:
            yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class GrowingLines(DataSource):
    """``spark.readStream.format("growing_lines").option("path", root).option("name", file_name)``."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self):
        return struct_type(LINES_DDL)

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options["name"])


def growing_lines(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Lines of all files called ``name`` below ``root``, as they are appended."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("path", root).option("name", name).load()


def growing_event_logs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of the recording folders below ``root``, as streams; both have ``at_byte``.

    Each needs a query, and a checkpoint, of its own. Folders not named by a UUID are ignored.
    """
    lines = growing_lines(spark, f"{root.rstrip('/')}/recordings", "events.ndjson")
    owned = lines.select(owner_of(F.col("path")).alias("owner"), "value", "at_byte").filter(is_uuid("owner"))
    return parse_log_lines(owned, uuids=True)
