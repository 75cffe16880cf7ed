"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of the contracts, as bytes and as a Java / RE2 class.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
WHITE_CLASS = r"[\x20\x09-\x0D]"
#: Rows whose texts a task holds as Python objects at once.
ROWS = 512


def read(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of one given table."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def fold_of(doc_id: Column | str, folds: int) -> Column:
    """Cross-validation fold of a document: crc32 of its id as text; a null id counts as empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def own_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no working column has, and the new name of each."""
    names = [f"given{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def add_columns(
    df: DataFrame, source: str, fields: list[T.StructField], compute: Callable[[pa.Array], list[pa.Array]]
) -> DataFrame:
    """Append columns that ``compute`` derives from the column ``source``, ``ROWS`` rows at a time."""
    place = df.columns.index(source)
    names = [*df.columns, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*batch.columns, *compute(batch.column(place))], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def in_bytes(values: list, size_of: Callable[[object], int], limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs whose sizes add up to ``limit`` or a single value."""
    start = total = 0
    for i, value in enumerate(values):
        size = size_of(value)
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(values):
        yield start, len(values)
