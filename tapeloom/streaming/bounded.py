"""A stream over input that is complete, run to its end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeloom.plans.stage import BATCH, settings
from tapeloom.session import fresh_folder

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table, one file or a folder, as a stream of its files."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern, as a lone file is no root


def drained(stream: DataFrame, stem: str, place: tuple[str, str] | None = None, batch: int | None = None) -> DataFrame:
    """All rows of ``stream``, written below the shared folder; the session's state store is put back after.

    ``place`` names the folders of rows and progress; a second call with them goes on where the first one ended.
    ``batch`` is for rows that hold samples: as many of them go to Python at once.
    """
    spark = stream.sparkSession
    out, mark = place or (fresh_folder(spark, stem), fresh_folder(spark, f"{stem}-progress"))
    _run(stream.writeStream.format("parquet").option("path", out), spark, mark, batch)
    return spark.read.schema(stream.schema).parquet(out)


def drained_into(stream: DataFrame, sink: Callable[[DataFrame, int], None], mark: str) -> None:
    """The same into a foreachBatch sink, with progress in the folder ``mark``."""
    _run(stream.writeStream.foreachBatch(sink), stream.sparkSession, mark)


def _run(writer, spark: SparkSession, mark: str, batch: int | None = None) -> None:
    with settings(spark, {_PROVIDER: ROCKS_DB} | ({BATCH: str(batch)} if batch else {})):
        writer.option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
