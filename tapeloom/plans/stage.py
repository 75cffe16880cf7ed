"""Written tables between the steps of a long job.

A table in the shared folder survives the loss of executors, is read column by column
by everything that follows, and has a known size for Spark's broadcast decision.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from tapeloom.session import fresh_folder


# Shuffle files of a finished write are of no more use; by default they stay until the driver collects garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# The JVM compiles no method of more than 8,000 bytes: wide projections run interpreted unless Spark splits them.
COMPILED = {"spark.sql.codegen.hugeMethodLimit": "8000"}
# Rows that a task hands to its Python worker at once; executor and worker both hold them.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def settings(spark: SparkSession, asked: dict[str, str]) -> Iterator[None]:
    """The session with ``asked`` set; what it had before is put back."""
    given = {name: spark.conf.get(name, None) for name in asked}
    for name, value in asked.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in given.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def written(df: DataFrame, stem: str, batch: int | None = None, asked: dict[str, str] | None = None) -> DataFrame:
    """Run ``df`` once into the shared folder and read it back; its shuffle files go when it is done.

    ``batch`` is for tables whose rows are whole texts: as many of them go to Python at once. ``asked`` are further settings of the run.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, stem)
    with settings(spark, {CLEANED: "true"} | ({BATCH: str(batch)} if batch else {}) | (asked or {})):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_below = path
    return found


def dropped(table: DataFrame) -> None:
    """Remove a ``written`` table that nothing reads any more, for steps whose tables together would fill the shared folder."""
    spark, path = table.sparkSession, getattr(table, "written_below", None)
    if path is not None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def until_stopped(spark: SparkSession, work: Callable[[], DataFrame], stop: Callable[[], bool], every_s: float = 0.5) -> DataFrame | None:
    """What ``work`` returns, or None if ``stop`` asked for its end first; its running jobs are then cancelled.

    A table that was being written is not committed, so nothing half-done can be read.
    """
    tag, found = f"stoppable-{uuid.uuid4()}", {}
    context = spark.sparkContext

    def go():
        context.addJobTag(tag)
        context.setInterruptOnCancel(True)
        try:
            found["out"] = work()
        except BaseException as error:  # handed to the caller's thread
            found["error"] = error
        finally:
            context.removeJobTag(tag)

    thread = InheritableThread(target=go)
    thread.start()
    asked = False
    while thread.is_alive():
        thread.join(every_s)
        if thread.is_alive() and (asked or stop()):
            asked = True
            context.cancelJobsWithTag(tag)
    if "error" in found and not asked:
        raise found["error"]
    return found.get("out")
