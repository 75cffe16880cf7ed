"""Integer spans to rows without one long array or one long task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN = 4_096


def explode_span(
    df: DataFrame, lo: Column, hi: Column, out: str, keys: Sequence[str], fan: int = FAN
) -> DataFrame:
    """One row per integer of ``lo .. hi`` (inclusive), in runs of at most ``fan``.

    The runs are exchanged by (keys, run) in between, so a very long span is shared by many tasks.
    Their number is given: an adaptive read would put the runs, which are few and small, back
    into one task, and that task would make all the rows.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = F.lit(fan).cast("bigint")
    runs = (
        df.withColumn("__hi", hi.cast("bigint"))
        .withColumn("__run", F.explode(F.sequence(lo.cast("bigint"), F.col("__hi"), step)))
        .repartition(tasks, *keys, "__run")
    )
    each = F.sequence(F.col("__run"), F.least(F.col("__run") + (fan - 1), F.col("__hi")))
    return runs.withColumn(out, F.explode(each)).drop("__hi", "__run")
