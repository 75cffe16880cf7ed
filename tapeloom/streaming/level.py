"""Live peak level over fixed windows of source time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.clips import RECORDING


def level_by_window(packets: DataFrame, width_us: int) -> DataFrame:
    """Peak and sample count per recording and window; the same code runs in batch and in update
    mode on a stream. ``packets``: recording_id, at_us, samples.

    Windows are integer buckets of source time: the state per window is one row.
    """
    start = F.col("at_us") - F.pmod(F.col("at_us"), F.lit(width_us))
    per = packets.filter(F.size("samples") > 0).select(
        RECORDING, start.alias("window_start_us"), F.size("samples").alias("n"),
        F.array_max(F.transform("samples", lambda x: F.abs(x))).alias("peak"),
    )
    return per.groupBy(RECORDING, "window_start_us").agg(F.sum("n").alias("n_samples"), F.max("peak").alias("peak"))
