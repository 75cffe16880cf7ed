"""Log-mel features of clips.

A feature window is 30 seconds, 480,000 samples: that fixed bound is what makes it safe
to hold one clip in one row. Longer clips are cut into windows first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions import spectral
from tapeloom.functions.timecode import div
from tapeloom.operators.audio import cut_clips, judged_ranges
from tapeloom.operators.clips import RECORDING, active
from tapeloom.plans.spread import explode_span

WINDOW_US = spectral.CLIP_SECONDS * 1_000_000


def clip_windows(clips: DataFrame) -> DataFrame:
    """Active clips in windows of at most 30 s: window_no, and the window's own range as start / end.

    A window is a whole number of samples, so the windows of a clip tile its samples. A clip
    whose range is not sound keeps it in a single window, to be rejected where it is cut.
    """
    span = F.col("end_us") - F.col("start_us")
    last = F.when(span > 0, div(span - 1, WINDOW_US)).otherwise(F.lit(0).cast("bigint"))
    cut = explode_span(active(clips), F.lit(0), last, "window_no", [RECORDING, "clip_id"])
    start = F.col("start_us") + F.col("window_no") * WINDOW_US
    return cut.select(
        RECORDING,
        F.concat_ws("#", "clip_id", "window_no").alias("window_id"),
        "clip_id", "window_no", F.col("start_us").alias("clip_start_us"),
        start.alias("start_us"),
        F.least(start + WINDOW_US, F.col("end_us")).alias("end_us"),
        (span > WINDOW_US).alias("is_long"),
    )


def assemble(pieces: DataFrame) -> DataFrame:
    """One row per clip of at most 480,000 samples; a longer one must be cut into windows before."""
    limit = spectral.N_SAMPLES
    too_long = F.concat(F.lit("clip longer than a feature window: "), F.col("clip_id"))
    fits = F.when(F.col("total_frames") <= limit, F.col("total_frames")).otherwise(F.raise_error(too_long).cast("bigint"))
    return (
        pieces.withColumn("total_frames", fits)
        .groupBy(RECORDING, "clip_id", "profile")
        .agg(
            F.array_sort(F.collect_list(F.struct("first_frame", "samples"))).alias("ps"),
            F.max("total_frames").alias("total_frames"),
            F.min("start_us").alias("start_us"),
            F.max("end_us").alias("end_us"),
        )
        .select(
            RECORDING, "clip_id", "profile", "start_us", "end_us", "total_frames",
            F.flatten(F.col("ps.samples")).alias("samples"),
        )
    )


def window_audio(clips: DataFrame, blocks: DataFrame, media: DataFrame, block_frames: int) -> tuple[DataFrame, DataFrame]:
    """(a row per feature window of the clips, with its samples; rejects).

    A window's ``clip_id`` stays that of its clip; ``window_id`` names the window. A clip that cannot
    be cut is rejected whole, as one window, and none of it is cut.
    """
    judged = judged_ranges(clips, media)
    windows = clip_windows(judged.filter("reason_code is null").withColumn("status", F.lit("pending")))
    as_clips = windows.select(
        RECORDING, F.col("window_id").alias("clip_id"), "start_us", "end_us", F.lit("pending").alias("status")
    )
    pieces, _ = cut_clips(as_clips, blocks, media, block_frames)  # windows of sound clips are sound
    first = F.lit(0).cast("bigint")
    rejects = judged.filter("reason_code is not null").select(
        RECORDING, F.concat_ws("#", "clip_id", first).alias("window_id"), "reason_code", "clip_id", first.alias("window_no"),
        F.col("start_us").alias("clip_start_us"), (F.col("end_us") - F.col("start_us") > WINDOW_US).alias("is_long"),
    )
    keys = windows.select(RECORDING, "window_id", "clip_id", "window_no", "clip_start_us", "is_long")
    named = assemble(pieces).withColumnRenamed("clip_id", "window_id").join(keys, [RECORDING, "window_id"], "left")
    return named, rejects


def clip_log_mel(clips: DataFrame, blocks: DataFrame, media: DataFrame, block_frames: int) -> tuple[DataFrame, DataFrame]:
    """(3,000 frames of 80 mel levels per feature window, rejects); ``clip_id`` is the window's id."""
    audio, rejects = window_audio(clips, blocks, media, block_frames)
    return log_mel(audio.select(RECORDING, F.col("window_id").alias("clip_id"), "profile", "samples")), rejects


def _mel_rows(batches):
    for batch in batches:
        recordings, clips, profiles = (batch.column(i).to_pylist() for i in range(3))
        samples = batch.column(3)
        for i in range(batch.num_rows):
            mel = spectral.log_mel(np.asarray(samples[i].values))
            n, width = mel.shape
            offsets = pa.array(np.arange(0, n * width + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([recordings[i]] * n, pa.string()),
                    pa.array([clips[i]] * n, pa.string()),
                    pa.array([profiles[i]] * n, pa.string()),
                    pa.array(np.arange(n, dtype=np.int32)),
                    pa.ListArray.from_arrays(offsets, pa.array(mel.ravel())),
                ],
                names=["recording_id", "clip_id", "profile", "frame_no", "mel"],
            )


def log_mel(assembled: DataFrame) -> DataFrame:
    """3,000 frames of 80 mel levels per clip, one row per frame."""
    return assembled.select(RECORDING, "clip_id", "profile", "samples").mapInArrow(
        _mel_rows, "recording_id string, clip_id string, profile string, frame_no int, mel array<float>"
    )


def spectrogram_stats(mel: DataFrame) -> DataFrame:
    return mel.groupBy(RECORDING, "clip_id", "profile").agg(
        F.count("*").alias("n_frames"),
        F.min(F.array_min("mel")).alias("min_value"),
        F.max(F.array_max("mel")).alias("max_value"),
    )


def at(mel: DataFrame, mel_bin: int, frame_no: int) -> DataFrame:
    """One level of every clip."""
    return mel.filter(F.col("frame_no") == frame_no).select(
        RECORDING, "clip_id", "profile", F.get("mel", F.lit(mel_bin)).alias("value")
    )


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def power_spectrum(frame: pa.Array) -> pa.Array:
    """Hann-windowed power of each frame; frames of one length are transformed together."""
    if len(frame) == 0:
        return pa.array([], pa.list_(pa.float64()))
    sizes = np.asarray(frame.value_lengths())
    flat = np.asarray(frame.flatten(), np.float64)
    if (sizes == sizes[0]).all():
        power = spectral.power_spectrum(flat.reshape(len(frame), -1))
        offsets = np.arange(0, power.size + 1, power.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(power.ravel()))
    ends = np.cumsum(sizes)
    return pa.array(
        [spectral.power_spectrum(flat[e - n : e]) for e, n in zip(ends, sizes)], pa.list_(pa.float64())
    )
