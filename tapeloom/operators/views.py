"""Read models: latest text, documents, status reports and navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.text import trim_unicode
from tapeloom.operators.clips import ORDINAL_BUCKET, RECORDING, active, first_active_clip
from tapeloom.plans.scan import FirstOfKey, Lag, LastOfKey, Lead, SumBefore, SumOfKey, ordered_scan
from tapeloom.plans.stage import written


def latest_transcript(transcripts: DataFrame) -> DataFrame:
    """Last committed version of every clip, pre-aggregated before the shuffle."""
    row = F.struct("version_no", "transcript_id", "provenance", "text")
    return (
        transcripts.groupBy(RECORDING, "clip_id")
        .agg(F.max_by(row, "version_no").alias("t"))
        .select(RECORDING, "clip_id", "t.*")
    )


def transcript_document(clips: DataFrame, transcripts: DataFrame, width: int = ORDINAL_BUCKET) -> DataFrame:
    """Latest text of the active clips in list order, a row per clip.

    The pieces of a recording in order, a blank line between two, are its document;
    ``byte_offset`` says where in it a piece begins. No recording is gathered.
    """
    texts = active(clips).select(RECORDING, "clip_id", "position").join(
        latest_transcript(transcripts), [RECORDING, "clip_id"]
    )
    piece = F.concat(
        F.lit("[clip "), F.col("clip_id"), F.lit(" | "), F.col("provenance"), F.lit("]\n"), trim_unicode("text")
    )
    pieces = texts.select(RECORDING, "position", piece.alias("piece"))
    sized = pieces.withColumn("byte_count", F.octet_length("piece").cast("bigint"))
    return ordered_scan(sized, [RECORDING], "position", [SumBefore("byte_offset", F.col("byte_count") + 2)], width)


def document_totals(pieces: DataFrame) -> DataFrame:
    """Clips and bytes of each document."""
    return pieces.groupBy(RECORDING).agg(
        F.count("*").alias("transcript_count"),
        (F.sum(F.col("byte_count") + 2) - 2).alias("byte_count"),
    )


def documents_missing(recordings: DataFrame, pieces: DataFrame) -> DataFrame:
    """Recordings with nothing to export."""
    return recordings.select(RECORDING).join(pieces.select(RECORDING).distinct(), RECORDING, "left_anti").select(
        RECORDING, F.lit("no_committed_transcripts").alias("reason_code")
    )


def version_history(transcripts: DataFrame, width: int = ORDINAL_BUCKET) -> DataFrame:
    """Every version beside the one before it, and whether the text changed."""
    seen = ordered_scan(
        transcripts, [RECORDING, "clip_id"], "version_no",
        [
            Lag("previous_provenance", "provenance"),
            Lag("previous_text", "text"),
            SumBefore("version_index", F.lit(1).cast("bigint")),
        ],
        width,
    )
    return seen.withColumn(
        "changed", F.col("previous_text").isNotNull() & (F.col("previous_text") != F.col("text"))
    )


def clip_navigation(clips: DataFrame, width: int = ORDINAL_BUCKET) -> DataFrame:
    """1-based index, count, and wrap-around neighbours of each active clip."""
    one = F.lit(1).cast("bigint")
    walked = ordered_scan(
        active(clips).select(RECORDING, "clip_id", "position"), [RECORDING], "position",
        [
            SumBefore("before", one),
            SumOfKey("clip_count", one),
            Lag("lag_id", "clip_id"),
            Lead("lead_id", "clip_id"),
            FirstOfKey("first_id", "clip_id"),
            LastOfKey("last_id", "clip_id"),
        ],
        width,
    )
    return walked.select(
        RECORDING, "clip_id",
        (F.col("before") + 1).alias("clip_index"),
        "clip_count",
        F.coalesce("lag_id", "last_id").alias("previous_clip_id"),
        F.coalesce("lead_id", "first_id").alias("next_clip_id"),
    )


def next_recording(recordings: DataFrame) -> DataFrame:
    """The recording after each one in id order, wrapping at the end.

    Spark samples the ids and cuts them into ranges of like size, whatever they begin with; a range
    is a bucket of the scan. The cut is written, as another run may cut elsewhere.
    """
    ranged = recordings.select(RECORDING).repartitionByRange(RECORDING)
    keyed = written(ranged.select(RECORDING, F.lit(1).alias("all_rows"), F.spark_partition_id().cast("bigint").alias("range_no")), "ranges")
    walked = ordered_scan(
        keyed, ["all_rows"], "range_no",
        [Lead("lead_id", RECORDING), FirstOfKey("first_id", RECORDING)], 1, ties=[RECORDING],
    )
    return walked.select(RECORDING, F.coalesce("lead_id", "first_id").alias("next_recording_id"))


def failure_report(recordings: DataFrame, clips: DataFrame) -> DataFrame:
    """Failed recordings and active clips with their reasons, one row each."""
    whole = recordings.filter("failure is not null").select(
        RECORDING, F.lit(None).cast("string").alias("clip_id"),
        F.concat(F.lit("recording: "), F.col("failure")).alias("message"),
    )
    parts = active(clips).filter("failure is not null").select(
        RECORDING, "clip_id",
        F.concat(F.lit("clip "), F.col("clip_id"), F.lit(": "), F.col("failure")).alias("message"),
    )
    return whole.unionByName(parts).withColumn("severity", F.lit("error"))


def recording_view(
    recordings: DataFrame, clips: DataFrame, transcripts: DataFrame, selected: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(header per recording, its active clips, its diagnostics).

    ``selected`` may name a clip per recording; one that is not active falls back to
    the first active clip. The header carries the selected clip's latest text.
    """
    live = active(clips)
    first = first_active_clip(clips).select(RECORDING, F.col("clip_id").alias("first_id"))
    header = recordings.select(RECORDING, "status").join(first, RECORDING, "left")
    if selected is not None:
        named = selected.select(RECORDING, "clip_id").join(
            live.select(RECORDING, "clip_id"), [RECORDING, "clip_id"], "left_semi"
        )
        header = header.join(named.withColumnRenamed("clip_id", "named_id"), RECORDING, "left")
        chosen = F.coalesce("named_id", "first_id")
    else:
        chosen = F.col("first_id")
    header = header.select(RECORDING, "status", chosen.alias("clip_id")).join(
        latest_transcript(transcripts), [RECORDING, "clip_id"], "left"
    )
    header = header.select(
        RECORDING, "status", F.col("clip_id").alias("selected_clip_id"), "transcript_id", "provenance", "text",
        F.col("transcript_id").isNotNull().alias("committed"),
    )
    return header, live, failure_report(recordings, clips)


def show_recordings(recordings: DataFrame, clips: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Counts per recording; deleted clips are counted too."""
    n_clips = clips.groupBy(RECORDING).agg(F.count("*").alias("clip_count"))
    n_texts = transcripts.groupBy(RECORDING).agg(F.count("*").alias("transcript_count"))
    zero = F.lit(0).cast("bigint")
    return (
        recordings.join(n_clips, RECORDING, "left")
        .join(n_texts, RECORDING, "left")
        .withColumn("clip_count", F.coalesce("clip_count", zero))
        .withColumn("transcript_count", F.coalesce("transcript_count", zero))
    )


def next_action_label(prepared: Column, has_text: Column) -> Column:
    """What a recording needs next; the wording is a fixed value."""
    return (
        F.when(~prepared, "CLICK PREPARE TO NORMALIZE AUDIO")
        .when(~has_text, "CLICK TRANSCRIBE TO CREATE TEXT")
        .otherwise("REVIEW TEXT, THEN CLICK EXPORT")
    )


def next_action(recordings: DataFrame, audio: DataFrame, clips: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Per recording: prepare, transcribe, or review and export.

    Text means text of the clip that would be shown first.
    """
    prepared = audio.select(RECORDING).distinct().withColumn("prepared", F.lit(True))
    first = first_active_clip(clips).select(RECORDING, "clip_id")
    texts = transcripts.select(RECORDING, "clip_id").distinct()
    with_text = first.join(texts, [RECORDING, "clip_id"], "left_semi").select(RECORDING).withColumn(
        "has_text", F.lit(True)
    )
    joined = recordings.select(RECORDING).join(prepared, RECORDING, "left").join(with_text, RECORDING, "left")
    no = F.lit(False)
    return joined.select(
        RECORDING,
        next_action_label(F.coalesce("prepared", no), F.coalesce("has_text", no)).alias("next_action"),
    )


def media_summary(recordings: DataFrame, media: DataFrame) -> DataFrame:
    """Counts, frames and duration by kind and status, with sub-totals."""
    return (
        recordings.join(media, RECORDING, "left")
        .rollup("source_kind", "status")
        .agg(
            F.count("*").alias("n_recordings"),
            F.sum("frame_count").alias("frame_count"),
            F.sum("duration_us").alias("duration_us"),
            F.max("sample_rate_hz").alias("max_rate_hz"),
        )
    )
