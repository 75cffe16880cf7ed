"""Row rules as typed rejects; nothing is dropped without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.text import is_blank
from tapeloom.operators.clips import ORDINAL_BUCKET, RECORDING
from tapeloom.plans.scan import Lag, ordered_scan
from tapeloom.schemas import ASSET_KINDS, CLIP_KINDS, EVENT_KINDS, PROVENANCES, SAMPLE_RATE_HZ


def split_rejects(df: DataFrame, code: Column, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with ``reason_code``) by a code that is null for good rows."""
    judged = df.withColumn("reason_code", code)
    bad = judged.filter("reason_code is not null")
    if keep is not None:
        bad = bad.select(*keep, "reason_code")
    return judged.filter("reason_code is null").drop("reason_code"), bad


def range_code() -> Column:
    """A range starts at or after zero and ends after it starts."""
    sound = (F.col("start_us") >= 0) & (F.col("end_us") > F.col("start_us"))
    return F.when(~F.coalesce(sound, F.lit(False)), "invalid_time_range")


def payload_code() -> Column:
    """First rule an event or command breaks on its own, whatever the state."""
    kind = F.col("kind")
    unnamed = F.col(RECORDING).isNull() | (kind.isin(*CLIP_KINDS) & F.col("clip_id").isNull())
    return (
        F.when(~F.coalesce(kind.isin(*EVENT_KINDS), F.lit(False)), "unknown_kind")
        .when(unnamed | ((kind == "transcript_committed") & F.col("transcript_id").isNull()), "missing_field")
        .when((kind == "recording_created") & (F.coalesce("source_path", F.lit("")) == ""), "empty_source_path")
        .when((kind == "recording_created") & ~F.coalesce(F.col("source_kind").isin(*ASSET_KINDS), F.lit(False)), "unknown_source_kind")
        .when((kind == "recording_failed") & is_blank("reason"), "empty_recording_failure")
        .when((kind == "transcription_failed") & is_blank("reason"), "empty_transcription_failure")
        .when((kind == "transcript_committed") & is_blank("text"), "empty_transcript")
        .when((kind == "transcript_committed") & ~F.coalesce(F.col("provenance").isin(*PROVENANCES), F.lit(False)), "unknown_provenance")
        .when(kind == "clip_added", range_code())
    )


def sequence_audit(events: DataFrame, width: int = ORDINAL_BUCKET) -> DataFrame:
    """Per log: records, how many do not follow the number before, and the first such number."""
    numbers = events.groupBy(RECORDING, "sequence").agg(F.count("*").alias("copies"))
    seen = ordered_scan(numbers, [RECORDING], "sequence", [Lag("was", "sequence")], width, share=True)
    jumps = F.col("sequence") != F.coalesce(F.col("was"), F.lit(0).cast("bigint")) + 1
    off = F.when(jumps, F.col("copies")).otherwise(F.col("copies") - 1)
    return seen.withColumn("off", off).groupBy(RECORDING).agg(
        F.sum("copies").alias("n_records"),
        F.sum("off").alias("n_out_of_order"),
        F.min(F.when(F.col("off") > 0, F.col("sequence"))).alias("first_bad_sequence"),
    )


def repeated_ids(rows: DataFrame, keys: list[str], code: str) -> DataFrame:
    """Keys used more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("uses")).filter("uses > 1").withColumn("reason_code", F.lit(code))


def dangling_references(rows: DataFrame, owners: DataFrame, keys: list[str], code: str) -> DataFrame:
    """Rows whose key names nothing in ``owners``."""
    return rows.join(owners.select(*keys), keys, "left_anti").withColumn("reason_code", F.lit(code))


def transcribable_code() -> Column:
    """Audio must be 16 kHz mono and have a path before a backend sees it."""
    path = F.coalesce(F.col("audio_path"), F.lit(""))
    return (
        F.when(path == "", "empty_audio_path")
        .when((F.col("sample_rate_hz") != SAMPLE_RATE_HZ) | (F.col("channels") != 1), "not_16khz_mono")
    )


def profile_input_code() -> Column:
    """Profiles apply to 16 kHz mono audio only."""
    ok = (F.col("sample_rate_hz") == SAMPLE_RATE_HZ) & (F.col("channels") == 1)
    return F.when(~F.coalesce(ok, F.lit(False)), "profile_needs_16khz_mono")
