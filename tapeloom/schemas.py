"""Table schemas and the fixed names used in them."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1
SAMPLE_RATE_HZ = 16_000
# Storage buckets of event tables.
N_BUCKETS = 256

# Names stored in event logs and manifests.
ASSET_KINDS = ("audio_file", "video_file", "microphone_recording")
RECORDING_STATUSES = ("created", "recording", "saved", "failed")
CLIP_STATUSES = ("pending", "ready", "processing", "failed", "transcribed", "edited", "deleted")
PROVENANCES = ("raw_asr", "user_edit", "local_llm", "imported")
PROFILES = ("original", "gain6_db", "noise_gate", "voice_eq")

RECORDING_KINDS = ("recording_created", "recording_started", "recording_saved", "recording_failed")
CLIP_KINDS = (
    "transcription_started",
    "transcription_failed",
    "clip_added",
    "clip_moved",
    "clip_deleted",
    "transcript_committed",
)
EVENT_KINDS = RECORDING_KINDS + CLIP_KINDS

# Command name -> the event it turns into.
COMMAND_EVENTS = {
    "create_recording": "recording_created",
    "start_recording": "recording_started",
    "complete_recording": "recording_saved",
    "fail_recording": "recording_failed",
    "begin_transcription": "transcription_started",
    "fail_transcription": "transcription_failed",
    "add_clip": "clip_added",
    "move_clip": "clip_moved",
    "delete_clip": "clip_deleted",
    "commit_transcript": "transcript_committed",
}

# Working form of a log: one flat row per event.
PAYLOAD = [
    ("clip_id", "string"),
    ("transcript_id", "string"),
    ("start_us", "bigint"),
    ("end_us", "bigint"),
    ("target_index", "bigint"),
    ("provenance", "string"),
    ("text", "string"),
    ("reason", "string"),
    ("source_kind", "string"),
    ("source_path", "string"),
]
PAYLOAD_COLUMNS = [name for name, _ in PAYLOAD]
_payload_ddl = ", ".join(f"{n} {t}" for n, t in PAYLOAD)
EVENTS_DDL = f"recording_id string, sequence bigint, kind string, {_payload_ddl}, schema_version int"
EVENT_COLUMNS = ["recording_id", "sequence", "kind", *PAYLOAD_COLUMNS, "schema_version"]
COMMANDS_DDL = f"recording_id string, ordinal bigint, kind string, {_payload_ddl}"

RECORDINGS_DDL = (
    "recording_id string, source_kind string, source_path string, status string, "
    "failure string, last_sequence bigint"
)
CLIPS_DDL = (
    "recording_id string, clip_id string, position bigint, start_us bigint, end_us bigint, "
    "status string, failure string"
)
TRANSCRIPTS_DDL = (
    "recording_id string, version_no bigint, transcript_id string, clip_id string, "
    "provenance string, text string"
)
REJECTS_DDL = "recording_id string, sequence bigint, kind string, reason_code string"

MEDIA_META_DDL = (
    "recording_id string, duration_us bigint, sample_rate_hz int, channels int, frame_count bigint"
)
# total_frames repeats on every block so that no operator has to gather a recording to know its end.
AUDIO_BLOCKS_DDL = (
    "recording_id string, profile string, block_no bigint, first_frame bigint, "
    "total_frames bigint, samples array<float>"
)
PACKETS_DDL = (
    "recording_id string, packet_no bigint, sample_format string, channels int, "
    "sample_rate_hz int, silent boolean, frames int, payload binary, stop boolean"
)

# Shape of one stored log line: the event is a struct with exactly one filled variant.
_range = "struct<start_us: bigint, end_us: bigint>"
_source = "struct<kind: string, path: string>"
LOG_LINE_DDL = (
    "schema_version int, sequence bigint, event struct<"
    f"recording_created: struct<recording_id: string, source: {_source}>,"
    "recording_started: struct<recording_id: string>,"
    "recording_saved: struct<recording_id: string>,"
    "recording_failed: struct<recording_id: string, reason: string>,"
    "transcription_started: struct<recording_id: string, clip_id: string>,"
    "transcription_failed: struct<recording_id: string, clip_id: string, reason: string>,"
    f"clip_added: struct<recording_id: string, clip_id: string, source_range: {_range}>,"
    "clip_moved: struct<recording_id: string, clip_id: string, target_index: bigint>,"
    "clip_deleted: struct<recording_id: string, clip_id: string>,"
    "transcript_committed: struct<recording_id: string, clip_id: string, transcript_id: string, "
    "provenance: string, text: string>>"
)
MANIFEST_DDL = (
    "schema_version int, last_sequence bigint, recording struct<"
    f"id: string, source: {_source}, status: string, failure: string, "
    f"clips: array<struct<id: string, source_range: {_range}, status: string, failure: string>>, "
    "transcripts: array<struct<id: string, clip_id: string, provenance: string, text: string>>>"
)


_FLAT = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(),
    "binary": T.BinaryType(), "array<float>": T.ArrayType(T.FloatType()),
}


def struct_type(ddl: str) -> T.StructType:
    """Schema of a flat column list; usable on Python workers, which have no session to parse DDL."""
    fields = [part.split(" ", 1) for part in ddl.split(", ")]
    return T.StructType([T.StructField(name, _FLAT[kind]) for name, kind in fields])
