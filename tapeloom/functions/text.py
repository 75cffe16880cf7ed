"""String rules: Unicode trimming, blank tests, extensions, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point Unicode calls white space, for trimming and blank tests.
WHITE_SPACE = (
    r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

# Supported media extensions.
AUDIO_EXTENSIONS = ("wav", "mp3", "m4a", "flac", "ogg", "aac", "opus", "aiff")
VIDEO_EXTENSIONS = ("mp4", "mov", "mkv", "webm", "avi")

# Profile -> (label, short label, file stem, next profile).
PROFILE_NAMES = {
    "original": ("ORIGINAL", "RAW", None, "gain6_db"),
    "gain6_db": ("GAIN +6DB", "GAIN", "gain-6db", "noise_gate"),
    "noise_gate": ("NOISE GATE", "GATE", "noise-gate", "voice_eq"),
    "voice_eq": ("VOICE EQ", "EQ", "voice-eq", "original"),
}


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def trim_unicode(text: Column | str) -> Column:
    """Strip Unicode white space on both sides (Spark's ``trim`` strips spaces only)."""
    return F.regexp_replace(_c(text), f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", "")


def is_blank(text: Column | str) -> Column:
    """True for null, empty and white-space-only text, without building the trimmed copy."""
    return ~F.coalesce(_c(text), F.lit("")).rlike(f"[^{WHITE_SPACE}]")


def extension(path: Column | str) -> Column:
    """Lower-case extension after the last dot of the file name, null where there is none.

    A name that only starts with a dot has no extension.
    """
    found = F.regexp_extract(_c(path), r"[^/\\]\.([^./\\]*)$", 1)
    return F.when(found != "", F.lower(found))


def is_supported_media(path: Column | str) -> Column:
    return F.coalesce(extension(path).isin(*AUDIO_EXTENSIONS, *VIDEO_EXTENSIONS), F.lit(False))


def asset_kind(path: Column | str) -> Column:
    """video_file for the video extensions, audio_file for anything else."""
    return F.when(extension(path).isin(*VIDEO_EXTENSIONS), "video_file").otherwise("audio_file")


def _profile_lookup(profile: Column | str, field: int) -> Column:
    pairs = [F.lit(x) for name, row in PROFILE_NAMES.items() for x in (name, row[field])]
    return F.element_at(F.create_map(*pairs), _c(profile))


def profile_label(profile: Column | str) -> Column:
    return _profile_lookup(profile, 0)


def profile_short_label(profile: Column | str) -> Column:
    return _profile_lookup(profile, 1)


def profile_file_stem(profile: Column | str) -> Column:
    return _profile_lookup(profile, 2)


def next_profile(profile: Column | str) -> Column:
    return _profile_lookup(profile, 3)


# The folders and file names of a store, in the three functions below.
def recording_folder(root: str, recording_id: Column | str) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), F.lit("recordings"), _c(recording_id))


def artifact_path(root: str, recording_id: Column | str, profile: Column | str) -> Column:
    """Where a recording's audio of one profile lives."""
    audio = F.concat_ws("/", recording_folder(root, recording_id), F.lit("audio"))
    stem = profile_file_stem(profile)
    return F.when(
        _c(profile) == "original", F.concat_ws("/", audio, F.lit("normalized-16khz-mono.wav"))
    ).otherwise(F.concat(audio, F.lit("/profiles/"), stem, F.lit(".wav")))


def clip_path(root: str, recording_id: Column | str, clip_id: Column | str) -> Column:
    return F.concat(
        recording_folder(root, recording_id), F.lit("/audio/clips/clip-"), _c(clip_id), F.lit(".wav")
    )
