"""Media files: discovery, WAV headers, parallel decoding, WAV output."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.audio import mean_of_channels, resampled_length
from tapeloom.functions.text import artifact_path, asset_kind, is_supported_media
from tapeloom.functions.timecode import div, duration_us
from tapeloom.operators.audio import BLOCK_SECONDS
from tapeloom.operators.clips import RECORDING
from tapeloom.plans.spread import explode_span
from tapeloom.schemas import AUDIO_BLOCKS_DDL, SAMPLE_RATE_HZ
from tapeloom.sources.files import open_path, write_files

HEADER_DDL = (
    "path string, sample_rate_hz bigint, channels int, bits int, is_float boolean, "
    "data_offset bigint, data_bytes bigint, frame_count bigint, error string"
)
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
MAX_RIFF = 0xFFFFFFFF
# Blocks that a decoding task hands on at a time.
DECODED_AT_ONCE = 8
DECODED_DDL = AUDIO_BLOCKS_DDL + ", previous_sample float, next_sample float, source_hz bigint"


def scan_media(spark: SparkSession, folder: str) -> DataFrame:
    """Supported files below a folder with kind and size; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length").filter(is_supported_media("path")).select(
        "path", asset_kind("path").alias("source_kind"), "length"
    )


def read_header(path: str) -> dict:
    """Format and data position of one WAV file, reading only its chunk headers."""
    files, inner = open_path(path)
    with files.open_input_file(inner) as f:
        riff = f.read(12)
        if len(riff) < 12 or riff[:4] not in (b"RIFF", b"RF64") or riff[8:] != b"WAVE":
            raise ValueError("not_a_wav_file")
        at, form, long_size = 12, None, None
        while True:
            f.seek(at)
            head = f.read(8)
            if len(head) < 8:
                raise ValueError("wav_without_data")
            name, size = head[:4], struct.unpack("<I", head[4:])[0]
            if name == b"fmt ":
                form = f.read(size)
            elif name == b"ds64":
                long_size = struct.unpack("<QQ", f.read(16))[1]
            elif name == b"data":
                size = long_size if long_size is not None and size == MAX_RIFF else size
                break
            at += 8 + size + (size & 1)
        if form is None or len(form) < 16:
            raise ValueError("wav_without_format")
        available = f.size() - at - 8
    tag, channels, rate, _, align, bits = struct.unpack("<HHIIHH", form[:16])
    if tag == EXTENSIBLE and len(form) >= 26:
        tag = struct.unpack("<H", form[24:26])[0]
    if channels == 0:
        raise ValueError("invalid_channels")
    if tag not in (PCM, FLOAT):
        raise ValueError("unsupported_wav_encoding")
    data = min(size, available)
    return {
        "path": path, "sample_rate_hz": rate, "channels": channels, "bits": bits, "is_float": tag == FLOAT,
        "data_offset": at + 8, "data_bytes": data, "frame_count": data // max(align, 1), "error": None,
    }


def _headers(batches):
    names = [c.split()[0] for c in HEADER_DDL.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            try:
                rows.append(read_header(path))
            except (ValueError, OSError, struct.error) as failure:
                rows.append({"path": path, "error": str(failure)})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(zip(names, types))))


def inspect_wav(files: DataFrame) -> DataFrame:
    """Header facts per ``path``; duration is frames over rate, rounded down. Bad files carry ``error``."""
    heads = files.select("path").mapInArrow(_headers, HEADER_DDL)
    return heads.withColumn("duration_us", duration_us("frame_count", "sample_rate_hz"))


def decode_code():
    """Why a header cannot be decoded, null where it can."""
    return (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.col("is_float") & (F.col("bits") > 16), "unsupported_integer_bits")
        .when(F.col("is_float") & (F.col("bits") != 32), "unsupported_float_bits")
        .when(F.col("sample_rate_hz") == 0, "invalid_sample_rate")
    )


def decode_span(path: str, offset: int, frames: int, channels: int, bits: int, is_float: bool) -> np.ndarray:
    """Mono samples of one byte span: scaled integers or floats, averaged over channels."""
    width = 4 if is_float else (bits + 7) // 8
    files, inner = open_path(path)
    with files.open_input_file(inner) as f:
        raw = f.read_at(frames * channels * width, offset)
    if is_float:
        samples = np.frombuffer(raw, "<f4")
    elif width == 1:
        samples = (np.frombuffer(raw, np.uint8).astype(np.int16) - 128).astype(np.float32) / np.float32(2 ** (bits - 1))
    else:
        samples = np.frombuffer(raw, "<i2").astype(np.float32) / np.float32(2 ** (bits - 1))
    return mean_of_channels(samples, channels)


def _decode(batches):
    names = [c.split()[0] for c in DECODED_DDL.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float32()), pa.float32(), pa.float32(), pa.int64()]

    def handed(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            width = 4 if row["is_float"] else (row["bits"] + 7) // 8
            first, total = row["block_no"] * row["block_frames"], row["frame_count"]
            stop = min(first + row["block_frames"], total)
            # one frame more on either side, for operators that look at a neighbour
            a, b = max(first - 1, 0), min(stop + 1, total)
            start = row["data_offset"] + a * row["channels"] * width
            read = decode_span(row["path"], start, b - a, row["channels"], row["bits"], row["is_float"])
            before, after = (read[0] if a < first else None), (read[-1] if b > stop else None)
            body = read[first - a : stop - a]
            rows.append((row["recording_id"], "original", row["block_no"], first, total, body, before, after, row["sample_rate_hz"]))
            if len(rows) == DECODED_AT_ONCE:
                yield handed(rows)
                rows = []
        if rows:
            yield handed(rows)


def _decoded(headers: DataFrame, block_seconds: int) -> tuple[DataFrame, DataFrame]:
    judged = headers.withColumn("reason_code", decode_code())
    good = judged.filter("reason_code is null and frame_count > 0").withColumn(
        "block_frames", F.col("sample_rate_hz") * block_seconds
    )
    spans = explode_span(
        good, F.lit(0), div(F.col("frame_count") - 1, F.col("block_frames")), "block_no", [RECORDING], fan=64
    )
    wanted = [
        RECORDING, "path", "block_no", "block_frames", "frame_count", "data_offset", "channels", "bits", "is_float", "sample_rate_hz",
    ]
    blocks = spans.select(*wanted).mapInArrow(_decode, DECODED_DDL)
    return blocks, judged.filter("reason_code is not null").select(RECORDING, "path", "reason_code")


def decode_wav(headers: DataFrame, block_seconds: int = BLOCK_SECONDS) -> tuple[DataFrame, DataFrame]:
    """Mono blocks at the file's own rate with their neighbouring samples, plus rejects.

    ``headers`` is ``inspect_wav`` output with a recording_id. Work is one byte span per
    block, exchanged by block number, so one long file is read by many tasks.
    """
    blocks, rejects = _decoded(headers, block_seconds)
    return blocks.drop("source_hz"), rejects


def normalize(headers: DataFrame, block_seconds: int = BLOCK_SECONDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(16 kHz mono blocks, their media_meta, rejects) for WAV sources; no audio is exchanged."""
    from tapeloom.operators.audio import resample

    blocks, rejects = _decoded(headers, block_seconds)
    normal = resample(blocks, F.col("source_hz"))
    ok = headers.withColumn("reason_code", decode_code()).filter("reason_code is null")
    return normal, normalized_meta(ok), rejects


def normalized_meta(headers: DataFrame) -> DataFrame:
    """media_meta after normalization, straight from the headers."""
    frames = resampled_length("frame_count", "sample_rate_hz", SAMPLE_RATE_HZ)
    return headers.select(
        RECORDING, duration_us(frames, SAMPLE_RATE_HZ).alias("duration_us"),
        F.lit(SAMPLE_RATE_HZ).alias("sample_rate_hz"), F.lit(1).alias("channels"), frames.alias("frame_count"),
    )


def decode_with(files: DataFrame, decoder: Callable[[bytes], tuple[int, int, np.ndarray]], block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Blocks from any format through a user's decoder: bytes -> (rate, channels, interleaved samples).

    ``files`` needs (recording_id, content). Such a codec works on a whole file, so a row is one file.
    """

    def run(batches):
        for batch in batches:
            for recording, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rate, channels, samples = decoder(content.as_py())
                mono = mean_of_channels(np.asarray(samples, np.float32), channels)
                size = rate * block_seconds
                for number, at in enumerate(range(0, len(mono), size)):
                    values = [recording, "original", number, at, len(mono), mono[at : at + size], rate]
                    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float32()), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], t) for v, t in zip(values, types)],
                        names=["recording_id", "profile", "block_no", "first_frame", "total_frames", "samples", "rate"],
                    )

    return files.select(RECORDING, "content").mapInArrow(run, AUDIO_BLOCKS_DDL + ", rate bigint")


def write_audio(blocks: DataFrame, path: str) -> None:
    """The authoritative audio table; existing blocks are never rewritten."""
    blocks.write.mode("append").parquet(path)


@F.arrow_udf(T.BinaryType())
def float_bytes(samples: pa.Array) -> pa.Array:
    return pa.array([np.asarray(s.values, "<f4").tobytes() for s in samples], pa.binary())


@F.arrow_udf(T.BinaryType())
def wav_header(total_frames: pa.Array) -> pa.Array:
    """RIFF header of a 16 kHz mono 32-bit float file; RF64, with sizes of 64 bits, above 4 GiB."""
    return pa.array([header_bytes(n) for n in total_frames.to_pylist()], pa.binary())


def header_bytes(frames: int) -> bytes:
    size = frames * 4
    form = b"fmt " + struct.pack("<IHHIIHH", 16, FLOAT, 1, SAMPLE_RATE_HZ, SAMPLE_RATE_HZ * 4, 4, 32)
    if 36 + size <= MAX_RIFF:
        return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVE" + form + b"data" + struct.pack("<I", size)
    long_sizes = b"ds64" + struct.pack("<IQQQI", 28, 72 + size, size, frames, 0)
    return b"RF64" + struct.pack("<I", MAX_RIFF) + b"WAVE" + long_sizes + form + b"data" + struct.pack("<I", MAX_RIFF)


def write_wav(blocks: DataFrame, root: str) -> DataFrame:
    """16 kHz mono float WAV files, one per recording and profile; sources are never touched."""
    path = artifact_path(root, RECORDING, "profile")
    body = blocks.select(path.alias("path"), F.col("block_no").alias("part"), float_bytes("samples").alias("data"))
    head = blocks.filter("block_no = 0").select(path.alias("path"), F.lit(-1).cast("bigint").alias("part"), wav_header("total_frames").alias("data"))
    return write_files(head.unionByName(body))
