"""Per-block sample arithmetic as column expressions.

A block's samples are an ARRAY<FLOAT>; arithmetic stays in single precision, as the
results to match are, except for interpolation, which runs in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.timecode import col, div

# Profile parameters.
GAIN = 1.9952623
GATE_LEVEL = 0.02
GATE_GAIN = 0.08
EQ_DECAY = 0.995
EQ_MIX = 0.25


def f32(value: float) -> Column:
    return F.lit(value).cast("float")


def clamp(x: Column) -> Column:
    return F.greatest(F.least(x, f32(1.0)), f32(-1.0))


def gain_6db(samples) -> Column:
    return F.transform(col(samples), lambda x: clamp(x * f32(GAIN)))


def noise_gate(samples) -> Column:
    """Samples below the gate level are turned down, samples at the level are kept."""
    return F.transform(
        col(samples), lambda x: F.when(F.abs(x) < f32(GATE_LEVEL), x * f32(GATE_GAIN)).otherwise(x)
    )


def voice_eq(samples, previous=None) -> Column:
    """First-difference lift; ``previous`` is the raw sample before the block, 0 at the start."""
    s = col(samples)
    before = f32(0.0) if previous is None else F.coalesce(col(previous), f32(0.0))

    def one(x: Column, i: Column) -> Column:
        prev = F.when(i == 0, before).otherwise(F.get(s, i - 1))
        return clamp(x + (x - prev * f32(EQ_DECAY)) * f32(EQ_MIX))

    return F.transform(s, one)


def pad_or_trim(samples, length: int) -> Column:
    """Exactly ``length`` samples: cut, or filled with zeros."""
    s = col(samples)
    missing = F.greatest(F.lit(length) - F.size(s), F.lit(0))
    return F.slice(F.concat(s, F.array_repeat(f32(0.0), missing)), 1, length)


def downmix(samples, channels) -> Column:
    """Mean over interleaved channels; a cut-off last frame is still divided by the channel count."""
    s, ch = col(samples), col(channels).cast("int")
    frames = F.ceil(F.size(s) / ch).cast("int")
    mixed = F.transform(
        F.sequence(F.lit(0), frames - 1),
        lambda i: F.aggregate(F.slice(s, i * ch + 1, ch), f32(0.0), lambda acc, x: acc + x)
        / ch.cast("float"),
    )
    mixed = F.transform(mixed, lambda x: x.cast("float"))
    return F.when(F.size(s) == 0, s).otherwise(mixed)


def downmix_callback(samples, channels) -> Column:
    """Mean of what each frame of a device buffer holds, within [-1, 1]; a cut-off last frame counts what is there."""
    s, ch = col(samples), col(channels).cast("int")
    frames = F.ceil(F.size(s) / ch).cast("int")

    def one(i: Column) -> Column:
        frame = F.slice(s, i * ch + 1, ch)
        total = F.aggregate(frame, f32(0.0), lambda acc, x: acc + x)
        return F.greatest(F.least((total / F.size(frame).cast("float")).cast("float"), f32(1.0)), f32(-1.0))

    return F.when(F.size(s) == 0, s).otherwise(F.transform(F.sequence(F.lit(0), frames - 1), one))


def resampled_length(frames, source_hz, target_hz) -> Column:
    n = col(frames)
    scaled = div(n * col(target_hz), col(source_hz))
    return F.when((n == 0) | (col(source_hz) == col(target_hz)), n).otherwise(F.greatest(scaled, col(1)))


def resample_span(samples, first_frame, following, lo, hi, source_hz, target_hz) -> Column:
    """Output samples ``lo .. hi`` (inclusive) of a linear resampling, read from one block.

    ``following`` is the sample after the block, null at the end of the recording,
    where the last sample stands in for it.
    """
    s, first = col(samples), col(first_frame)
    src, dst = col(source_hz), col(target_hz)
    after = F.coalesce(col(following), F.element_at(s, -1))

    def one(i: Column) -> Column:
        at = i * src
        k = (div(at, dst) - first).cast("int")
        share = (at % dst).cast("double") / dst.cast("double")
        right = F.coalesce(F.get(s, k + 1), after).cast("double")
        left = F.get(s, k).cast("double")
        return (left * (F.lit(1.0) - share) + right * share).cast("float")

    empty = F.array().cast("array<float>")
    return F.when(col(hi) < col(lo), empty).otherwise(F.transform(F.sequence(col(lo), col(hi)), one))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def resample_blocks(
    samples: pa.Array, first: pa.Array, following: pa.Array, lo: pa.Array, stop: pa.Array, source: pa.Array, target: pa.Array
) -> pa.Array:
    """Output samples ``lo .. stop - 1`` of a linear resampling, each from one block.

    ``following`` is the sample after the block, null at the end of the recording,
    where the last sample stands in for it.
    """
    out = []
    for s, begin, after, a, b, src, dst in zip(samples, *(c.to_pylist() for c in (first, following, lo, stop, source, target))):
        held = np.asarray(s.values, np.float32) if s.is_valid else np.zeros(0, np.float32)
        if src == dst or b <= a or not len(held):
            out.append(held if src == dst else held[:0])
            continue
        at = np.arange(a, b, dtype=np.int64) * src
        k = at // dst - begin
        share = (at % dst) / dst
        reach = np.append(held, np.float32(held[-1] if after is None else after)).astype(np.float64)
        out.append((reach[k] * (1.0 - share) + reach[k + 1] * share).astype(np.float32))
    return pa.array(out, pa.list_(pa.float32()))


def resample_linear(samples, source_hz: int, target_hz: int) -> Column:
    """Linear resampling of a whole signal held in one array."""
    s = col(samples)
    n = F.size(s).cast("bigint")
    out = resampled_length(n, source_hz, target_hz)
    none = F.lit(None).cast("float")
    moved = resample_span(s, 0, none, 0, out - 1, source_hz, target_hz)
    return s if source_hz == target_hz else F.when(n == 0, s).otherwise(moved)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def pcm_to_float(payload: pa.Array, sample_format: pa.Array) -> pa.Array:
    """Packed little-endian PCM (pcm16, pcm24, pcm32, float32) as floats, batch at a time."""
    out = [
        None if raw is None else decode_pcm(raw, fmt)
        for raw, fmt in zip(payload.to_pylist(), sample_format.to_pylist())
    ]
    return pa.array(out, type=pa.list_(pa.float32()))


def decode_pcm(raw: bytes, sample_format: str) -> np.ndarray:
    """One packet's bytes as float32; a cut-off last sample is left out."""
    if sample_format == "pcm16":
        return np.frombuffer(raw, "<i2", len(raw) // 2).astype(np.float32) / np.float32(32768)
    if sample_format == "pcm24":
        b = np.frombuffer(raw, np.uint8, len(raw) // 3 * 3).reshape(-1, 3).astype(np.int32)
        value = (b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)) << 8 >> 8
        return value.astype(np.float32) / np.float32(8388608)
    if sample_format == "pcm32":
        return np.frombuffer(raw, "<i4", len(raw) // 4).astype(np.float32) / np.float32(2147483648)
    if sample_format == "float32":
        return np.clip(np.frombuffer(raw, "<f4", len(raw) // 4), -1, 1)
    raise ValueError(f"unknown sample format {sample_format!r}")


@F.arrow_udf(T.ArrayType(T.FloatType()))
def packet_samples(
    payload: pa.Array, sample_format: pa.Array, channels: pa.Array, frames: pa.Array, silent: pa.Array
) -> pa.Array:
    """Mono samples of capture packets: zeros for a silent one, else the mean over channels."""
    out = []
    for raw, fmt, ch, n, quiet in zip(*(c.to_pylist() for c in (payload, sample_format, channels, frames, silent))):
        if quiet:
            out.append(np.zeros(n or 0, np.float32))
        elif not raw:
            out.append(np.zeros(0, np.float32))
        else:
            out.append(mean_of_channels(decode_pcm(raw, fmt), max(ch or 1, 1)))
    return pa.array(out, type=pa.list_(pa.float32()))


def mean_of_channels(samples: np.ndarray, channels: int) -> np.ndarray:
    """Channels summed in order in single precision; a cut-off last frame counts missing ones as 0."""
    if channels == 1:
        return samples
    short = -len(samples) % channels
    shaped = np.concatenate([samples, np.zeros(short, np.float32)]).reshape(-1, channels)
    total = shaped[:, 0].copy()
    for c in range(1, channels):
        total += shaped[:, c]
    return total / np.float32(channels)
