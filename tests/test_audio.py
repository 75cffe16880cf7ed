"""Audio operators: literal fixtures, and independence from block size."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import spectral
from tapeloom.operators import audio, features
from tapeloom.schemas import AUDIO_BLOCKS_DDL, MEDIA_META_DDL
from tapeloom.sources import media as M
from tests.test_streaming import folder


def wav_bytes(rate, channels, bits, data, tag=1):
    align = channels * bits // 8
    form = struct.pack("<HHIIHH", tag, channels, rate, rate * align, align, bits)
    body = b"WAVEfmt " + struct.pack("<I", 16) + form + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    """The 8 kHz stereo fixture beside files that cannot be decoded."""
    root = tmp_path_factory.mktemp("media")
    frames = np.tile(np.array([10000, -10000], "<i2"), 800)
    (root / "stereo.wav").write_bytes(wav_bytes(8000, 2, 16, frames.tobytes()))
    (root / "deep.wav").write_bytes(wav_bytes(16000, 1, 24, b"\0\0\0" * 10))
    (root / "broken.WAV").write_bytes(b"not a wav")
    (root / "film.MKV").write_bytes(b"x")
    (root / "notes.txt").write_text("skip me")
    tone = (0.25 * np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)).astype("<f4")
    (root / "tone.wav").write_bytes(wav_bytes(16000, 1, 32, tone.tobytes(), tag=3))
    return str(root)


def headers(spark, store):
    files = M.scan_media(spark, store)
    name = F.regexp_extract("path", r"([^/]*)\.[^.]*$", 1)
    return M.inspect_wav(files.filter("source_kind = 'audio_file'")).withColumn("recording_id", name)


def test_scan_and_inspect(spark, store):
    kinds = {r.path.rsplit("/", 1)[1]: r.source_kind for r in M.scan_media(spark, store).collect()}
    assert kinds == {"stereo.wav": "audio_file", "deep.wav": "audio_file", "broken.WAV": "audio_file", "film.MKV": "video_file", "tone.wav": "audio_file"}
    got = {r.recording_id: r for r in headers(spark, store).collect()}
    s = got["stereo"]
    assert (s.sample_rate_hz, s.channels, s.frame_count, s.duration_us) == (8000, 2, 800, 100_000)
    assert got["broken"].error == "not_a_wav_file" and got["deep"].frame_count == 10


def test_normalize_peaks_and_cut(spark, store):
    blocks, meta, rejects = M.normalize(headers(spark, store), block_seconds=1)
    assert {r.recording_id: r.reason_code for r in rejects.collect()} == {"deep": "unsupported_integer_bits", "broken": "not_a_wav_file"}
    m = {r.recording_id: (r.duration_us, r.sample_rate_hz, r.channels, r.frame_count) for r in meta.collect()}
    assert m["stereo"] == (100_000, 16000, 1, 1600)
    stereo = blocks.filter("recording_id = 'stereo'")
    assert sum(len(r.samples) for r in stereo.collect()) == 1600
    peaks = audio.waveform_peaks(stereo, 16).collect()
    assert len(peaks) == 16 and all(p.peak == 0.0 for p in peaks)
    clips = spark.createDataFrame([("stereo", "c", 25_000, 75_000, "pending"), ("stereo", "late", 0, 100_001, "pending")],
                                  "recording_id string, clip_id string, start_us bigint, end_us bigint, status string")
    pieces, bad = audio.cut_clips(clips, blocks, meta, 16_000)
    got = pieces.collect()
    assert sum(len(r.samples) for r in got) == 800 and got[0].total_frames == 800
    assert [(r.clip_id, r.reason_code) for r in bad.collect()] == [("late", "invalid_clip_range")]


def test_wav_round_trip(spark, store):
    blocks, _, _ = M.normalize(headers(spark, store).filter("recording_id = 'tone'"), block_seconds=1)
    profiles = audio.all_profiles(blocks)
    root = folder()
    written = M.write_wav(profiles, root).collect()
    assert len(written) == 4 and all(w.byte_count == 44 + 64_000 for w in written)
    again = M.inspect_wav(M.scan_media(spark, root)).withColumn("recording_id", F.col("path"))
    out, bad = M.decode_wav(again)
    assert bad.count() == 0
    key = F.regexp_extract("recording_id", r"([^/]*)\.wav$", 1)
    by = {r.k: np.array(r.samples) for r in out.select(key.alias("k"), "samples").collect()}
    raw = by["normalized-16khz-mono"]
    prev = np.concatenate([[0], raw[:-1]])
    assert np.allclose(by["gain-6db"], np.clip(raw * 1.9952623, -1, 1), atol=1e-6)
    assert np.allclose(by["noise-gate"], np.where(abs(raw) < 0.02, raw * 0.08, raw), atol=1e-6)
    assert np.allclose(by["voice-eq"], np.clip(raw + 0.25 * (raw - 0.995 * prev), -1, 1), atol=1e-6)


SIGNAL = np.random.default_rng(5).uniform(-1, 1, 500).astype(np.float32)


def cut_into(spark, size):
    rows = [("r", "original", i // size, i, len(SIGNAL), SIGNAL[i:i + size].tolist()) for i in range(0, len(SIGNAL), size)]
    return spark.createDataFrame(rows, AUDIO_BLOCKS_DDL)


def joined(blocks):
    rows = sorted(blocks.select("first_frame", "samples").collect())
    assert [r.first_frame for r in rows] == list(np.cumsum([0] + [len(r.samples) for r in rows[:-1]]))
    return np.concatenate([np.array(r.samples, np.float32) for r in rows])


def plain_resample(x, src, dst):
    out = []
    for i in range(max(1, len(x) * dst // src)):
        lo, rest = divmod(i * src, dst)
        f = rest / dst
        out.append(np.float64(x[lo]) * (1 - f) + np.float64(x[min(lo + 1, len(x) - 1)]) * f)
    return np.array(out, np.float32)


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_block_size_does_not_matter(spark, size):
    blocks = cut_into(spark, size)
    for src, dst in ((8000, 16000), (44100, 16000), (16000, 16000), (16000, 100)):
        want = SIGNAL if src == dst else plain_resample(SIGNAL, src, dst)
        assert np.array_equal(joined(audio.resample(blocks, src, dst)), want)
    prev = np.concatenate([[0], SIGNAL[:-1]]).astype(np.float32)
    want = np.clip(SIGNAL + (SIGNAL - prev * np.float32(0.995)) * np.float32(0.25), -1, 1)
    assert np.array_equal(joined(audio.apply_profile(blocks, "voice_eq")), want.astype(np.float32))
    peaks = {r.bin: r.peak for r in audio.waveform_peaks(blocks, 180).collect()}
    assert peaks == {b: max(abs(v) for i, v in enumerate(SIGNAL.tolist()) if i * 180 // 500 == b) for b in range(180)}
    assert np.array_equal(joined(audio.reblock(blocks, 64)), SIGNAL)
    assert audio.block_faults(blocks).count() == 0


def test_block_faults(spark):
    rows = [("r", "original", 0, 0, 6, [0.0, 0.0]), ("r", "original", 2, 4, 6, [0.0, 0.0]), ("s", "original", 0, 0, 2, [0.0]),
            ("s", "original", 0, 0, 2, [0.0]), ("s", "original", 1, 5, 2, [0.0])]
    got = audio.block_faults(spark.createDataFrame(rows, AUDIO_BLOCKS_DDL)).collect()
    assert {(r.recording_id, r.block_no, r.reason_code) for r in got} == {
        ("r", 2, "block_missing_before"), ("s", 0, "block_repeated"), ("s", 1, "block_not_contiguous")}


def test_empty_recording_has_one_silent_peak(spark):
    media = spark.createDataFrame([("e", 0, 16000, 1, 0)], MEDIA_META_DDL)
    got = audio.waveform_peaks(cut_into(spark, 100).limit(0), 16, media).collect()
    assert [(r.recording_id, r.bin, r.peak) for r in got] == [("e", 0, 0.0)]


# Feature levels of a 440 Hz tone, as (mel, frame): level.
TONE = {(0, 0): 0.832764, (0, 1): 0.320756, (0, 2): -0.7123103, (10, 0): 1.185726, (10, 1): 1.199681, (10, 10): 1.1982229,
        (40, 100): 0.11720395, (79, 2999): -0.7123103}


def test_log_mel_points(spark, store):
    blocks, meta, _ = M.normalize(headers(spark, store).filter("recording_id = 'tone'"), block_seconds=1)
    clips = spark.createDataFrame([("tone", "c", 0, 1_000_000, "pending")], "recording_id string, clip_id string, start_us bigint, end_us bigint, status string")
    pieces, _ = audio.cut_clips(clips, blocks, meta, 16_000)
    mel = features.log_mel(features.assemble(pieces)).cache()
    for (m, frame), level in TONE.items():
        assert abs(features.at(mel, m, frame).collect()[0].value - level) < 1e-3
    stats = features.spectrogram_stats(mel).collect()[0]
    assert stats.n_frames == 3000 and abs(stats.min_value + 0.7123103) < 1e-3 and abs(stats.max_value - 1.2876897) < 1e-3


def test_full_length_clip_uses_its_mirrored_end():
    x = np.random.default_rng(1).uniform(-1, 1, spectral.N_SAMPLES).astype(np.float32)
    energy = spectral.power_spectrum(spectral.frame_matrix(x.astype(float))) @ spectral.mel_filters().T
    levels = np.log10(np.maximum(energy, 1e-10))
    want = (np.maximum(levels, levels.max() - 8) + 4) / 4
    assert np.allclose(spectral.log_mel(x), want, atol=1e-6)
    assert np.allclose(spectral.log_mel(np.concatenate([x, x])), want, atol=1e-6)


def test_pad_or_trim_and_reflection():
    assert list(spectral.pad_or_trim(np.array([1.0, 2, 3]), 5)) == [1, 2, 3, 0, 0]
    assert list(spectral.pad_or_trim(np.array([1.0, 2, 3]), 2)) == [1, 2]
    assert list(spectral.reflect_index(np.array([-2, -1, 0, 3, 4, 5]), 4)) == [2, 1, 0, 3, 2, 1]


def test_user_decoder(spark):
    files = spark.createDataFrame([("x", bytearray([0, 64, 128, 192]))], "recording_id string, content binary")
    out = M.decode_with(files, lambda raw: (2, 2, np.frombuffer(raw, np.uint8) / 256), block_seconds=1).collect()
    assert [(r.block_no, list(r.samples), r.rate) for r in out] == [(0, [0.125, 0.625], 2)]


def test_large_files_get_64_bit_sizes(tmp_path):
    frames = 2**31
    assert M.header_bytes(10)[:4] == b"RIFF" and M.header_bytes(frames)[:4] == b"RF64"
    path = tmp_path / "long.wav"
    with open(path, "wb") as f:
        head = M.header_bytes(frames)
        f.write(head)
        f.truncate(len(head) + frames * 4)  # a hole on disk
    found = M.read_header(str(path))
    assert (found["frame_count"], found["data_offset"]) == (frames, len(head))
