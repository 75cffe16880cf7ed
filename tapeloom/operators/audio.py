"""Audio as a table of sample blocks.

``audio_blocks``: recording_id, profile, block_no, first_frame, total_frames, samples.
Blocks of a recording are numbered without holes and unique on (recording_id, profile,
block_no). Where blocks carry ``previous_sample`` and ``next_sample``, as decoded files do,
operators that need a neighbouring sample read it there and move no audio; otherwise it comes
over an equi-join on the block number. No operator gathers a recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import audio as A
from tapeloom.functions.text import artifact_path
from tapeloom.functions.timecode import div, duration_us, sample_ceil, sample_floor, scale_ceil
from tapeloom.operators.clips import RECORDING, active
from tapeloom.plans.spread import explode_span
from tapeloom.plans.stage import written
from tapeloom.schemas import PROFILES, SAMPLE_RATE_HZ
from tapeloom.sources.block_store import BlockStore

BLOCK_KEY = [RECORDING, "profile", "block_no"]
# Seconds of audio in one block; every whole rate then gives blocks that stay aligned when resampled.
BLOCK_SECONDS = 4
PEAK_BINS = 180
HALO = ("previous_sample", "next_sample")


def n_samples() -> Column:
    return F.size("samples").cast("bigint")


def with_previous_sample(blocks: DataFrame) -> DataFrame:
    """Add the last sample of the block before, null for the first block."""
    if "previous_sample" in blocks.columns:
        return blocks
    tails = blocks.select(
        RECORDING, "profile", (F.col("block_no") + 1).alias("block_no"),
        F.try_element_at("samples", F.lit(-1)).alias("previous_sample"),
    )
    return blocks.join(tails, BLOCK_KEY, "left")


def with_next_sample(blocks: DataFrame) -> DataFrame:
    """Add the first sample of the block after, null for the last block."""
    if "next_sample" in blocks.columns:
        return blocks
    heads = blocks.select(
        RECORDING, "profile", (F.col("block_no") - 1).alias("block_no"),
        F.try_element_at("samples", F.lit(1)).alias("next_sample"),
    )
    return blocks.join(heads, BLOCK_KEY, "left")


def apply_profile(blocks: DataFrame, profile: str) -> DataFrame:
    """Derive one profile from the original 16 kHz mono blocks; the originals are kept."""
    if profile not in PROFILES:
        raise ValueError(f"unknown audio profile {profile!r}")
    return _profiles(blocks, [profile])


def all_profiles(blocks: DataFrame) -> DataFrame:
    """Every profile of the original blocks, from one pass over them."""
    return _profiles(blocks, list(PROFILES))


def _profiles(blocks: DataFrame, names: list[str]) -> DataFrame:
    source = blocks.filter("profile = 'original'")
    if "voice_eq" in names:
        source = with_previous_sample(source)
    changes = {
        "original": lambda: F.col("samples"),
        "gain6_db": lambda: A.gain_6db("samples"),
        "noise_gate": lambda: A.noise_gate("samples"),
        "voice_eq": lambda: A.voice_eq("samples", "previous_sample"),
    }
    made = F.array(*[F.struct(F.lit(n).alias("profile"), changes[n]().alias("samples")) for n in names])
    wanted = [c for c in blocks.columns if c not in HALO]
    rows = source.select(*[c for c in wanted if c not in ("profile", "samples")], F.explode(made).alias("made"))
    return rows.select(*[F.col(f"made.{c}") if c in ("profile", "samples") else F.col(c) for c in wanted])


def profile_receipts(blocks: DataFrame, root: str) -> DataFrame:
    """One provenance row per derived profile of every recording."""
    derived = blocks.filter("profile <> 'original'").groupBy(RECORDING, "profile").agg(
        F.max("total_frames").alias("frame_count")
    )
    return derived.select(
        RECORDING, "profile",
        artifact_path(root, RECORDING, F.lit("original")).alias("source_path"),
        artifact_path(root, RECORDING, "profile").alias("output_path"),
        duration_us("frame_count", SAMPLE_RATE_HZ).alias("duration_us"),
        "frame_count",
    )


def resample(blocks: DataFrame, source_hz: Column | int, target_hz: int = SAMPLE_RATE_HZ) -> DataFrame:
    """Linear resampling block by block; every output sample is made by the block its left
    neighbour lies in. A last block too short to own an output sample vanishes; one in the
    middle stays as an empty block, so that numbers keep no hole. A rate of zero is an error.
    """
    src = F.lit(source_hz).cast("bigint") if isinstance(source_hz, int) else source_hz.cast("bigint")
    dst = F.lit(target_hz).cast("bigint")
    rate = F.col("__rate")
    known = F.when(src > 0, src).otherwise(F.raise_error("sample rate must be above zero").cast("bigint"))
    linked = with_next_sample(blocks.withColumn("__rate", known))
    out_total = A.resampled_length("total_frames", rate, dst)
    after = F.col("first_frame") + n_samples()
    lo = scale_ceil("first_frame", dst, rate)
    stop = F.least(scale_ceil(after, dst, rate), out_total)
    same = rate == dst
    # new names first: an alias of the same select would win over the input column
    placed = linked.select(
        RECORDING, "profile", "block_no", "first_frame", "samples", "next_sample", "__rate",
        F.when(same, F.col("first_frame")).otherwise(F.least(lo, out_total)).alias("new_first"),
        F.when(same, after).otherwise(stop).alias("new_stop"),
        out_total.alias("new_total"),
        (after < F.col("total_frames")).alias("inner"),
    )
    empty = F.col("new_stop") <= F.col("new_first")
    moved = A.resample_blocks("samples", "first_frame", "next_sample", "new_first", "new_stop", "__rate", dst)
    shaped = placed.withColumn("new_samples", moved).filter(~empty | F.col("inner"))
    return shaped.select(
        RECORDING, "profile", "block_no", F.col("new_first").alias("first_frame"), F.col("new_total").alias("total_frames"),
        F.col("new_samples").alias("samples"),
    )


def reblock(blocks: DataFrame, block_frames: int) -> DataFrame:
    """Cut to blocks of exactly ``block_frames``; each new block is put together from its pieces only."""
    size = F.lit(block_frames).cast("bigint")
    first, last = div("first_frame", size), div(F.col("first_frame") + n_samples() - 1, size)
    cut = explode_span(blocks.filter(F.size("samples") > 0), first, last, "target", [RECORDING, "profile", "block_no"])
    a = F.greatest(F.col("target") * size, F.col("first_frame"))
    b = F.least((F.col("target") + 1) * size, F.col("first_frame") + n_samples())
    piece = F.slice("samples", (a - F.col("first_frame") + 1).cast("int"), (b - a).cast("int"))
    pieces = cut.select(RECORDING, "profile", "target", "total_frames", F.struct(a.alias("at"), piece.alias("samples")).alias("p"))
    return (
        pieces.groupBy(RECORDING, "profile", F.col("target").alias("block_no"))
        .agg(F.max("total_frames").alias("total_frames"), F.array_sort(F.collect_list("p")).alias("ps"))
        .select(
            RECORDING, "profile", "block_no", (F.col("block_no") * size).alias("first_frame"), "total_frames",
            F.flatten(F.col("ps.samples")).alias("samples"),
        )
    )


def waveform_peaks(blocks: DataFrame, bins: int = PEAK_BINS, media: DataFrame | None = None, channels: int = 1) -> DataFrame:
    """Peak envelope: greatest absolute sample per bin, each block reduced before the shuffle.

    Recordings of ``media`` without a frame get the single peak 0. With ``channels`` above
    one, samples are interleaved and first_frame / total_frames count frames.
    """
    total = F.col("total_frames")
    n_bins = F.least(F.lit(max(bins, 1)).cast("bigint"), total)
    frames = div(n_samples(), channels)
    sized = blocks.filter(F.size("samples") > 0).select("*", n_bins.alias("n_bins"), frames.alias("n_frames"))
    first = div(F.col("first_frame") * F.col("n_bins"), total)
    last = div((F.col("first_frame") + F.col("n_frames") - 1) * F.col("n_bins"), total)
    per = sized.withColumn("bin", F.explode(F.sequence(first, last)))
    a = F.greatest(scale_ceil("bin", total, "n_bins"), F.col("first_frame"))
    b = F.least(scale_ceil(F.col("bin") + 1, total, "n_bins"), F.col("first_frame") + F.col("n_frames"))
    part = F.slice(
        "samples", ((a - F.col("first_frame")) * channels + 1).cast("int"), ((b - a) * channels).cast("int")
    )
    peak = F.array_max(F.transform(part, lambda x: F.abs(x)))
    peaks = per.select(RECORDING, "profile", "bin", peak.alias("peak")).groupBy(RECORDING, "profile", "bin").agg(
        F.max("peak").alias("peak")
    )
    if media is None:
        return peaks
    silent = media.filter("frame_count = 0").select(
        RECORDING, F.lit("original").alias("profile"), F.lit(0).cast("bigint").alias("bin"), A.f32(0.0).alias("peak")
    )
    return peaks.unionByName(silent)


def judged_ranges(clips: DataFrame, media: DataFrame) -> DataFrame:
    """Active clips with their sample range [first_sample, stop_sample) and why they cannot be cut, null where they can."""
    joined = active(clips).select(RECORDING, "clip_id", "start_us", "end_us").join(
        media.select(RECORDING, "frame_count"), RECORDING, "left"
    )
    frames = F.col("frame_count")
    lo = F.least(sample_floor("start_us"), frames)
    hi = F.least(sample_ceil("end_us"), frames)
    code = (
        F.when(frames.isNull(), "recording_not_prepared")
        .when(F.col("end_us") <= F.col("start_us"), "invalid_clip_range")
        .when(F.col("end_us") > duration_us(frames, SAMPLE_RATE_HZ), "invalid_clip_range")
        .when(lo >= hi, "empty_clip")
    )
    return joined.select("*", lo.alias("first_sample"), hi.alias("stop_sample"), code.alias("reason_code"))


def cut_ranges(clips: DataFrame, media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clips with their sample range [first_sample, stop_sample), rejects)."""
    judged = judged_ranges(clips, media)
    good = judged.filter("reason_code is null").select(
        RECORDING, "clip_id", "start_us", "end_us", "first_sample", "stop_sample"
    )
    return good, judged.filter("reason_code is not null").select(RECORDING, "clip_id", "reason_code")


def cut_clips(
    clips: DataFrame, blocks: DataFrame | BlockStore, media: DataFrame, block_frames: int
) -> tuple[DataFrame, DataFrame]:
    """Samples of every active clip as re-based pieces, one per block it touches, plus rejects.

    ``blocks`` must be uniform (see ``reblock``), which turns the range lookup into an
    equi-join on the block number. From a ``BlockStore`` only the files that hold a clip are read,
    and no sample is exchanged; the touched block numbers are written out first to choose the files.
    Otherwise the join is a merge join at every size: the row counts behind a generator are not in
    Spark's size estimate, and it would send all touched blocks through the driver.
    """
    ranges, rejects = cut_ranges(clips, media)
    size = F.lit(block_frames).cast("bigint")
    touched = explode_span(
        ranges, div("first_sample", size), div(F.col("stop_sample") - 1, size), "block_no", [RECORDING, "clip_id"]
    )
    if isinstance(blocks, BlockStore):
        touched = written(touched, "touched")
        blocks = blocks.holding(touched)
    else:
        touched = touched.hint("merge")
    joined = touched.join(blocks.select(RECORDING, "profile", "block_no", "first_frame", "samples"), [RECORDING, "block_no"])
    a = F.greatest("first_sample", "first_frame")
    b = F.least(F.col("stop_sample"), F.col("first_frame") + n_samples())
    piece = F.slice("samples", (a - F.col("first_frame") + 1).cast("int"), (b - a).cast("int"))
    pieces = joined.select(
        RECORDING, "clip_id", "profile", "start_us", "end_us",
        (F.col("block_no") - div("first_sample", size)).alias("piece_no"),
        (a - F.col("first_sample")).alias("first_frame"),
        (F.col("stop_sample") - F.col("first_sample")).alias("total_frames"),
        piece.alias("samples"),
    )
    return pieces, rejects


def level_stats(blocks: DataFrame) -> DataFrame:
    """Samples, share below the gate level, peak and RMS per recording and profile."""
    low = F.size(F.filter("samples", lambda x: F.abs(x) < A.f32(A.GATE_LEVEL)))
    energy = F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    per_block = blocks.filter(F.size("samples") > 0).select(
        RECORDING, "profile", n_samples().alias("n"), low.alias("low"),
        F.array_max(F.transform("samples", lambda x: F.abs(x))).alias("peak"), energy.alias("energy"),
    )
    return per_block.groupBy(RECORDING, "profile").agg(
        F.sum("n").alias("n_samples"),
        (F.sum("low") / F.sum("n")).alias("gated_share"),
        F.max("peak").alias("peak"),
        F.sqrt(F.sum("energy") / F.sum("n")).alias("rms"),
    )


def block_faults(blocks: DataFrame) -> DataFrame:
    """Blocks that break the table's contract: repeated numbers, or frames that do not line up
    with the block before."""
    once = blocks.groupBy(*BLOCK_KEY).agg(
        F.count("*").alias("copies"), F.min("first_frame").alias("first_frame"), F.max(n_samples()).alias("n"),
    )
    ends = once.select(
        RECORDING, "profile", (F.col("block_no") + 1).alias("block_no"),
        (F.col("first_frame") + F.col("n")).alias("expected"),
    )
    zero = F.lit(0).cast("bigint")
    code = (
        F.when(F.col("copies") > 1, "block_repeated")
        .when((F.col("block_no") > 0) & F.col("expected").isNull(), "block_missing_before")
        .when(F.col("first_frame") != F.coalesce("expected", zero), "block_not_contiguous")
    )
    return once.join(ends, BLOCK_KEY, "left").select(*BLOCK_KEY, code.alias("reason_code")).filter("reason_code is not null")
