"""Clip algebra over whole clip tables.

A clip is a half-open range of source time, ``[start_us, end_us)``. Deleted clips
stay in the table; operators that speak of active clips filter them out themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.ids import derived_uuid
from tapeloom.functions.timecode import div, midpoint
from tapeloom.plans.scan import Lag, LastSeen, Lead, MaxBefore, SumBefore, ordered_scan
from tapeloom.plans.spread import FAN, explode_span
from tapeloom.plans.stage import written

RECORDING = "recording_id"
# Default width of one scan bucket in source time: ten minutes. Clips of seconds give some dozens
# of rows per summary row; starts are merged first, so even hostile input stays below 6e8 rows.
TIME_BUCKET_US = 600_000_000
# Default width of one scan bucket over list positions and sequence numbers.
ORDINAL_BUCKET = 65_536
PAIR = [RECORDING, "first_clip_id", "second_clip_id"]


def active(clips: DataFrame) -> DataFrame:
    return clips.filter(F.col("status") != "deleted")


def plan_chunks(media: DataFrame, max_us: int, fan: int = FAN) -> DataFrame:
    """Contiguous ranges of at most ``max_us`` that cover every recording exactly.

    A long recording is cut in two steps with an exchange between them, so neither
    one array nor one task has to hold all of its chunks.
    """
    if max_us <= 0:
        raise ValueError("chunks need a length above zero")
    size = F.lit(max_us).cast("bigint")
    sized = media.filter("duration_us > 0").select(RECORDING, "duration_us")
    last = div(F.col("duration_us") - 1, size)
    chunks = explode_span(sized, F.lit(0), last, "chunk_no", [RECORDING], fan)
    start = F.col("chunk_no") * size
    left = F.col("duration_us") - start
    return chunks.select(
        RECORDING,
        "chunk_no",
        start.alias("start_us"),
        (start + F.least(size, left)).alias("end_us"),
    )


def chunk_rejects(media: DataFrame) -> DataFrame:
    """Recordings no chunk can be planned for."""
    return media.filter(F.coalesce(F.col("duration_us"), F.lit(0)) <= 0).select(
        RECORDING, F.lit("invalid_chunk_duration").alias("reason_code")
    )


def compare_with_plan(clips: DataFrame, plan: DataFrame) -> DataFrame:
    """Per planned recording: ``add`` (no active clips yet), ``reuse`` (same ranges) or ``mismatch``.

    Ranges are matched as keys of an aggregate, so no recording's list is gathered.
    """
    have = active(clips).select(RECORDING, "start_us", "end_us", F.lit(1).alias("a"), F.lit(0).alias("p"))
    want = plan.select(RECORDING, "start_us", "end_us", F.lit(0).alias("a"), F.lit(1).alias("p"))
    ranges = (
        have.unionByName(want)
        .groupBy(RECORDING, "start_us", "end_us")
        .agg(F.sum("a").alias("a"), F.sum("p").alias("p"))
    )
    per = ranges.groupBy(RECORDING).agg(
        F.sum("a").alias("n_active"),
        F.sum("p").alias("n_planned"),
        F.sum(F.when(F.col("a") != F.col("p"), 1).otherwise(0)).alias("n_different"),
    )
    decision = (
        F.when(F.col("n_active") == 0, "add")
        .when(F.col("n_different") == 0, "reuse")
        .otherwise("mismatch")
    )
    return per.filter("n_planned > 0").select(RECORDING, decision.alias("decision"), "n_active", "n_planned")


def ensure_chunks(clips: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clips to use, clips to add first, recordings whose clips do not match the plan)."""
    decided = compare_with_plan(clips, plan)
    pick = decided.select(RECORDING, "decision")
    added = plan.join(pick.filter("decision = 'add'"), RECORDING, "left_semi").select(
        RECORDING,
        derived_uuid("chunk", RECORDING, "start_us", "end_us").alias("clip_id"),
        "start_us",
        "end_us",
    )
    kept = active(clips).join(pick.filter("decision = 'reuse'"), RECORDING, "left_semi")
    use = kept.select(RECORDING, "clip_id", "start_us", "end_us").unionByName(added)
    return use, added, decided.filter("decision = 'mismatch'")


def first_active_clip(clips: DataFrame) -> DataFrame:
    """The active clip that comes first in list order, per recording."""
    row = F.struct("clip_id", "start_us", "end_us", "status", "position")
    return (
        active(clips)
        .groupBy(RECORDING)
        .agg(F.min_by(row, F.struct("position", "clip_id")).alias("c"))
        .select(RECORDING, "c.*")
    )


def ensure_full_clip(clips: DataFrame, media: DataFrame) -> DataFrame:
    """First active clip of every recording, or a new one over its whole duration."""
    first = first_active_clip(clips).select(RECORDING, "clip_id", "start_us", "end_us")
    full = media.filter("duration_us > 0").select(RECORDING, "duration_us")
    return full.join(first, RECORDING, "left").select(
        RECORDING,
        F.coalesce("clip_id", derived_uuid("full", RECORDING, "duration_us")).alias("clip_id"),
        F.coalesce("start_us", F.lit(0).cast("bigint")).alias("start_us"),
        F.coalesce("end_us", "duration_us").alias("end_us"),
        F.col("clip_id").isNull().alias("is_new"),
    )


def split_clips(clips: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut active clips at ``split_at_us``: (two rows per accepted split, rejects).

    ``points`` holds (recording_id, clip_id, split_at_us). Points are taken in source order, so
    of several points inside one clip the first splits it; the others find it gone.
    """
    target = active(clips).select(RECORDING, "clip_id", "start_us", "end_us")
    asked = points.groupBy(RECORDING, "clip_id", "split_at_us").agg(F.count("*").alias("n"))
    joined = asked.join(target, [RECORDING, "clip_id"], "left")
    inside = (F.col("split_at_us") > F.col("start_us")) & (F.col("split_at_us") < F.col("end_us"))
    code = F.when(F.col("start_us").isNull(), "clip_not_active").when(~inside, "split_outside_clip")
    judged = joined.withColumn("code", code)
    first = judged.filter("code is null").groupBy(RECORDING, "clip_id").agg(F.min("split_at_us").alias("first_us"))
    judged = judged.join(first, [RECORDING, "clip_id"], "left").withColumn(
        "splits", F.col("code").isNull() & (F.col("split_at_us") == F.col("first_us"))
    )
    halves = F.array(
        F.struct(F.lit("left").alias("side"), F.col("start_us"), F.col("split_at_us").alias("end_us")),
        F.struct(F.lit("right").alias("side"), F.col("split_at_us").alias("start_us"), F.col("end_us")),
    )
    made = (
        judged.filter("splits")
        .select(RECORDING, F.col("clip_id").alias("original_clip_id"), "split_at_us", F.explode(halves).alias("h"))
        .select(RECORDING, "original_clip_id", "split_at_us", "h.side", "h.start_us", "h.end_us")
        .withColumn("clip_id", derived_uuid("split", RECORDING, "original_clip_id", "split_at_us", "side"))
    )
    refused = judged.withColumn("n", F.col("n") - F.col("splits").cast("int")).filter("n > 0")
    rejects = repeat_rows(refused, [RECORDING, "clip_id", "split_at_us"]).select(
        RECORDING, "clip_id", "split_at_us", F.coalesce("code", F.lit("clip_not_active")).alias("reason_code")
    )
    return made, rejects


def repeat_rows(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Each row of ``counted`` as often as its ``n`` says."""
    return explode_span(counted, F.lit(1), F.col("n"), "copy_no", keys)


def midpoints(clips: DataFrame) -> DataFrame:
    """A split point in the middle of every active clip."""
    return active(clips).select(RECORDING, "clip_id", midpoint("start_us", "end_us").alias("split_at_us"))


def append_clips(
    clips: DataFrame, pairs: DataFrame, width: int = TIME_BUCKET_US, most: int = ORDINAL_BUCKET
) -> tuple[DataFrame, DataFrame]:
    """Join two touching active clips, named in either order: (new clips, rejects).

    ``pairs`` holds (recording_id, first_clip_id, second_clip_id). Each pair is looked up once, in a written table. Recordings
    with at most a bucket of pairs are then taken in source order by windows over one exchange, longer ones by scans in buckets.
    """
    live = active(clips)
    one = live.select(
        RECORDING, F.col("clip_id").alias("first_clip_id"), F.col("start_us").alias("s1"), F.col("end_us").alias("e1")
    )
    two = live.select(
        RECORDING, F.col("clip_id").alias("second_clip_id"), F.col("start_us").alias("s2"), F.col("end_us").alias("e2")
    )
    joined = pairs.join(one, [RECORDING, "first_clip_id"], "left").join(
        two, [RECORDING, "second_clip_id"], "left"
    )
    forward, backward = F.col("e1") == F.col("s2"), F.col("e2") == F.col("s1")
    code = (
        F.when(F.col("first_clip_id") == F.col("second_clip_id"), "same_clip")
        .when(F.col("s1").isNull() | F.col("s2").isNull(), "clip_not_active")
        .when(~(forward | backward), "clips_not_adjacent")
    )
    forwards = F.when(code.isNull(), forward).alias("forward")
    judged = written(joined.select(*PAIR, "s1", "e1", "s2", "e2", forwards, code.alias("reason_code")), "judged-pairs")
    forward = F.col("forward")
    sound = judged.filter("reason_code is null")
    shaped = sound.select(
        RECORDING,
        F.when(forward, F.col("first_clip_id")).otherwise(F.col("second_clip_id")).alias("first_clip_id"),
        F.when(forward, F.col("second_clip_id")).otherwise(F.col("first_clip_id")).alias("second_clip_id"),
        F.least("s1", "s2").alias("start_us"),
        F.greatest("e1", "e2").alias("end_us"),
    )
    # Taken in source order, a pair whose first clip went into the pair before finds it deleted;
    # in a chain of pairs that is every second one.
    long = written(sound.groupBy(RECORDING).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(RECORDING), "long-pairs")
    if long.isEmpty():
        chained = _chained_together(shaped)
    else:
        many = shaped.join(long, RECORDING, "left_semi")
        counted = many.groupBy(*shaped.columns).agg(F.count("*").alias("n"))
        chained = _chained_together(shaped.join(long, RECORDING, "left_anti")).unionByName(_chained_in_buckets(counted, width))
    again = repeat_rows(chained.withColumn("n", F.col("n") - 1).filter("n > 0"), [RECORDING, "first_clip_id"])
    made = chained.filter("turn % 2 = 0").select(*shaped.columns)
    made = made.withColumn("clip_id", derived_uuid("append", RECORDING, "first_clip_id", "second_clip_id"))
    used = chained.filter("turn % 2 = 1").select(
        RECORDING, "first_clip_id", "second_clip_id", F.lit("clip_not_active").alias("reason_code")
    )
    rejects = judged.filter("reason_code is not null").select(
        RECORDING, "first_clip_id", "second_clip_id", "reason_code"
    )
    repeated = again.select(RECORDING, "first_clip_id", "second_clip_id", F.lit("clip_not_active").alias("reason_code"))
    return made, rejects.unionByName(used).unionByName(repeated)


def _chained_together(shaped: DataFrame) -> DataFrame:
    """Different pairs of recordings that one task may hold, with ``n``, how often they are named, and ``turn`` in their chain."""
    columns = shaped.columns
    counted = shaped.repartition(RECORDING).groupBy(*columns).agg(F.count("*").alias("n"))
    time = Window.partitionBy(RECORDING).orderBy("start_us")
    linked = counted.select("*", F.lag("second_clip_id").over(time).alias("pair_before"), F.row_number().over(time).cast("bigint").alias("rank"))
    opens = F.when(~F.coalesce(F.col("pair_before") == F.col("first_clip_id"), F.lit(False)), F.col("rank"))
    chain = F.last(opens, ignorenulls=True).over(time.rowsBetween(Window.unboundedPreceding, 0))
    return linked.select(*columns, "n", (F.col("rank") - chain).alias("turn"))


def _chained_in_buckets(counted: DataFrame, width: int) -> DataFrame:
    """The same for recordings of any length."""
    linked = ordered_scan(
        counted, [RECORDING], "start_us", [Lag("pair_before", "second_clip_id"), SumBefore("rank", F.lit(1).cast("bigint"))], width, share=True
    )
    opens = F.when(~F.coalesce(F.col("pair_before") == F.col("first_clip_id"), F.lit(False)), F.col("rank"))
    chained = ordered_scan(
        linked.select(*counted.columns, "rank", opens.alias("opens")), [RECORDING], "start_us", [LastSeen("chain", "opens")], width, share=True,
    )
    return chained.select(*counted.columns, (F.col("rank") - F.coalesce("opens", "chain")).alias("turn"))


def adjacent_pairs(clips: DataFrame, width: int = TIME_BUCKET_US) -> DataFrame:
    """Neighbouring active clips that touch, by source time (active clips never overlap)."""
    steps = [Lead("next_clip_id", "clip_id"), Lead("next_start_us", "start_us")]
    scanned = ordered_scan(
        active(clips).select(RECORDING, "clip_id", "start_us", "end_us"),
        [RECORDING], "start_us", steps, width, ties=["clip_id"], share=True,
    )
    return scanned.filter("next_start_us = end_us").select(
        RECORDING, F.col("clip_id").alias("first_clip_id"), F.col("next_clip_id").alias("second_clip_id")
    )


def _by_start(clips: DataFrame) -> DataFrame:
    """One row per (recording, start): copies of a start are merged before anything is ordered,
    so a scan bucket holds at most one row per microsecond of its width."""
    return active(clips).groupBy(RECORDING, "start_us").agg(
        F.max("end_us").alias("max_end"),
        F.max(F.struct("end_us", "clip_id")).alias("far"),
        F.min("clip_id").alias("min_clip"),
        F.count("*").alias("n_clips"),
    )


def coalesce_runs(clips: DataFrame, width: int = TIME_BUCKET_US) -> DataFrame:
    """Maximal runs of touching active clips, one row per run."""
    starts = _by_start(clips).select(RECORDING, "start_us", "max_end", "n_clips")
    ends = ordered_scan(starts, [RECORDING], "start_us", [MaxBefore("reach", "max_end")], width, share=True)
    opens = F.col("reach").isNull() | (F.col("reach") < F.col("start_us"))
    marked = ends.select(*starts.columns, F.when(opens, F.col("start_us")).alias("opens_at"))
    runs = ordered_scan(marked, [RECORDING], "start_us", [LastSeen("run_start", "opens_at")], width, share=True)
    return (
        runs.withColumn("run_start", F.coalesce("opens_at", "run_start"))
        .groupBy(RECORDING, "run_start")
        .agg(F.max("max_end").alias("end_us"), F.sum("n_clips").alias("n_clips"))
        .select(RECORDING, F.col("run_start").alias("start_us"), "end_us", "n_clips")
    )


def find_overlaps(clips: DataFrame, width: int = TIME_BUCKET_US) -> DataFrame:
    """Every active clip that overlaps one before it in (start, id) order, with one such clip.

    One row per offending clip, found from the furthest end so far; pairs are not listed.
    """
    starts = _by_start(clips).select(RECORDING, "start_us", "far", "n_clips", "min_clip")
    scanned = ordered_scan(starts, [RECORDING], "start_us", [MaxBefore("before", "far")], width, share=True)
    hit = F.col("before.end_us") > F.col("start_us")
    suspects = scanned.filter(hit | (F.col("n_clips") > 1)).select(
        RECORDING,
        "start_us",
        F.when(hit, F.col("before.clip_id")).alias("reaching_clip_id"),
        "min_clip",
    )
    rows = active(clips).select(RECORDING, "clip_id", "start_us", "end_us").join(
        suspects, [RECORDING, "start_us"]
    )
    other = F.coalesce("reaching_clip_id", F.when(F.col("clip_id") > F.col("min_clip"), F.col("min_clip")))
    return rows.select(RECORDING, "clip_id", "start_us", "end_us", other.alias("other_clip_id")).filter(
        "other_clip_id is not null"
    )


def coverage(clips: DataFrame, media: DataFrame, width: int = TIME_BUCKET_US) -> DataFrame:
    """Microseconds of each recording inside and outside its active clips, and whether they
    cover it exactly (no gap, no overlap, nothing past the end)."""
    starts = _by_start(clips).select(RECORDING, "start_us", "max_end")
    scanned = ordered_scan(starts, [RECORDING], "start_us", [MaxBefore("reach", "max_end")], width, share=True)
    reach = F.coalesce("reach", F.lit(0).cast("bigint"))
    fresh = F.greatest(F.col("max_end") - F.greatest(F.col("start_us"), reach), F.lit(0))
    per_clip = active(clips).groupBy(RECORDING).agg(
        F.sum(F.col("end_us") - F.col("start_us")).alias("clip_us")
    )
    per = scanned.groupBy(RECORDING).agg(
        F.sum(fresh).alias("covered_us"),
        F.sum(F.when(F.col("start_us") > reach, 1).otherwise(0)).alias("inner_gaps"),
        F.max("max_end").alias("last_end"),
    )
    zero = F.lit(0).cast("bigint")
    joined = media.select(RECORDING, "duration_us").join(per, RECORDING, "left").join(per_clip, RECORDING, "left")
    covered = F.coalesce("covered_us", zero)
    return joined.select(
        RECORDING,
        "duration_us",
        covered.alias("covered_us"),
        (F.col("duration_us") - covered).alias("gap_us"),
        (F.coalesce("inner_gaps", zero) + F.when(F.coalesce("last_end", zero) < F.col("duration_us"), 1).otherwise(0)).alias("n_gaps"),
        (
            (F.coalesce("last_end", zero) == F.col("duration_us"))
            & (F.coalesce("inner_gaps", zero) == 0)
            & (F.coalesce("clip_us", zero) == covered)
        ).alias("exact_cover"),
    )


def timeline(items: DataFrame, position: str, length: str, width: int = ORDINAL_BUCKET) -> DataFrame:
    """Lay items end to end in list order: start_us and end_us from running lengths."""
    laid = ordered_scan(items, [RECORDING], position, [SumBefore("start_us", length)], width)
    return laid.withColumn("end_us", F.col("start_us") + F.col(length))


def locate(clips: DataFrame, points: DataFrame, width: int = TIME_BUCKET_US) -> DataFrame:
    """The active clip that holds each ``(recording_id, point_id, at_us)``, null where none does.

    Active clips of a recording never overlap, so the last clip to start at or before
    the point is the only candidate: one merged ordered scan, no range join.
    """
    clip_rows = active(clips).select(
        RECORDING, F.col("start_us").alias("at_us"), F.lit(0).alias("is_point"), F.struct("clip_id", "end_us").alias("clip")
    )
    # points at the same time share one look-up, so a popular moment does not fill a bucket
    times = points.select(RECORDING, "at_us").distinct().select(
        RECORDING, "at_us", F.lit(1).alias("is_point"), F.lit(None).cast(clip_rows.schema["clip"].dataType).alias("clip")
    )
    merged = ordered_scan(
        clip_rows.unionByName(times), [RECORDING], "at_us",
        [LastSeen("held_by", "clip")], width, ties=["is_point"], share=True,
    )
    found = merged.filter("is_point = 1 and held_by.end_us > at_us").select(RECORDING, "at_us", "held_by.clip_id")
    return points.select(RECORDING, F.col("point_id").cast("string").alias("point_id"), "at_us").join(
        found, [RECORDING, "at_us"], "left"
    ).select(RECORDING, "point_id", "at_us", "clip_id")


def active_target_index(clips: DataFrame, width: int = ORDINAL_BUCKET) -> DataFrame:
    """Full list position for every index among active clips (moves count deleted clips too)."""
    ranked = ordered_scan(
        active(clips), [RECORDING], "position", [SumBefore("active_index", F.lit(1).cast("bigint"))], width
    )
    return ranked.select(RECORDING, "clip_id", "active_index", F.col("position").alias("target_index"))
