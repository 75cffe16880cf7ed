"""The supplied tables read as recordings, clips, versions and audio.

They hold no audio, so each operator is exercised on a stand-in: an order or a user is a
recording, its line items, events or turns are clips, an embedding vector is a block of
64 samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.ids import derived_uuid
from tapeloom.operators.clips import timeline
from tapeloom.plans.scan import Lag, Lead, SumBefore, SumOfKey, ordered_scan

RECORDING = "recording_id"
VECTOR = 64


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def text_id(column: str) -> F.Column:
    return F.col(column).cast("string").alias(RECORDING)


def micros(column: str) -> F.Column:
    """Microseconds of a zone-less timestamp since 1970, whatever the session's time zone."""
    return F.expr(f"(cast({column} as timestamp_ntz) - timestamp_ntz'1970-01-01 00:00:00') div interval '0.000001' second")


def conversation_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as versions: two turns in a row are two versions of one clip."""
    role = F.col("role")
    provenance = F.when(role == "user", "user_edit").when(role == "assistant", "raw_asr").otherwise("imported")
    slot = F.expr("turn div 2")
    return read(spark, folder, "conversations").select(
        text_id("conv_id"),
        F.col("turn").alias("version_no"),
        F.concat_ws("-", "conv_id", "turn").alias("transcript_id"),
        F.concat_ws("-", F.col("conv_id"), slot).alias("clip_id"),
        provenance.alias("provenance"),
        "text",
        slot.alias("position"),
    )


def conversation_clips(versions: DataFrame) -> DataFrame:
    """Clips of the turns; one that holds a system turn counts as deleted."""
    return versions.groupBy(RECORDING, "clip_id", "position").agg(
        F.when(F.max(F.col("provenance") == "imported"), "deleted").otherwise("transcribed").alias("status")
    )


def turn_clips(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn as a clip at its own position; system turns are deleted clips."""
    return read(spark, folder, "conversations").select(
        text_id("conv_id"), F.concat_ws("-", "conv_id", "turn").alias("clip_id"), F.col("turn").alias("position"),
        F.when(F.col("role") == "system", "deleted").otherwise("pending").alias("status"),
    )


def conversation_log(spark: SparkSession, folder: str, turns: DataFrame | None = None) -> DataFrame:
    """A log per conversation: creation, then per turn add, begin, commit.

    A system turn skips its begin event's right to commit: it deletes the clip first, which
    stops the log there.
    """
    turns = read(spark, folder, "conversations") if turns is None else turns
    role = F.col("role")
    none = F.lit(None)
    start = F.col("turn") * 1_000_000
    base = F.col("turn") * 3 + 2
    clip, version = F.concat_ws("-", "conv_id", "turn"), F.concat_ws("-", F.lit("v"), "conv_id", "turn")
    provenance = F.when(role == "user", "user_edit").otherwise("raw_asr")
    middle = F.when(role == "system", "clip_deleted").otherwise("transcription_started")

    def event(sequence, kind, clip_id=none, version_id=none, s=none, e=none, prov=none, text=none, sk=none, sp=none):
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(
            sequence.cast("bigint").alias("sequence"), kind.alias("kind"), clip_id.cast("string").alias("clip_id"),
            version_id.cast("string").alias("transcript_id"), s.cast("bigint").alias("start_us"), e.cast("bigint").alias("end_us"),
            none.cast("bigint").alias("target_index"), prov.cast("string").alias("provenance"), text.cast("string").alias("text"),
            none.cast("string").alias("reason"), sk.cast("string").alias("source_kind"), sp.cast("string").alias("source_path"),
            F.lit(1).alias("schema_version"),
        )

    per_turn = turns.select(text_id("conv_id"), F.explode(F.array(
        event(base, "clip_added", clip, s=start, e=start + 1_000_000),
        event(base + 1, middle, clip),
        event(base + 2, "transcript_committed", clip, version, prov=provenance, text=F.col("text")),
    )).alias("e"))
    created = turns.filter("turn = 0").select(text_id("conv_id"), event(
        F.lit(1), "recording_created", sk=F.lit("audio_file"), sp=F.concat(F.lit("c"), F.col("conv_id"))
    ).alias("e"))
    return per_turn.unionByName(created).select(RECORDING, "e.*")


def uuid_log(spark: SparkSession, folder: str) -> DataFrame:
    """The conversation logs under ids that folders may have; ``line`` shuffles two lines of every fifth."""
    log = conversation_log(spark, folder)
    swapped = F.when(F.col("sequence") == 3, 4).when(F.col("sequence") == 4, 3).otherwise(F.col("sequence"))
    fifth = F.expr("cast(recording_id as bigint) % 5 = 1")
    log = log.withColumn("line", F.when(fifth, swapped).otherwise(F.col("sequence")).cast("bigint"))
    for name in (RECORDING, "clip_id", "transcript_id"):
        log = log.withColumn(name, F.when(F.col(name).isNotNull(), derived_uuid("log", name)))
    return log


def user_events(spark: SparkSession, folder: str) -> DataFrame:
    """Event rows as life-cycle records of one recording per user, numbered by event id."""
    kind = F.col("event_type")
    return read(spark, folder, "events").select(
        text_id("user_id"),
        F.col("event_id").alias("sequence"),
        F.when(kind == "signup", "recording_created").when(kind == "view", "recording_started")
        .when(kind == "click", "recording_saved").when(kind == "error", "recording_failed")
        .otherwise("clip_added").alias("kind"),
        F.when(kind == "purchase", F.col("event_id").cast("string")).alias("clip_id"),
        F.when(kind == "purchase", F.col("event_id") * 1_000_000).alias("start_us"),
        F.when(kind == "purchase", F.col("event_id") * 1_000_000 + 1_000_000).alias("end_us"),
        F.col("props").alias("reason"),
        F.lit("microphone_recording").alias("source_kind"),
        F.concat(F.lit("u"), F.col("user_id")).alias("source_path"),
    )


def user_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Events as clips laid end to end; value is the length in seconds, a hundredth at least."""
    items = read(spark, folder, "events").select(
        text_id("user_id"),
        F.col("event_id").cast("string").alias("clip_id"),
        F.col("event_id").alias("position"),
        (F.greatest(F.round(F.col("value") * 100).cast("bigint"), F.lit(1)) * 10_000).alias("length_us"),
        F.when(F.col("event_type") == "error", "failed").otherwise("pending").alias("status"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("failure"),
    )
    return timeline(items, "position", "length_us").drop("length_us")


def order_clips(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as clips of their order: from the ship date, as many days as the quantity."""
    start = micros("l_shipdate")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    flag = F.col("l_returnflag")
    return read(spark, folder, "lineitem").select(
        text_id("l_orderkey"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", cents).alias("clip_id"),
        start.alias("start_us"),
        (start + F.col("l_quantity").cast("bigint") * 86_400_000_000).alias("end_us"),
        F.when(flag == "A", "failed").when(flag == "N", "pending").otherwise("transcribed").alias("status"),
        F.col("l_linestatus").alias("line_status"),
    )


def order_media(spark: SparkSession, folder: str) -> DataFrame:
    """Duration of an order: a second per unit ordered; frames at 16 kHz."""
    return read(spark, folder, "lineitem").groupBy(text_id("l_orderkey")).agg(
        (F.sum("l_quantity").cast("bigint") * 1_000_000).alias("duration_us"),
        (F.sum("l_quantity").cast("bigint") * 16_000).alias("frame_count"),
    )


def label_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors of one label in id order as the 64-sample blocks of one recording."""
    one = F.lit(1).cast("bigint")
    vectors = read(spark, folder, "embeddings").select(text_id("label"), "vec_id", "embedding")
    ranked = ordered_scan(vectors, [RECORDING], "vec_id", [
        SumBefore("block_no", one), SumOfKey("n_blocks", one),
        Lag("previous_sample", F.element_at("embedding", -1)), Lead("next_sample", F.element_at("embedding", 1)),
    ], 4096)
    return ranked.select(
        RECORDING, F.lit("original").alias("profile"), "block_no", (F.col("block_no") * VECTOR).alias("first_frame"),
        (F.col("n_blocks") * VECTOR).alias("total_frames"), F.col("embedding").alias("samples"), "previous_sample", "next_sample",
    )


# Samples that one line item stands for.
LINE_BLOCK = 64


def line_blocks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, media): a recording per line number, its items in key order, 64 samples each."""
    one = F.lit(1).cast("bigint")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    lines = read(spark, folder, "lineitem").select(
        text_id("l_linenumber"), "l_orderkey", F.col("l_partkey").cast("bigint").alias("part"), F.col("l_suppkey").cast("bigint").alias("supp"), cents.alias("cents")
    )
    ranked = ordered_scan(
        lines, [RECORDING], "l_orderkey", [SumBefore("block_no", one), SumOfKey("n", one)], 65_536, ties=["part", "supp", "cents"]
    )
    steps = F.sequence(F.lit(0), F.lit(LINE_BLOCK - 1))
    wave = F.transform(steps, lambda i: (F.pmod(F.col("cents") + i * F.col("part"), F.lit(128)) / 64 - 1).cast("float"))
    blocks = ranked.select(
        RECORDING, F.lit("original").alias("profile"), "block_no", (F.col("block_no") * LINE_BLOCK).alias("first_frame"),
        (F.col("n") * LINE_BLOCK).alias("total_frames"), wave.alias("samples"),
    )
    frames = F.count("*") * LINE_BLOCK
    media = lines.groupBy(RECORDING).agg(
        F.expr(f"count(*) * {LINE_BLOCK} * 1000000 div 16000").alias("duration_us"), frames.alias("frame_count")
    )
    return blocks, media


def label_media(spark: SparkSession, folder: str) -> DataFrame:
    frames = F.count("*") * VECTOR
    return read(spark, folder, "embeddings").groupBy(text_id("label")).agg(
        F.expr(f"count(*) * {VECTOR} * 1000000 div 16000").alias("duration_us"), frames.alias("frame_count")
    )
