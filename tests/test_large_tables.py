"""What only larger tables show: long clips, many customers, plans that small tables would hide."""

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import audio, clips, transcription
from tapeloom.plans.oracle import oracle_sql
from tapeloom.plans.queries import REGISTRY
from tapeloom.plans.spread import explode_span
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
CLIPS = "recording_id string, clip_id string, start_us bigint, end_us bigint, status string"
BLOCKS = "recording_id string, profile string, block_no bigint, first_frame bigint, total_frames bigint, samples array<float>"


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_probe_clocks_of_many_customers(spark, tmp_path):
    import shutil

    shutil.copytree(SF, tmp_path / "t")
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    far = orders.withColumn("o_custkey", F.col("o_custkey") * 997 + 355_000)
    assert far.agg(F.max("o_custkey")).first()[0] > 360_000
    far.toPandas().to_parquet(tmp_path / "t" / "far.parquet", coerce_timestamps="us")
    (tmp_path / "t" / "orders.parquet").unlink()
    (tmp_path / "t" / "far.parquet").rename(tmp_path / "t" / "orders.parquet")
    folder = str(tmp_path / "t")
    problem, n, _ = compare(spark, connect(folder), "probe_parse", REGISTRY["probe_parse"], oracle_sql()["probe_parse"], folder)
    assert problem is None and n > 0


class Loud:
    """Fails on a window that is silent, and counts what it is asked."""

    def capabilities(self):
        return transcription.Capabilities("loud")

    def transcribe(self, request):
        if not request.samples.any():
            raise ValueError("silence")
        return "raw_asr", "words"


@pytest.mark.parametrize("level", [0.0, 0.5])
def test_a_long_clip_past_the_end_fails_whole(spark, level):
    """Forty seconds: the first of its two windows could be cut."""
    frames = 40 * 16_000
    blocks = spark.createDataFrame([("r", "original", i, i * 16_000, frames, [level] * 16_000) for i in range(40)], BLOCKS)
    media = spark.createDataFrame([("r", 40_000_000, frames)], "recording_id string, duration_us bigint, frame_count bigint")
    held = spark.createDataFrame([("r", "past", 5, 40_000_001, "pending"), ("r", "whole", 0, 40_000_000, "pending")], CLIPS)
    out = {r.clip_id: r for r in transcription.transcribe(held, blocks, media, 16_000, Loud, run_key=f"loud{level}").collect()}
    assert (out["past"].provenance, out["past"].text, out["past"].error, out["past"].start_us) == (None, None, "invalid_clip_range", 5)
    want = ("raw_asr", "words words", None) if level else (None, None, "silence")
    assert (out["whole"].provenance, out["whole"].text, out["whole"].error) == want
    asked, refused = transcription.clip_audio(held, blocks, media, 16_000)
    assert {r.clip_id for r in asked.collect()} == {"whole"} and [r.clip_id for r in refused.collect()] == ["past"]


def test_touched_blocks_are_never_broadcast(spark):
    """One clip and one block row stand for any number of touched blocks; Spark's estimate knows neither."""
    blocks = spark.range(2_000).select(
        F.lit("r").alias("recording_id"), F.lit("original").alias("profile"), F.col("id").alias("block_no"), (F.col("id") * 64).alias("first_frame"),
        F.lit(128_000).cast("bigint").alias("total_frames"), F.array_repeat(F.lit(0.5).cast("float"), 64).alias("samples"),
    )
    media = spark.createDataFrame([("r", 8_000_000, 128_000)], "recording_id string, duration_us bigint, frame_count bigint")
    held = spark.createDataFrame([("r", "all", 0, 8_000_000, "pending")], CLIPS)
    pieces, _ = audio.cut_clips(held, blocks, media, 64)
    plan = final_plan(pieces).split("== Initial Plan ==")[0]
    assert pieces.count() == 2_000
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "block_no" in line]


@pytest.mark.parametrize("name", ["stereo_files", "wav_round_trip"])
def test_samples_are_never_broadcast(spark, name):
    plan = final_plan(REGISTRY[name](spark, SF).filter("sample is not null")).split("== Initial Plan ==")[0]
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert joins and all("BuildRight" in line for line in joins)


def test_runs_of_spans_stay_in_their_tasks(spark):
    one = spark.createDataFrame([(f"r{i}", 200_000) for i in range(40)], "recording_id string, n bigint")
    out = explode_span(one, F.lit(0), F.col("n") - 1, "at", ["recording_id"])
    sizes = out.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(sizes) == 4 and sum(r["count"] for r in sizes) == 40 * 200_000
    assert clips.plan_chunks(one.withColumn("duration_us", F.col("n")), 100_000).count() == 80
