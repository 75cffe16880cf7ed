"""Logs that one task may hold: what is written for them, and where their rows are cut."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import tapeloom.operators.commands as commands_module
import tapeloom.operators.replay as replay_module
import tapeloom.operators.short_logs as short_logs
import tapeloom.plans.stage as stage
from tapeloom.operators import clips, commands
from tapeloom.operators.replay import replay
from tapeloom.plans.queries import REGISTRY
from tapeloom.plans.stage import written
from tapeloom.schemas import EVENT_COLUMNS, EVENTS_DDL, PAYLOAD_COLUMNS

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([tuple(row.get(c) for c in EVENT_COLUMNS) for row in rows], EVENTS_DDL)


def ev(rec, seq, kind, **payload):
    return {**dict.fromkeys(PAYLOAD_COLUMNS), **payload, "recording_id": rec, "sequence": seq, "kind": kind, "schema_version": 1}


@pytest.fixture
def stems(monkeypatch):
    """Names of the tables written meanwhile."""
    made = []

    def kept(df, stem, *more):
        made.append(stem)
        return written(df, stem, *more)

    monkeypatch.setattr(replay_module, "written", kept)
    monkeypatch.setattr(commands_module, "written", kept)
    return made


def size(folder):
    return sum(os.path.getsize(os.path.join(at, n)) for at, _, names in os.walk(folder) for n in names if n.endswith(".parquet"))


def test_batches_are_cut_where_logs_end(monkeypatch):
    monkeypatch.setattr(short_logs, "TOGETHER", 5)
    ids = [f"r{i}" for i, n in enumerate([3, 1, 9, 2, 2, 6]) for _ in range(n)]
    given = [pa.record_batch({"recording_id": ids[i : i + 4]}) for i in range(0, len(ids), 4)]
    tables = [t.column("recording_id").to_pylist() for t in short_logs.whole_logs(iter(given))]
    assert [x for t in tables for x in t] == ids and len(tables) > 1
    assert all(a[-1] != b[0] for a, b in zip(tables, tables[1:]))


def test_splits_are_stored_once(spark, tmp_path, monkeypatch):
    """command_splits: of commands no table but the judged ones is left, and no second copy of their ids."""
    monkeypatch.setattr(stage, "fresh_folder", lambda spark, stem: f"{tmp_path}/{stem}-{os.urandom(4).hex()}")
    log = spark.range(4_000).select(
        F.expr("cast(id div 20 as string)").alias("recording_id"), F.expr("id % 20 + 2").alias("sequence"), F.lit("clip_added").alias("kind"),
        F.expr("concat('c', id % 20)").alias("clip_id"), F.expr("id % 20 * 10").alias("start_us"), F.expr("id % 20 * 10 + 10").alias("end_us"),
    )
    made = log.select("recording_id").distinct().select(
        "recording_id", F.lit(1).cast("bigint").alias("sequence"), F.lit("recording_created").alias("kind"), F.lit("audio_file").alias("source_kind"), F.lit("x").alias("source_path"),
    )
    whole = log.unionByName(made, allowMissingColumns=True).withColumn("schema_version", F.lit(1)).withColumns(
        {n: F.lit(None).cast("string") for n in ("transcript_id", "provenance", "text", "reason")} | {"target_index": F.lit(None).cast("bigint")}
    ).select(*EVENT_COLUMNS)
    whole.write.parquet(f"{tmp_path}/given")
    whole = spark.read.parquet(f"{tmp_path}/given")
    held = whole.filter("kind = 'clip_added'").select("recording_id", "clip_id", "start_us", "end_us", F.lit("pending").alias("status"))
    asked = commands.split_commands(clips.split_clips(held, clips.midpoints(held))[0])
    before = size(tmp_path)
    events, refused = commands.apply_commands(whole, asked, ordinal_width=commands.TIME_ORDINALS)
    left = size(tmp_path) - before
    assert events.count() == 12_000 and refused.count() == 0
    assert not [n for n in os.listdir(tmp_path) if n.startswith("commands-")]
    events.write.parquet(f"{tmp_path}/events")
    assert left < 1.25 * size(f"{tmp_path}/events")


def test_a_tail_and_its_state_come_from_two_passes(spark, stems):
    """replay_tail: no table of accepted records or list changes is made, and what follows is what one replay of all gives."""
    log = [ev("r", 1, "recording_created", source_kind="audio_file", source_path="x")]
    log += [ev("r", 2 + k, "clip_added", clip_id=f"c{k}", start_us=10 * k, end_us=10 * k + 10) for k in range(3)]
    log += [ev("r", 5, "clip_moved", clip_id="c2", target_index=0), ev("r", 6, "transcription_started", clip_id="c1")]
    late = [ev("r", 7, "transcription_failed", clip_id="c1", reason="broke"), ev("r", 8, "clip_deleted", clip_id="c0"),
            ev("r", 9, "clip_added", clip_id="n", start_us=0, end_us=10), ev("r", 10, "clip_moved", clip_id="n", target_index=1),
            ev("r", 11, "transcription_started", clip_id="c2"),
            ev("r", 12, "transcript_committed", clip_id="c2", transcript_id="t", provenance="user_edit", text="w"), ev("r", 13, "clip_moved", clip_id="n", target_index=9)]
    other = [ev("q", 1, "recording_created", source_kind="audio_file", source_path="y"), ev("q", 2, "clip_added", clip_id="a", start_us=0, end_us=5)]
    every = ("recordings", "clips", "transcripts")
    first = replay(frame(spark, log + other), tables=every)
    then = replay(frame(spark, late), snapshot=first, tables=every)
    whole = replay(frame(spark, log + late + other), tables=every)
    for name in (*every, "rejects"):
        assert sorted(map(repr, getattr(then, name).collect())) == sorted(map(repr, getattr(whole, name).collect()))
    assert [tuple(r) for r in then.clips.filter("recording_id = 'r'").orderBy("position").select("clip_id", "status", "failure").collect()] == [
        ("c2", "edited", None), ("n", "pending", None), ("c0", "deleted", None), ("c1", "failed", "broke"),
    ]
    assert [(r.recording_id, r.sequence, r.reason_code) for r in then.rejects.collect()] == [("r", 13, "invalid_clip_index")]
    assert not {"accepted", "list-changes", "picked", "overlapping"} & set(stems) and stems.count("seen") == 3


@pytest.mark.parametrize("name,passes", [("moved_clips", 1), ("replay_full_rejects", 1), ("replay_full_clips", 1), ("replay_full_transcripts", 1)])
def test_a_query_judges_its_log_once(spark, stems, name, passes):
    """No second look at the log for list changes, repeated numbers or overlaps, and no join of the log with its stops."""
    found = REGISTRY[name](spark, SF)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert stems.count("seen") == passes and not {"list-changes", "repeated", "picked", "overlapping", "islands"} & set(stems)
    assert "stop_sequence" not in plan or "LeftOuter" not in plan


def test_refused_commands_are_judged_in_the_same_pass(spark, stems):
    """command_log: commands are neither numbered in one table, checked in others and judged in a third."""
    found = REGISTRY["command_log"](spark, SF)
    assert found.filter("reason_code is not null").count() > 0
    assert stems.count("tentative") == 1 and not {"seen", "overlapping", "conflicts", "judged", "known-clips"} & set(stems)
