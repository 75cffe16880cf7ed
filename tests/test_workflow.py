"""Commands, transcription, storage and export end to end."""

import json
import os
import random
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import clips as C
from tapeloom.operators import commands as K
from tapeloom.operators import transcription as X
from tapeloom.operators.fold import Refused
from tapeloom.operators.replay import replay, state_differences
from tapeloom.operators.views import document_totals, failure_report, latest_transcript, next_recording, transcript_document
from tapeloom.schemas import AUDIO_BLOCKS_DDL, COMMANDS_DDL, MEDIA_META_DDL, PAYLOAD_COLUMNS
from tapeloom.sources.event_log import append_events, in_file_order, list_recordings, parse_manifests, read_event_log, read_events, write_event_logs, write_manifests
from tapeloom.sources.export import export_transcripts, write_report
from tests.test_replay import PlainFold, ev, frame, random_log
from tests.test_streaming import folder

A, B = "00000000-0000-4000-8000-00000000000a", "00000000-0000-4000-8000-00000000000b"


def command_frame(spark, rows):
    cols = ["recording_id", "ordinal", "kind", *PAYLOAD_COLUMNS]
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], COMMANDS_DDL)


def log_of(rec):
    return [
        ev(rec, 1, "recording_created", source_kind="audio_file", source_path="x.wav"),
        ev(rec, 2, "clip_added", clip_id="p", start_us=0, end_us=1_000_000),
        ev(rec, 3, "clip_added", clip_id="q", start_us=1_000_000, end_us=2_000_000),
        ev(rec, 4, "transcription_started", clip_id="p"),
        ev(rec, 5, "transcript_committed", clip_id="p", transcript_id="t1", provenance="raw_asr", text="raw words"),
    ]


def test_random_commands_match_one_by_one(spark):
    rng = random.Random(8)
    logs, cmds, want = [], [], set()
    for i in range(80):
        rec = f"k{i:02d}"
        log = log_of(rec)
        logs += log
        fold = PlainFold()
        for e in log:
            fold.record(e)
        batch = [r for r in random_log(rng, rec) if r["kind"] != "recording_created" or rng.random() < 0.3]
        for n, row in enumerate(batch):
            row = {**row, "ordinal": n * 3, "provenance": row["provenance"]}
            cmds.append(row)
            number = fold.next_sequence
            try:
                fold.apply(row)
                want.add((rec, row["kind"], number, "ok"))
            except Refused as stop:
                want.add((rec, row["kind"], n * 3, stop.code))
    events, rejects = K.apply_commands(frame(spark, logs), command_frame(spark, cmds))
    got = {(r.recording_id, r.kind, r.sequence, "ok") for r in events.collect()}
    got |= {(r.recording_id, r.kind, r.ordinal, r.reason_code) for r in rejects.collect()}
    assert got == want
    both = frame(spark, logs).unionByName(events)
    assert replay(both).rejects.count() == 0


def test_split_append_edit_through_commands(spark):
    log = frame(spark, log_of("r"))
    state = replay(log)
    halves, _ = C.split_clips(state.clips, spark.createDataFrame([("r", "q", 1_500_000)], "recording_id string, clip_id string, split_at_us bigint"))
    events, bad = K.apply_commands(log, K.split_commands(halves))
    assert bad.count() == 0
    log = log.unionByName(events)
    state = replay(log)
    live = C.active(state.clips).select("start_us", "end_us").collect()
    assert sorted(map(tuple, live)) == [(0, 1_000_000), (1_000_000, 1_500_000), (1_500_000, 2_000_000)]
    made, _ = C.append_clips(state.clips, halves.groupBy("recording_id").agg(F.min("clip_id").alias("first_clip_id"), F.max("clip_id").alias("second_clip_id")))
    events, bad = K.apply_commands(log, K.append_commands(made))
    assert bad.count() == 0
    log = log.unionByName(events)
    edits = spark.createDataFrame([("r", "p", "edited words")], "recording_id string, clip_id string, text string")
    moves = spark.createDataFrame([("r", "p", 2)], "recording_id string, clip_id string, target_index bigint")
    batch = K.edit_commands(edits, F.lit(0)).unionByName(K.move_commands(moves, F.lit(1)))
    events, bad = K.apply_commands(log, batch)
    assert bad.count() == 0
    state = replay(log.unionByName(events))
    assert state.rejects.count() == 0
    final = {(r.start_us, r.end_us, r.status): r.position for r in state.clips.collect()}
    assert final[(0, 1_000_000, "edited")] == 2 and (1_000_000, 2_000_000, "pending") in final and len(final) == 5
    assert latest_transcript(state.transcripts).collect()[0].text == "edited words"
    assert state.transcripts.count() == 2


def audio_fixture(spark, seconds):
    n = int(seconds * 16_000)
    blocks = [("r", "original", i, i * 16_000, n, np.zeros(min(16_000, n - i * 16_000), "f4").tolist()) for i in range(-(-n // 16_000))]
    return spark.createDataFrame(blocks, AUDIO_BLOCKS_DDL), spark.createDataFrame([("r", n * 1_000_000 // 16_000, 16_000, 1, n)], MEDIA_META_DDL)


class Picky:
    """Fails one clip, answers the others with their length."""

    def capabilities(self):
        return X.Capabilities("picky")

    def transcribe(self, request):
        if request.clip_id == "bad":
            raise RuntimeError("local worker exited")
        return "raw_asr", f" {len(request.samples)} "


def test_transcribe_retry_and_export(spark):
    blocks, meta = audio_fixture(spark, 62)
    log = frame(spark, [
        ev("r", 1, "recording_created", source_kind="audio_file", source_path="x.wav"),
        ev("r", 2, "clip_added", clip_id="long", start_us=0, end_us=61_000_000),
        ev("r", 3, "clip_added", clip_id="bad", start_us=61_000_000, end_us=61_500_000),
        ev("r", 4, "clip_added", clip_id="past", start_us=61_500_000, end_us=70_000_000),
    ])
    clips = replay(log).clips
    out = X.transcribe(clips, blocks, meta, 16_000, Picky, run_key="picky")
    got = {r.clip_id: (r.text, r.error) for r in out.collect()}
    assert got == {"long": ("480000 480000 16000", None), "bad": (None, "local worker exited"), "past": (None, "invalid_clip_range")}
    events, bad = K.apply_commands(log, X.outcome_commands(out))
    assert bad.count() == 0
    log = log.unionByName(events)
    state = replay(log)
    assert {r.clip_id: r.status for r in state.clips.collect()} == {"long": "transcribed", "bad": "failed", "past": "failed"}
    assert sorted(r.message for r in failure_report(state.recordings, state.clips).collect()) == [
        "clip bad: local worker exited", "clip past: invalid_clip_range"]
    again = X.pending_work(state.clips, state.transcripts)
    assert sorted(r.clip_id for r in again.collect()) == ["bad", "past"]
    retry = X.transcribe(state.clips.filter("clip_id = 'bad'"), blocks, meta, 16_000)
    events, _ = K.apply_commands(log, X.outcome_commands(retry))
    state = replay(log.unionByName(events))
    row = state.clips.filter("clip_id = 'bad'").collect()[0]
    assert (row.status, row.failure) == ("transcribed", None)
    pieces = transcript_document(state.clips, state.transcripts).orderBy("position").collect()
    assert [r.piece for r in pieces] == ["[clip long | raw_asr]\n480000 480000 16000", "[clip bad | raw_asr]\n[fake transcription]"]
    assert [r.byte_offset for r in pieces] == [0, len(pieces[0].piece) + 2]


def test_blank_backend_text_fails(spark):
    blocks, meta = audio_fixture(spark, 1)
    clips = spark.createDataFrame([("r", "c", 0, 0, 1_000_000, "pending")], "recording_id string, clip_id string, position bigint, start_us bigint, end_us bigint, status string")
    out = X.transcribe(clips, blocks, meta, 16_000, lambda: X.FixedTextBackend(" "), run_key="blank").collect()
    assert [(r.text, r.error) for r in out] == [(None, "empty_transcript")]


def test_steps_progress_and_stop(spark):
    clips = spark.createDataFrame([("r", f"c{i}") for i in range(20)], "recording_id string, clip_id string")
    seen = []
    done, cancelled = X.transcribe_in_steps(clips, lambda part: part, 4, lambda a, b: seen.append((a, b)), lambda: len(seen) > 2)
    assert cancelled and len(done) == 2 and seen[0] == (0, 20) and seen[-1][0] == sum(d.count() for d in done)
    done, cancelled = X.transcribe_in_steps(clips, lambda part: part, 3)
    assert not cancelled and sum(d.count() for d in done) == 20


def test_stop_ends_a_running_job(spark):
    """The backend of the second step would take minutes; the first step's clips stay."""
    clips = spark.createDataFrame([(f"r{i}", "c") for i in range(40)], "recording_id string, clip_id string")
    ddl = "recording_id string, clip_id string, error string"
    began, seen = [], []

    def slow(frames):
        for part in frames:
            time.sleep(300)
            yield part.assign(error=None)

    def run(part):
        began.append(time.time())
        return part.mapInPandas(slow, ddl) if len(began) == 2 else part.selectExpr("*", "cast(null as string) error")

    done, cancelled = X.transcribe_in_steps(
        clips, run, 4, lambda a, b: seen.append((a, b)), lambda: len(began) == 2 and time.time() > began[1] + 3)
    assert time.time() < began[1] + 30
    assert cancelled and len(done) == 1 and len(began) == 2
    assert seen == [(0, 40), (done[0].count(), 40)] and spark.range(3).count() == 3


def test_failed_clip_ends_the_steps(spark):
    clips = spark.createDataFrame([(f"r{i}", "c") for i in range(40)], "recording_id string, clip_id string")
    bad = clips.selectExpr("*", "if(recording_id = 'r7', 'bad', null) error")
    done, cancelled = X.transcribe_in_steps(bad, lambda part: part, 40, stop_on_error=True)
    assert cancelled and done[-1].filter("error = 'bad'").count() == 1
    with pytest.raises(Exception, match="no_such_column"):
        X.transcribe_in_steps(clips, lambda part: part.select("no_such_column"), 2)


def test_ids_with_one_prefix_are_cut_into_ranges(spark):
    ids = spark.range(20_000).selectExpr("concat('same-long-prefix-', lpad(id, 8, '0')) as recording_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        walked = next_recording(ids)
        rows = sorted(map(tuple, walked.collect()))
        names = [r[0] for r in rows]
        assert [r[1] for r in rows] == names[1:] + names[:1]
        ranges = ids.repartitionByRange("recording_id").groupBy(F.spark_partition_id()).count().collect()
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert len(ranges) == n and max(r["count"] for r in ranges) < 2 * 20_000 / n
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def as_uuid(name):
    return str(uuid.uuid5(uuid.NAMESPACE_OID, name))


def line(sequence, kind, **event):
    return json.dumps({"schema_version": 1, "sequence": sequence, "event": {kind: {"recording_id": A, **event}}})


def test_lines_have_types_and_places(spark):
    p, t = as_uuid("p"), as_uuid("t")
    texts = [
        line(1, "recording_created", source={"kind": "audio_file", "path": "x.wav"}),
        "",
        line(2, "clip_added", clip_id=p, source_range={"start_us": 0, "end_us": 5}),
        line(4, "transcription_started", clip_id=p),
        line(3, "clip_deleted", clip_id=p),
    ]
    bad = [
        line(1, "recording_created", source={"kind": "tape", "path": "x.wav"}),
        line(1, "recording_created", source={"kind": "audio_file"}),
        line(2, "clip_added", clip_id=p, source_range={"start_us": -1, "end_us": 5}),
        line(2, "clip_added", clip_id="p", source_range={"start_us": 0, "end_us": 5}),
        line(2, "clip_moved", clip_id=p),
        line(2, "clip_moved", clip_id=p, target_index=-1),
        line(2, "transcription_failed", clip_id=p),
        line(2, "transcript_committed", clip_id=p, transcript_id=t, provenance="nonsense", text="x"),
        line(2, "transcript_committed", clip_id=p, transcript_id=t, provenance="raw_asr"),
        line(-2, "recording_started"),
        line(2, "recording_paused"),
    ]
    root = folder()
    for rec, lines in ((A, texts), (B, [x.replace(A, B) for x in bad])):
        os.makedirs(f"{root}/recordings/{rec}")
        open(f"{root}/recordings/{rec}/events.ndjson", "w").write("\n".join(lines) + "\n")
    events, rejects = read_event_log(spark, root, line_numbers=True)
    assert sorted((r.line_no, r.sequence) for r in events.collect()) == [(1, 1), (3, 2), (4, 4), (5, 3)]
    assert sorted((r.recording_id, r.line_no, r.reason_code) for r in rejects.collect()) == [
        (B, n + 1, "invalid_event_line") for n in range(len(bad))]
    sound, late = in_file_order(events)
    assert sorted(r.sequence for r in sound.collect()) == [1, 2]
    assert [(r.line_no, r.sequence, r.kind) for r in late.collect()] == [(4, 4, "transcription_started")]
    listed = list_recordings(spark, root)
    assert listed.recordings.count() == 0 and {r.reason_code for r in listed.rejects.collect()} == {"event_out_of_order", "invalid_event_line"}


def test_many_small_logs_are_listed_and_read_in_few_tasks(spark, tmp_path):
    """As many tasks as files would grow the listing, a task per 32 files the reading."""
    import uuid

    ids = sorted(str(uuid.UUID(int=i)) for i in range(300))
    for one in ids:
        folder = tmp_path / "recordings" / one
        folder.mkdir(parents=True)
        (folder / "events.ndjson").write_text("".join(
            f'{{"schema_version":1,"sequence":{n},"event":{{"{kind}":{{"recording_id":"{one}"}}}}}}\n' for n, kind in ((1, "recording_started"), (3, "recording_saved"))
        ))
    context = spark.sparkContext
    context.setJobGroup("small-logs", "small logs")
    events, bad = read_event_log(spark, str(tmp_path), line_numbers=True)
    rejects = in_file_order(events)[1]
    assert sorted((r.recording_id, r.line_no, r.sequence) for r in rejects.collect()) == [(one, 2, 3) for one in ids]
    status = context.statusTracker()
    stages = [s for job in status.getJobIdsForGroup("small-logs") for s in status.getJobInfo(job).stageIds]
    tasks = [info.numTasks for s in stages if (info := status.getStageInfo(s))]
    context.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(tasks)[-2] < 9 and sorted(tasks)[-1] <= 256


def test_store_round_trip(spark):
    root = folder()
    rows = log_of(A) + log_of(B) + [ev(B, 6, "clip_deleted", clip_id="q"), ev(B, 7, "recording_failed", reason='said "no"\n')]
    for row in rows:  # ids in files are UUIDs
        row.update({name: as_uuid(row[name]) for name in ("clip_id", "transcript_id") if row[name]})
    log = frame(spark, rows)
    write_event_logs(log, root)
    os.makedirs(f"{root}/recordings/cache")
    open(f"{root}/recordings/cache/events.ndjson", "w").write("junk\n")
    with open(f"{root}/recordings/{A}/events.ndjson", "a") as f:
        f.write("\n   \n")
    events, bad = read_event_log(spark, root)
    assert bad.count() == 0 and state_differences(events, log).count() == 0
    state = replay(log)
    write_manifests(state, root)
    only = "00000000-0000-4000-8000-00000000000c"
    text = open(f"{root}/recordings/{A}/manifest.json").read()
    for rec, body in ((only, text.replace(A, only)), ("00000000-0000-4000-8000-00000000000d", text), ("00000000-0000-4000-8000-00000000000e", text.replace('"schema_version":1', '"schema_version":2'))):
        os.makedirs(f"{root}/recordings/{rec}")
        open(f"{root}/recordings/{rec}/manifest.json", "w").write(body)
    broken = "00000000-0000-4000-8000-00000000000f"
    os.makedirs(f"{root}/recordings/{broken}")
    open(f"{root}/recordings/{broken}/events.ndjson", "w").write('{"schema_version":1,"sequence":1,"event":{}}\n')
    listed = list_recordings(spark, root)
    assert [r.recording_id for r in listed.recordings.collect()] == [A, B, only]
    assert {(r.recording_id[-1], r.reason_code) for r in listed.rejects.collect()} == {
        ("d", "wrong_recording"), ("e", "unsupported_schema"), ("f", "invalid_event_line")}
    assert state_differences(listed.clips.filter(F.col("recording_id") != only), state.clips).count() == 0
    assert listed.clips.filter(F.col("recording_id") == only).count() == 2
    last = {r.recording_id: r.last_sequence for r in listed.recordings.collect()}
    assert last[only] == last[A] == state.recordings.filter(F.col("recording_id") == A).first().last_sequence
    old = text.replace(f',"last_sequence":{last[A]}', "")
    known, bad = parse_manifests(spark.createDataFrame([(A, old)], "owner string, value string"))
    assert old != text and bad.count() == 0 and known.recordings.first().last_sequence is None
    table = folder() + "/events"
    append_events(log, table)
    assert state_differences(read_events(spark, table), log).count() == 0
    reports, missing = export_transcripts(state.recordings, state.clips, state.transcripts, root)
    got = {r.recording_id: r for r in reports.collect()}
    body = open(f"{root}/recordings/{A}/transcripts/transcript.txt").read()
    assert body == f"[clip {as_uuid('p')} | raw_asr]\nraw words\n" and got[A].byte_count == len(body) - 1 and missing.count() == 0
    for form in ("json", "csv", "text"):
        write_report(reports, f"{root}/report-{form}", form)
    assert spark.read.json(f"{root}/report-json").count() == 2
    with pytest.raises(ValueError):
        write_report(reports, root, "xml")


def test_several_splits_and_repeated_pairs(spark):
    clips = spark.createDataFrame([("r", "a", 0, 100, "pending"), ("r", "b", 100, 200, "pending")], "recording_id string, clip_id string, start_us bigint, end_us bigint, status string")
    points = spark.createDataFrame([("r", "a", 60), ("r", "a", 30), ("r", "a", 30), ("r", "a", 100), ("r", "x", 1)], "recording_id string, clip_id string, split_at_us bigint")
    made, bad = C.split_clips(clips, points)
    assert sorted((r.start_us, r.end_us) for r in made.collect()) == [(0, 30), (30, 100)]
    assert sorted((r.split_at_us, r.reason_code) for r in bad.collect()) == [
        (1, "clip_not_active"), (30, "clip_not_active"), (60, "clip_not_active"), (100, "split_outside_clip")]
    pairs = spark.createDataFrame([("r", "a", "b"), ("r", "b", "a")], "recording_id string, first_clip_id string, second_clip_id string")
    made, bad = C.append_clips(clips, pairs)
    assert made.count() == 1 and [r.reason_code for r in bad.collect()] == ["clip_not_active"]


def test_backend_is_asked_once(spark, tmp_path):
    calls = str(tmp_path / "calls")

    class Counting:
        def capabilities(self):
            return X.Capabilities("counting")

        def transcribe(self, request):
            with open(calls, "a") as f:
                f.write("x")
            return "raw_asr", "said"

    blocks = spark.createDataFrame([("r", "original", i, i * 160, 640, [0.1] * 160) for i in range(4)], AUDIO_BLOCKS_DDL)
    meta = spark.createDataFrame([("r", 40_000, 16_000, 1, 640)], MEDIA_META_DDL)
    clips = spark.createDataFrame([("r", f"c{i}", i * 10_000, i * 10_000 + 10_000, "pending") for i in range(4)], "recording_id string, clip_id string, start_us bigint, end_us bigint, status string")
    out = X.transcribe(clips, blocks, meta, 160, Counting, run_key="counting")
    assert X.outcome_commands(out).count() == 8 and out.count() == 4
    assert len(open(calls).read()) == 4


def test_document_offsets_do_not_depend_on_buckets(spark):
    clips = spark.createDataFrame([("r", f"c{i}", i, "transcribed") for i in range(10)], "recording_id string, clip_id string, position bigint, status string")
    texts = spark.createDataFrame([("r", i, f"t{i}", f"c{i}", "raw_asr", f" w{i}　") for i in range(10)], "recording_id string, version_no bigint, transcript_id string, clip_id string, provenance string, text string")
    whole = sorted(transcript_document(clips, texts).collect(), key=lambda r: r.position)
    assert whole == sorted(transcript_document(clips, texts, 3).collect(), key=lambda r: r.position)
    body = "\n\n".join(r.piece for r in whole).encode()
    assert len(whole) == 10 and all(body[r.byte_offset :].startswith(r.piece.encode()) for r in whole)
    total = document_totals(transcript_document(clips, texts, 3)).collect()
    assert [(r.transcript_count, r.byte_count) for r in total] == [(10, len(body))]


class _Says:
    def __init__(self, text):
        self.text = text

    def capabilities(self):
        return X.Capabilities(self.text)

    def transcribe(self, request):
        return "raw_asr", self.text


def test_another_factory_is_another_backend(spark):
    ddl = "recording_id string, clip_id string, window_no bigint, clip_start_us bigint, audio_path string, samples array<float>"
    windows = spark.createDataFrame([("r", "c", 0, 0, "p", [0.0])], ddl)
    for text in ("first", "second", "first"):
        assert [r.text for r in X.call_backend(windows, lambda text=text: _Says(text)).collect()] == [text]
