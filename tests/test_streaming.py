"""Streams against their batch twins."""

import random
import tempfile
import time

import numpy as np

from tapeloom.operators.replay import replay
from tapeloom.schemas import EVENTS_DDL, PACKETS_DDL, struct_type
from tapeloom.streaming.capture import NO_FRAMES, assemble_capture, capture_lifecycle, decode_packets, placed_stream, read_capture_stream
from tapeloom.streaming.level import level_by_window
from tapeloom.streaming.replay import Snapshots, command_sink, read_snapshots, replay_stream, snapshot_sink
from tests.test_replay import ev, frame, random_log

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def drain(stream, name, mode="append", rows=None):
    """Run to the end of the input; a stream with timers never idles, so it is stopped at ``rows`` rows."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", folder())
    if rows is None:
        q = writer.trigger(availableNow=True).start()
        assert q.awaitTermination(90)
    else:
        q = writer.start()
        end = time.time() + 60
        while q.isActive and time.time() < end and spark.table(name).count() < rows:
            time.sleep(0.5)
        q.stop()
    assert q.exception() is None
    return spark.table(name)


def test_stream_agrees_with_batch_replay(spark):
    rng = random.Random(11)
    rows = []
    for i in range(25):
        seen = set()
        rows += [r for r in random_log(rng, f"s{i:02d}") if not (r["sequence"] in seen or seen.add(r["sequence"]))]
    source, judged, snaps = folder(), folder(), folder()
    for low, high in ((0, 12), (12, 30), (30, 999)):
        part = [r for r in rows if low <= r["sequence"] < high]
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(struct_type(EVENTS_DDL)).option("maxFilesPerTrigger", 1).parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    q = replay_stream(stream).writeStream.foreachBatch(snapshot_sink(judged, snaps, compact_every=2)).option(
        "checkpointLocation", folder()).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert q.exception() is None
    batch, live = replay(frame(spark, rows)), read_snapshots(spark, snaps)
    for name in ("recordings", "clips", "transcripts"):
        a, b = getattr(batch, name), getattr(live, name)
        assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.select(*a.columns).collect()}, name
    out = spark.read.parquet(judged)
    got = out.filter("outcome not in ('accepted', 'log_closed')").select("recording_id", "sequence", "outcome")
    assert {tuple(r) for r in got.collect()} == {
        tuple(r) for r in batch.rejects.select("recording_id", "sequence", "reason_code").collect()
    }


def test_command_batches_can_be_repeated(spark):
    made = dict(source_kind="audio_file", source_path="x")
    batches = [
        [ev("r", 1, "create_recording", **made), ev("r", 2, "add_clip", clip_id="a", start_us=0, end_us=10), ev("s", 1, "add_clip", clip_id="z", start_us=0, end_us=1)],
        [ev("r", 1, "add_clip", clip_id="b", start_us=5, end_us=15), ev("r", 2, "delete_clip", clip_id="a"), ev("r", 3, "add_clip", clip_id="b", start_us=5, end_us=15)],
        [ev("r", 1, "move_clip", clip_id="b", target_index=0), ev("t", 1, "create_recording", **made)],
        [ev("r", 1, "begin_transcription", clip_id="b"), ev("r", 2, "commit_transcript", clip_id="b", transcript_id="t", provenance="raw_asr", text="x")],
    ]
    log, snaps = folder(), folder()
    sink = command_sink(log, snaps, compact_every=2)

    def state():
        now = read_snapshots(spark, snaps)
        return [sorted(map(tuple, t.collect())) for t in (now.recordings, now.clips, now.transcripts)]

    for number, rows in enumerate(batches):
        asked = frame(spark, rows).withColumnRenamed("sequence", "ordinal").drop("schema_version")
        sink(asked, number)
        once = state()
        sink(asked, number)  # as after a crash before the batch was committed
        assert state() == once
    assert once[0] == [("r", "audio_file", "x", "created", None, 7), ("t", "audio_file", "x", "created", None, 1)]
    assert once[1] == [("r", "a", 1, 0, 10, "deleted", None), ("r", "b", 0, 5, 15, "transcribed", None)]
    assert once[2] == [("r", 7, "t", "b", "raw_asr", "x")]
    refused = spark.read.parquet(f"{log}/refused").collect()
    assert {(r.recording_id, r.batch, r.ordinal, r.reason_code) for r in refused} == {("s", 0, 1, "recording_not_found"), ("r", 1, 1, "clip_overlaps")}
    events = spark.read.schema(EVENTS_DDL + ", batch int, bucket int").parquet(f"{log}/events")
    again = replay(events)
    assert [sorted(map(tuple, t.collect())) for t in (again.recordings, again.clips, again.transcripts)] == once
    assert again.rejects.count() == 0 and sorted(Snapshots(snaps)._folders("clips")) == ["base=2", "version=3"]


def test_gap_is_rejected_or_held(spark):
    rows = [ev("r", 1, "recording_created", source_kind="audio_file", source_path="x"),
            ev("r", 2, "recording_started"), ev("r", 4, "recording_failed", reason="late"), ev("r", 3, "recording_saved"),
            ev("g", 1, "recording_created", source_kind="audio_file", source_path="x"), ev("g", 3, "recording_saved")]
    source = folder()
    for part in (rows[:3], rows[3:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(struct_type(EVENTS_DDL)).option("maxFilesPerTrigger", 1).parquet(source)
    strict = drain(replay_stream(stream), "strict").filter("recording_id = 'r'").collect()
    assert {r.sequence: r.outcome for r in strict} == {1: "accepted", 2: "accepted", 4: "event_out_of_order", 3: "log_closed"}
    held = drain(replay_stream(stream, patience_ms=2_000), "held", rows=6).collect()
    assert {(r.recording_id, r.sequence): r.outcome for r in held} == {
        ("r", 1): "accepted", ("r", 2): "accepted", ("r", 3): "accepted", ("r", 4): "invalid_recording_transition",
        ("g", 1): "accepted", ("g", 3): "event_out_of_order",
    }


def test_poison_record_is_a_reject(spark):
    rows = [ev("p", 1, "recording_created", source_kind="audio_file", source_path="x"), ev("p", 2, "no_such_kind"), ev("p", 3, "recording_started"),
            ev("q", 1, "recording_created", source_kind="tape", source_path="x"), ev("n", None, "recording_created", source_kind="audio_file", source_path="x"),
            ev("m", 1, "recording_created", source_kind="audio_file", source_path="x"), ev("m", 2, "clip_added", clip_id="c", start_us=-5, end_us=10)]
    source = folder()
    frame(spark, rows).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(struct_type(EVENTS_DDL)).parquet(source)
    got = drain(replay_stream(stream), "poison").collect()
    assert {(r.recording_id, r.sequence): r.outcome for r in got} == {
        ("p", 1): "accepted", ("p", 2): "unknown_kind", ("p", 3): "log_closed", ("q", 1): "unknown_source_kind",
        ("n", None): "event_out_of_order", ("m", 1): "accepted", ("m", 2): "invalid_time_range"}


def test_timer_of_a_filled_gap_is_gone(spark):
    """Two gaps one after the other: the first one's timer must not cut the second one's patience short."""
    path, source = folder(), folder()
    parts = [
        [ev("r", 1, "recording_created", source_kind="audio_file", source_path="x"), ev("r", 3, "recording_saved")],
        [ev("r", 2, "recording_started")],
        [ev("r", 5, "clip_deleted", clip_id="c")],
    ]
    stream = spark.readStream.schema(struct_type(EVENTS_DDL)).parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    q = replay_stream(stream, patience_ms=9_000).writeStream.format("memory").queryName("gaps").option("checkpointLocation", path).start()
    began = time.time()
    for i, part in enumerate(parts):
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        want = (1, 3, 3)[i]
        while spark.table("gaps").count() < want and time.time() < began + 60:
            time.sleep(0.2)
    while time.time() < began + 10:
        time.sleep(0.2)
    early = {(r.sequence, r.outcome) for r in spark.table("gaps").collect()}
    q.stop()
    assert q.exception() is None
    assert {(1, "accepted"), (2, "accepted"), (3, "accepted")} == {x for x in early if x[0] < 4}
    assert all(sequence != 5 for sequence, _ in early)


def test_packets_after_the_end(spark):
    pcm = np.array([1, 2], "<i2").tobytes()
    rows = [("a", i, "pcm16", 1, 16000, False, 2, pcm, i == 2) for i in range(5)]
    source = folder()
    spark.createDataFrame(rows, PACKETS_DDL).coalesce(1).write.mode("append").parquet(source)
    life = drain(capture_lifecycle(decode_packets(read_capture_stream(spark, source))), "late").collect()
    assert [(r.kind, r.frame_count) for r in life] == [
        ("recording_created", None), ("recording_started", None), ("recording_saved", 6), ("packets_rejected", 2)]


def packets(spark):
    left = np.array([0.5, -0.5, 0.25], "<f4")
    stereo = np.stack([left, np.zeros(3, "<f4")], 1).astype("<f4").tobytes()
    pcm = np.array([16384, -16384], "<i2").tobytes()
    rows = [
        ("a", 0, "float32", 2, 48000, False, 3, stereo, False),
        ("a", 1, "pcm16", 1, 48000, False, 2, pcm, False),
        ("a", 2, "pcm16", 1, 48000, True, 4, None, True),
        ("b", 0, "pcm24", 1, 16000, False, 0, b"", True),
    ]
    return spark.createDataFrame(rows, PACKETS_DDL)


def test_capture(spark):
    blocks, report = assemble_capture(decode_packets(packets(spark)))
    got = {(r.recording_id, r.block_no): (r.first_frame, r.total_frames, list(r.samples)) for r in blocks.collect()}
    assert got == {("a", 0): (0, 9, [0.25, -0.25, 0.125]), ("a", 1): (3, 9, [0.5, -0.5]), ("a", 2): (5, 9, [0.0] * 4)}
    assert {r.recording_id: (r.frame_count, r.duration_us, r.stopped) for r in report.collect()} == {
        "a": (9, 187, True), "b": (0, 0, True)}
    source = folder()
    packets(spark).coalesce(1).write.mode("append").parquet(source)
    life = drain(capture_lifecycle(decode_packets(read_capture_stream(spark, source))), "life").collect()
    ends = {r.recording_id: (r.kind, r.frame_count, r.reason) for r in life if r.kind not in ("recording_created", "recording_started")}
    assert ends == {"a": ("recording_saved", 9, None), "b": ("recording_failed", 0, NO_FRAMES)}
    assert sum(r.kind == "recording_started" for r in life) == 2


def test_blocks_are_placed_as_packets_come(spark):
    """Packets out of order, repeated, without frames or number, after the end, and over a restart."""
    def packet(rec, number, n, stop=False):
        return (rec, number, "pcm16", 1, 16000, False, n, np.arange(n, dtype="<i2").tobytes(), stop)

    parts = [
        [packet("a", 2, 3), packet("a", 0, 2), packet("b", 0, 0), packet("c", 1, 1), packet("a", None, 1)],
        [packet("a", 2, 9), packet("a", 5, 1), packet("a", 1, 4), packet("a", 0, 7), packet("b", 1, 0, True)],
        [packet("a", 3, 0), packet("a", 4, 5, True), packet("a", 6, 1), packet("b", 2, 1)],
    ]
    source, progress, out = folder(), folder(), folder()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    for part in parts:  # a run each, so the state is read back
        spark.createDataFrame(part, PACKETS_DDL).coalesce(1).write.mode("append").parquet(source)
        stream = placed_stream(decode_packets(read_capture_stream(spark, source)))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
        assert q.awaitTermination(90) and q.exception() is None
    got = [(r.recording_id, r.packet_no, r.outcome, r.block_no, r.first_frame, r.total_frames, r.samples and len(r.samples)) for r in spark.read.parquet(out).collect()]
    want = [
        ("a", 0, "placed", 0, 0, None, 2), ("a", 1, "placed", 1, 2, None, 4), ("a", 2, "placed", 2, 6, None, 3), ("a", 3, "no_frames", None, None, None, None),
        ("a", 4, "placed", 3, 9, None, 5), ("a", None, "saved", 4, None, 14, None), ("a", 2, "packet_repeated", None, None, None, None),
        ("a", 0, "packet_repeated", None, None, None, None), ("a", 5, "recording_ended", None, None, None, None), ("a", 6, "recording_ended", None, None, None, None),
        ("a", None, "packet_unnumbered", None, None, None, None), ("b", 0, "no_frames", None, None, None, None), ("b", 1, "no_frames", None, None, None, None),
        ("b", None, "failed", 0, None, 0, None), ("b", 2, "recording_ended", None, None, None, None),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_missing_packet_is_given_up(spark):
    pcm = np.array([1, 2], "<i2").tobytes()
    rows = [("a", i, "pcm16", 1, 16000, False, 2, pcm, i == 4) for i in (0, 2, 4)]
    source = folder()
    spark.createDataFrame(rows, PACKETS_DDL).coalesce(1).write.mode("append").parquet(source)
    placed = drain(placed_stream(decode_packets(read_capture_stream(spark, source)), 500), "given_up", rows=4).collect()
    assert sorted((r.packet_no or 9, r.outcome, r.first_frame, r.total_frames) for r in placed) == [
        (2, "placed", 2, None), (4, "placed", 4, None), (9, "placed", 0, None), (9, "saved", None, 6)]


def test_level_stream_matches_batch(spark):
    rows = [("a", i * 400, [0.1 * i, -0.2]) for i in range(10)]
    ddl = "recording_id string, at_us bigint, samples array<float>"
    source = folder()
    spark.createDataFrame(rows, ddl).write.mode("append").parquet(source)
    stream = spark.readStream.schema(struct_type(ddl)).parquet(source)
    live = drain(level_by_window(stream, 1000), "level", "complete")
    batch = level_by_window(spark.createDataFrame(rows, ddl), 1000)
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))


def test_rows_with_samples_go_to_python_few_at_once(spark, tmp_path):
    import pyarrow as pa

    from tapeloom.plans.stage import BATCH
    from tapeloom.streaming.bounded import drained, table_stream

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    given = spark.conf.get(BATCH)
    seen = drained(table_stream(spark, str(tmp_path / "t")).mapInArrow(sizes, "n bigint"), "sizes", batch=16)
    assert sorted(r.n for r in seen.collect()) == [4, *[16] * 6] and spark.conf.get(BATCH) == given
