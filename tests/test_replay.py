"""Set-wise replay against a plain one-record-at-a-time fold, and literal cases."""

import random
import time

import pytest
from pyspark.sql import functions as F

import tapeloom.operators.replay as replay_module
from tapeloom.operators.fold import RecordingFold, Refused
from tapeloom.operators.commands import apply_commands
from tapeloom.operators.replay import ListOrder, Replayed, replay, state_differences, transition_audit
from tapeloom.plans.stage import written
from tapeloom.schemas import ASSET_KINDS, EVENT_COLUMNS, EVENT_KINDS, EVENTS_DDL, PAYLOAD_COLUMNS, PROVENANCES, RECORDING_KINDS


def ev(rec, seq, kind, version=1, **payload):
    row = {c: None for c in PAYLOAD_COLUMNS}
    row.update(payload, recording_id=rec, sequence=seq, kind=kind, schema_version=version)
    return row


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in EVENT_COLUMNS) for r in rows], EVENTS_DDL)


WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def problem(row):
    """What a payload breaks on its own, written out again."""
    def blank(text):
        return not (text or "").strip(WHITE)

    kind = row["kind"]
    if kind not in EVENT_KINDS:
        return "unknown_kind"
    if kind not in RECORDING_KINDS and row["clip_id"] is None:
        return "missing_field"
    if kind == "transcript_committed" and row["transcript_id"] is None:
        return "missing_field"
    if kind == "recording_created" and not row["source_path"]:
        return "empty_source_path"
    if kind == "recording_created" and row["source_kind"] not in ASSET_KINDS:
        return "unknown_source_kind"
    if kind == "recording_failed" and blank(row["reason"]):
        return "empty_recording_failure"
    if kind == "transcription_failed" and blank(row["reason"]):
        return "empty_transcription_failure"
    if kind == "transcript_committed" and blank(row["text"]):
        return "empty_transcript"
    if kind == "transcript_committed" and row["provenance"] not in PROVENANCES:
        return "unknown_provenance"
    start, end = row["start_us"], row["end_us"]
    if kind == "clip_added" and (start is None or end is None or start < 0 or end <= start):
        return "invalid_time_range"
    return None


class PlainFold(RecordingFold):
    def apply(self, event):
        super().apply({**event, "problem": problem(event)})


class ListedFold(PlainFold):
    """Also keeps list order, source and texts, for comparison."""

    def __init__(self):
        super().__init__()
        self.order, self.source, self.texts = [], (None, None), []

    def apply(self, event):
        number = self.next_sequence
        super().apply(event)
        kind, clip = event["kind"], event["clip_id"]
        if kind == "recording_created":
            self.source = (event["source_kind"], event["source_path"])
        elif kind == "clip_added":
            self.order.append(clip)
        elif kind == "clip_moved":
            self.order.remove(clip)
            self.order.insert(event["target_index"], clip)
        elif kind == "transcript_committed":
            self.texts.append((number, event["transcript_id"], clip, event["provenance"], event["text"]))


def plain_fold(rows):
    """Expected state and rejects, log by log."""
    logs = {}
    for row in sorted(rows, key=lambda r: (r["sequence"] is None, r["sequence"])):
        logs.setdefault(row["recording_id"], []).append(row)
    recs, clips, texts, rejects = set(), set(), set(), set()
    for rec, log in logs.items():
        fold = ListedFold()
        for row in log:
            try:
                fold.record(row)
            except Refused as stop:
                rejects.add((rec, row["sequence"], stop.code))
                break
        if fold.status:
            recs.add((rec, *fold.source, fold.status, fold.failure, fold.next_sequence - 1))
        for position, clip in enumerate(fold.order):
            clips.add((rec, clip, position, *fold.clips[clip]))
        for number, tid, clip, prov, text in fold.texts:
            texts.add((rec, number, tid, clip, prov, text))
    return recs, clips, texts, rejects


def check(spark, rows, **widths):
    out = replay(frame(spark, rows), **widths)
    recs, clips, texts, rejects = plain_fold(rows)
    assert {tuple(r) for r in out.rejects.select("recording_id", "sequence", "reason_code").collect()} == rejects
    assert {tuple(r) for r in out.recordings.collect()} == recs
    assert {tuple(r) for r in out.clips.collect()} == clips
    assert {tuple(r) for r in out.transcripts.collect()} == texts
    return out


def random_log(rng, rec):
    """Mostly sensible events over few clips, so that every rule is met and broken."""
    rows, seq = [], 0
    legal_until = rng.choice([0, 5, 15, 30, 60])
    fold = PlainFold()
    for step in range(rng.randint(1, 60)):
        legal = step < legal_until
        kinds = ["recording_created", "recording_started", "recording_saved", "recording_failed"] + [
            "clip_added", "clip_moved", "clip_deleted", "transcription_started",
            "transcription_failed", "transcript_committed"] * 6 + ["no_such_kind"]
        kind = "recording_created" if seq == 0 and rng.random() < 0.95 else rng.choice(kinds)
        start = rng.randint(0, 12) * rng.choice([1, 7, 10, 100]) - (0 if legal else rng.choice([0] * 9 + [5]))
        row = ev(
            rec, seq + 1 if legal or rng.random() < 0.98 else seq + rng.choice([0, 2]), kind,
            version=1 if legal or rng.random() < 0.99 else 2,
            clip_id=f"c{rng.randint(0, 7)}" if kind not in ("recording_created",) else None,
            transcript_id=f"t{rng.randint(0, 400 if legal else 12)}",
            start_us=start, end_us=start + rng.choice([-1, 1, 3, 10, 25, 110, 999]),
            target_index=rng.randint(0, 5), provenance=rng.choice(["raw_asr", "user_edit", "imported"] * 3 + ([] if legal else ["nonsense"])),
            text=rng.choice(["hello", "　\t", "more words", "\x1c"]) if not legal else f"w{seq}",
            reason=rng.choice(["broke", "  ", "other"]) if not legal else "broke",
            source_kind="audio_file", source_path="a.wav",
        )
        try:
            fold.record(row)
            ok = True
        except Refused:
            ok = False
        if legal and not ok:
            continue
        rows.append(row)
        seq = row["sequence"]
        if not ok and rng.random() < 0.7:
            break
    return rows


@pytest.mark.parametrize("seed,widths", [(1, {}), (2, {"width": 4, "time_width": 16}), (3, {"width": 1, "time_width": 1})])
def test_random_logs_match_the_fold(spark, seed, widths):
    rng = random.Random(seed)
    rows = []
    for i in range(260):
        log = random_log(rng, f"r{i:03d}")
        seen = set()
        # repeats of a number are a case of their own, below
        rows += [r for r in log if not (r["sequence"] in seen or seen.add(r["sequence"]))]
    rng.shuffle(rows)
    out = check(spark, rows, **widths)
    codes = {r[0] for r in out.rejects.select("reason_code").distinct().collect()}
    assert {"clip_overlaps", "clip_not_found", "invalid_clip_transition", "event_out_of_order"} <= codes


def stored(state):
    return Replayed(*(written(getattr(state, n), n) for n in ("recordings", "clips", "transcripts")))


@pytest.mark.parametrize("seed,cut,island", [(4, 12, 32), (5, 25, 0)])
def test_replay_goes_on_from_a_state(spark, monkeypatch, seed, cut, island):
    """Two steps give what one gives; the second never sees an old record, unless it is read twice."""
    monkeypatch.setattr("tapeloom.operators.replay.ISLAND", island)
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        seen = set()
        rows += [r for r in random_log(rng, f"r{i:03d}") if not (r["sequence"] in seen or seen.add(r["sequence"]))]
    for row in rows:  # some records lack what they need
        if rng.random() < 0.02:
            row[rng.choice(["clip_id", "transcript_id", "target_index", "kind", "text", "start_us"])] = None
    early = [r for r in rows if r["sequence"] <= cut]
    first = replay(frame(spark, early), width=4)
    state, stopped = stored(first), {r.recording_id for r in first.rejects.collect()}
    late = [r for r in rows if r["sequence"] > cut and r["recording_id"] not in stopped]
    again = [r for r in early if r["recording_id"] not in stopped]
    recs, clips, texts, rejects = plain_fold(rows)
    for tail in (late, late + again):
        out = replay(frame(spark, tail), width=4, snapshot=state)
        bad = first.rejects.unionByName(out.rejects).select("recording_id", "sequence", "reason_code")
        assert {tuple(r) for r in bad.collect()} == rejects
        assert {tuple(r) for r in out.recordings.collect()} == recs
        assert {tuple(r) for r in out.clips.collect()} == clips
        assert {tuple(r) for r in out.transcripts.collect()} == texts


def test_records_without_number_or_ids(spark):
    made = dict(source_kind="audio_file", source_path="x")
    rows = [
        ev("a", 1, "recording_created", **made), ev("a", 2, "clip_added", clip_id="c", start_us=0, end_us=9), ev("a", None, "clip_added", clip_id="d", start_us=20, end_us=29),
        ev("b", 1, "recording_created", **made), ev("b", 2, "clip_added", start_us=0, end_us=9), ev("b", None, "clip_deleted", clip_id="c"),
        ev("c", 1, "recording_created", **made), ev("c", 2, "clip_added", clip_id="c", start_us=0, end_us=9), ev("c", 3, "transcription_started", clip_id="c"),
        ev("c", 4, "transcript_committed", clip_id="c", provenance="raw_asr", text="x"), ev("d", None, "recording_created", **made),
    ]
    out = check(spark, rows)
    assert {(r.recording_id, r.sequence, r.reason_code) for r in out.rejects.collect()} == {
        ("a", None, "event_out_of_order"), ("b", 2, "missing_field"), ("c", 4, "missing_field"), ("d", None, "event_out_of_order")}
    lost = replay(frame(spark, [ev(None, 1, "recording_created", **made)]))
    assert [tuple(r) for r in lost.rejects.collect()] == [(None, 1, "recording_created", "missing_field")] and lost.recordings.count() == 0


def test_commands_start_from_state_tables(spark):
    made = dict(source_kind="audio_file", source_path="x")
    rows = []
    for rec in ("calm", "torn", "dark"):
        rows += [
            ev(rec, 1, "recording_created", **made), ev(rec, 2, "clip_added", clip_id="a", start_us=0, end_us=10), ev(rec, 3, "transcription_started", clip_id="a"),
            ev(rec, 4, "transcript_committed", clip_id="a", transcript_id="t", provenance="raw_asr", text="x"), ev(rec, 5, "clip_deleted", clip_id="a"),
            ev(rec, 6, "clip_added", clip_id="b", start_us=0, end_us=10),
        ]
    state = stored(replay(frame(spark, rows)))
    dark = state.recordings.withColumn("last_sequence", F.when(F.col("recording_id") != "dark", F.col("last_sequence")))
    state = Replayed(written(dark, "recordings"), state.clips, state.transcripts)
    cmd = lambda rec, n, kind, **p: {**ev(rec, n, kind, **p)}
    asked = [
        cmd("calm", 1, "begin_transcription", clip_id="b"), cmd("calm", 2, "commit_transcript", clip_id="b", transcript_id="u", provenance="user_edit", text="y"),
        cmd("torn", 1, "add_clip", clip_id="c", start_us=5, end_us=15), cmd("torn", 2, "add_clip", clip_id="a", start_us=50, end_us=60),
        cmd("torn", 3, "begin_transcription", clip_id="b"), cmd("torn", 4, "commit_transcript", clip_id="b", transcript_id="t", provenance="raw_asr", text="y"),
        cmd("torn", 5, "move_clip", clip_id="b", target_index=1), cmd("torn", 6, "move_clip", clip_id="b", target_index=2),
        cmd("dark", 1, "begin_transcription", clip_id="b"), cmd("new", 1, "create_recording", **made), cmd("calm", 3, "delete_clip"), cmd("calm", None, "delete_clip", clip_id="b"),
    ]
    asked = frame(spark, asked).withColumnRenamed("sequence", "ordinal").drop("schema_version")
    events, refused = apply_commands(state, asked)
    assert {(r.recording_id, r.sequence, r.kind) for r in events.collect()} == {
        ("calm", 7, "transcription_started"), ("calm", 8, "transcript_committed"), ("torn", 7, "transcription_started"), ("torn", 8, "clip_moved"), ("new", 1, "recording_created")}
    assert {(r.recording_id, r.ordinal, r.reason_code) for r in refused.collect()} == {
        ("torn", 1, "clip_overlaps"), ("torn", 2, "clip_already_exists"), ("torn", 4, "transcript_already_exists"), ("torn", 6, "invalid_clip_index"),
        ("dark", 1, "unknown_sequence"), ("calm", 3, "missing_field"), ("calm", None, "missing_field")}
    done = replay(events, snapshot=state)
    assert done.rejects.count() == 0
    assert {(r.recording_id, r.status) for r in done.clips.filter("clip_id = 'b'").collect()} == {("calm", "edited"), ("torn", "processing"), ("dark", "pending")}


def test_lists_of_many_recordings_go_back_together():
    import pyarrow as pa

    from tapeloom.operators.replay import WALKED, _walk_moves

    rows = [(f"r{i:05d}", clip, target) for i in range(WALKED) for clip, target in (("a", None), ("b", None), ("b", 0))]
    given = pa.RecordBatch.from_pydict(dict(zip(("recording_id", "clip_id", "target"), zip(*rows))))
    out = list(_walk_moves([given.slice(i, 1_000) for i in range(0, len(rows), 1_000)]))
    assert [len(b) for b in out] == [WALKED, WALKED]
    found = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert found == [(f"r{i:05d}", clip, at) for i in range(WALKED) for at, clip in enumerate("ba")]


def test_moves_in_a_long_list():
    rng = random.Random(8)
    order, plain = ListOrder(), []
    for i in range(3_000):
        order.append(f"c{i}")
        plain.append(f"c{i}")
        for _ in range(3):
            clip, target = f"c{rng.randint(0, i)}", rng.choice([0, i, rng.randint(0, i)])
            order.move(clip, target)
            plain.remove(clip)
            plain.insert(target, clip)
    assert order.ids() == plain
    began = time.time()
    order = ListOrder()
    for i in range(100_000):
        order.append(i)
    for i in range(100_000):
        order.move(rng.randrange(100_000), rng.randrange(100_000))
    assert time.time() - began < 30


def test_literal_replay(spark):
    rows = [
        ev("r", 1, "recording_created", source_kind="audio_file", source_path="x.wav"),
        ev("r", 2, "clip_added", clip_id="a", start_us=0, end_us=1_000_000),
        ev("r", 3, "clip_added", clip_id="b", start_us=1_000_000, end_us=2_000_000),
        ev("r", 4, "clip_moved", clip_id="b", target_index=0),
        ev("r", 5, "transcription_started", clip_id="b"),
        ev("r", 6, "transcript_committed", clip_id="b", transcript_id="t", provenance="raw_asr", text="hello locally"),
    ]
    out = check(spark, rows)
    got = {r.clip_id: (r.position, r.status) for r in out.clips.collect()}
    assert got == {"b": (0, "transcribed"), "a": (1, "pending")}


def test_repeated_number_stops_after_the_first_copy(spark):
    base = [
        ev("r", 1, "recording_created", source_kind="audio_file", source_path="x.wav"),
        ev("r", 2, "clip_added", clip_id="a", start_us=0, end_us=10),
    ]
    out = replay(frame(spark, [*base, base[1], ev("r", 3, "clip_deleted", clip_id="a")]))
    assert [tuple(r) for r in out.rejects.collect()] == [("r", 2, "clip_added", "event_out_of_order")]
    assert [r.status for r in out.clips.collect()] == ["pending"]


@pytest.mark.parametrize("second,code", [((999_999, 2_000_000), "clip_overlaps"), ((10, 10), "invalid_time_range"), ((20, 10), "invalid_time_range")])
def test_bad_ranges(spark, second, code):
    rows = [
        ev("r", 1, "recording_created", source_kind="audio_file", source_path="x.wav"),
        ev("r", 2, "clip_added", clip_id="a", start_us=0, end_us=1_000_000),
        ev("r", 3, "clip_added", clip_id="b", start_us=second[0], end_us=second[1]),
    ]
    out = check(spark, rows)
    assert [r.reason_code for r in out.rejects.collect()] == [code]


def test_life_cycle(spark):
    made = lambda rec: ev(rec, 1, "recording_created", source_kind="microphone_recording", source_path="m.wav")
    rows = [
        made("early"), ev("early", 2, "recording_saved"),
        made("kept"), ev("kept", 2, "recording_started"), ev("kept", 3, "recording_saved"),
        made("lost"), ev("lost", 2, "recording_started"),
        ev("lost", 3, "recording_failed", reason="simulated device disconnect"),
    ]
    out = check(spark, rows)
    got = {r.recording_id: (r.status, r.failure) for r in out.recordings.collect()}
    assert got == {
        "early": ("created", None), "kept": ("saved", None), "lost": ("failed", "simulated device disconnect"),
    }
    assert state_differences(out.recordings, out.recordings).count() == 0
    audit = {(r.from_status, r.to_status): r.legal for r in transition_audit(frame(spark, rows)).collect()}
    assert audit[("created", "saved")] is False and audit[("recording", "saved")] is True


def test_retry_after_failure(spark):
    rows = [
        ev("r", 1, "recording_created", source_kind="audio_file", source_path="x.wav"),
        ev("r", 2, "clip_added", clip_id="a", start_us=0, end_us=10),
        ev("r", 3, "transcription_started", clip_id="a"),
        ev("r", 4, "transcription_failed", clip_id="a", reason="local worker exited"),
        ev("r", 5, "transcription_started", clip_id="a"),
        ev("r", 6, "transcript_committed", clip_id="a", transcript_id="t", provenance="raw_asr", text="retried locally"),
    ]
    clip = check(spark, rows).clips.collect()[0]
    assert (clip.status, clip.failure) == ("transcribed", None)


def test_short_logs_are_exchanged_by_recording_alone(spark):
    """Numbers, life cycle and clips are judged over one exchange; no join with the repeated numbers is left."""
    rows = [("r", i, "recording_created" if i == 1 else "clip_added", f"c{i}", None, i * 10, i * 10 + 10, None, None, None, None, "audio_file", "x", 1)
            for i in range(1, 9)]
    rows.append(rows[5])  # a number that is used twice, by the same record
    log = spark.createDataFrame(rows, EVENTS_DDL)
    held = []

    def kept(df, stem):
        held.append((stem, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, stem)

    before, replay_module.written = replay_module.written, kept
    try:
        state = replay(log)
    finally:
        replay_module.written = before
    plans = dict(held)
    assert {"long-logs", "seen"} <= set(plans)
    assert plans["seen"].count("Exchange hashpartitioning(recording_id") == 1 and plans["seen"].count("Exchange ") == 1
    assert "Join" not in plans["seen"]
    assert [r.sequence for r in state.rejects.collect()] == [6]
    assert state.accepted.count() == 6 and state.clips.count() == 5
    # a log that is longer than a task may hold is judged in buckets, with the same outcome
    wide = replay(log, width=4)
    assert [tuple(r) for r in wide.rejects.collect()] == [tuple(r) for r in state.rejects.collect()]
    assert sorted(map(tuple, wide.clips.collect())) == sorted(map(tuple, state.clips.collect()))


def test_commands_are_numbered_over_one_exchange(spark):
    """No join brings the numbers back to the commands; recordings of many commands are numbered in buckets, alike."""
    from tapeloom.operators import commands as commands_module

    rows = [ev("r", None, "create_recording", source_kind="audio_file", source_path="x")]
    rows += [ev("r", None, "add_clip", clip_id=f"c{i}", start_us=i * 10, end_us=i * 10 + 10) for i in range(6)]
    rows += [ev("q", None, "add_clip", clip_id="c", start_us=0, end_us=10), ev("q", None, "create_recording", source_kind="audio_file", source_path="x")]
    asked = frame(spark, rows).drop("sequence", "schema_version").withColumn("ordinal", F.monotonically_increasing_id() * 3)
    plans = {}

    def kept(df, stem):
        plans[stem] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, stem)

    before, commands_module.written = commands_module.written, kept
    try:
        events, refused = apply_commands(frame(spark, []), asked)
    finally:
        commands_module.written = before
    assert plans["tentative"].count("Join") == 1  # with the last numbers
    assert "ordinal" not in "".join(x for x in plans["tentative"].splitlines() if "Exchange hashpartitioning(" in x).split("hashpartitioning(")[1].split(")")[0]
    got = sorted((r.recording_id, r.sequence, r.kind) for r in events.collect())
    assert got == [("q", 1, "recording_created"), ("r", 1, "recording_created"), *[("r", k, "clip_added") for k in range(2, 8)]]
    assert [(r.recording_id, r.reason_code) for r in refused.collect()] == [("q", "recording_not_found")]
    more, no = apply_commands(frame(spark, []), asked, width=3)
    assert sorted((r.recording_id, r.sequence, r.kind) for r in more.collect()) == got
    assert [r.reason_code for r in no.collect()] == ["recording_not_found"]


def test_list_changes_are_cut_off_at_the_stop_once_and_only_for_clips(spark, monkeypatch):
    made = []

    def kept(df, stem, *more):
        made.append(stem)
        return written(df, stem, *more)

    monkeypatch.setattr(replay_module, "written", kept)
    rows = [ev("r", 1, "recording_created", source_kind="audio_file", source_path="x")]
    rows += [ev("r", 2 + k, "clip_added", clip_id=f"c{k}", start_us=10 * k, end_us=10 * k + 10) for k in range(3)]
    rows += [ev("r", 5, "clip_moved", clip_id="c2", target_index=0), ev("r", 6, "clip_moved", clip_id="c1", target_index=9)]
    state = replay(written(frame(spark, rows), "log"))
    assert state.recordings.first()["last_sequence"] == 5 and "list-changes" not in made
    clips = state.clips
    assert made.count("list-changes") == 1 and state.clips is clips
    plan = clips._jdf.queryExecution().optimizedPlan().toString().split("\n")
    reads = [line for line in plan if "Relation" in line and "source_path" in line]
    assert len(reads) <= 2  # what became of the clips, and why some failed
    assert [r.clip_id for r in clips.orderBy("position").collect()] == ["c2", "c0", "c1"]
    assert [(r.sequence, r.reason_code) for r in state.rejects.collect()] == [(6, "invalid_clip_index")]
