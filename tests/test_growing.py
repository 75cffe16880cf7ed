"""Logs that grow in place: every line once, whatever was written when a batch was planned."""

import io
import os
import random
import tempfile
import uuid

from tapeloom.streaming import growing
from tapeloom.streaming.bounded import drained
from tapeloom.streaming.growing import growing_event_logs, growing_lines, lines_ended_in
from tapeloom.streaming.replay import replay_stream


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_ranges_own_the_lines_that_end_in_them(monkeypatch):
    monkeypatch.setattr(growing, "LOOK_BACK", 3)
    monkeypatch.setattr(growing, "RANGE_BYTES", 5)
    rng = random.Random(2)
    for _ in range(300):
        data = b"".join(rng.choice([b"\n", b"a\n", b"longer line\n", "é ü\n".encode(), b"x" * 20 + b"\n"]) for _ in range(rng.randint(0, 9))) + rng.choice([b"", b"half"])
        cuts = sorted({0, len(data), *(rng.randint(0, len(data)) for _ in range(5))})
        got = [x for a, b in zip(cuts, cuts[1:]) for x in lines_ended_in(io.BytesIO(data), a, b)]
        want, at = [], 0
        for line in data.split(b"\n")[:-1]:
            want.append((at, line))
            at += len(line) + 1
        assert got == want


def test_lines_come_once_over_restarts(spark, monkeypatch):
    root, place = folder(), (folder(), folder())
    os.makedirs(f"{root}/a")

    def add(name, data):
        with open(f"{root}/{name}/log.txt", "ab") as out:
            out.write(data)

    def seen():
        rows = drained(growing_lines(spark, root, "log.txt"), "lines", place).collect()
        return sorted((os.path.basename(os.path.dirname(r.path)), r.at_byte, r.value) for r in rows)

    add("a", b"one\ntwo\nthr")
    first = [("a", 0, "one"), ("a", 4, "two")]
    assert seen() == first
    assert seen() == first  # nothing new
    add("a", b"ee\n")
    os.makedirs(f"{root}/b")
    add("b", "ü\n\n".encode())
    with open(f"{root}/b/other.txt", "w") as out:
        out.write("not asked for\n")
    second = [*first, ("a", 8, "three"), ("b", 0, "ü"), ("b", 3, "")]
    assert seen() == second
    add("b", b"x" * 200_000 + b"\nend\n")
    assert seen() == [*second, ("b", 4, "x" * 200_000), ("b", 200_005, "end")]


def test_event_logs_are_judged_once(spark):
    root, place, bad_place = folder(), (folder(), folder()), (folder(), folder())
    rec = str(uuid.UUID(int=7))
    os.makedirs(f"{root}/recordings/{rec}")
    os.makedirs(f"{root}/recordings/not-a-recording")
    lines = [
        '{"schema_version":1,"sequence":1,"event":{"recording_created":{"recording_id":"%s","source":{"kind":"audio_file","path":"x"}}}}' % rec,
        '{"schema_version":1,"sequence":2,"event":{"recording_started":{"recording_id":"%s"}}}' % rec,
        "no event",
        '{"schema_version":1,"sequence":3,"event":{"recording_saved":{"recording_id":"%s"}}}' % rec,
        '{"schema_version":1,"sequence":3,"event":{"recording_saved":{"recording_id":"%s"}}}' % rec,
    ]
    with open(f"{root}/recordings/not-a-recording/events.ndjson", "w") as out:
        out.write(lines[0] + "\n")
    text = "\n".join(lines) + "\n"
    for upto in (len(lines[0]) + 5, len(lines[0]) + len(lines[1]) + 2, len(text)):
        with open(f"{root}/recordings/{rec}/events.ndjson", "w") as out:
            out.write(text[:upto])
        events, bad = growing_event_logs(spark, root)
        judged = drained(replay_stream(events), "judged", place)
        rejects = drained(bad, "bad", bad_place)
    assert sorted((r.sequence, r.kind, r.outcome) for r in judged.collect()) == [
        (1, "recording_created", "accepted"), (2, "recording_started", "accepted"),
        (3, "recording_saved", "accepted"), (3, "recording_saved", "event_out_of_order")]
    assert [(r.recording_id, r.raw, r.at_byte) for r in rejects.collect()] == [(rec, "no event", len(lines[0]) + len(lines[1]) + 2)]


def test_short_logs_share_a_task_and_long_ones_are_cut(monkeypatch):
    monkeypatch.setattr(growing, "RANGE_BYTES", 1_000)
    monkeypatch.setattr(growing, "OPEN_BYTES", 10)
    root, sizes = folder(), {}
    for i in range(300):
        os.makedirs(f"{root}/{i:03d}")
        with open(f"{root}/{i:03d}/log.txt", "wb") as out:
            out.write(b"%03d\n" % i * (1 if i else 2_000))
    reader = growing._Reader(root, "log.txt")
    end = reader.latestOffset()
    tasks = reader.partitions(reader.initialOffset(), end)
    assert 8 <= len(tasks) < 20  # 8 for the long one, 299 files of 4 bytes in the others
    assert max(sum(e - s for _, s, e in t.ranges) for t in tasks) <= 1_000
    lines = sorted(x for t in tasks for batch in reader.read(t) for x in batch.column("value").to_pylist())
    assert lines == sorted(["000"] * 2_000 + [f"{i:03d}" for i in range(1, 300)])
    assert reader.partitions(end, end) == []


def test_state_of_a_batch_is_read_and_written_once():
    from tapeloom.streaming.replay import _StateMapping

    class Counted(dict):
        reads = writes = 0

        def getValue(self, key):
            self.reads += 1
            return self.get(key)

        def updateValue(self, key, value):
            self.writes += 1
            self[key] = value

    state = Counted()
    new = _StateMapping(state, fresh=True)
    for i in range(5):
        assert new.get("c") == (None if i == 0 else (i - 1,))
        new["c"] = (i,)
    new.flush()
    assert (state.reads, state.writes) == (0, 1) and state[("c",)] == (4,)
    later = _StateMapping(state, fresh=False)
    assert [later.get("c"), later.get("c"), later.get("d"), later.get("d")] == [(4,), (4,), None, None]
    assert state.reads == 2
