"""Clip algebra on literal and random clip tables."""

import random

import pytest

from tapeloom.operators import clips as C
from tapeloom.operators.tokens import cut_token_stream, stop_reasons
from tapeloom.sources.probe import parse_probe

DDL = "recording_id string, clip_id string, start_us bigint, end_us bigint, status string, position bigint"


def table(spark, rows):
    return spark.createDataFrame([(r, c, s, e, st, i) for i, (r, c, s, e, st) in enumerate(rows)], DDL)


def media(spark, **durations):
    return spark.createDataFrame(list(durations.items()), "recording_id string, duration_us bigint")


def test_plan_chunks(spark):
    got = C.plan_chunks(media(spark, a=2_500_000, b=0), 1_000_000, fan=2).collect()
    assert sorted((r.recording_id, r.start_us, r.end_us) for r in got) == [
        ("a", 0, 1_000_000), ("a", 1_000_000, 2_000_000), ("a", 2_000_000, 2_500_000)]
    assert [r.recording_id for r in C.chunk_rejects(media(spark, a=1, b=0)).collect()] == ["b"]
    assert C.plan_chunks(media(spark, p=2_051_500), 500_000).count() == 5
    with pytest.raises(ValueError):
        C.plan_chunks(media(spark, a=1), 0)


def test_split_and_append(spark):
    held = table(spark, [("r", "a", 0, 2_000_000, "pending"), ("r", "d", 5, 9, "deleted")])
    points = spark.createDataFrame([("r", "a", 1_000_000), ("r", "d", 6), ("r", "a", 0)], "recording_id string, clip_id string, split_at_us bigint")
    made, bad = C.split_clips(held, points)
    assert sorted((r.side, r.start_us, r.end_us) for r in made.collect()) == [("left", 0, 1_000_000), ("right", 1_000_000, 2_000_000)]
    assert sorted((r.clip_id, r.reason_code) for r in bad.collect()) == [("a", "split_outside_clip"), ("d", "clip_not_active")]
    halves = table(spark, [("r", "x", 0, 10, "pending"), ("r", "y", 10, 20, "pending"), ("r", "z", 20, 30, "pending"), ("r", "w", 50, 60, "pending")])
    pairs = spark.createDataFrame([("r", "y", "x"), ("r", "y", "z"), ("r", "x", "x"), ("r", "x", "w"), ("r", "x", "q")],
                                  "recording_id string, first_clip_id string, second_clip_id string")
    made, bad = C.append_clips(halves, pairs)
    assert [(r.first_clip_id, r.second_clip_id, r.start_us, r.end_us) for r in made.collect()] == [("x", "y", 0, 20)]
    assert sorted((r.first_clip_id, r.second_clip_id, r.reason_code) for r in bad.collect()) == [
        ("x", "q", "clip_not_active"), ("x", "w", "clips_not_adjacent"), ("x", "x", "same_clip"), ("y", "z", "clip_not_active")]


def test_random_tables_match_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for rec in range(40):
        for i in range(rng.randint(0, 25)):
            s = rng.randint(0, 60)
            rows.append((f"r{rec}", f"c{i:02d}", s, s + rng.randint(1, 12), rng.choice(["pending", "pending", "deleted"])))
    live = [r for r in rows if r[4] != "deleted"]
    width = 4
    found = {(r.recording_id, r.clip_id): r.other_clip_id for r in C.find_overlaps(table(spark, rows), width).collect()}
    by_id = {(r[0], r[1]): r for r in live}
    for r in live:
        earlier = [o for o in live if o[0] == r[0] and (o[2], o[1]) < (r[2], r[1]) and o[3] > r[2]]
        assert ((r[0], r[1]) in found) == bool(earlier)
        if earlier:
            assert by_id[(r[0], found[(r[0], r[1])])] in earlier
    runs = {(r.recording_id, r.start_us, r.end_us, r.n_clips) for r in C.coalesce_runs(table(spark, rows), width).collect()}
    want = set()
    cover = {}
    for rec in {r[0] for r in live}:
        own = sorted(r for r in live if r[0] == rec)
        own.sort(key=lambda r: r[2])
        start, end, n = own[0][2], own[0][3], 0
        for r in own:
            if r[2] > end:
                want.add((rec, start, end, n))
                start, end, n = r[2], r[3], 0
            end, n = max(end, r[3]), n + 1
        want.add((rec, start, end, n))
        cover[rec] = len({t for r in own for t in range(r[2], r[3])})
    assert runs == want
    got = {r.recording_id: r.covered_us for r in C.coverage(table(spark, rows), media(spark, **{f"r{i}": 100 for i in range(40)}), width).collect()}
    assert got == {f"r{i}": cover.get(f"r{i}", 0) for i in range(40)}


def test_exact_cover_and_lookup(spark):
    held = table(spark, [("r", "a", 0, 10, "pending"), ("r", "b", 10, 15, "pending"), ("g", "c", 2, 4, "pending")])
    got = {r.recording_id: (r.exact_cover, r.n_gaps) for r in C.coverage(held, media(spark, r=15, g=4)).collect()}
    assert got == {"r": (True, 0), "g": (False, 1)}
    points = spark.createDataFrame([("r", 1, 9), ("r", 2, 10), ("r", 3, 15), ("g", 4, 1)], "recording_id string, point_id bigint, at_us bigint")
    assert {r.point_id: r.clip_id for r in C.locate(held, points, 3).collect()} == {"1": "a", "2": "b", "3": None, "4": None}


def test_ensure_chunks(spark):
    plan = C.plan_chunks(media(spark, new=25, same=25, other=25), 10)
    held = table(spark, [("same", "a", 0, 10, "pending"), ("same", "b", 10, 20, "edited"), ("same", "c", 20, 25, "pending"),
                         ("same", "d", 3, 4, "deleted"), ("other", "e", 0, 25, "pending")])
    use, added, wrong = C.ensure_chunks(held, plan)
    assert sorted((r.recording_id, r.start_us) for r in use.collect()) == [("new", 0), ("new", 10), ("new", 20), ("same", 0), ("same", 10), ("same", 20)]
    assert added.count() == 3 and [r.recording_id for r in wrong.collect()] == ["other"]


def test_probe_literals(spark):
    log = "Input #0, wav, from 'fixture.wav':\n  Duration: 00:00:02.050000, bitrate: 512 kb/s\n  Stream #0:0: Audio: pcm_f32le, 48000 Hz, stereo, flt, 3072 kb/s\n"
    rows = [("a", "csv", "48000,2,N/A,1.250000\n"), ("b", "csv", "not,a,probe"), ("c", "log", log), ("d", "log", log.replace("stereo", "7.1(wide)")),
            ("e", "log", "no duration here"), ("f", "csv", "8000,1,77,3"), ("g", "csv", "8000, 1 , 77 , 3.1234567"), ("h", "log", log.replace("stereo", "x channels"))]
    good, bad = parse_probe(spark.createDataFrame(rows, "recording_id string, form string, text string"))
    assert {r.recording_id: (r.sample_rate_hz, r.channels, r.duration_us, r.frame_count) for r in good.collect()} == {
        "a": (48000, 2, 1_250_000, 60_000), "c": (48000, 2, 2_050_000, 98_400), "d": (48000, 8, 2_050_000, 98_400), "g": (8000, 1, 3_123_456, 77)}
    assert sorted(r.recording_id for r in bad.collect()) == ["b", "e", "f", "h"]


def test_token_cuts(spark):
    streams = {"repeat": [5, 7, 7, 7, 7, 8], "short": [5, 7, 7, 7], "broken": [5, 7, 7, 8, 7], "end": [1, 2, 99, 3], "at_once": [99, 1],
               "long": list(range(100)), "end_in_repeat": [7, 7, 99, 7]}
    rows = [(c, i, t) for c, ts in streams.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "clip_id string, step bigint, token bigint")
    kept = {}
    for r in cut_token_stream(df, 99).collect():
        kept.setdefault(r.clip_id, {})[r.step] = r.token
    kept = {c: [t for _, t in sorted(v.items())] for c, v in kept.items()}
    assert kept == {"repeat": [5, 7, 7, 7, 7], "short": [5, 7, 7, 7], "broken": [5, 7, 7, 8, 7], "end": [1, 2], "long": list(range(64)), "end_in_repeat": [7, 7]}
    assert {r.clip_id: r.stop_reason for r in stop_reasons(df, 99).collect()} == {
        "repeat": "repeated_token_collapse", "short": "max_decode_tokens", "broken": "max_decode_tokens", "end": "end_of_text",
        "at_once": "end_of_text", "long": "max_decode_tokens", "end_in_repeat": "end_of_text"}


def test_pairs_are_looked_up_once(spark):
    """Chains of three lengths, some pairs named twice or turned round: the same by windows and by scans in buckets."""
    held = spark.createDataFrame(
        [(f"r{r}", f"c{i}", i * 10, i * 10 + 10, "deleted" if (r, i) == (2, 4) else "pending") for r in range(3) for i in range(4 + 3 * r)],
        "recording_id string, clip_id string, start_us bigint, end_us bigint, status string",
    )
    named = [(f"r{r}", f"c{i}", f"c{i + 1}") for r in range(3) for i in range(3 + 3 * r)]
    named += [("r0", "c1", "c0"), ("r1", "c2", "c3"), ("r1", "c2", "c2"), ("r2", "c0", "c5"), ("r2", "c0", "none")]
    pairs = spark.createDataFrame(named, "recording_id string, first_clip_id string, second_clip_id string")
    found = []
    for most in (1_000, 4, 0):
        made, bad = C.append_clips(held, pairs, width=30, most=most)
        plan = bad._jdf.queryExecution().optimizedPlan().toString()
        if most == 1_000:
            assert "Join" not in plan  # no clip is looked up again
        found.append((sorted(map(tuple, made.collect())), sorted(map(tuple, bad.collect()))))
    assert found[0] == found[1] == found[2]
    made, bad = found[0]
    assert [r[1:3] for r in made if r[0] == "r0"] == [("c0", "c1"), ("c2", "c3")]
    assert [r[1:] for r in bad if r[0] == "r0"] == [("c0", "c1", "clip_not_active"), ("c1", "c2", "clip_not_active")]
    assert sorted(r[3] for r in bad if r[0] == "r2").count("clip_not_active") == 3 + 3
