"""Blocks stored by block number: same pieces, no exchange of samples, few files for few clips."""

import tempfile

import pytest

from tapeloom.operators import audio
from tapeloom.schemas import AUDIO_BLOCKS_DDL
from tapeloom.sources.block_store import open_blocks, store_blocks

FRAMES, BLOCKS, BUCKETS = 160, 200, 8
CLIPS = "recording_id string, clip_id string, start_us bigint, end_us bigint, status string"


@pytest.fixture(scope="module")
def stored(spark):
    rows = [
        (r, "original", b, b * FRAMES, BLOCKS * FRAMES, [float((b * FRAMES + i) % 97) for i in range(FRAMES)])
        for r in ("a", "b") for b in range(BLOCKS)
    ]
    blocks = spark.createDataFrame(rows, AUDIO_BLOCKS_DDL)
    media = spark.createDataFrame([(r, BLOCKS * FRAMES) for r in ("a", "b")], "recording_id string, frame_count bigint")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/blocks"
    store_blocks(blocks, path, BUCKETS)
    return blocks, open_blocks(spark, path, BUCKETS), media


def pieces_of(clips, blocks, media):
    return audio.cut_clips(clips, blocks, media, FRAMES)[0]


def values(pieces):
    return sorted((r.recording_id, r.clip_id, r.piece_no, r.first_frame, tuple(r.samples)) for r in pieces.collect())


def test_same_pieces_as_from_loose_blocks(spark, stored):
    blocks, store, media = stored
    clips = spark.createDataFrame([(r, f"{r}{k}", k * 7_001, k * 7_001 + 35_003, "pending") for r in "ab" for k in range(200)], CLIPS)
    got = values(pieces_of(clips, store, media))
    assert got == values(pieces_of(clips, blocks, media)) and len(got) > 800


def test_no_sample_is_exchanged(spark, stored):
    _, store, media = stored
    clips = spark.createDataFrame([("a", f"c{k}", k * 1000, k * 1000 + 900, "pending") for k in range(1500)], CLIPS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a store of any size that matters
    try:
        plan = pieces_of(clips, store, media)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    depth = {n: len(line) - len(line.lstrip(" :+-*()0123456789")) for n, line in enumerate(lines)}
    scan = next(n for n, line in enumerate(lines) if "FileScan" in line and "samples" in line)
    above, at = [], scan
    for n in range(scan - 1, -1, -1):
        if depth[n] < depth[at]:
            above.append(lines[n])
            at = n
    assert any("Join" in line for line in above) and not any("Exchange" in line for line in above), plan


def test_few_clips_read_few_files(spark, stored):
    _, store, media = stored
    clips = spark.createDataFrame([("b", "c", 20_000, 39_999, "pending")], CLIPS)
    ranges = spark.createDataFrame([("b", 2), ("b", 3)], "recording_id string, block_no bigint")
    held = store.holding(ranges)
    files = {r[0] for r in held.select("_metadata.file_name").distinct().collect()}
    assert 1 <= len(files) <= 2 and {("b", 2), ("b", 3)} <= {(r.recording_id, r.block_no) for r in held.collect()}
    assert store.holding(ranges.limit(0)).count() == 0
    assert len(values(pieces_of(clips, store, media))) == 2
    run = held._jdf.queryExecution()
    scan = run.executedPlan().collectLeaves().head()
    run.toRdd().count()
    assert scan.metrics().apply("numFiles").value() == len(files)
