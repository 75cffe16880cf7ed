"""Event logs and manifests on storage.

Two layouts: a parquet table of flat events, hash-partitioned so that a recording is not
a directory of its own, and the folder layout ``<root>/recordings/<uuid>/`` with
``events.ndjson`` and ``manifest.json``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions.ids import is_uuid
from tapeloom.functions.text import is_blank
from tapeloom.operators.clips import ORDINAL_BUCKET, RECORDING
from tapeloom.operators.replay import Replayed, replay
from tapeloom.plans.once import computed_once
from tapeloom.plans.scan import SumBefore, ordered_scan
from tapeloom.plans.stage import settings, written
from tapeloom.schemas import (
    ASSET_KINDS, CLIP_KINDS, EVENT_COLUMNS, EVENT_KINDS, LOG_LINE_DDL, MANIFEST_DDL, N_BUCKETS, PROVENANCES, SCHEMA_VERSION,
)
from tapeloom.sources.files import write_files

_FOLDER = r"/recordings/([^/]+)/[^/]+$"
# A folder per recording: Spark would list up to 10,000 of them in a task each, and read 32 files in one, as it counts opening a
# file as reading 4 MB.
LISTING = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "256"}
OPENING = {"spark.sql.files.openCostInBytes": str(256 << 10)}


def owner_of(path) -> F.Column:
    return F.regexp_extract(path, _FOLDER, 1)


def _untyped(uuids: bool) -> F.Column:
    """Whether a parsed line lacks a field its kind needs, or a value is not of the field's type."""
    kind = F.col("kind")

    def lacks(kinds: tuple[str, ...], *names: str):
        missing = F.lit(False)
        for name in names:
            missing = missing | F.col(name).isNull()
        return kind.isin(*kinds) & missing

    wrong = (
        lacks(CLIP_KINDS, "clip_id")
        | lacks(("recording_failed", "transcription_failed"), "reason")
        | lacks(("recording_created",), "source_kind", "source_path")
        | lacks(("clip_added",), "start_us", "end_us")
        | lacks(("clip_moved",), "target_index")
        | lacks(("transcript_committed",), "transcript_id", "provenance", "text")
        | ~F.col("source_kind").isin(*ASSET_KINDS)
        | ~F.col("provenance").isin(*PROVENANCES)
    )
    for name in ("sequence", "start_us", "end_us", "target_index"):
        wrong = F.coalesce(wrong, F.lit(False)) | F.coalesce(F.col(name) < 0, F.lit(False))
    if uuids:
        for name in (RECORDING, "clip_id", "transcript_id"):
            wrong = wrong | F.coalesce(~is_uuid(name), F.lit(False))
    return wrong


def parse_log_lines(lines: DataFrame, uuids: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(owner, value)`` text lines to (flat events, rejects with the raw line).

    Blank lines are skipped. A line is malformed unless it parses, holds exactly one event, and
    that event has the fields of its kind: known names, numbers from zero up, and with ``uuids``
    ids that are UUIDs. A ``line_no`` or ``at_byte`` column is kept.
    """
    kept = ["owner", "value", *(c for c in ("line_no", "at_byte") if c in lines.columns)]
    shape = LOG_LINE_DDL + ", _corrupt string"
    parsed = lines.filter(~is_blank("value")).withColumn(
        "j", F.from_json("value", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    )
    parsed = computed_once(parsed, kept, [F.col("j")])
    event = F.col("j.event")
    filled = [F.when(event[k].isNotNull(), F.lit(k)) for k in EVENT_KINDS]
    kinds = F.filter(F.array(*filled), lambda x: x.isNotNull())

    def pick(path: str, kinds_with: tuple[str, ...]):
        return F.coalesce(*[F.col(f"j.event.{k}.{path}") for k in kinds_with]) if kinds_with else F.lit(None)

    clip_kinds = tuple(k for k in EVENT_KINDS if not k.startswith("recording_"))
    flat = computed_once(parsed, kept, [
        F.col("j._corrupt").isNotNull().alias("corrupt"),
        F.size(kinds).alias("n_kinds"),
        pick("recording_id", EVENT_KINDS).alias(RECORDING),
        F.col("j.sequence").alias("sequence"),
        F.get(kinds, F.lit(0)).alias("kind"),
        pick("clip_id", clip_kinds).alias("clip_id"),
        F.col("j.event.transcript_committed.transcript_id").alias("transcript_id"),
        F.col("j.event.clip_added.source_range.start_us").alias("start_us"),
        F.col("j.event.clip_added.source_range.end_us").alias("end_us"),
        F.col("j.event.clip_moved.target_index").alias("target_index"),
        F.col("j.event.transcript_committed.provenance").alias("provenance"),
        F.col("j.event.transcript_committed.text").alias("text"),
        pick("reason", ("recording_failed", "transcription_failed")).alias("reason"),
        F.col("j.event.recording_created.source.kind").alias("source_kind"),
        F.col("j.event.recording_created.source.path").alias("source_path"),
        F.col("j.schema_version").alias("schema_version"),
    ])
    malformed = (
        F.col("corrupt") | (F.col("n_kinds") != 1) | F.col("sequence").isNull()
        | F.col("schema_version").isNull() | F.col(RECORDING).isNull() | _untyped(uuids)
    )
    code = F.when(malformed, "invalid_event_line").when(
        F.lower(RECORDING) != F.lower("owner"), "wrong_recording"
    )
    judged = flat.withColumn("reason_code", code)
    bad = judged.filter("reason_code is not null").select(
        F.col("owner").alias(RECORDING), *kept[2:], "sequence", "kind", "reason_code", F.col("value").alias("raw")
    )
    good = judged.filter("reason_code is null").withColumn(RECORDING, F.lower(RECORDING)).select(*EVENT_COLUMNS, *kept[2:])
    return good, bad


def read_event_log(spark: SparkSession, root: str, line_numbers: bool = False) -> tuple[DataFrame, DataFrame]:
    """All logs below ``root`` whose folder is named by a UUID; other folders are ignored.

    With ``line_numbers`` events and rejects have ``line_no``, counted from 1 in each file.
    """
    lines = _texts(spark, root, "events.ndjson")
    owned = lines.select(
        owner_of(F.col("_metadata.file_path")).alias("owner"), "value",
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
    ).filter(is_uuid("owner"))
    return parse_log_lines(_numbered(owned) if line_numbers else owned.select("owner", "value"), uuids=True)


def _texts(spark: SparkSession, root: str, name: str, whole: bool = False) -> DataFrame:
    """The text files called ``name`` in the folders of recordings."""
    with settings(spark, LISTING):
        return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(f"{root.rstrip('/')}/recordings", wholetext=whole)


def _numbered(lines: DataFrame) -> DataFrame:
    """``(owner, line_no, value)``: a reader takes a block's lines in order, blocks add up their counts."""
    held = written(lines.withColumn("at", F.monotonically_increasing_id()), "lines", asked=OPENING)
    blocks = held.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return held.join(offsets, ["path", "block"]).select(
        "owner", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "value"
    )


def in_file_order(events: DataFrame, width: int = ORDINAL_BUCKET) -> tuple[DataFrame, DataFrame]:
    """(events up to the first line out of sequence in its file, that line as a reject).

    A log's k-th event must have the number k. ``events`` come with ``line_no``.
    """
    one = F.lit(1).cast("bigint")
    ranked = ordered_scan(
        events.select(RECORDING, "line_no", "sequence", "kind"), [RECORDING], "line_no", [SumBefore("rank", one)], width, share=True
    )
    off = ranked.filter(F.col("sequence") != F.col("rank") + 1)
    first = off.groupBy(RECORDING).agg(F.min(F.struct("line_no", "sequence", "kind")).alias("f"))
    rejects = first.select(RECORDING, "f.*", F.lit("event_out_of_order").alias("reason_code"))
    stops = rejects.select(RECORDING, F.col("line_no").alias("stop_line"))
    sound = events.join(stops, RECORDING, "left").filter("stop_line is null or line_no < stop_line").drop("stop_line")
    return sound, rejects


def line_json(events: DataFrame, order: str = "sequence") -> DataFrame:
    """Flat events as canonical one-line JSON: (recording_id, ``order``, value)."""
    clip = [F.col(RECORDING), F.col("clip_id")]
    payload = {
        "recording_created": F.struct(RECORDING, F.struct(F.col("source_kind").alias("kind"), F.col("source_path").alias("path")).alias("source")),
        "recording_started": F.struct(RECORDING),
        "recording_saved": F.struct(RECORDING),
        "recording_failed": F.struct(RECORDING, "reason"),
        "transcription_started": F.struct(*clip),
        "transcription_failed": F.struct(*clip, F.col("reason")),
        "clip_added": F.struct(*clip, F.struct("start_us", "end_us").alias("source_range")),
        "clip_moved": F.struct(*clip, F.col("target_index")),
        "clip_deleted": F.struct(*clip),
        "transcript_committed": F.struct(*clip, F.col("transcript_id"), F.col("provenance"), F.col("text")),
    }
    event = F.struct(*[F.when(F.col("kind") == k, payload[k]).alias(k) for k in EVENT_KINDS])
    line = F.to_json(F.struct("schema_version", "sequence", event.alias("event")), {"ignoreNullFields": "true"})
    return events.select(RECORDING, order, line.alias("value"))


def write_event_logs(events: DataFrame, root: str, order: str = "sequence") -> DataFrame:
    """Whole logs in the folder layout, one file per recording, lines by ``order``; returns what was written."""
    path = F.concat(F.lit(f"{root.rstrip('/')}/recordings/"), F.col(RECORDING), F.lit("/events.ndjson"))
    lines = line_json(events, order).select(path.alias("path"), F.col(order).alias("part"), F.concat("value", F.lit("\n")).cast("binary").alias("data"))
    return write_files(lines)


def append_events(events: DataFrame, path: str) -> None:
    """Append flat events to the parquet table."""
    bucket = F.pmod(F.xxhash64(RECORDING), F.lit(N_BUCKETS)).cast("int")
    events.select(*EVENT_COLUMNS).withColumn("bucket", bucket).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    from tapeloom.schemas import EVENTS_DDL

    return spark.read.schema(EVENTS_DDL + ", bucket int").parquet(path).select(*EVENT_COLUMNS)


def parse_manifests(texts: DataFrame) -> tuple[Replayed, DataFrame]:
    """``(owner, value)`` manifest texts to state tables and rejects.

    A manifest without ``last_sequence`` loads, but cannot be continued.
    """
    parsed = texts.withColumn("j", F.from_json("value", MANIFEST_DDL))
    code = (
        F.when(F.col("j.recording.id").isNull() | F.col("j.schema_version").isNull(), "invalid_manifest")
        .when(F.col("j.schema_version") != SCHEMA_VERSION, "unsupported_schema")
        .when(F.lower("j.recording.id") != F.lower("owner"), "wrong_recording")
    )
    judged = parsed.withColumn("reason_code", code)
    none = F.lit(None).cast("bigint")
    bad = judged.filter("reason_code is not null").select(
        F.col("owner").alias(RECORDING), none.alias("sequence"), F.lit(None).cast("string").alias("kind"), "reason_code", F.col("value").alias("raw")
    )
    good = judged.filter("reason_code is null").select(F.lower("j.recording.id").alias(RECORDING), "j.last_sequence", F.col("j.recording").alias("r"))
    recordings = good.select(
        RECORDING, F.col("r.source.kind").alias("source_kind"), F.col("r.source.path").alias("source_path"),
        F.col("r.status").alias("status"), F.col("r.failure").alias("failure"), "last_sequence",
    )
    clips = good.select(RECORDING, F.posexplode("r.clips").alias("position", "c")).select(
        RECORDING, F.col("c.id").alias("clip_id"), F.col("position").cast("bigint").alias("position"),
        F.col("c.source_range.start_us").alias("start_us"), F.col("c.source_range.end_us").alias("end_us"),
        F.col("c.status").alias("status"), F.col("c.failure").alias("failure"),
    )
    texts_out = good.select(RECORDING, F.posexplode("r.transcripts").alias("position", "t")).select(
        RECORDING, F.col("position").cast("bigint").alias("version_no"), F.col("t.id").alias("transcript_id"),
        F.col("t.clip_id").alias("clip_id"), F.col("t.provenance").alias("provenance"), F.col("t.text").alias("text"),
    )
    return Replayed(recordings, clips, texts_out, bad, None), bad


def read_manifests(spark: SparkSession, root: str) -> tuple[Replayed, DataFrame]:
    texts = _texts(spark, root, "manifest.json", whole=True)
    owned = texts.select(owner_of(F.col("_metadata.file_path")).alias("owner"), "value").filter(is_uuid("owner"))
    return parse_manifests(owned)


def manifest_lines(state: Replayed) -> DataFrame:
    """Manifests as ordered lines: (recording_id, part, line_no, value).

    A manifest is opened, its clips and versions follow one per line, then it is closed,
    so a recording with many clips is streamed out and never gathered.
    """
    q = lambda c: F.coalesce(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), F.lit(""))
    value = lambda c: F.regexp_extract(q(c), r'(?s)^\{"v":(.*)\}$', 1)
    r = state.recordings
    last_clip = state.clips.groupBy(RECORDING).agg(F.max("position").alias("last"))
    last_text = state.transcripts.groupBy(RECORDING).agg(F.max("version_no").alias("last"))
    head = r.select(
        RECORDING, F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("line_no"),
        F.concat(
            F.lit(f'{{"schema_version":{SCHEMA_VERSION},"recording":{{"id":'), value(RECORDING), F.lit(',"source":{"kind":'), value("source_kind"),
            F.lit(',"path":'), value("source_path"), F.lit('},"status":'), value("status"), F.lit(',"failure":'), value("failure"), F.lit(',"clips":['),
        ).alias("value"),
    )
    clip = F.to_json(F.struct(
        F.col("clip_id").alias("id"), F.struct("start_us", "end_us").alias("source_range"), "status", "failure"
    ), {"ignoreNullFields": "false"})
    clips = state.clips.join(last_clip, RECORDING).select(
        RECORDING, F.lit(1).alias("part"), F.col("position").alias("line_no"),
        F.concat(clip, F.when(F.col("position") < F.col("last"), ",").otherwise("")).alias("value"),
    )
    middle = r.select(RECORDING, F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("line_no"), F.lit('],"transcripts":[').alias("value"))
    version = F.to_json(F.struct(F.col("transcript_id").alias("id"), "clip_id", "provenance", "text"), {"ignoreNullFields": "false"})
    versions = state.transcripts.join(last_text, RECORDING).select(
        RECORDING, F.lit(3).alias("part"), F.col("version_no").alias("line_no"),
        F.concat(version, F.when(F.col("version_no") < F.col("last"), ",").otherwise("")).alias("value"),
    )
    tail = r.select(RECORDING, F.lit(4).alias("part"), F.lit(0).cast("bigint").alias("line_no"),
        F.concat(F.lit(']},"last_sequence":'), F.coalesce(F.col("last_sequence").cast("string"), F.lit("null")), F.lit("}")).alias("value"),
    )
    return head.unionByName(clips).unionByName(middle).unionByName(versions).unionByName(tail)


def write_manifests(state: Replayed, root: str) -> DataFrame:
    """One manifest.json per recording, each moved into place when complete."""
    path = F.concat(F.lit(f"{root.rstrip('/')}/recordings/"), F.col(RECORDING), F.lit("/manifest.json"))
    lines = manifest_lines(state).select(
        path.alias("path"), F.struct("part", "line_no").alias("part"), F.concat("value", F.lit("\n")).cast("binary").alias("data")
    )
    return write_files(lines)


def list_recordings(spark: SparkSession, root: str) -> Replayed:
    """Every recording below ``root``: from its log, or from its manifest where there is no log.

    A recording that cannot be loaded whole is reported in ``rejects`` and left out;
    the others are unaffected.
    """
    read, bad_lines = read_event_log(spark, root, line_numbers=True)
    events, disordered = in_file_order(written(read, "events"))
    unread = bad_lines.select(RECORDING).distinct()
    state = replay(events.join(unread, RECORDING, "left_anti").drop("line_no"))
    manifests, bad_manifests = read_manifests(spark, root)
    logged = events.select(RECORDING).unionByName(bad_lines.select(RECORDING)).distinct()
    broken = state.rejects.select(RECORDING).unionByName(disordered.select(RECORDING)).distinct()
    late = disordered.join(unread.unionByName(state.rejects.select(RECORDING)).distinct(), RECORDING, "left_anti")

    def both(name: str) -> DataFrame:
        from_log = getattr(state, name).join(broken, RECORDING, "left_anti")
        return from_log.unionByName(getattr(manifests, name).join(logged, RECORDING, "left_anti"))

    cols = [RECORDING, "sequence", "kind", "reason_code"]
    rejects = state.rejects.select(*cols).unionByName(late.select(*cols)).unionByName(bad_lines.select(*cols)).unionByName(
        bad_manifests.join(logged, RECORDING, "left_anti").select(*cols)
    )
    return Replayed(both("recordings").orderBy(RECORDING), lambda: both("clips"), both("transcripts"), rejects, state.accepted)
