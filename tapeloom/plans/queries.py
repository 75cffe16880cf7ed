"""Registered queries: every operator over the whole supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import audio as A
from tapeloom.functions.ids import derived_uuid
from tapeloom.functions.text import (
    artifact_path, asset_kind, extension, is_blank, is_supported_media, next_profile, profile_label,
    profile_short_label, trim_unicode,
)
from tapeloom.functions.timecode import duration_us, midpoint, sample_ceil, sample_floor
from tapeloom.operators import audio, clips, commands, features, replay, tokens, transcription, validation, views
from tapeloom.plans import tables as T
from tapeloom.plans.full_log import full_log
from tapeloom.plans.once import computed_once
from tapeloom.plans.scan import SumBefore, ordered_scan
from tapeloom.plans.stage import COMPILED, written
from tapeloom.plans.tables import RECORDING
from tapeloom.session import fresh_folder
from tapeloom.schemas import COMMAND_EVENTS, COMMANDS_DDL, EVENTS_DDL, struct_type
from tapeloom.sources import block_store, event_log, export, media
from tapeloom.sources.event_log import line_json, parse_log_lines
from tapeloom.sources.files import write_files
from tapeloom.sources.probe import parse_probe
from tapeloom.streaming import capture
from tapeloom.streaming.bounded import drained, drained_into, table_stream
from tapeloom.streaming.growing import growing_event_logs
from tapeloom.streaming.replay import command_sink, read_snapshots, replay_stream, snapshot_sink
from tapeloom.streaming.level import level_by_window

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Ship dates are whole days, so a bucket holds at most this many distinct starts of one order.
DAY_BUCKET_US = 4_096 * 86_400_000_000


def query(make: Callable[[SparkSession, str], DataFrame]):
    REGISTRY[make.__name__] = make
    return make


def _rounded(column, digits: int = 6):
    return F.round(F.col(column).cast("double") if isinstance(column, str) else column.cast("double"), digits)


def _samples(blocks: DataFrame, digits: int = 6) -> DataFrame:
    """Blocks as one row per sample, for comparison by value."""
    return blocks.select(RECORDING, "profile", "first_frame", F.posexplode("samples").alias("i", "x")).select(
        RECORDING, "profile", (F.col("first_frame") + F.col("i")).alias("frame_no"), _rounded("x", digits).alias("sample")
    )


# --- read models -----------------------------------------------------------

@query
def transcript_document(spark, d):
    versions = T.conversation_versions(spark, d)
    return views.transcript_document(T.conversation_clips(versions), versions.drop("position"))


@query
def document_totals(spark, d):
    return views.document_totals(transcript_document(spark, d))


@query
def latest_transcript(spark, d):
    return views.latest_transcript(T.conversation_versions(spark, d)).select(
        RECORDING, "clip_id", "version_no", "provenance", "text"
    )


@query
def version_history(spark, d):
    return views.version_history(T.conversation_versions(spark, d)).select(
        RECORDING, "clip_id", "version_no", "version_index", "provenance", "previous_provenance", "changed"
    )


@query
def clip_navigation(spark, d):
    return views.clip_navigation(T.turn_clips(spark, d))


@query
def first_active_clip(spark, d):
    found = T.turn_clips(spark, d).withColumn("start_us", F.col("position")).withColumn("end_us", F.col("position") + 1)
    return clips.first_active_clip(found).select(RECORDING, "clip_id", "position")


@query
def active_target_index(spark, d):
    return clips.active_target_index(T.turn_clips(spark, d))


@query
def recording_view(spark, d):
    versions = T.conversation_versions(spark, d)
    recordings = versions.select(RECORDING).distinct().withColumn("status", F.lit("saved")).withColumn(
        "failure", F.lit(None).cast("string")
    )
    held = T.conversation_clips(versions).withColumn("start_us", F.col("position")).withColumn(
        "end_us", F.col("position") + 1
    ).withColumn("failure", F.lit(None).cast("string"))
    header, _, _ = views.recording_view(recordings, held, versions.drop("position"))
    return header.select(RECORDING, "status", "selected_clip_id", "provenance", "text", "committed")


@query
def recording_view_selected(spark, d):
    """The same view with a clip named per conversation: its last one, which may be deleted."""
    versions = T.conversation_versions(spark, d)
    recordings = versions.select(RECORDING).distinct().withColumn("status", F.lit("saved")).withColumn(
        "failure", F.lit(None).cast("string")
    )
    held = T.conversation_clips(versions).withColumn("start_us", F.col("position")).withColumn(
        "end_us", F.col("position") + 1
    ).withColumn("failure", F.when(F.col("position") % 2 == 1, F.concat(F.lit("odd "), "clip_id")))
    named = held.groupBy(RECORDING).agg(F.max_by("clip_id", "position").alias("clip_id"))
    header, _, diagnostics = views.recording_view(recordings, held, versions.drop("position"), named)
    notes = diagnostics.groupBy(RECORDING).agg(F.count("*").alias("n_notes"), F.min("message").alias("first_note"))
    return header.select(RECORDING, "selected_clip_id", "provenance", "text", "committed").join(notes, RECORDING, "left")


@query
def report_lines(spark, d):
    """A report written as text and read back."""
    path = f"{fresh_folder(spark, 'report')}/totals"
    export.write_report(document_totals(spark, d), path, "text")
    return spark.read.text(path)


@query
def show_recordings(spark, d):
    recordings = T.read(spark, d, "orders").select(T.text_id("o_orderkey"), F.col("o_orderstatus").alias("status"))
    held = T.order_clips(spark, d)
    return views.show_recordings(recordings, held, held.filter("line_status = 'F'"))


@query
def media_summary(spark, d):
    recordings = T.read(spark, d, "orders").select(
        T.text_id("o_orderkey"), F.col("o_orderpriority").alias("source_kind"), F.col("o_orderstatus").alias("status")
    )
    media = T.order_media(spark, d).withColumn("sample_rate_hz", F.lit(16000))
    return views.media_summary(recordings, media)


@query
def next_action(spark, d):
    recordings = T.read(spark, d, "orders").select(T.text_id("o_orderkey"))
    held = T.order_clips(spark, d).withColumn("position", F.col("start_us")).withColumn(
        "status", F.when(F.col("status") == "failed", "deleted").otherwise(F.col("status"))
    )
    return views.next_action(recordings, T.order_media(spark, d), held, held.filter("line_status = 'F'"))


@query
def next_recording(spark, d):
    ids = T.read(spark, d, "customer").select(derived_uuid("customer", "c_custkey").alias(RECORDING))
    return views.next_recording(ids)


@query
def failure_report(spark, d):
    recordings = replay.latest_status(T.user_events(spark, d))
    return views.failure_report(recordings, T.user_timeline(spark, d))


# --- event logs ------------------------------------------------------------

@query
def replay_recordings(spark, d):
    return replay.replay(written(T.conversation_log(spark, d), "log")).recordings


@query
def replay_clips(spark, d):
    return replay.replay(written(T.conversation_log(spark, d), "log")).clips


@query
def replay_transcripts(spark, d):
    return replay.replay(written(T.conversation_log(spark, d), "log")).transcripts


@query
def replay_rejects(spark, d):
    return replay.replay(written(T.conversation_log(spark, d), "log")).rejects


def _stored_log(spark, d) -> DataFrame:
    """The full logs as the table that they are in use."""
    return written(full_log(spark, d), "log", asked=COMPILED)


@query
def replay_full_recordings(spark, d):
    """Logs with all ten kinds and every reject code, one per order."""
    return replay.replay(_stored_log(spark, d)).recordings


@query
def replay_full_clips(spark, d):
    return replay.replay(_stored_log(spark, d), tables=("clips",)).clips


@query
def replay_full_transcripts(spark, d):
    return replay.replay(_stored_log(spark, d), tables=("transcripts",)).transcripts


@query
def replay_full_rejects(spark, d):
    return replay.replay(_stored_log(spark, d), tables=()).rejects


@query
def life_cycle_rejects(spark, d):
    """Events as logs numbered anew, purchases as clips; numbering faults are in ``numbering_rejects``."""
    one = F.lit(1).cast("bigint")
    dense = ordered_scan(T.user_events(spark, d), [RECORDING], "sequence", [SumBefore("n", one)], 65_536).withColumn(
        "sequence", F.col("n") + 1
    ).drop("n")
    return replay.replay(_as_log(dense)).rejects


@query
def numbering_rejects(spark, d):
    """The same events under their own numbers: gaps stop nearly every log at once."""
    return replay.replay(_as_log(T.user_events(spark, d))).rejects


def _as_log(dense: DataFrame) -> DataFrame:
    for name, kind in [("transcript_id", "string"), ("target_index", "bigint"), ("provenance", "string"), ("text", "string")]:
        dense = dense.withColumn(name, F.lit(None).cast(kind))
    return dense.withColumn("schema_version", F.lit(1))


@query
def latest_state(spark, d):
    return replay.latest_status(T.user_events(spark, d))


@query
def transition_audit(spark, d):
    return replay.transition_audit(T.user_events(spark, d))


@query
def sequence_audit(spark, d):
    return validation.sequence_audit(T.user_events(spark, d))


@query
def state_equals(spark, d):
    """Line items against the same rows with returned ones relabelled: what a stale snapshot shows."""
    now = T.order_clips(spark, d).select(RECORDING, "clip_id", "status")
    then = now.withColumn("status", F.when(F.col("status") == "failed", "pending").otherwise(F.col("status")))
    return replay.state_differences(now, then).groupBy("only_in", "status").agg(F.count("*").alias("n_rows"))


@query
def event_lines(spark, d):
    """Logs to canonical lines and back."""
    lines = computed_once(line_json(T.conversation_log(spark, d)), [F.col(RECORDING).alias("owner")], [F.col("value")])
    good, _ = parse_log_lines(lines)
    return good.groupBy(RECORDING, "kind").agg(
        F.count("*").alias("n_events"), F.sum("sequence").alias("sum_sequence"),
        F.sum(F.octet_length("text")).cast("bigint").alias("text_bytes"), F.sum("start_us").alias("sum_start_us"),
    )


@query
def foreign_lines(spark, d):
    """Committed texts that stand in the log of the next conversation."""
    lines = line_json(T.conversation_log(spark, d))
    text = (F.col("sequence") % 3 == 1) & (F.col("sequence") > 1)
    owner = F.when(text, (F.col(RECORDING).cast("bigint") + 1).cast("string")).otherwise(F.col(RECORDING))
    _, bad = parse_log_lines(lines.select(owner.alias("owner"), "value"))
    return bad.select(RECORDING, "sequence", "kind", "reason_code")


def _log_files(spark, d) -> str:
    root = fresh_folder(spark, "store")
    event_log.write_event_logs(T.uuid_log(spark, d), root, "line")
    return root


@query
def file_order_rejects(spark, d):
    """Logs as files, two lines of every fifth swapped: where reading each one stops."""
    events, _ = event_log.read_event_log(spark, _log_files(spark, d), line_numbers=True)
    return event_log.in_file_order(events)[1]


@query
def list_recordings(spark, d):
    """What can be loaded whole from the same files."""
    found = event_log.list_recordings(spark, _log_files(spark, d))
    return found.recordings.select(RECORDING, "source_kind", "status", "last_sequence")


@query
def manifest_round_trip(spark, d):
    """Replayed logs as manifests and back."""
    root = fresh_folder(spark, "store")
    event_log.write_manifests(replay.replay(T.uuid_log(spark, d).drop("line")), root)
    read, _ = event_log.read_manifests(spark, root)
    held = read.clips.groupBy(RECORDING).agg(F.count("*").alias("n_clips"), F.sum("end_us").alias("sum_end_us"))
    texts = read.transcripts.groupBy(RECORDING).agg(
        F.count("*").alias("n_transcripts"), F.sum(F.octet_length("text")).cast("bigint").alias("text_bytes")
    )
    return read.recordings.select(RECORDING, "status").join(held, RECORDING, "left").join(texts, RECORDING, "left")


@query
def manifest_continued(spark, d):
    """Every clip that a manifest holds is deleted: commands go on from where its log ended."""
    root = fresh_folder(spark, "store")
    event_log.write_manifests(replay.replay(T.uuid_log(spark, d).drop("line")), root)
    read, _ = event_log.read_manifests(spark, root)
    events, _ = commands.apply_commands(read, commands.delete_commands(clips.active(read.clips), F.col("position")))
    events = written(events, "tail")
    now = replay.replay(events, snapshot=read)
    added = events.groupBy(RECORDING).agg(F.min("sequence").alias("first_new"), F.count("*").alias("n_new"))
    live = clips.active(now.clips).groupBy(RECORDING).agg(F.count("*").alias("n_live"))
    return added.join(now.recordings.select(RECORDING, "last_sequence"), RECORDING).join(live, RECORDING, "left").na.fill({"n_live": 0})


@query
def export_reports(spark, d):
    """Latest texts as files, one per conversation."""
    versions = T.conversation_versions(spark, d)
    recordings = versions.select(RECORDING).distinct()
    made, _ = export.export_transcripts(recordings, T.conversation_clips(versions), versions.drop("position"), fresh_folder(spark, "store"))
    return made.drop("path")


@query
def export_missing(spark, d):
    versions = T.conversation_versions(spark, d)
    recordings = versions.select(RECORDING).distinct()
    pieces = views.transcript_document(T.conversation_clips(versions), versions.drop("position"))
    return views.documents_missing(recordings, pieces)


@query
def malformed_lines(spark, d):
    """Document texts are no log lines: every one that is not blank is rejected with its raw text."""
    lines = T.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("owner"), F.col("text").alias("value"))
    _, bad = parse_log_lines(lines)
    return bad.select(RECORDING, "reason_code", F.octet_length("raw").cast("bigint").alias("raw_bytes"))


@query
def apply_commands(spark, d):
    """User edits of every committed turn, on top of the replayed logs."""
    state = replay.replay(written(T.conversation_log(spark, d), "log"))
    edits = T.read(spark, d, "conversations").select(
        T.text_id("conv_id"), F.concat_ws("-", "conv_id", "turn").alias("clip_id"), "turn",
        F.upper("text").alias("text"),
    )
    events, rejects = commands.apply_commands(state.accepted, commands.edit_commands(edits, F.col("turn")))
    done = events.select(RECORDING, "clip_id", "kind", F.lit("accepted").alias("outcome"))
    turn = F.concat_ws("-", RECORDING, "ordinal")
    refused = rejects.select(RECORDING, turn.alias("clip_id"), "kind", F.col("reason_code").alias("outcome"))
    return done.unionByName(refused)


@query
def command_log(spark, d):
    """Every record of the full logs as a command on an empty log: refused ones change nothing."""
    named = F.create_map(*[F.lit(x) for pair in COMMAND_EVENTS.items() for x in reversed(pair)])
    rows = full_log(spark, d, copies=True).withColumn("kind", F.coalesce(named[F.col("kind")], F.col("kind")))
    asked = rows.withColumn("ordinal", F.col("sequence") * 2 + F.col("copy")).drop("copy", "sequence", "schema_version")
    empty = spark.createDataFrame([], EVENTS_DDL)
    events, refused = commands.apply_commands(empty, asked)
    done = events.select(RECORDING, "sequence", "kind", "clip_id", F.lit(None).cast("string").alias("reason_code"))
    return done.unionByName(refused.select(
        RECORDING, F.col("ordinal").alias("sequence"), "kind", F.lit(None).cast("string").alias("clip_id"), "reason_code"
    ))


def _order_log(spark, d) -> DataFrame:
    """A created recording per order and its line items as clips of 10 µs, one after the other."""
    one = F.lit(1).cast("bigint")
    lines = T.order_clips(spark, d).select(RECORDING, F.col("clip_id").alias("item"), "start_us")
    ranked = ordered_scan(lines, [RECORDING], "start_us", [SumBefore("rank", one)], DAY_BUCKET_US, ties=["item"])
    rows = ranked.select(
        RECORDING, (F.col("rank") + 2).alias("sequence"), F.lit("clip_added").alias("kind"),
        F.concat(F.lit("c"), F.col("rank")).alias("clip_id"), (F.col("rank") * 10).alias("start_us"), (F.col("rank") * 10 + 10).alias("end_us"),
    )
    made = lines.select(RECORDING).distinct().select(
        RECORDING, F.lit(1).cast("bigint").alias("sequence"), F.lit("recording_created").alias("kind"),
        F.lit("audio_file").alias("source_kind"), F.lit("x").alias("source_path"),
    )
    both = rows.unionByName(made, allowMissingColumns=True).withColumn("schema_version", F.lit(1))
    wanted = struct_type(EVENTS_DDL)
    return both.select(*[F.col(f.name) if f.name in both.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted])


def _cut_log(spark, d) -> tuple[DataFrame, DataFrame]:
    """The full logs in two parts, as a table written twice would hold them: each log up to a number of its own, and the rest."""
    log = _stored_log(spark, d)
    early = F.col("sequence") <= F.expr("3 + cast(recording_id as bigint) % 17")
    return log.filter(early), log.filter(~early)


@query
def replay_tail(spark, d):
    """The full logs judged in two steps: state tables of the first part, then only the records after them.

    Logs that broke a rule in the first part have no more to say."""
    early, late = _cut_log(spark, d)
    every = ("recordings", "clips", "transcripts")
    first = replay.replay(early, tables=every)  # the pass that judges writes them
    stopped = written(first.rejects, "rejects")
    then = replay.replay(late.join(stopped, RECORDING, "left_anti"), snapshot=first, tables=every)
    held = then.clips.groupBy(RECORDING).agg(
        F.count("*").alias("n_clips"), F.sum(F.col("position") * F.col("end_us")).alias("placed"),
        F.sum(F.when(F.col("status") == "edited", F.col("position") + 1)).alias("edited_at"), F.count("failure").alias("n_failures"),
    )
    texts = then.transcripts.groupBy(RECORDING).agg(F.count("*").alias("n_transcripts"), F.sum("version_no").alias("sum_versions"))
    bad = stopped.unionByName(then.rejects).select(RECORDING, F.col("sequence").alias("stop_sequence"), "reason_code")
    return (
        then.recordings.select(RECORDING, "status", "failure", "last_sequence")
        .join(held, RECORDING, "left").join(texts, RECORDING, "left").join(bad, RECORDING, "full_outer")
    )


@query
def command_tail(spark, d):
    """Commands on state tables alone: each clip of the full logs' first part is deleted and added anew, later in the
    source and under another id; before that, where the first clip was edited, one is asked for that would lie over it."""
    state = replay.replay(_cut_log(spark, d)[0])
    state = replay.Replayed(*(written(getattr(state, n), n) for n in ("recordings", "clips", "transcripts")))
    again = state.clips.withColumns({
        "clip_id": F.concat(F.lit("n"), "position"), "start_us": F.col("position") * 10 + 10_000_000, "end_us": F.col("position") * 10 + 10_000_010,
    })
    over = state.clips.filter("position = 0 and status = 'edited'").withColumn("clip_id", F.lit("over"))
    asked = (
        commands.delete_commands(state.clips, F.col("position") * 2)
        .unionByName(commands.add_clip_commands(again, F.col("position") * 2 + 1))
        .unionByName(commands.add_clip_commands(over, F.lit(-1)))
    )
    events, refused = commands.apply_commands(state, asked)
    done = events.select(RECORDING, "sequence", "kind", "clip_id", F.lit(None).cast("string").alias("reason_code"))
    return done.unionByName(refused.select(RECORDING, F.col("ordinal").alias("sequence"), "kind", F.lit(None).cast("string").alias("clip_id"), "reason_code"))


def _command_query(spark, d, change) -> DataFrame:
    log = written(_order_log(spark, d), "log")
    held = log.filter("kind = 'clip_added'").select(RECORDING, "clip_id", "start_us", "end_us", F.lit("pending").alias("status"))
    events, refused = commands.apply_commands(log, change(held), ordinal_width=commands.TIME_ORDINALS)
    done = events.select(RECORDING, "sequence", "kind", "start_us", "end_us")
    return done.unionByName(refused.select(RECORDING, "ordinal", "kind", F.lit(-1).alias("start_us"), F.lit(-1).alias("end_us")).toDF(*done.columns))


@query
def command_splits(spark, d):
    """Every line item split in the middle: each clip deleted, two added."""
    return _command_query(spark, d, lambda held: commands.split_commands(clips.split_clips(held, clips.midpoints(held))[0]))


@query
def command_appends(spark, d):
    """Neighbouring line items joined, as far as a pair's clips are still there."""
    return _command_query(spark, d, lambda held: commands.append_commands(clips.append_clips(held, clips.adjacent_pairs(held))[0]))


def _moves(held: DataFrame) -> DataFrame:
    """Each clip in turn moved to the front; of recordings with an even number the first one behind the end."""
    sized = held.join(held.groupBy(RECORDING).agg(F.count("*").alias("n")), RECORDING)
    beyond = (F.col("start_us") == 0) & (F.col("n") % 2 == 0)
    moves = sized.withColumn("target_index", F.when(beyond, F.col("n")).otherwise(0).cast("bigint"))
    return commands.move_commands(moves, F.col("start_us"))


@query
def command_moves(spark, d):
    """Line items moved to the front of their order, some past its end."""
    return _command_query(spark, d, _moves)


@query
def moved_clips(spark, d):
    """The same moves appended to the stored log, which is read and replayed: the list is turned round."""
    log = written(_order_log(spark, d), "log")
    held = log.filter("kind = 'clip_added'").select(RECORDING, "clip_id", "start_us")
    path = fresh_folder(spark, "events")
    event_log.append_events(log, path)
    moved, _ = commands.apply_commands(event_log.read_events(spark, path), _moves(held), ordinal_width=commands.TIME_ORDINALS)
    event_log.append_events(moved, path)
    state = replay.replay(event_log.read_events(spark, path), tables=("recordings", "clips"))
    return state.clips.join(state.recordings.select(RECORDING, "last_sequence"), RECORDING).select(
        RECORDING, "clip_id", "position", "start_us", "status", "last_sequence"
    )


# --- clip algebra ----------------------------------------------------------

@query
def plan_chunks(spark, d):
    return clips.plan_chunks(T.order_media(spark, d), 30_000_000)


@query
def clip_timeline(spark, d):
    return T.user_timeline(spark, d).select(
        RECORDING, "clip_id", "start_us", "end_us", midpoint("start_us", "end_us").alias("middle_us")
    )


@query
def coverage(spark, d):
    held = T.user_timeline(spark, d)
    media = held.groupBy(RECORDING).agg((F.max("end_us") + 1_000_000).alias("duration_us"))
    return clips.coverage(held.filter("status <> 'failed'"), media)


@query
def overlaps(spark, d):
    return clips.find_overlaps(T.order_clips(spark, d), DAY_BUCKET_US)


@query
def coalesce_runs(spark, d):
    return clips.coalesce_runs(T.order_clips(spark, d), DAY_BUCKET_US)


@query
def locate(spark, d):
    points = T.read(spark, d, "orders").select(
        T.text_id("o_custkey"), F.col("o_orderkey").alias("point_id"),
        (F.round(F.col("o_totalprice") * 100).cast("bigint") * 10).alias("at_us"),
    )
    return clips.locate(T.user_timeline(spark, d), points)


@query
def split_midpoint(spark, d):
    held = T.user_timeline(spark, d)
    made, _ = clips.split_clips(held, clips.midpoints(held))
    return made


@query
def split_rejects(spark, d):
    """Split points taken from event ids: nearly all lie outside their clip."""
    held = T.user_timeline(spark, d)
    points = held.select(RECORDING, "clip_id", F.col("position").alias("split_at_us"))
    _, bad = clips.split_clips(held.filter("status <> 'failed'"), points)
    return bad


@query
def append_pairs(spark, d):
    held = T.user_timeline(spark, d)
    made, _ = clips.append_clips(held, clips.adjacent_pairs(held))
    return made


@query
def append_rejects(spark, d):
    """Pairs that cannot be joined: chained, a clip with itself, one too far, with a failed one, with none."""
    held = T.user_timeline(spark, d).select(
        RECORDING, "clip_id", "start_us", "end_us", F.when(F.col("status") == "failed", "deleted").otherwise("pending").alias("status")
    )
    held = written(held, "clips")  # eight readers below
    every = held.withColumn("status", F.lit("pending"))
    near = written(clips.adjacent_pairs(every), "pairs")
    after = near.toDF(RECORDING, "second_clip_id", "third")
    far = near.join(after, [RECORDING, "second_clip_id"]).select(RECORDING, "first_clip_id", F.col("third").alias("second_clip_id"))
    own = every.select(RECORDING, F.col("clip_id").alias("first_clip_id"), F.col("clip_id").alias("second_clip_id"))
    gone = own.withColumn("second_clip_id", F.lit("gone"))
    chained = clips.append_clips(every, near)[1].select(F.lit("chain").alias("asked"), RECORDING, "first_clip_id", "second_clip_id", "reason_code")
    refused = clips.append_clips(held, far.unionByName(own).unionByName(gone))[1]
    return chained.unionByName(refused.select(F.lit("pair").alias("asked"), *chained.columns[1:]))


@query
def chunk_rejects(spark, d):
    """Orders as recordings, those finished without a length, those in part with an unknown one."""
    status = T.read(spark, d, "orders").select(T.text_id("o_orderkey"), "o_orderstatus")
    length = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", F.col("duration_us"))
    media = T.order_media(spark, d).join(status, RECORDING).withColumn("duration_us", length)
    planned = clips.plan_chunks(media, 30_000_000).groupBy(RECORDING).agg(F.lit("planned").alias("outcome"), F.count("*").alias("n_chunks"))
    none = clips.chunk_rejects(media).select(RECORDING, F.col("reason_code").alias("outcome"), F.lit(0).cast("bigint").alias("n_chunks"))
    return planned.unionByName(none)


def _planned(spark, d) -> tuple[DataFrame, DataFrame]:
    """(clips held, plan): finished orders hold the plan, partial ones another plan, open ones nothing."""
    media = T.order_media(spark, d)
    status = T.read(spark, d, "orders").select(T.text_id("o_orderkey"), "o_orderstatus")
    known = media.join(status, RECORDING)
    plan = clips.plan_chunks(known, 30_000_000)
    have = clips.plan_chunks(known.filter("o_orderstatus = 'F'"), 30_000_000).unionByName(
        clips.plan_chunks(known.filter("o_orderstatus = 'P'"), 10_000_000)
    ).withColumn("status", F.lit("pending"))
    return have.withColumn("clip_id", F.concat(F.lit("k"), "chunk_no")), plan


@query
def ensure_chunks(spark, d):
    return clips.compare_with_plan(*_planned(spark, d))


@query
def ensure_chunks_use(spark, d):
    """The clips to work on: those held where they match, new ones where there are none."""
    return clips.ensure_chunks(*_planned(spark, d))[0]


@query
def ensure_chunks_add(spark, d):
    return clips.ensure_chunks(*_planned(spark, d))[1]


@query
def ensure_full_clip(spark, d):
    held = T.order_clips(spark, d).withColumn("position", F.col("start_us")).filter("status = 'pending'")
    return clips.ensure_full_clip(held, T.order_media(spark, d)).select(RECORDING, "start_us", "end_us", "is_new")


# --- validation and scalars ------------------------------------------------

@query
def blank_text(spark, d):
    trimmed = trim_unicode("text")
    return T.read(spark, d, "documents").select(
        "doc_id", is_blank("text").alias("blank"), F.length(trimmed).cast("bigint").alias("n_trimmed"),
        F.md5(trimmed).alias("trimmed_md5"),
    )


@query
def id_audit(spark, d):
    """Ids used twice and references that name nothing."""
    lines = T.read(spark, d, "lineitem")
    twice = validation.repeated_ids(lines.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], "clip_already_exists")
    lost = validation.dangling_references(
        lines.select("l_orderkey"), T.read(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), ["l_orderkey"], "recording_not_found"
    )
    return twice.groupBy("reason_code").agg(F.count("*").alias("n_keys"), F.sum("uses").alias("n_rows")).unionByName(
        lost.groupBy("reason_code").agg(F.countDistinct("l_orderkey").alias("n_keys"), F.count("*").alias("n_rows"))
    )


@query
def frame_arithmetic(spark, d):
    rate = F.element_at(F.array(*[F.lit(r) for r in (8000, 11025, 16000, 22050, 44100, 48000, 96000)]), F.col("l_linenumber"))
    frames = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return T.read(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", rate.alias("rate"), frames.alias("frames"), duration_us(frames, rate).alias("duration_us"),
        sample_floor(frames).alias("sample_floor"), sample_ceil(frames).alias("sample_ceil"),
    )


@query
def media_kinds(spark, d):
    path = F.regexp_replace("url", "[?#].*$", "")
    return T.read(spark, d, "pages").select(
        "page_id", extension(path).alias("extension"), asset_kind(path).alias("source_kind"),
        is_supported_media(path).alias("supported"),
    )


@query
def profile_names(spark, d):
    profile = F.element_at(F.array(*[F.lit(p) for p in T_PROFILES]), (F.col("label") % 4 + 1).cast("int"))
    return T.read(spark, d, "embeddings").select("vec_id", profile.alias("profile")).select(
        "vec_id", profile_label("profile").alias("label"), profile_short_label("profile").alias("short_label"),
        next_profile("profile").alias("next_profile"),
        artifact_path("store", F.col("vec_id").cast("string"), "profile").alias("path"),
    )


T_PROFILES = ("original", "gain6_db", "noise_gate", "voice_eq")


def _probes(spark, d):
    orders = T.read(spark, d, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole, part = F.expr("o_custkey % 7200"), F.lpad(cents % 1_000_000, 6, "0")
    status = F.col("o_orderstatus")
    frames = F.when(status == "F", "N/A").when(status == "O", "").otherwise(cents.cast("string"))
    csv = F.concat_ws(",", F.lit("48000"), F.lit("2"), frames, F.concat(whole, F.lit("."), part))
    csv = F.when(F.col("o_orderpriority") == "5-LOW", F.concat_ws(",", F.col("o_orderpriority"), F.col("o_orderstatus"))).otherwise(csv)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.expr("o_custkey div 3600 % 100")), two(F.expr("o_custkey div 60 % 60")), F.concat(two(F.expr("o_custkey % 60")), F.lit("."), part))
    layout = F.when(status == "F", "stereo").when(status == "O", "5.1(side)").otherwise("4 channels")
    log = F.concat(F.lit("Input #0, wav\n  Duration: "), clock, F.lit(", bitrate: 512 kb/s\n  Stream #0:0: Audio: pcm_f32le, 44100 Hz, "), layout, F.lit(", flt\n"))
    base = orders.select(F.concat_ws("-", F.lit("csv"), "o_orderkey").alias(RECORDING), F.lit("csv").alias("form"), csv.alias("text"))
    return base.unionByName(orders.select(F.concat_ws("-", F.lit("log"), "o_orderkey").alias(RECORDING), F.lit("log").alias("form"), log.alias("text")))


@query
def probe_parse(spark, d):
    return parse_probe(_probes(spark, d))[0]


@query
def probe_rejects(spark, d):
    return parse_probe(_probes(spark, d))[1].select(RECORDING, "reason_code", "raw")


# --- audio -----------------------------------------------------------------

def _vector_query(spark, d, change):
    return T.read(spark, d, "embeddings").select("vec_id", F.posexplode(change(F.col("embedding"))).alias("i", "x")).select(
        "vec_id", F.col("i").cast("bigint").alias("i"), _rounded("x").alias("sample")
    )


@query
def gain(spark, d):
    return _vector_query(spark, d, A.gain_6db)


@query
def noise_gate(spark, d):
    return _vector_query(spark, d, A.noise_gate)


@query
def voice_eq(spark, d):
    return _vector_query(spark, d, A.voice_eq)


@query
def pad_or_trim(spark, d):
    longer = _vector_query(spark, d, lambda x: A.pad_or_trim(x, 100)).withColumn("length", F.lit(100))
    return longer.unionByName(_vector_query(spark, d, lambda x: A.pad_or_trim(x, 50)).withColumn("length", F.lit(50)))


@query
def downmix(spark, d):
    """Vectors as interleaved three-channel audio, so the last frame is cut off."""
    return _vector_query(spark, d, lambda x: A.downmix(x, F.lit(3)))


@query
def downmix_callback(spark, d):
    """The same vectors as a device buffer of three channels."""
    return _vector_query(spark, d, lambda x: A.downmix_callback(x, F.lit(3)))


def _page_pcm(spark, d, form: str) -> DataFrame:
    pages = T.read(spark, d, "pages").select("page_id", F.encode("url", "UTF-8").alias("payload"))
    heard = pages.select("page_id", A.pcm_to_float("payload", F.lit(form)).alias("samples"))
    return heard.select("page_id", F.posexplode("samples").alias("i", "x")).select(
        "page_id", F.col("i").cast("bigint").alias("i"), _rounded("x").alias("sample")
    )


@query
def pcm24_to_float(spark, d):
    return _page_pcm(spark, d, "pcm24")


@query
def pcm32_to_float(spark, d):
    return _page_pcm(spark, d, "pcm32")


@query
def pcm_to_float(spark, d):
    """Bytes of the page addresses as 16-bit samples."""
    return _page_pcm(spark, d, "pcm16")


@query
def profiles(spark, d):
    return _samples(audio.all_profiles(T.label_blocks(spark, d)))


@query
def profile_receipts(spark, d):
    return audio.profile_receipts(audio.all_profiles(T.label_blocks(spark, d)), "store")


@query
def resample(spark, d):
    return _samples(audio.resample(T.label_blocks(spark, d), 24_000)).drop("profile")


@query
def upsample(spark, d):
    return _samples(audio.resample(T.label_blocks(spark, d), 11_025)).drop("profile")


@query
def reblock(spark, d):
    out = audio.reblock(T.label_blocks(spark, d), 100)
    return out.select(RECORDING, "block_no", "first_frame", "total_frames", F.size("samples").cast("bigint").alias("n_samples"))


@query
def waveform_peaks(spark, d):
    return audio.waveform_peaks(T.label_blocks(spark, d)).select(RECORDING, "bin", _rounded("peak").alias("peak"))


@query
def peaks_of_empty(spark, d):
    """Peaks where every third label has no frame at all."""
    media = T.label_media(spark, d).withColumn("frame_count", F.when(F.expr("cast(recording_id as bigint) % 3 = 0"), 0).otherwise(F.col("frame_count")))
    sounding = T.label_blocks(spark, d).filter("cast(recording_id as bigint) % 3 <> 0")
    return audio.waveform_peaks(sounding, 7, media).select(RECORDING, "profile", "bin", _rounded("peak").alias("peak"))


@query
def cut_clips(spark, d):
    media = T.label_media(spark, d)
    held = _label_clips(media)
    pieces, _ = audio.cut_clips(held, T.label_blocks(spark, d), media, T.VECTOR)
    return pieces.select(RECORDING, "clip_id", "first_frame", F.posexplode("samples").alias("i", "x")).select(
        RECORDING, "clip_id", (F.col("first_frame") + F.col("i")).alias("frame_no"), _rounded("x").alias("sample")
    )


@query
def cut_stored(spark, d):
    """Every third chunk of the label recordings, cut from blocks that were stored by block number."""
    media = T.label_media(spark, d)
    store = block_store.store_blocks(T.label_blocks(spark, d), fresh_folder(spark, "blocks"), 16)
    again = block_store.open_blocks(spark, store.path, 16)
    held = _label_clips(media).withColumn("status", F.when(F.col("start_us") % 30_000 == 0, "pending").otherwise("deleted"))
    pieces, _ = audio.cut_clips(held, again, media, T.VECTOR)
    return pieces.select(RECORDING, "clip_id", "first_frame", F.posexplode("samples").alias("i", "x")).select(
        RECORDING, "clip_id", (F.col("first_frame") + F.col("i")).alias("frame_no"), _rounded("x").alias("sample")
    )


@query
def cut_rejects(spark, d):
    """Line items as clips of the label recordings: most reach past the end."""
    held = T.read(spark, d, "lineitem").select(
        F.col("l_linenumber").cast("string").alias(RECORDING), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey").alias("clip_id"),
        (F.col("l_orderkey") * 10).alias("start_us"), (F.col("l_orderkey") * 10 + F.col("l_partkey")).alias("end_us"), F.lit("pending").alias("status"),
    )
    _, bad = audio.cut_clips(held, T.label_blocks(spark, d), T.label_media(spark, d), T.VECTOR)
    return bad.groupBy(RECORDING, "reason_code").agg(F.count("*").alias("n_clips"))


@query
def level_stats(spark, d):
    stats = audio.level_stats(audio.all_profiles(T.label_blocks(spark, d)))
    return stats.select(RECORDING, "profile", "n_samples", _rounded("gated_share").alias("gated_share"), _rounded("peak").alias("peak"), _rounded("rms").alias("rms"))


@query
def power_spectrum(spark, d):
    power = T.read(spark, d, "embeddings").select("vec_id", features.power_spectrum("embedding").alias("p"))
    return power.select("vec_id", F.posexplode("p").alias("bin", "x")).select(
        "vec_id", F.col("bin").cast("bigint").alias("bin"), _rounded("x", 5).alias("power")
    )


def _label_clips(media: DataFrame) -> DataFrame:
    return clips.plan_chunks(media, 10_000).select(
        RECORDING, F.concat_ws("-", RECORDING, "chunk_no").alias("clip_id"), "start_us", "end_us", F.lit("pending").alias("status")
    )


def _whole(media: DataFrame) -> DataFrame:
    """One clip over each recording."""
    return media.select(
        RECORDING, F.lit("all").alias("clip_id"), F.lit(0).cast("bigint").alias("start_us"),
        F.col("duration_us").alias("end_us"), F.lit("pending").alias("status"),
    )


@query
def log_mel(spark, d):
    """Features of each label recording, summed up per mel band over the 3,000 frames of each window."""
    media = T.label_media(spark, d)
    mel, _ = features.clip_log_mel(_whole(media), T.label_blocks(spark, d), media, T.VECTOR)
    levels = mel.select(RECORDING, F.col("clip_id").alias("window_id"), F.posexplode("mel").alias("mel_bin", "x"))
    return levels.withColumn("mel_bin", F.col("mel_bin").cast("bigint")).groupBy(RECORDING, "window_id", "mel_bin").agg(
        F.count("*").alias("n_frames"), F.round(F.min("x").cast("double"), 3).alias("min_level"),
        F.round(F.max("x").cast("double"), 3).alias("max_level"),
    )


@query
def spectrogram_stats(spark, d):
    """Least and greatest level of each feature window of the whole label recordings."""
    media = T.label_media(spark, d)
    mel, _ = features.clip_log_mel(_whole(media), T.label_blocks(spark, d), media, T.VECTOR)
    return features.spectrogram_stats(mel).select(
        RECORDING, F.col("clip_id").alias("window_id"), "n_frames", _rounded("min_value", 3).alias("min_value"), _rounded("max_value", 3).alias("max_value")
    )


@query
def window_samples(spark, d):
    """Line items as blocks of recordings that are far longer than a feature window."""
    blocks, media = T.line_blocks(spark, d)
    audio_rows, _ = features.window_audio(_whole(media), blocks, media, T.LINE_BLOCK)
    total = F.aggregate("samples", F.lit(0).cast("bigint"), lambda acc, x: acc + F.round(x * 64).cast("bigint"))
    return audio_rows.select(
        RECORDING, "window_id", "window_no", F.size("samples").cast("bigint").alias("n_samples"), total.alias("sum_64ths")
    )


# --- transcription ---------------------------------------------------------

@query
def cut_tokens(spark, d):
    return tokens.cut_token_stream(_user_tokens(spark, d), "purchase")


@query
def cut_tokens_limited(spark, d):
    """The same streams under a limit per user, error tokens taken out at the end."""
    room = F.lit(64) - F.expr("cast(clip_id as bigint) % 60")
    limited = _user_tokens(spark, d).withColumn("room", room)
    return tokens.cut_token_stream(limited, "purchase", special=["error"], limit="room")


@query
def stop_reasons(spark, d):
    return tokens.stop_reasons(_user_tokens(spark, d), "purchase")


def _user_tokens(spark, d):
    one = F.lit(1).cast("bigint")
    rows = T.read(spark, d, "events").select(T.text_id("user_id"), "event_id", "event_type")
    ranked = ordered_scan(rows, [RECORDING], "event_id", [SumBefore("step", one)], 65_536)
    return ranked.select(F.col(RECORDING).alias("clip_id"), "step", F.col("event_type").alias("token"))


@query
def pending_work(spark, d):
    held = T.order_clips(spark, d)
    return transcription.pending_work(held, held.filter("line_status = 'F'"))


@query
def transcribe_fixed(spark, d):
    """Every 10 ms clip of the label recordings through the fixed-text backend."""
    media = T.label_media(spark, d)
    return transcription.transcribe(_label_clips(media), T.label_blocks(spark, d), media, T.VECTOR).select(
        RECORDING, "clip_id", "start_us", "provenance", "text", "error", "backend_id"
    )


class LoudCount:
    """A backend whose answer is a function of the samples, so that every sample is checked."""

    def capabilities(self):
        return transcription.Capabilities("loud-count")

    def transcribe(self, request):
        loud = int((abs(request.samples) > 0.1).sum())
        if loud % 5 == 4:
            raise ValueError(f"no speech in {len(request.samples)} samples")
        return "raw_asr", f"{loud} of {len(request.samples)}"

    def transcribe_batch(self, requests):
        answers = []
        for request in requests:
            try:
                answers.append(self.transcribe(request))
            except ValueError as failure:
                answers.append(failure)
        return answers


def _checked(spark, d):
    """The 10 ms clips, and one per recording that reaches past its end."""
    media = T.label_media(spark, d)
    past = media.select(
        RECORDING, F.concat_ws("-", RECORDING, F.lit("past")).alias("clip_id"), F.lit(5).cast("bigint").alias("start_us"),
        (F.col("duration_us") + 1).alias("end_us"), F.lit("pending").alias("status"),
    )
    held = _label_clips(media).unionByName(past)
    return transcription.transcribe(held, T.label_blocks(spark, d), media, T.VECTOR, LoudCount, run_key="loud-count")


@query
def transcribe_checked(spark, d):
    return _checked(spark, d).select(RECORDING, "clip_id", "start_us", "provenance", "text", "error")


@query
def transcribe_events(spark, d):
    """Begin, commit and fail commands of the same clips."""
    return transcription.outcome_commands(_checked(spark, d)).select(
        RECORDING, "ordinal", "kind", "clip_id", "provenance", "text", "reason"
    )


@query
def text_outcomes(spark, d):
    """Two conversation turns in a row as the window texts of one clip, put back together."""
    rows = T.read(spark, d, "conversations").select(
        T.text_id("conv_id"), F.concat_ws("-", F.col("conv_id"), F.expr("turn div 2")).alias("clip_id"), F.col("turn").alias("window_no"), F.lit(0).cast("bigint").alias("clip_start_us"),
        F.lit("raw_asr").alias("provenance"), "text", F.lit(None).cast("string").alias("error"), F.lit("fake").alias("backend_id"),
    )
    return transcription.clip_outcomes(rows).select(RECORDING, "clip_id", "text", "error")


@query
def clip_windows(spark, d):
    """Orders as clips of a second per unit, cut into feature windows."""
    whole = T.order_media(spark, d).select(
        RECORDING, F.lit("all").alias("clip_id"), F.lit(7).cast("bigint").alias("start_us"),
        (F.col("duration_us") + 7).alias("end_us"), F.lit("pending").alias("status"),
    )
    return features.clip_windows(whole).select(RECORDING, "window_id", "window_no", "start_us", "end_us", "is_long")


@query
def transcribable(spark, d):
    """Line items as prepared audio: what may be transcribed and what may take a profile."""
    rate = F.when(F.col("l_returnflag") == "N", 8000).otherwise(16000)
    held = T.read(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", rate.alias("sample_rate_hz"), F.when(F.col("l_linenumber") > 5, 2).otherwise(1).alias("channels"),
        F.when(F.col("l_linestatus") == "O", "").otherwise("a.wav").alias("audio_path"),
    )
    return held.select(
        "l_orderkey", "l_partkey", validation.transcribable_code().alias("transcribe_code"),
        validation.profile_input_code().alias("profile_code"),
    )


def _with_meta(samples: DataFrame, meta: DataFrame) -> DataFrame:
    """Samples beside their file's figures. Every sample has them; an outer join keeps Spark from sending the
    samples through the driver, whose number its size estimate does not know."""
    return samples.join(meta.select(RECORDING, "frame_count", "duration_us"), RECORDING, "left")


@query
def wav_round_trip(spark, d):
    """Label recordings to WAV files, found, inspected, decoded and normalised again."""
    root = fresh_folder(spark, "store")
    media.write_wav(T.label_blocks(spark, d), root)
    found = media.inspect_wav(media.scan_media(spark, root))
    owner = F.regexp_extract("path", r"/recordings/([^/]+)/", 1)
    normal, meta, _ = media.normalize(found.withColumn(RECORDING, owner), 1)
    return _with_meta(_samples(normal), meta).drop("profile")


def _stereo_lines(blocks: DataFrame, root: str) -> DataFrame:
    """Files of two 16-bit channels at 8 kHz: the samples in ten-thousandths, and half of them."""
    little = lambda v, n: F.array_join(F.transform(
        F.lit([0, 8, 16, 24][:n]), lambda bit: F.lpad(F.hex(F.pmod(F.floor(v / F.pow(F.lit(2.0), bit)), F.lit(256))), 2, "0")
    ), "")
    path = F.concat(F.lit(f"{root}/"), F.col(RECORDING), F.lit(".wav"))
    left = lambda x: F.floor(F.greatest(F.least(x.cast("double"), F.lit(3.0)), F.lit(-3.0)) * 10_000)
    frame = lambda x: F.concat(little(left(x), 2), little(F.floor(left(x) / 2), 2))
    body = blocks.select(path.alias("path"), F.col("block_no").alias("part"), F.unhex(F.array_join(F.transform("samples", frame), "")).alias("data"))
    size = F.col("total_frames") * 4
    form = "".join(v.to_bytes(n, "little").hex() for v, n in ((16, 4), (1, 2), (2, 2), (8000, 4), (32000, 4), (4, 2), (16, 2)))
    head = F.concat(
        F.lit(b"RIFF".hex()), little(size + 36, 4), F.lit(b"WAVEfmt ".hex() + form + b"data".hex()), little(size, 4)
    )
    return blocks.filter("block_no = 0").select(path.alias("path"), F.lit(-1).cast("bigint").alias("part"), F.unhex(head).alias("data")).unionByName(body)


@query
def stereo_files(spark, d):
    """Label recordings as 16-bit stereo files at 8 kHz, found and made 16 kHz mono."""
    root = fresh_folder(spark, "stereo")
    write_files(_stereo_lines(T.label_blocks(spark, d), root))
    found = media.inspect_wav(media.scan_media(spark, root)).withColumn(RECORDING, F.regexp_extract("path", r"/([^/]+)\.wav$", 1))
    normal, meta, _ = media.normalize(found, 1)
    return _with_meta(_samples(normal), meta).drop("profile")


@query
def block_faults(spark, d):
    """Vectors of a label numbered by their own ids: holes between nearly all of them."""
    held = T.read(spark, d, "embeddings").select(
        T.text_id("label"), F.lit("original").alias("profile"), F.col("vec_id").alias("block_no"),
        (F.col("vec_id") * T.VECTOR).alias("first_frame"), F.col("embedding").alias("samples"),
    )
    return audio.block_faults(held)


# --- streams' batch twins --------------------------------------------------

def _turn_packets(spark, d, turns: DataFrame | None = None):
    """Turns as capture packets: the text's bytes are 16-bit samples, system turns are silent."""
    turns = T.read(spark, d, "conversations") if turns is None else turns
    return turns.select(
        T.text_id("conv_id"), F.col("turn").alias("packet_no"), F.lit("pcm16").alias("sample_format"), F.lit(1).alias("channels"),
        F.lit(16_000).alias("sample_rate_hz"), (F.col("role") == "system").alias("silent"), F.lit(480).alias("frames"),
        F.encode("text", "UTF-8").alias("payload"), (F.col("role") == "assistant").alias("stop"),
    )


@query
def capture_blocks(spark, d):
    blocks, _ = capture.assemble_capture(capture.decode_packets(_turn_packets(spark, d)))
    return blocks.select(RECORDING, "block_no", "first_frame", "total_frames", F.size("samples").cast("bigint").alias("n_samples"))


@query
def capture_report(spark, d):
    return capture.assemble_capture(capture.decode_packets(_turn_packets(spark, d)))[1]


@query
def stream_replay(spark, d):
    """The conversation logs judged by the stream."""
    turns = table_stream(spark, f"{d}/conversations.parquet")
    judged = drained(replay_stream(T.conversation_log(spark, d, turns)), "judged")
    return judged.select(RECORDING, "sequence", "kind", "outcome")


@query
def stream_growing_logs(spark, d):
    """Log files judged as they grow: each is written in part, drained, appended to, and drained again after a restart."""
    log = written(T.uuid_log(spark, d).drop("line"), "log")
    root = fresh_folder(spark, "store")
    place = fresh_folder(spark, "judged"), fresh_folder(spark, "judged-progress")
    for part in (log.filter("sequence < 6"), log):
        # a log written whole has the bytes of its first part in front, as if it had been appended to
        event_log.write_event_logs(part, root)
        events, _ = growing_event_logs(spark, root)
        judged = drained(replay_stream(events), "judged", place)
    return judged.groupBy("kind", "outcome").agg(F.count("*").alias("n_records"), F.sum("sequence").alias("sum_sequence"), F.countDistinct(RECORDING).alias("n_recordings"))


def _conversation_commands(spark, d) -> DataFrame:
    """Every record of the conversation logs as a command, in the logs' order."""
    named = F.create_map(*[F.lit(x) for pair in COMMAND_EVENTS.items() for x in reversed(pair)])
    rows = T.conversation_log(spark, d).withColumn("kind", named[F.col("kind")]).withColumnRenamed("sequence", "ordinal")
    return rows.select(*[f.name for f in struct_type(COMMANDS_DDL)])


def _state_totals(state: replay.Replayed) -> DataFrame:
    held = state.clips.groupBy(RECORDING).agg(
        F.count("*").alias("n_clips"), F.count(F.when(F.col("status") == "deleted", 1)).alias("n_deleted"), F.sum("position").alias("sum_positions"),
    )
    texts = state.transcripts.groupBy(RECORDING).agg(F.count("*").alias("n_transcripts"))
    return state.recordings.select(RECORDING, "status", "last_sequence").join(held, RECORDING, "left").join(texts, RECORDING, "left")


@query
def stream_commands(spark, d):
    """Commands as a stream in two runs, each on the snapshots that the one before left."""
    asked = written(_conversation_commands(spark, d), "commands")
    source, log, snaps, mark = (fresh_folder(spark, n) for n in ("asked", "log", "snapshots", "progress"))
    for part in (asked.filter("ordinal < 6"), asked.filter("ordinal >= 6")):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(struct_type(COMMANDS_DDL)).parquet(source)
        drained_into(stream, command_sink(log, snaps, compact_every=2), mark)
    refused = spark.read.parquet(f"{log}/refused").groupBy(RECORDING).agg(F.count("*").alias("n_refused"), F.min("reason_code").alias("reason_code"))
    return _state_totals(read_snapshots(spark, snaps)).join(refused, RECORDING, "left")


@query
def stream_snapshots(spark, d):
    """Snapshots moved on batch by batch by the judged conversation logs, in two runs."""
    log = written(T.conversation_log(spark, d), "log")
    source, judged, snaps, mark = (fresh_folder(spark, n) for n in ("events", "judged", "snapshots", "progress"))
    for part in (log.filter("sequence < 6"), log.filter("sequence >= 6")):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(struct_type(EVENTS_DDL)).parquet(source)
        drained_into(replay_stream(stream), snapshot_sink(judged, snaps, compact_every=2), mark)
    return _state_totals(read_snapshots(spark, snaps))


@query
def stream_capture(spark, d):
    """Life cycles of the turns as packets: an assistant's turn ends the capture, later ones are refused."""
    turns = table_stream(spark, f"{d}/conversations.parquet")
    packets = capture.decode_packets(_turn_packets(spark, d, turns))
    return drained(capture.capture_lifecycle(packets), "life").select(
        RECORDING, "kind", "reason", "sample_rate_hz", "frame_count", "duration_us"
    )


@query
def stream_blocks(spark, d):
    """Decoded packets of a stream, placed set-wise once they have landed."""
    turns = table_stream(spark, f"{d}/conversations.parquet")
    landed = drained(capture.decode_packets(_turn_packets(spark, d, turns)), "packets")
    blocks, _ = capture.assemble_capture(landed)
    return blocks.select(RECORDING, "block_no", "first_frame", "total_frames", F.size("samples").cast("bigint").alias("n_samples"))


@query
def stream_placed(spark, d):
    """Turns as packets, placed inside the stream; the sixth ends the capture."""
    turns = table_stream(spark, f"{d}/conversations.parquet")
    packets = _turn_packets(spark, d, turns).withColumn("stop", F.col("packet_no") == 5)
    placed = drained(capture.placed_stream(capture.decode_packets(packets)), "placed", batch=256)
    n = F.size("samples").cast("bigint").alias("n_samples")
    return placed.select(RECORDING, "packet_no", "outcome", "block_no", "first_frame", "total_frames", n)


@query
def live_level(spark, d):
    rows = T.read(spark, d, "events").select(
        T.text_id("user_id"), T.micros("ts").alias("at_us"), F.array(F.col("value").cast("float")).alias("samples")
    )
    return level_by_window(rows, 3_600_000_000).select(RECORDING, "window_start_us", "n_samples", _rounded("peak").alias("peak"))
