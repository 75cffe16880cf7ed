"""Commands to events: accepted ones get the next numbers, refused ones change nothing.

Commands are first numbered as if all were accepted and checked set-wise against the state they
meet. Only recordings where that finds a conflict need their commands judged one after another, in order, holding one
recording's state. Recordings that one task may hold go through one exchange, longer ones through scans in buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.ids import derived_uuid
from tapeloom.operators.clips import ORDINAL_BUCKET, RECORDING, TIME_BUCKET_US
from tapeloom.operators.fold import RecordingFold, Refused
from tapeloom.operators.ranges import SortedRanges
from tapeloom.operators.replay import (
    ISLAND, LIFE, UNKNOWN_LAST, Known, Replayed, judged_by, known_log, known_rows, known_state, long_logs, long_stops, together, weighed,
)
from tapeloom.operators.short_logs import Logs, whole_logs
from tapeloom.operators.validation import payload_code, split_rejects
from tapeloom.plans.scan import SumBefore, ordered_scan
from tapeloom.plans.stage import COMPILED, dropped, settings, written
from tapeloom.schemas import CLIP_STATUSES, COMMAND_EVENTS, EVENT_COLUMNS, EVENTS_DDL, PAYLOAD_COLUMNS, RECORDING_KINDS, SCHEMA_VERSION

# Span of ordinals per scan bucket where ordinals are multiples of source microseconds.
TIME_ORDINALS = 4 * TIME_BUCKET_US
# Ids are most of a command, and only codes by frequency make hex digits shorter.
PACKED = {"spark.sql.parquet.compression.codec": "zstd"}
STATUS_OF = dict(LIFE)
JUDGED_DDL = EVENTS_DDL + ", ordinal bigint, reason_code string"


def as_events(commands: DataFrame) -> DataFrame:
    """Commands under the names of the events they turn into; event names pass through."""
    pairs = [F.lit(x) for pair in COMMAND_EVENTS.items() for x in pair]
    return commands.withColumn("kind", F.coalesce(F.element_at(F.create_map(*pairs), F.col("kind")), F.col("kind")))


def apply_commands(
    before: Replayed | DataFrame, commands: DataFrame, width: int = ORDINAL_BUCKET, time_width: int = TIME_BUCKET_US,
    ordinal_width: int = ORDINAL_BUCKET,
) -> tuple[DataFrame, DataFrame]:
    """(new events to append, rejects).

    ``before`` is the state the commands meet: state tables, of which only the rows of the
    recordings, clips and ids that the commands name are read, or a log of accepted events, from
    which the same facts are taken first. ``commands`` has the columns of COMMANDS_DDL, with
    ``ordinal`` giving the order within a recording (unique per recording). Pass
    ``ordinal_width=TIME_ORDINALS`` for commands ordered by source time. Commands that name no
    recording or have no ordinal are refused.
    """
    with settings(commands.sparkSession, PACKED | COMPILED):
        return _applied(before, commands, width, time_width, ordinal_width)


def _applied(
    before: Replayed | DataFrame, commands: DataFrame, width: int, time_width: int, ordinal_width: int
) -> tuple[DataFrame, DataFrame]:
    commands = written(as_events(commands), "commands")
    code = F.coalesce(payload_code(), F.when(F.col("ordinal").isNull(), "missing_field"))
    sound, unsound = split_rejects(commands, code, [RECORDING, "ordinal", "kind"])
    unsound = written(unsound, "unsound")
    named = written(sound.select(RECORDING).distinct(), "named")
    facts = known_rows(before) if isinstance(before, Replayed) else _log_rows(before)
    weights = weighed(sound, PAYLOAD_COLUMNS).unionByName(weighed(facts, ["reason"]))
    long = long_logs(weights, width, "long-commands")
    all_short = long.isEmpty()
    asked, facts = sound, facts.join(named, RECORDING, "left_semi")
    if not all_short:
        asked, facts = sound.join(long, RECORDING, "left_anti"), facts.join(long, RECORDING, "left_anti")
    rows = asked.select(*judged_by(
        "provenance", "text", "reason", "source_kind", "source_path", F.col("ordinal").alias("place"), F.lit(True).alias("fresh"),
        F.lit(None).cast("bigint").alias("sequence"), F.lit(None).cast("string").alias("status"),
    ))
    rows = rows.unionByName(facts.select(*[n for n in facts.columns if n in rows.columns]), allowMissingColumns=True)
    tentative = written(together(rows).mapInArrow(judge_commands(UNKNOWN_LAST, ISLAND), JUDGED_DDL), "tentative")
    events = tentative.filter("reason_code is null").select(*EVENT_COLUMNS)
    refused = unsound.unionByName(tentative.filter("reason_code is not null").select(RECORDING, "ordinal", "kind", "reason_code"))
    if not all_short:
        more, no = _apply_long(before, sound.join(long, RECORDING, "left_semi"), width, time_width, ordinal_width)
        events, refused = events.unionByName(more), refused.unionByName(no)
    dropped(commands)  # what is returned has them all
    return events, refused


def _log_rows(log: DataFrame) -> DataFrame:
    """A log of accepted events as rows that come before the commands."""
    return log.select(*judged_by("sequence", F.col("sequence").alias("place"), F.lit(False).alias("fresh")))


def judge_commands(unknown_last: int, island: int):
    """A function of batches of whole logs that one task may hold: every command with its number, or the reason why it is refused.

    Where nothing is found all commands are accepted; those of the other recordings are judged one after the other.
    """
    def judge(batches):
        schema = _judged_schema()
        for table in whole_logs(batches):
            logs = Logs(table, False, island)
            rows = np.flatnonzero(~logs.old)
            if not len(rows):
                continue
            number, reason = logs.sequence.copy(), np.full(len(logs.row), None, object)
            # a state that does not say where its log ended cannot be continued
            endless = logs.last >= unknown_last
            reason[endless[logs.log] & ~logs.old] = "unknown_sequence"
            _one_by_one(logs, logs.stopped[~endless[logs.stopped]], number, reason)
            at = pa.array(rows)
            columns = {n: logs.column[n].take(at) for n in EVENT_COLUMNS if n in logs.column}
            columns |= {
                "sequence": pa.array(number[rows]), "ordinal": logs.column["place"].take(at), "reason_code": pa.array(reason[rows], pa.string()),
                "schema_version": pa.array(np.full(len(rows), SCHEMA_VERSION, np.int32)),
            }
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)
    return judge


def _one_by_one(logs: Logs, some: np.ndarray, number: np.ndarray, reason: np.ndarray) -> None:
    """Commands of ``some`` recordings, those with conflicts, in order, each on what is left."""
    chosen = np.zeros(logs.n_logs, bool)
    chosen[some] = True
    at = np.flatnonzero(chosen[logs.log])
    names = ("kind", "clip_id", "transcript_id", "start_us", "end_us", "target_index", "provenance", "reason")
    columns = [_plain(logs.column[n].take(pa.array(at))) for n in names]
    current, fold = None, None
    for i, log, old, after, values in zip(at.tolist(), logs.log[at].tolist(), logs.old[at].tolist(), logs.after[at].tolist(), zip(*columns)):
        if log != current:
            current, fold = log, RecordingFold(live=SortedRanges())
            fold.next_sequence = int(logs.last[log]) + 1
        row = dict(zip(names, values), problem=None)
        if old:
            _take_in(fold, row, CLIP_STATUSES[after] if after >= 0 else None)
            continue
        number[i] = fold.next_sequence
        try:
            fold.apply(row)
        except Refused as stop:
            reason[i] = stop.code


def _plain(column: pa.Array) -> list:
    """Python values; strings, and columns without null, by way of NumPy, which is faster."""
    if pa.types.is_string(column.type) or not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _take_in(fold: RecordingFold, row: dict, after: str | None) -> None:
    """A known row: a fact of the state or an accepted record."""
    kind, clip_id = row["kind"], row["clip_id"]
    if kind in RECORDING_KINDS:
        fold.status = STATUS_OF[kind]
    elif kind == "clip_added":
        fold.hold(clip_id, row["start_us"], row["end_us"], after)
        fold.n_clips += 1
    else:
        if kind == "transcript_committed":
            fold.versions[row["transcript_id"]] = 0
        if clip_id is not None and after is not None:
            start, end, was, _ = fold.clips[clip_id]
            if after == "deleted" and was != "deleted":
                fold.live.remove(start, end)
            fold.clips[clip_id] = (start, end, after, None)


def _apply_long(
    before: Replayed | DataFrame, sound: DataFrame, width: int, time_width: int, ordinal_width: int
) -> tuple[DataFrame, DataFrame]:
    """The same for recordings that no task may hold whole, by scans in buckets; only where these find a conflict are
    commands streamed through one task."""
    known = (known_state(before) if isinstance(before, Replayed) else known_log(before)).of(sound)
    known = Known(*(written(getattr(known, n), f"known-{n}") for n in ("heads", "clips", "versions")))
    endless = written(known.heads.filter(F.col("last_sequence") == UNKNOWN_LAST).select(RECORDING), "endless")
    lost = sound.join(endless, RECORDING, "left_semi").select(RECORDING, "ordinal", "kind", F.lit("unknown_sequence").alias("reason_code"))
    lost = written(lost, "lost")
    if not endless.isEmpty():
        sound = sound.join(endless, RECORDING, "left_anti")
    tail = known.heads.select(RECORDING, "last_sequence")
    numbered = written(
        _ranked(sound, ordinal_width).join(tail, RECORDING, "left").withColumns({
            "sequence": F.coalesce("last_sequence", F.lit(0).cast("bigint")) + F.col("rank") + 1, "schema_version": F.lit(SCHEMA_VERSION),
        }).select(*EVENT_COLUMNS, "ordinal"), "long-tentative"
    )
    stops = written(long_stops(numbered, width, time_width, known, unique=True), "conflicts")
    calm = numbered.join(stops, RECORDING, "left_anti")
    none = F.lit(None)
    asked = numbered.join(stops, RECORDING, "left_semi").select(*EVENT_COLUMNS, "ordinal", none.cast("string").alias("problem"))
    judged = (
        asked.unionByName(_facts(known.of(stops)), allowMissingColumns=True)
        # by a hash of the key: Spark drops an exchange by the key itself below a join on it, and
        # adaptive reads may then split a key
        .repartition(F.xxhash64(RECORDING))
        .sortWithinPartitions(RECORDING, F.col("ordinal").asc_nulls_first())
        .mapInArrow(_judge, JUDGED_DDL)
    )
    judged = written(judged, "judged")
    events = calm.select(*EVENT_COLUMNS).unionByName(judged.filter("reason_code is null").select(*EVENT_COLUMNS))
    refused = judged.filter("reason_code is not null").select(RECORDING, "ordinal", "kind", "reason_code")
    return events, lost.unionByName(refused)


def _ranked(commands: DataFrame, ordinal_width: int) -> DataFrame:
    """Commands with their ``rank`` in their recording, from 0, by a scan in buckets of the ordinal."""
    ranks = ordered_scan(commands.select(RECORDING, "ordinal"), [RECORDING], "ordinal", [SumBefore("rank", F.lit(1).cast("bigint"))], ordinal_width)
    return commands.join(ranks, [RECORDING, "ordinal"])


def _facts(known: Known) -> DataFrame:
    """What is known of recordings as rows that come before their commands; they have no ordinal."""
    return (
        known.heads.select(RECORDING, F.lit("head").alias("kind"), F.col("last_sequence").alias("sequence"), F.col("n_clips").alias("target_index"), F.col("last_kind").alias("text"))
        .unionByName(known.clips.select(RECORDING, F.lit("clip").alias("kind"), "clip_id", "start_us", "end_us", F.col("status").alias("text")), allowMissingColumns=True)
        .unionByName(known.versions.select(RECORDING, F.lit("version").alias("kind"), "transcript_id"), allowMissingColumns=True)
    )


def _judge(batches):
    """Take in the known facts of a recording, then emit every command with its number or its refusal."""
    status_of, schema = dict(LIFE), _judged_schema()
    current, fold = None, None
    for batch in batches:
        names = batch.schema.names
        sequences, codes, is_command = [], [], []
        for values in zip(*(column.to_pylist() for column in batch.columns)):
            row = dict(zip(names, values))
            if row["recording_id"] != current:
                current, fold = row["recording_id"], RecordingFold()
            is_command.append(row["ordinal"] is not None)
            if row["ordinal"] is None:
                if row["kind"] == "head":
                    fold.next_sequence, fold.status, fold.n_clips = row["sequence"] + 1, status_of[row["text"]], row["target_index"]
                elif row["kind"] == "clip":
                    fold.hold(row["clip_id"], row["start_us"], row["end_us"], row["text"])
                else:
                    fold.versions[row["transcript_id"]] = 0
                continue
            sequences.append(fold.next_sequence)
            try:
                fold.apply(row)
                codes.append(None)
            except Refused as stop:
                codes.append(stop.code)
        if sequences:
            # payloads go back as they came, column by column
            kept = batch.filter(pa.array(is_command))
            judged = {"sequence": pa.array(sequences, pa.int64()), "reason_code": pa.array(codes, pa.string())}
            yield pa.RecordBatch.from_arrays([judged[f.name] if f.name in judged else kept.column(f.name).cast(f.type) for f in schema], schema=schema)


def _judged_schema() -> pa.Schema:
    longs = {"sequence", "start_us", "end_us", "target_index", "ordinal"}
    names = [*EVENT_COLUMNS, "ordinal", "reason_code"]
    kinds = [pa.int64() if n in longs else pa.int32() if n == "schema_version" else pa.string() for n in names]
    return pa.schema(list(zip(names, kinds)))


def commands_of(rows: DataFrame, kind: str, ordinal, **payload) -> DataFrame:
    """A command table from rows that have the recording id; missing payload is null."""
    def one(name):
        value = payload.get(name)
        if value is None:
            return F.lit(None)
        return F.col(value) if isinstance(value, str) else value

    types = {n: "bigint" if n in ("start_us", "end_us", "target_index") else "string" for n in PAYLOAD_COLUMNS}
    return rows.select(
        RECORDING, F.lit(None).cast("bigint").alias("ordinal") if ordinal is None else ordinal.cast("bigint").alias("ordinal"),
        F.lit(kind).alias("kind"), *[one(n).cast(types[n]).alias(n) for n in PAYLOAD_COLUMNS],
    )


def add_clip_commands(clips: DataFrame, ordinal) -> DataFrame:
    return commands_of(clips, "add_clip", ordinal, clip_id="clip_id", start_us="start_us", end_us="end_us")


def move_commands(moves: DataFrame, ordinal) -> DataFrame:
    return commands_of(moves, "move_clip", ordinal, clip_id="clip_id", target_index="target_index")


def delete_commands(clips: DataFrame, ordinal) -> DataFrame:
    return commands_of(clips, "delete_clip", ordinal, clip_id="clip_id")


def split_commands(halves: DataFrame) -> DataFrame:
    """Delete the original, add left, add right; numbered by source time so splits do not interleave."""
    base = F.col("start_us")
    lefts, rights = halves.filter("side = 'left'"), halves.filter("side = 'right'")
    origin = lefts.withColumn("clip_id", F.col("original_clip_id"))
    return (
        delete_commands(origin, base * 4)
        .unionByName(add_clip_commands(lefts, base * 4 + 1))
        .unionByName(add_clip_commands(rights, base * 4 + 2))
    )


def append_commands(made: DataFrame) -> DataFrame:
    """Delete both clips, add their union."""
    base = F.col("start_us") * 4
    first = made.withColumn("clip_id", F.col("first_clip_id"))
    second = made.withColumn("clip_id", F.col("second_clip_id"))
    return (
        delete_commands(first, base)
        .unionByName(delete_commands(second, base + 1))
        .unionByName(add_clip_commands(made, base + 2))
    )


def edit_commands(edits: DataFrame, ordinal) -> DataFrame:
    """User edits (recording_id, clip_id, text) as new versions; earlier versions stay."""
    minted = edits.withColumn("transcript_id", derived_uuid("edit", RECORDING, "clip_id", ordinal, "text"))
    return commands_of(
        minted, "commit_transcript", ordinal, clip_id="clip_id", transcript_id="transcript_id",
        provenance=F.lit("user_edit"), text="text",
    )
