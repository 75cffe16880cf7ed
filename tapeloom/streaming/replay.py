"""Logs judged as they grow.

Each recording is a key of a stateful operator; its clips, version ids and blocks of live ranges
are map state, looked up one at a time, so a long recording does not have to fit in a worker. A batch
brings a key only the records that arrived since the last one. Positions and state
tables are not kept here: they follow set-wise from the accepted records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tapeloom.operators.clips import RECORDING
from tapeloom.operators.commands import apply_commands
from tapeloom.operators.fold import RecordingFold, Refused
from tapeloom.operators.ranges import RangeBlocks
from tapeloom.operators.replay import Replayed, touched_state
from tapeloom.operators.validation import payload_code
from tapeloom.plans.stage import written
from tapeloom.schemas import (
    CLIPS_DDL, EVENT_COLUMNS, EVENTS_DDL, N_BUCKETS, PAYLOAD, PAYLOAD_COLUMNS, RECORDINGS_DDL, SCHEMA_VERSION, TRANSCRIPTS_DDL, struct_type,
)
from tapeloom.sources.files import open_path

# Batches between two bases of the snapshots.
COMPACT_EVERY = 16

JUDGED_DDL = EVENTS_DDL + ", outcome string"
_HELD = ["kind", *PAYLOAD_COLUMNS, "schema_version", "problem"]
_HELD_DDL = "kind string, " + ", ".join(f"{n} {t}" for n, t in PAYLOAD) + ", schema_version int, problem string"
_LONGS = {"sequence", "start_us", "end_us", "target_index", "schema_version"}


class _StateMapping:
    """A map state with the few mapping methods the rules use. What a batch's records of one key name is held
    until ``flush``, so each entry is read and written once; of a ``fresh`` key nothing has to be read."""

    def __init__(self, state, fresh: bool):
        self.state, self.fresh, self.held, self.changed = state, fresh, {}, set()

    def get(self, key):
        if key not in self.held:
            value = None if self.fresh else self.state.getValue((key,))
            self.held[key] = None if value is None else tuple(value)
        return self.held[key]

    def __setitem__(self, key, value):
        self.held[key] = value if isinstance(value, tuple) else (value,)
        self.changed.add(key)

    def flush(self) -> None:
        for key in self.changed:
            if self.held[key] is not None:
                self.state.updateValue((key,), self.held[key])
            elif not self.fresh and self.state.containsKey((key,)):
                self.state.removeKey((key,))


class _StateBlocks(_StateMapping):
    """A map state from numbers to packed blocks."""

    def get(self, key):
        return super().get(key)[0]

    def pop(self, key, default=None):
        self.held[key] = None
        self.changed.add(key)


class LogJudge(StatefulProcessor):
    """Accept records in sequence; the first bad one closes the log.

    With ``patience_ms`` above 0, records that came too early wait that long for the gap to
    fill; those left over then are rejected. A closed log keeps nothing but that it is closed.
    """

    def __init__(self, patience_ms: int = 0):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState(
            "facts", struct_type("next_sequence bigint, status string, failure string, n_clips bigint, closed boolean, n_held bigint, timer bigint"),
        )
        self.clips = handle.getMapState(
            "clips", struct_type("clip_id string"), struct_type("start_us bigint, end_us bigint, status string, failure string")
        )
        self.versions = handle.getMapState("versions", struct_type("transcript_id string"), struct_type("sequence bigint"))
        self.directory = handle.getValueState("directory", struct_type("packed binary"))
        self.blocks = handle.getMapState("blocks", struct_type("number bigint"), struct_type("packed binary"))
        self.early = handle.getMapState("early", struct_type("sequence bigint"), struct_type(_HELD_DDL))

    def _load(self):
        known = self.facts.get() if self.facts.exists() else None
        self.fresh = fresh = known is None
        self.empty = fresh or bool(known[4])  # a closed log was cleared when it closed
        packed = self.directory.get()[0] if not fresh and self.directory.exists() else b""
        live = RangeBlocks(_StateBlocks(self.blocks, fresh), packed)
        fold = RecordingFold(_StateMapping(self.clips, fresh), _StateMapping(self.versions, fresh), live)
        closed, held, self.timer = False, 0, 0
        if known is not None:
            fold.next_sequence, fold.status, fold.failure, fold.n_clips, closed, held, self.timer = known
        return fold, bool(closed), int(held)

    def _save(self, fold, closed, held):
        if closed:
            held = 0
            # of a new key nothing was written but records that waited
            for state in () if self.empty else (self.clips, self.versions, self.directory, self.blocks):
                state.clear()
            if self.patience_ms:
                self.early.clear()
        else:
            directory = fold.live.directory()
            for changed in (fold.clips, fold.versions, fold.live.blocks):
                changed.flush()
            self.directory.update((directory,))
        if self.timer and not held:
            self.handle.deleteTimer(self.timer)
            self.timer = 0
        self.facts.update((fold.next_sequence, fold.status, fold.failure, fold.n_clips, closed, held, self.timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fold, closed, held = self._load()
        arrived = sorted((r for part in rows for r in _records(part)), key=lambda r: (r["sequence"] is None, r["sequence"] or 0))
        out = []

        def judge(row):
            nonlocal closed
            if closed:
                out.append({**row, "outcome": "log_closed"})
                return
            try:
                fold.record(row)
                out.append({**row, "outcome": "accepted"})
            except Refused as stop:
                closed = True
                out.append({**row, "outcome": stop.code})

        for row in arrived:
            too_early = (row["sequence"] or 0) > fold.next_sequence and row["schema_version"] == SCHEMA_VERSION
            if not closed and too_early and self.patience_ms and not self.early.containsKey((row["sequence"],)):
                self.early.updateValue((row["sequence"],), tuple(row[c] for c in _HELD))
                held += 1
                if held == 1:
                    self.timer = timerValues.getCurrentProcessingTimeInMs() + self.patience_ms
                    self.handle.registerTimer(self.timer)
                continue
            judge(row)
            while held and self.early.containsKey((fold.next_sequence,)):
                judge(self._take(key, fold.next_sequence))
                held -= 1
                if closed:
                    break
            if closed and held:
                out += self._left_over(key, "log_closed")
                held = 0
        self._save(fold, closed, held)
        yield _frame(out)

    def _take(self, key, sequence) -> dict:
        value = self.early.getValue((sequence,))
        self.early.removeKey((sequence,))
        return {RECORDING: key[0], "sequence": sequence, **dict(zip(_HELD, value))}

    def _left_over(self, key, outcome) -> list[dict]:
        return [{**self._take(key, s), "outcome": outcome} for s in sorted(k[0] for k in self.early.keys())]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fold, closed, held = self._load()
        if not held or expiredTimerInfo.getExpiryTimeInMs() != self.timer:
            return
        out = self._left_over(key, "event_out_of_order")
        self.timer = 0
        self._save(fold, True, 0)
        yield _frame(out)

    def close(self) -> None:
        pass


def _records(part: pd.DataFrame) -> list[dict]:
    columns = []
    for name in part.columns:
        values = [None if x is None or x != x else x for x in part[name].tolist()]
        columns.append([None if x is None else int(x) for x in values] if name in _LONGS else values)
    return [dict(zip(part.columns, row)) for row in zip(*columns)]


def _frame(rows: list[dict]) -> pd.DataFrame:
    columns = {}
    for name in [*EVENT_COLUMNS, "outcome"]:
        values = [row[name] for row in rows]
        columns[name] = pd.array(values, dtype="Int64") if name in _LONGS else pd.Series(values, dtype=object)
    return pd.DataFrame(columns)


def replay_stream(events: DataFrame, patience_ms: int = 0) -> DataFrame:
    """Every record with its outcome: accepted, a reject code, or log_closed after one.

    Needs the RocksDB state store.
    """
    rows = events.select(*EVENT_COLUMNS, payload_code().alias("problem"))
    return rows.groupBy(RECORDING).transformWithStateInPandas(
        statefulProcessor=LogJudge(patience_ms), outputStructType=struct_type(JUDGED_DDL),
        outputMode="Append", timeMode="ProcessingTime" if patience_ms else "None",
    )


def judged_sink(path: str):
    """foreachBatch writer of judged records, one folder per batch: a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("bucket", bucket_of()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{path.rstrip('/')}/batch={batch_id}"
        )

    return write


def bucket_of():
    """Storage bucket of a recording; there are few enough to list."""
    return F.pmod(F.xxhash64(RECORDING), F.lit(N_BUCKETS)).cast("int")


def snapshot_sink(judged_path: str, snapshot_path: str, compact_every: int = COMPACT_EVERY):
    """foreachBatch writer that keeps judged records and moves on the snapshots they touch.

    A batch reads the newest snapshot of its own recordings, never their history, and writes one new
    version of them; see ``Snapshots``. A repeated batch starts from the versions before it and
    replaces exactly what it wrote.
    """
    keep = judged_sink(judged_path)
    store = Snapshots(snapshot_path, compact_every)

    def write(batch: DataFrame, batch_id: int) -> None:
        keep(batch, batch_id)
        judged = batch.sparkSession.read.schema(JUDGED_DDL).parquet(f"{judged_path.rstrip('/')}/batch={batch_id}")
        accepted = judged.filter("outcome = 'accepted'").select(*EVENT_COLUMNS)
        store.put(touched_state(store.before(accepted, batch_id), accepted), batch_id)

    return write


def command_sink(log_path: str, snapshot_path: str, compact_every: int = COMPACT_EVERY):
    """foreachBatch writer of commands (COMMANDS_DDL): events, refusals and snapshots of each batch.

    Commands meet the state that earlier batches left, events are written before the snapshot that
    holds them, and everything of a batch lies in a folder of its own: a repeated batch finds the
    same state and replaces what it wrote. ``ordinal`` orders the commands of a recording in a batch.
    """
    log, store = log_path.rstrip("/"), Snapshots(snapshot_path, compact_every)

    def write(batch: DataFrame, batch_id: int) -> None:
        commands = written(batch, "batch")
        before = store.before(commands, batch_id)
        events, refused = apply_commands(before, commands)
        refused.write.mode("overwrite").parquet(f"{log}/refused/batch={batch_id}")
        events.withColumn("bucket", bucket_of()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{log}/events/batch={batch_id}")
        kept = batch.sparkSession.read.schema(EVENTS_DDL).parquet(f"{log}/events/batch={batch_id}")
        store.put(touched_state(before, kept), batch_id)

    return write


_TABLES = {"recordings": RECORDINGS_DDL, "clips": CLIPS_DDL, "transcripts": TRANSCRIPTS_DDL}


class Snapshots:
    """State tables in versions, one per batch, in storage buckets.

    A version holds the recordings its batch touched, whole. Every ``compact_every`` batches the newest
    rows of all recordings are written as a base and the versions up to it are deleted, so a reader
    meets one base and that many versions at most.
    """

    def __init__(self, path: str, compact_every: int = COMPACT_EVERY):
        self.path, self.compact_every = path.rstrip("/"), compact_every

    def _folders(self, name: str) -> list[str]:
        files, inner = open_path(f"{self.path}/{name}")
        found = files.get_file_info(fs.FileSelector(inner, allow_not_found=True))
        return [f.base_name for f in found if f.type == fs.FileType.Directory]

    def _numbers(self, kind: str) -> list[int]:
        """Batches of the versions or bases that are complete: recordings are written last."""
        numbers = []
        for folder in self._folders("recordings"):
            files, inner = open_path(f"{self.path}/recordings/{folder}/_SUCCESS")
            if folder.startswith(f"{kind}=") and files.get_file_info(inner).type == fs.FileType.File:
                numbers.append(int(folder.split("=")[1]))
        return sorted(numbers)

    def newest(self, spark, before: int | None = None, buckets: list[int] | None = None) -> Replayed:
        """Newest rows of every recording, of the batches before ``before``."""
        base = max((n for n in self._numbers("base") if before is None or n < before), default=-1)
        versions = [n for n in self._numbers("version") if n > base and (before is None or n < before)]
        folders = [(n, f"version={n}") for n in versions] + ([(base, f"base={base}")] if base >= 0 else [])

        def table(name: str) -> DataFrame:
            ddl = _TABLES[name] + ", bucket int"
            whole = spark.createDataFrame([], ddl + ", number bigint")
            for number, folder in folders:
                part = spark.read.schema(ddl).parquet(f"{self.path}/{name}/{folder}")
                whole = whole.unionByName(part.withColumn("number", F.lit(number).cast("bigint")))
            return whole if buckets is None else whole.filter(F.col("bucket").isin(buckets))

        latest = table("recordings").groupBy(RECORDING).agg(F.max("number").alias("number"))
        return Replayed(*(table(n).join(latest, [RECORDING, "number"], "left_semi").drop("number", "bucket") for n in _TABLES))

    def before(self, rows: DataFrame, batch_id: int) -> Replayed:
        """The state that a batch meets, of the recordings that ``rows`` name."""
        named = written(rows.select(RECORDING).distinct(), "named")
        buckets = [r.bucket for r in named.select(bucket_of().alias("bucket")).distinct().collect()]  # at most N_BUCKETS
        state = self.newest(rows.sparkSession, batch_id, buckets)
        return Replayed(*(written(getattr(state, n).join(named, RECORDING, "left_semi"), n) for n in _TABLES))

    def put(self, state: Replayed, batch_id: int) -> None:
        self._write(state, f"version={batch_id}")
        if (batch_id + 1) % self.compact_every == 0:
            self.compact(state.recordings.sparkSession, batch_id)

    def _write(self, state: Replayed, folder: str) -> None:
        for name in reversed(_TABLES):
            table = getattr(state, name).withColumn("bucket", bucket_of())
            table.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/{folder}")

    def compact(self, spark, batch_id: int) -> None:
        """A base of all rows before ``batch_id``; then what it replaces is deleted. The batch itself may
        be repeated and still find the state that it met."""
        base = batch_id - 1
        if base < 0:
            return
        if base not in self._numbers("base"):
            self._write(self.newest(spark, batch_id), f"base={base}")
        for name in _TABLES:
            for folder in self._folders(name):
                if int(folder.split("=")[1]) <= base and folder != f"base={base}":
                    files, inner = open_path(f"{self.path}/{name}/{folder}")
                    files.delete_dir(inner)


def read_snapshots(spark, snapshot_path: str) -> Replayed:
    """Latest snapshot of every recording."""
    return Snapshots(snapshot_path).newest(spark)
