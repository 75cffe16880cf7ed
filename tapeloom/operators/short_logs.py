"""Logs that one task may hold, judged and folded whole from sorted Arrow batches.

Rows come by recording, what is known already first, then the records in their order. The rules are those of
``operators.replay``: each is asked as if all earlier records of the log were valid, column by column over many
logs at once, and the earliest finding of a log is where it stops.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tapeloom.operators.ranges import SortedRanges
from tapeloom.schemas import CLIP_STATUSES, EVENT_KINDS

# Rows, and bytes, that are judged together; the rest of the last log waits for its next rows.
TOGETHER, TOGETHER_BYTES = 32_768, 1 << 26
NONE = np.iinfo(np.int64).max

CREATED, STARTED, SAVED, FAILED, BEGUN, BROKEN, ADDED, MOVED, DELETED, COMMITTED = range(len(EVENT_KINDS))
STATUS = {name: i for i, name in enumerate(CLIP_STATUSES)}
#: The clip status each kind leaves; committed texts are looked at on their own.
AFTER = np.full(len(EVENT_KINDS) + 1, -1, np.int8)
AFTER[[BEGUN, BROKEN, ADDED, DELETED, COMMITTED]] = [STATUS[s] for s in ("processing", "failed", "pending", "deleted", "transcribed")]
RECORDING_STATUS = ("created", "recording", "saved", "failed")
#: Codes of the rules over several records, from the one that is asked last to the one that is asked first.
CODES = (
    None, "invalid_clip_index", "transcript_already_exists", "clip_overlaps", "clip_deleted", "invalid_clip_transition", "clip_not_found",
    "clip_already_exists", "invalid_recording_transition", "recording_not_found", "recording_already_exists", "problem", "event_out_of_order",
    "unsupported_schema",
)
CODE = {name: i for i, name in enumerate(CODES)}

FOLDED = pa.schema([
    ("what", pa.string()), ("recording_id", pa.string()), ("sequence", pa.int64()), ("copy", pa.int32()), ("kind", pa.string()),
    ("reason_code", pa.string()), ("clip_id", pa.string()), ("position", pa.int64()), ("start_us", pa.int64()), ("end_us", pa.int64()),
    ("status", pa.string()), ("failure", pa.string()), ("source_kind", pa.string()), ("source_path", pa.string()),
    ("transcript_id", pa.string()), ("provenance", pa.string()), ("text", pa.string()),
])
FOLDED_DDL = (
    "what string, recording_id string, sequence bigint, copy int, kind string, reason_code string, clip_id string, position bigint, "
    "start_us bigint, end_us bigint, status string, failure string, source_kind string, source_path string, transcript_id string, provenance string, text string"
)


def whole_logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows in tables that end where a log ends."""
    held, n, size = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n < TOGETHER and size < TOGETHER_BYTES:
            continue
        ids = batch.column("recording_id")
        ends = np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False))
        if not len(ends):
            continue
        cut = int(ends[-1]) + 1
        held[-1] = batch.slice(0, cut)
        yield pa.Table.from_batches(held)
        held = [batch.slice(cut)]
        n, size = held[0].num_rows, held[0].nbytes
    if held:
        yield pa.Table.from_batches(held)


def _codes(column: pa.Array, names=None) -> np.ndarray:
    """Whole numbers for strings, -1 for null: places in ``names`` (-1 for others), or numbers as they come."""
    found = column.dictionary_encode() if not pa.types.is_dictionary(column.type) else column
    codes = found.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    if names is None:
        return codes
    places = {name: i for i, name in enumerate(names)}
    place = np.array([places.get(x, -1) for x in found.dictionary.to_pylist()] + [-1], np.int64)
    return place[codes]


def _numbers(column: pa.Array, null: int = 0) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False)


def _flags(column: pa.Array) -> np.ndarray:
    return column.fill_null(False).to_numpy(zero_copy_only=False)


def _last_before(marked: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each row the last row before it that is ``marked``, in groups that start at ``first``; -1 for none."""
    at = np.where(marked, np.arange(len(marked)), -1)
    last = np.empty_like(at)
    last[:1] = -1
    np.maximum.accumulate(at[:-1], out=last[1:])
    return np.where(last >= first, last, -1)


def _starts(group: np.ndarray) -> np.ndarray:
    """Of each row of sorted groups the first row of its group."""
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))


class Logs:
    """Some whole logs as columns, and what is found in them."""

    def __init__(self, table: pa.Table, numbered: bool, island: int):
        self.column = {n: table.column(n).combine_chunks() for n in table.column_names}
        ids = self.column["recording_id"]
        new = np.ones(len(ids), bool)
        new[1:] = pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
        log = np.cumsum(new) - 1
        old = ~_flags(self.column["fresh"]) if "fresh" in self.column else np.zeros(len(ids), bool)
        sequence = _numbers(self.column["sequence"])
        # of records with one number the first counts
        twice = np.zeros(len(ids), bool)
        if numbered:
            twice[1:] = ~new[1:] & ~old[1:] & ~old[:-1] & (sequence[1:] == sequence[:-1])
        self.row = np.flatnonzero(~twice)  # rows of the table that count; all below is over these
        self.repeated = np.append(twice, False)[self.row + 1]
        if twice.any():
            self.column = {n: c.take(pa.array(self.row)) for n, c in self.column.items()}
        self.log, self.old, self.sequence = log[self.row], old[self.row], sequence[self.row]
        n = len(self.row)
        self.n_logs = int(self.log[-1]) + 1 if n else 0
        self.first = np.searchsorted(self.log, np.arange(self.n_logs))  # first row of each log
        self.start_row = self.first[self.log]
        self.kind = _codes(self.column["kind"], EVENT_KINDS)
        self.added, self.moved, self.deleted, self.committed = (self.kind == k for k in (ADDED, MOVED, DELETED, COMMITTED))
        self.is_recording = (self.kind >= CREATED) & (self.kind <= FAILED)
        after = AFTER[self.kind].copy()
        after[self.committed & _flags(self.column["edited"])] = STATUS["edited"]
        if "status" in self.column:
            known = _codes(self.column["status"], CLIP_STATUSES)
            after = np.where(known >= 0, known, after)
        self.after = after
        self.start_us, self.end_us = _numbers(self.column["start_us"], -1), _numbers(self.column["end_us"], -1)
        self.last = np.zeros(self.n_logs, np.int64)  # the number that each log is known to have come to
        np.maximum.at(self.last, self.log[self.old], self.sequence[self.old])
        if not numbered:
            fresh = (~self.old).astype(np.int64)
            rank = np.cumsum(fresh)
            before = (rank - fresh)[self.first]
            self.sequence = np.where(self.old, self.sequence, self.last[self.log] + rank - before[self.log])
        # clips: rows by clip in their order
        clip = _codes(self.column["clip_id"])
        self.clip_rows = np.flatnonzero((clip >= 0) & ~self.is_recording)
        key = self.log[self.clip_rows] * (clip.max(initial=0) + 1) + clip[self.clip_rows]
        self.by_clip = self.clip_rows[np.argsort(key, kind="stable")]
        self.clip_key = self.log[self.by_clip] * (clip.max(initial=0) + 1) + clip[self.by_clip]
        self._find(island)

    def _find(self, island: int) -> None:
        n = len(self.row)
        code = np.zeros(n, np.int8)
        fresh = ~self.old

        def mark(bad: np.ndarray, name: str) -> None:
            code[bad & fresh] = CODE[name]

        clips_before = np.cumsum(self.added) - self.added
        clips_before = clips_before - clips_before[self.start_row]
        target = _numbers(self.column["target_index"], -1)
        mark(self.moved & ((target < 0) | (target >= clips_before)), "invalid_clip_index")
        mark(self._second_uses(), "transcript_already_exists")
        overlapping = np.zeros(n, bool)
        overlapping[self._overlaps(island)] = True
        mark(overlapping, "clip_overlaps")
        # what became of the clip before
        was = np.full(n, -1, np.int8)
        after = self.after[self.by_clip]
        before = _last_before(after >= 0, _starts(self.clip_key))
        was[self.by_clip] = np.where(before >= 0, after[before], -1)
        of_clip = np.zeros(n, bool)
        of_clip[self.clip_rows] = True
        settling = np.isin(was, [STATUS[s] for s in ("processing", "transcribed", "edited")])
        mark(self.committed & (was == STATUS["deleted"]), "clip_deleted")
        startable = (was != STATUS["processing"]) & (was != STATUS["deleted"])
        unsettled = ((self.kind == BROKEN) | (self.committed & (was != STATUS["deleted"]))) & ~settling
        mark(of_clip & (((self.kind == BEGUN) & ~startable) | unsettled), "invalid_clip_transition")
        mark(of_clip & ~self.added & (was < 0), "clip_not_found")
        mark(of_clip & self.added & (was >= 0), "clip_already_exists")
        # life of the recording
        last = _last_before(self.is_recording, self.start_row)
        last = np.where(last >= 0, self.kind[last], -1)
        wrong = (
            ((self.kind == STARTED) & (last != CREATED)) | ((self.kind == SAVED) & (last != STARTED))
            | ((self.kind == FAILED) & (last != CREATED) & (last != STARTED))
        )
        mark(wrong, "invalid_recording_transition")
        mark((self.kind != CREATED) & (last < 0), "recording_not_found")
        mark((self.kind == CREATED) & (last >= 0), "recording_already_exists")
        if "problem" in self.column:
            mark(self.column["problem"].is_valid().to_numpy(zero_copy_only=False), "problem")
        expected = np.empty(n, np.int64)
        expected[1:] = self.sequence[:-1] + 1
        opens = fresh.copy()
        opens[1:] &= self.old[:-1] | (self.log[1:] != self.log[:-1])
        expected[opens] = self.last[self.log[opens]] + 1
        mark(self.sequence != expected, "event_out_of_order")
        if "stale" in self.column:
            mark(_flags(self.column["stale"]), "unsupported_schema")
        self.code = code
        bad = np.flatnonzero((code > 0) | (self.repeated & fresh))
        self.stopped, at = np.unique(self.log[bad], return_index=True)  # logs that stop, and the rows they stop at
        self.stop = bad[at]
        self.copy = (code[self.stop] == 0).astype(np.int32)
        end = np.full(self.n_logs, n, np.int64)
        end[self.stopped] = self.stop + self.copy
        self.accepted = fresh & (np.arange(n) < end[self.log])

    def _second_uses(self) -> np.ndarray:
        again = np.zeros(len(self.row), bool)
        version = _codes(self.column["transcript_id"])
        rows = np.flatnonzero(self.committed & (version >= 0))
        key = self.log[rows] * (version.max(initial=0) + 1) + version[rows]
        order = np.argsort(key, kind="stable")
        key = key[order]
        again[rows[order[1:][key[1:] == key[:-1]]]] = True
        return again

    def _overlaps(self, island: int) -> np.ndarray:
        """Rows that add a clip over an active one."""
        first_of = np.ones(len(self.by_clip), bool)
        first_of[1:] = self.clip_key[1:] != self.clip_key[:-1]
        group = np.cumsum(first_of) - 1
        n_groups = int(group[-1]) + 1 if len(group) else 0
        made, gone = np.full(n_groups, NONE, np.int64), np.full(n_groups, NONE, np.int64)
        adds, ends = self.added[self.by_clip], self.deleted[self.by_clip]
        np.minimum.at(made, group[adds], self.by_clip[adds])
        np.minimum.at(gone, group[ends], self.by_clip[ends])
        held = made < NONE
        made, gone = made[held], gone[held]
        alive = (self.start_us[made] >= 0) & (self.end_us[made] > self.start_us[made]) & (self.after[made] != STATUS["deleted"])
        made, gone = made[alive], gone[alive]
        order = np.lexsort((self.end_us[made], self.start_us[made], self.log[made]))
        made, gone = made[order], gone[order]
        log, start, end = self.log[made], self.start_us[made], self.end_us[made]
        met = (log[1:] == log[:-1]) & (start[1:] < end[:-1])
        if not met.any():  # most logs never have two clips over the same time
            return made[:0]
        some = np.isin(log, log[1:][met])
        made, gone, log, start, end = made[some], gone[some], log[some], start[some], end[some]
        # stretches of source time that meeting ranges cover without a gap; ends by their rank, so logs can be told apart
        ranks, rank = np.unique(end, return_inverse=True)
        reach = np.maximum.accumulate(log * len(ranks) + rank)
        shore = np.ones(len(made), bool)
        shore[1:] = (log[1:] != log[:-1]) | (start[1:] >= ranks[reach[:-1] % len(ranks)])
        place = np.cumsum(shore) - 1
        size = np.bincount(place)[place]
        found = []
        few = np.flatnonzero((size > 1) & (size <= island))
        for apart in range(1, int(size[few].max(initial=1))):
            left = few[few + apart < len(made)]
            right = left + apart
            near = (place[left] == place[right]) & (start[right] < end[left])
            left, right = left[near], right[near]
            before, after = np.where(made[left] < made[right], left, right), np.where(made[left] < made[right], right, left)
            found.append(made[after[gone[before] > made[after]]])
        for at in np.unique(place[size > island]):
            rows = np.flatnonzero(place == at)
            steps = sorted([(made[i], 1, i) for i in rows] + [(gone[i], 0, i) for i in rows if gone[i] < NONE])
            live, there = SortedRanges(), set()
            for row, adds, i in steps:
                one = int(start[i]), int(end[i])
                if not adds:
                    if i in there:
                        live.remove(*one)
                elif live.meets(*one):
                    found.append(np.array([row]))
                    break
                else:
                    live.add(*one)
                    there.add(i)
        return np.concatenate(found) if found else made[:0]

    # --- what comes of them -------------------------------------------------

    def reasons(self, rows: np.ndarray) -> list:
        own = self.column["problem"].take(pa.array(rows)).to_pylist()
        return [problem if c == CODE["problem"] else CODES[c] or "event_out_of_order" for c, problem in zip(self.code[rows].tolist(), own)]

    def _batch(self, what: str, n: int, **columns) -> pa.RecordBatch:
        columns["what"] = pa.array([what] * n, pa.string())
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in FOLDED], schema=FOLDED)

    def _take(self, name: str, rows: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
        return self.column[name].take(pa.array(rows) if valid is None else pa.array(rows, mask=~valid))

    def stops(self) -> pa.RecordBatch:
        rows = self.stop
        return self._batch(
            "stop", len(rows), recording_id=self._take("recording_id", rows), sequence=pa.array(self.sequence[rows]), copy=pa.array(self.copy),
            kind=self._take("kind", rows), reason_code=pa.array(self.reasons(rows), pa.string()),
        )

    def changed(self) -> np.ndarray:
        """Logs with an accepted record."""
        return np.unique(self.log[self.accepted])

    def recordings(self) -> pa.RecordBatch:
        logs = self.changed()
        n = len(self.row)
        stays = self.accepted | self.old
        own = np.flatnonzero(stays & self.is_recording)
        last = np.full(self.n_logs, -1, np.int64)
        last[self.log[own]] = own
        made = np.full(self.n_logs, n, np.int64)
        np.minimum.at(made, self.log[own], own)
        number = np.zeros(self.n_logs, np.int64)
        np.maximum.at(number, self.log[stays], self.sequence[stays])
        last, made = last[logs], made[logs]
        failed = self.kind[last] == FAILED
        names = np.array(RECORDING_STATUS, object)
        return self._batch(
            "recording", len(logs), recording_id=self._take("recording_id", made), sequence=pa.array(number[logs]), status=pa.array(names[self.kind[last]], pa.string()),
            failure=self._take("reason", last, failed), source_kind=self._take("source_kind", made), source_path=self._take("source_path", made),
        )

    def clips(self) -> pa.RecordBatch:
        touched = np.zeros(self.n_logs, bool)
        touched[self.changed()] = True
        stays = (self.accepted | self.old) & touched[self.log]
        keep = stays[self.by_clip]
        rows, key = self.by_clip[keep], self.clip_key[keep]
        first_of = np.ones(len(rows), bool)
        first_of[1:] = key[1:] != key[:-1]
        group = np.cumsum(first_of) - 1
        n = int(group[-1]) + 1 if len(group) else 0
        made = rows[first_of]  # a clip's first record adds it
        last, settled = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        marks = self.after[rows] >= 0
        last[group[marks]] = rows[marks]
        marks &= ~self.deleted[rows]
        settled[group[marks]] = rows[marks]
        failed = self.old[settled] | (self.kind[settled] == BROKEN)
        position = np.empty(len(self.row), np.int64)
        adds = np.flatnonzero(stays & self.added)
        starts = _starts(self.log[adds])
        position[adds] = np.arange(len(adds)) - starts
        moves = stays & self.moved
        if moves.any():
            self._walk(position, moves, stays & self.added, rows, group, made)
        names = np.array(CLIP_STATUSES, object)
        return self._batch(
            "clip", n, recording_id=self._take("recording_id", made), clip_id=self._take("clip_id", made), position=pa.array(position[made]),
            start_us=self._take("start_us", made), end_us=self._take("end_us", made), status=pa.array(names[self.after[last]], pa.string()),
            failure=self._take("reason", settled, failed),
        )

    def _walk(self, position, moves, adds, rows, group, made) -> None:
        """Positions in the lists of logs with moves, change by change."""
        from tapeloom.operators.replay import ListOrder

        clip = np.full(len(self.row), -1, np.int64)
        clip[rows] = made[group]  # a clip goes by the row that added it
        walked = np.zeros(self.n_logs, bool)
        walked[self.log[moves]] = True
        steps = np.flatnonzero((moves | adds) & walked[self.log])
        target = np.where(moves, _numbers(self.column["target_index"], -1), -1)[steps].tolist()
        names, logs = clip[steps].tolist(), self.log[steps]
        bounds = [*np.flatnonzero(np.append(True, logs[1:] != logs[:-1])).tolist(), len(steps)]
        for low, high in zip(bounds, bounds[1:]):
            if high - low > 512:
                order = ListOrder()
                for i in range(low, high):
                    order.append(names[i]) if target[i] < 0 else order.move(names[i], target[i])
                ids = order.ids()
            else:
                ids = []
                for i in range(low, high):
                    if target[i] < 0:
                        ids.append(names[i])
                    else:
                        ids.remove(names[i])
                        ids.insert(target[i], names[i])
            position[ids] = np.arange(len(ids))

    def transcripts(self) -> pa.RecordBatch:
        rows = np.flatnonzero(self.accepted & self.committed)
        took = {n: self._take(n, rows) for n in ("recording_id", "transcript_id", "clip_id", "provenance", "text")}
        return self._batch("transcript", len(rows), sequence=pa.array(self.sequence[rows]), **took)


def fold_logs(tables: Collection[str], island: int):
    """A function of batches: where logs stop, and the rows of the state ``tables`` that come of the records before."""
    def fold(batches):
        for table in whole_logs(batches):
            logs = Logs(table, True, island)
            yield logs.stops()
            for name in tables:
                found = getattr(logs, name)()
                if found.num_rows:
                    yield found
    return fold
