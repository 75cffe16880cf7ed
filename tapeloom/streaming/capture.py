"""Audio packets from live recordings.

Decoding needs no state: a packet becomes a block of mono samples on its own. Where the
block stands in its recording follows from packet numbers, set-wise once they have landed
(``assemble_capture``), or as they come (``placed_stream``), with counters per recording and
only the packets that came before their turn as state. So is the life cycle, which has a deadline.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tapeloom.functions import audio as A
from tapeloom.functions.timecode import duration_us
from tapeloom.operators.clips import ORDINAL_BUCKET, RECORDING
from tapeloom.plans.scan import SumBefore, SumOfKey, ordered_scan
from tapeloom.schemas import PACKETS_DDL, struct_type

# Fixed value: why a capture without sound fails.
NO_FRAMES = "microphone recording stopped before any audio frames were captured"
ENDED = "recording_ended"

PLACED = "placed"
WITHOUT_FRAMES = "no_frames"
REPEATED = "packet_repeated"
UNNUMBERED = "packet_unnumbered"
SAVED = "saved"
PLACED_DDL = "recording_id string, packet_no bigint, outcome string, block_no bigint, first_frame bigint, total_frames bigint, samples array<float>"

LIFE_DDL = "recording_id string, kind string, reason string, sample_rate_hz int, frame_count bigint, duration_us bigint"


def read_capture_stream(spark: SparkSession, path: str, files_per_batch: int = 1_000) -> DataFrame:
    """Packets arriving as parquet files below ``path``."""
    return (
        spark.readStream.schema(struct_type(PACKETS_DDL))
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def decode_packets(packets: DataFrame) -> DataFrame:
    """Mono samples per packet; a silent packet is as many zeros as it has frames.

    Works the same on a batch and on a stream.
    """
    samples = A.packet_samples("payload", "sample_format", "channels", "frames", F.coalesce("silent", F.lit(False)))
    return packets.select(RECORDING, "packet_no", "sample_rate_hz", "stop", samples.alias("samples"))


def assemble_capture(decoded: DataFrame, width: int = ORDINAL_BUCKET) -> tuple[DataFrame, DataFrame]:
    """(audio blocks at the capture rate, capture report) of decoded packets."""
    n = F.size("samples").cast("bigint")
    sounding = decoded.filter(F.size("samples") > 0).select(RECORDING, "packet_no", "samples", n.alias("n"))
    one = F.lit(1).cast("bigint")
    placed = ordered_scan(
        sounding, [RECORDING], "packet_no",
        [SumBefore("first_frame", "n"), SumOfKey("total_frames", "n"), SumBefore("block_no", one)], width,
    )
    blocks = placed.select(RECORDING, F.lit("original").alias("profile"), "block_no", "first_frame", "total_frames", "samples")
    report = decoded.groupBy(RECORDING).agg(
        F.max("sample_rate_hz").alias("sample_rate_hz"), F.sum(n).alias("frame_count"), F.max("stop").alias("stopped")
    )
    return blocks, report.select(
        RECORDING, "sample_rate_hz", "frame_count", duration_us("frame_count", "sample_rate_hz").alias("duration_us"), "stopped"
    )


class CaptureLife(StatefulProcessor):
    """Started on the first packet; saved, or failed without sound, on a stop packet or deadline.

    Packets after the end are reported as ``packets_rejected`` with their frames. With ``forget_ms``
    above 0, the last trace of a recording is removed so long after its end.
    """

    def __init__(self, deadline_ms: int, forget_ms: int):
        self.deadline_ms, self.forget_ms = deadline_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", struct_type("frames bigint, rate int, ended boolean, timer bigint"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, timer = [], 0
        if self.facts.exists():
            frames, rate, ended, timer = self.facts.get()
        else:
            frames, rate, ended = 0, 0, False
            out += [self._row(key, "recording_created"), self._row(key, "recording_started")]
            timer = self._wake(timerValues, self.deadline_ms)
        late, stopped = 0, None
        packets = pd.concat(list(rows)).sort_values("packet_no", kind="stable")
        for n, hz, stop in zip(packets["n"], packets["sample_rate_hz"], packets["stop"]):
            if ended:
                late += 1
                continue
            frames, rate = frames + int(n), max(rate, 0 if pd.isna(hz) else int(hz))
            if stop:
                ended = stopped = True
        if stopped:
            out.append(self._end(key, frames, rate))
            if timer:
                self.handle.deleteTimer(timer)
            timer = self._wake(timerValues, self.forget_ms)
        if late:
            out.append(self._row(key, "packets_rejected", ENDED, None, late))
        self.facts.update((frames, rate, ended, timer))
        yield _life_frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.facts.exists():
            return
        frames, rate, ended, timer = self.facts.get()
        if expiredTimerInfo.getExpiryTimeInMs() != timer:
            return
        if ended:
            self.facts.clear()
            return
        self.facts.update((frames, rate, True, self._wake(timerValues, self.forget_ms)))
        yield _life_frame([self._end(key, frames, rate)])

    def _wake(self, timerValues, after_ms: int) -> int:
        if not after_ms:
            return 0
        at = timerValues.getCurrentProcessingTimeInMs() + after_ms
        self.handle.registerTimer(at)
        return at

    def _end(self, key, frames, rate):
        if frames == 0:
            return self._row(key, "recording_failed", NO_FRAMES, rate, 0, 0)
        return self._row(key, "recording_saved", None, rate, frames, frames * 1_000_000 // rate if rate else 0)

    @staticmethod
    def _row(key, kind, reason=None, rate=None, frames=None, duration=None):
        return (key[0], kind, reason, rate, frames, duration)

    def close(self) -> None:
        pass


def _life_frame(rows) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in LIFE_DDL.split(", ")])
    for name in ("sample_rate_hz", "frame_count", "duration_us"):
        out[name] = out[name].astype("Int64")
    return out


def capture_lifecycle(decoded: DataFrame, deadline_ms: int = 0, forget_ms: int = 0) -> DataFrame:
    """Life-cycle events of live recordings; ``deadline_ms`` 0 waits for a stop packet.

    ``packets_rejected`` rows count, as ``frame_count``, the packets that came after the end.
    Without ``forget_ms`` an ended recording leaves one small state row for good.
    """
    counts = decoded.select(
        RECORDING, "packet_no", F.size("samples").cast("bigint").alias("n"), F.col("sample_rate_hz"),
        F.coalesce("stop", F.lit(False)).alias("stop"),
    )
    return counts.groupBy(RECORDING).transformWithStateInPandas(
        statefulProcessor=CaptureLife(deadline_ms, forget_ms), outputStructType=struct_type(LIFE_DDL),
        outputMode="Append", timeMode="ProcessingTime" if deadline_ms or forget_ms else "None",
    )


class PlacePackets(StatefulProcessor):
    """Gives each packet its block number and first frame, in the order of packet numbers from 0.

    A packet ahead of its turn waits in map state. With ``patience_ms``, a missing packet is waited for
    so long and then left out; if it comes later it is ``packet_repeated``, as its number is past.
    The packet with ``stop`` ends the recording: what has a later number is ``recording_ended``.
    """

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", struct_type("due bigint, block bigint, frame bigint, ended boolean, held bigint, timer bigint"))
        self.early = handle.getMapState("early", struct_type("packet_no bigint"), struct_type("samples array<float>, stop boolean"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        began = self.due
        for batch in rows:
            out = []
            for number, samples, stop in zip(*(batch.sort_values("packet_no")[c] for c in ("packet_no", "samples", "stop"))):
                out += self._take(key, number, samples, bool(stop))
            yield _placed_frame(out)
        if self.timer and (not self.held or self.due != began):
            self.handle.deleteTimer(self.timer)
            self.timer = 0
        self._wait(timerValues)
        self._save()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        if expiredTimerInfo.getExpiryTimeInMs() != self.timer:
            return
        self.timer, out = 0, []
        if self.held:
            self.due = min(k[0] for k in self.early.keys())
            out = list(self._follow(key))
        self._wait(timerValues)
        self._save()
        yield _placed_frame(out)

    def _take(self, key, number, samples, stop):
        if pd.isna(number):
            return [(key[0], None, UNNUMBERED, None, None, None, None)]
        number = int(number)
        if number < self.due:
            return [(key[0], number, REPEATED, None, None, None, None)]
        if self.ended:
            return [(key[0], number, ENDED, None, None, None, None)]
        if number > self.due:
            if self.held and self.early.containsKey((number,)):
                return [(key[0], number, REPEATED, None, None, None, None)]
            self.early.updateValue((number,), ([float(x) for x in samples], stop))
            self.held += 1
            return []
        return [*self._put(key, samples, stop), *self._follow(key)]

    def _follow(self, key):
        """Packets that waited and whose turn has come; once ended, all that wait are late."""
        while self.held and not self.ended and self.early.containsKey((self.due,)):
            samples, stop = self.early.getValue((self.due,))
            self.early.removeKey((self.due,))
            self.held -= 1
            yield from self._put(key, samples, stop)
        if self.ended and self.held:
            for number in sorted(k[0] for k in self.early.keys()):
                yield (key[0], number, ENDED, None, None, None, None)
            self.early.clear()
            self.held = 0

    def _put(self, key, samples, stop):
        number, n = self.due, len(samples)
        self.due += 1
        if n:
            yield (key[0], number, PLACED, self.block, self.frame, None, samples)
            self.block, self.frame = self.block + 1, self.frame + n
        else:
            yield (key[0], number, WITHOUT_FRAMES, None, None, None, None)
        if stop:
            self.ended = True
            yield (key[0], None, SAVED if self.frame else "failed", self.block, None, self.frame, None)

    def _load(self):
        empty = (0, 0, 0, False, 0, 0)
        self.due, self.block, self.frame, self.ended, self.held, self.timer = self.place.get() if self.place.exists() else empty

    def _save(self):
        self.place.update((self.due, self.block, self.frame, self.ended, self.held, self.timer))

    def _wait(self, timerValues):
        if self.held and self.patience_ms and not self.timer:
            self.timer = timerValues.getCurrentProcessingTimeInMs() + self.patience_ms
            self.handle.registerTimer(self.timer)

    def close(self) -> None:
        pass


def _placed_frame(rows) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in PLACED_DDL.split(", ")])
    for name in ("packet_no", "block_no", "first_frame", "total_frames"):
        out[name] = out[name].astype("Int64")
    return out


def placed_stream(decoded: DataFrame, patience_ms: int = 0) -> DataFrame:
    """A row per packet of a live capture, with the place of its block, and one per ended recording.

    ``outcome`` is ``placed``, ``no_frames``, or why a packet was refused. The row of an ended recording
    is ``saved``, or ``failed`` where nothing sounded, with ``total_frames`` and, as ``block_no``, its number of blocks.
    ``patience_ms`` 0 waits for a missing packet for good. An ended recording leaves one row of counters.
    """
    packets = decoded.select(
        RECORDING, F.col("packet_no").cast("bigint").alias("packet_no"),
        F.coalesce("samples", F.array().cast("array<float>")).alias("samples"), F.coalesce("stop", F.lit(False)).alias("stop"),
    )
    return packets.groupBy(RECORDING).transformWithStateInPandas(
        statefulProcessor=PlacePackets(patience_ms), outputStructType=struct_type(PLACED_DDL),
        outputMode="Append", timeMode="ProcessingTime" if patience_ms else "None",
    )
