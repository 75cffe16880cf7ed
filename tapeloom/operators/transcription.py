"""Bulk transcription: choose clips, cut audio, call a backend per clip, record the outcome."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.ids import derived_uuid
from tapeloom.functions.text import trim_unicode
from tapeloom.operators import features
from tapeloom.operators.clips import RECORDING, active, first_active_clip
from tapeloom.operators.commands import commands_of
from tapeloom.plans.stage import until_stopped, written
from tapeloom.session import fresh_folder

# Fixed value: what the stand-in backend answers by default.
FIXED_TEXT = "[fake transcription]"

RESULTS_DDL = (
    "recording_id string, clip_id string, window_no bigint, clip_start_us bigint, provenance string, "
    "text string, error string, backend_id string"
)


@dataclass(frozen=True)
class Capabilities:
    backend_id: str
    local_only: bool = True
    accepts_normalized_audio: bool = True


@dataclass
class Request:
    recording_id: str
    clip_id: str
    audio_path: str
    samples: np.ndarray

    def log_mel(self) -> np.ndarray:
        """(3000, 80) features, computed when a backend asks for them."""
        from tapeloom.functions.spectral import log_mel

        return log_mel(self.samples)


class Backend(Protocol):
    """Made once per Python worker by a factory, then called window by window.

    A backend that also has ``transcribe_batch(requests)``, giving a (provenance, text) pair or
    an exception for each, is called with several windows at once.
    """

    def capabilities(self) -> Capabilities: ...

    def transcribe(self, request: Request) -> tuple[str, str]:
        """(provenance, text); raise to fail the clip."""
        ...


class FixedTextBackend:
    """Answers every clip with the same text."""

    def __init__(self, text: str = FIXED_TEXT):
        self.text = text

    def capabilities(self) -> Capabilities:
        return Capabilities("fake")

    def transcribe(self, request: Request) -> tuple[str, str]:
        if not request.audio_path:
            raise ValueError("empty_audio_path")
        if not self.text.strip():
            raise ValueError("empty_transcript")
        return "raw_asr", self.text


_loaded: dict = {}


def _worker_backend(key: str, factory: Callable[[], Backend]) -> Backend:
    """One backend per worker process, however many partitions it serves; ``key`` names what ``factory`` makes."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = factory()
    return _loaded[key]


def ask(backend: Backend, requests: list[Request]) -> list[tuple[str | None, str | None, str | None]]:
    """(provenance, text, error) of each request, through ``transcribe_batch`` where a backend has it.

    A backend may raise anything; a failure stays with its request. A failed batch call is
    repeated one by one.
    """
    together = getattr(backend, "transcribe_batch", None)
    if together and len(requests) > 1:
        try:
            answers = list(together(requests))
            if len(answers) == len(requests):
                return [(*a, None) if not isinstance(a, Exception) else (None, None, _message(a)) for a in answers]
        except Exception:  # noqa: BLE001, S110
            pass
    found = []
    for request in requests:
        try:
            found.append((*backend.transcribe(request), None))
        except Exception as failure:  # noqa: BLE001
            found.append((None, None, _message(failure)))
    return found


def _message(failure: Exception) -> str:
    return str(failure).strip() or type(failure).__name__


def call_backend(
    windows: DataFrame, factory: Callable[[], Backend], run_key: str = "default", batch: int = 16
) -> DataFrame:
    """One result row per window: text, or the error that failed it. A failure stays with its window.

    ``windows``: recording_id, clip_id, window_no, clip_start_us, audio_path, samples. At most
    ``batch`` windows are held as requests at once.
    """
    names = [f.split()[0] for f in RESULTS_DDL.split(", ")]
    # workers outlive a job: another factory, or one that holds other values, is another backend
    key = f"{run_key} {hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()}"

    def run(batches):
        backend = _worker_backend(key, factory)
        name = backend.capabilities().backend_id
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                recordings, clips, numbers, starts, paths = (c.to_pylist() for c in part.columns[:5])
                requests = [
                    Request(r, c, p or "", np.asarray(s.values, np.float32))
                    for r, c, p, s in zip(recordings, clips, paths, part.column(5))
                ]
                provenance, text, error = zip(*ask(backend, requests))
                types = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
                values = [recordings, clips, numbers, starts, provenance, text, error, [name] * part.num_rows]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=names)

    wanted = [RECORDING, "clip_id", "window_no", "clip_start_us", "audio_path", "samples"]
    return windows.select(*wanted).mapInArrow(run, RESULTS_DDL)


def clip_outcomes(results: DataFrame) -> DataFrame:
    """Windows of a clip back together: texts joined in order, blank ones left out.

    Any failed window fails its clip; a clip left without text fails as empty.
    """
    text = trim_unicode("text")
    per = results.groupBy(RECORDING, "clip_id").agg(
        F.min("clip_start_us").alias("start_us"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("window_no"))).alias("error"),
        F.array_sort(F.collect_list(F.when(text != "", F.struct("window_no", text.alias("text"))))).alias("texts"),
        F.max("provenance").alias("provenance"),
        F.max("backend_id").alias("backend_id"),
    )
    joined = F.array_join(F.col("texts.text"), " ")
    error = F.coalesce("error", F.when(joined == "", "empty_transcript"))
    return per.select(
        RECORDING, "clip_id", "start_us", F.when(error.isNull(), F.col("provenance")).alias("provenance"),
        F.when(error.isNull(), joined).alias("text"), error.alias("error"), "backend_id",
    )


def outcome_commands(outcomes: DataFrame) -> DataFrame:
    """Begin, then commit or fail, for every clip; ordered by source time within a recording,
    so numbering does not depend on which clip finished first."""
    ordinal = F.col("start_us") * 2
    minted = outcomes.withColumn("transcript_id", derived_uuid("transcript", RECORDING, "clip_id", "backend_id", "text"))
    begin = commands_of(minted, "begin_transcription", ordinal, clip_id="clip_id")
    commit = commands_of(
        minted.filter("error is null"), "commit_transcript", ordinal + 1, clip_id="clip_id",
        transcript_id="transcript_id", provenance="provenance", text="text",
    )
    fail = commands_of(minted.filter("error is not null"), "fail_transcription", ordinal + 1, clip_id="clip_id", reason="error")
    return begin.unionByName(commit).unionByName(fail)


def pending_work(clips: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Active clips still without a committed text: new ones and those to retry after a failure."""
    waiting = clips.filter(F.col("status").isin("pending", "ready", "failed"))
    done = transcripts.select(RECORDING, "clip_id").distinct()
    return waiting.join(done, [RECORDING, "clip_id"], "left_anti").select(
        RECORDING, "clip_id", "start_us", "end_us", "status"
    )


def choose_clips(clips: DataFrame, mode: str = "all_active") -> DataFrame:
    """``all_active``, or ``first`` for only the first active clip of each recording."""
    if mode == "all_active":
        return active(clips)
    if mode == "first":
        return first_active_clip(clips)
    raise ValueError(f"unknown mode {mode!r}")


def clip_audio(clips: DataFrame, blocks: DataFrame, media: DataFrame, block_frames: int) -> tuple[DataFrame, DataFrame]:
    """(one row per feature window with its samples and path, rejects)."""
    sampled, rejects = features.window_audio(clips, blocks, media, block_frames)
    path = F.concat_ws("/", RECORDING, F.lit("audio/clips"), "window_id")
    return sampled.withColumn("audio_path", path), rejects


def transcribe(
    clips: DataFrame, blocks: DataFrame, media: DataFrame, block_frames: int,
    factory: Callable[[], Backend] = FixedTextBackend, mode: str = "all_active", run_key: str = "default",
) -> DataFrame:
    """Outcome per chosen clip. Clips that cannot be cut fail like any other, with their code.

    What the backend answered is written before anything reads it, so each window is asked
    for once, however often the outcomes are used.
    """
    chosen = choose_clips(clips, mode)
    windows, rejects = clip_audio(chosen, blocks, media, block_frames)
    results = written(call_backend(windows, factory, run_key), "results")
    uncut = rejects.select(
        RECORDING, "clip_id", "window_no", "clip_start_us", F.lit(None).cast("string").alias("provenance"),
        F.lit(None).cast("string").alias("text"), F.col("reason_code").alias("error"),
        F.lit(None).cast("string").alias("backend_id"),
    )
    return clip_outcomes(results.unionByName(uncut))


def transcribe_in_steps(
    clips: DataFrame, run: Callable[[DataFrame], DataFrame], steps: int,
    progress: Callable[[int, int], None] = lambda done, total: None,
    stop: Callable[[], bool] = lambda: False,
    stop_on_error: bool = False,
) -> tuple[list[DataFrame], bool]:
    """Run clips in ``steps`` jobs; (written outcomes of the finished jobs, cancelled).

    Clips are dealt to the jobs by recording and written once, so a job reads its own clips only.
    Progress is reported once before work and after every job, from metrics that the write
    itself observes. A stop request is seen every half second and ends the job that runs; a failed clip
    with ``stop_on_error`` is seen between jobs. What is finished is kept.
    """
    step = F.pmod(F.xxhash64(RECORDING), F.lit(steps)).cast("int")
    dealt = fresh_folder(clips.sparkSession, "steps")
    clips.withColumn("step", step).repartition("step").write.partitionBy("step").parquet(dealt)
    dealt = clips.sparkSession.read.schema(T.StructType([*clips.schema.fields, T.StructField("step", T.IntegerType())])).parquet(dealt)
    total = dealt.count()
    progress(0, total)
    done, finished = 0, []
    for i in range(steps):
        if stop():
            return finished, True
        out = run(dealt.filter(F.col("step") == i).drop("step"))
        seen = Observation()
        failed = F.count("error") if stop_on_error else F.lit(0)
        out = until_stopped(clips.sparkSession, lambda: written(out.observe(seen, F.count(F.lit(1)).alias("n"), failed.alias("failed")), "outcomes"), stop)
        if out is None:
            return finished, True
        finished.append(out)
        done += seen.get.get("n", 0)
        progress(done, total)
        if stop_on_error and seen.get.get("failed"):
            return finished, True
    return finished, False
