"""Event logs to state tables, set-wise.

A log is folded in sequence order and stops at its first invalid record. Every rule
is checked here on the assumption that all earlier records of the log were valid.
That assumption holds for the first invalid record of a log, which is the only one
that matters, so the earliest finding of any check is exactly where a sequential
fold would have stopped. What remains is ordinary aggregation: the checks are
windows over (recording, clip) or bucketed scans, the state is ``max_by`` over the
accepted prefix. No task has to walk a recording's log.

A replay may go on from a state: what the checks need to know of the records before (``Known``)
is one narrow row per log, clip and version id, and joins the scans as a record of its own that
comes first. Only the rows of the recordings, clips and ids that the new records name take part,
so no old event is read.

The one thing with a true order dependence, list positions after moves, is walked in
sequence order over clip ids alone, and only for recordings that have moves.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.clips import ORDINAL_BUCKET, RECORDING, TIME_BUCKET_US
from tapeloom.operators.short_logs import FOLDED_DDL, fold_logs
from tapeloom.operators.validation import payload_code
from tapeloom.plans.scan import Lag, LastSeen, Lead, MaxBefore, SumBefore, ordered_scan
from tapeloom.plans.stage import COMPILED, settings, written
from tapeloom.schemas import EVENT_COLUMNS, PAYLOAD_COLUMNS, RECORDING_KINDS, SCHEMA_VERSION

KEY = [RECORDING, "clip_id"]
# Kind of the rows that stand for what is known already, and a last number that no record follows:
# that of a state which does not say where its log ended.
KNOWN = "known"
UNKNOWN_LAST = 2**62
# Clips that meet in one stretch of source time up to which they are compared in one row.
ISLAND = 32
# Rows of walked lists that go back to Spark at once; a batch per recording costs more than the walk.
WALKED = 8_192
# Clip statuses, and the recording kinds with the status each leaves, by their codes.
STATUS_CODES = ("pending", "ready", "processing", "failed", "transcribed", "edited", "deleted")
LIFE = (("recording_created", "created"), ("recording_started", "recording"), ("recording_saved", "saved"), ("recording_failed", "failed"))

# From which clip status each transcription event is allowed.
STARTABLE = ("pending", "ready", "failed", "transcribed", "edited")
SETTLING = ("processing", "transcribed", "edited")


class Replayed:
    """State after the accepted prefix of every log; each table may be given as what makes it when it is first asked for."""

    def __init__(self, recordings, clips, transcripts, rejects=None, accepted=None):
        self._made = {"recordings": recordings, "clips": clips, "transcripts": transcripts, "rejects": rejects, "accepted": accepted}

    def _table(self, name: str) -> DataFrame | None:
        if callable(self._made[name]):
            self._made[name] = self._made[name]()
        return self._made[name]

    recordings = property(lambda self: self._table("recordings"))
    clips = property(lambda self: self._table("clips"))
    transcripts = property(lambda self: self._table("transcripts"))
    rejects = property(lambda self: self._table("rejects"))
    accepted = property(lambda self: self._table("accepted"))


@dataclass
class Known:
    """What the records before left that later ones are judged by."""

    heads: DataFrame  # recording_id, last_sequence, last_kind, n_clips
    clips: DataFrame  # recording_id, clip_id, status, start_us, end_us
    versions: DataFrame  # recording_id, transcript_id

    def of(self, rows: DataFrame) -> Known:
        """Only the recordings that ``rows`` name."""
        named = written(rows.select(RECORDING).distinct(), "named")
        return Known(*(t.join(named, RECORDING, "left_semi") for t in (self.heads, self.clips, self.versions)))


def known_state(state: Replayed) -> Known:
    """From state tables. A recording whose last number is not known takes no further record."""
    life = F.create_map(*[F.lit(x) for kind, status in LIFE for x in (status, kind)])
    counts = state.clips.groupBy(RECORDING).agg(F.count("*").alias("n_clips"))
    heads = state.recordings.join(counts, RECORDING, "left").select(
        RECORDING, F.coalesce("last_sequence", F.lit(UNKNOWN_LAST)).alias("last_sequence"), life[F.col("status")].alias("last_kind"),
        F.coalesce("n_clips", F.lit(0).cast("bigint")).alias("n_clips"),
    )
    return Known(heads, state.clips.select(*KEY, "status", "start_us", "end_us"), state.transcripts.select(RECORDING, "transcript_id"))


def _decoded(last: Column, names) -> Column:
    """The name whose code is in the last three bits; an array of non-null names alone would turn null into one of them."""
    return F.when(last.isNotNull(), F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(last, F.lit(8)) + 1).cast("int")))


def known_log(accepted: DataFrame) -> Known:
    """From a log of accepted events; positions are left out, as no check asks for them."""
    kind = F.col("kind")
    life = F.coalesce(*[F.when(kind == k, F.lit(i)) for i, (k, _) in enumerate(LIFE)])
    last = F.max(F.col("sequence") * 8 + life)
    heads = accepted.groupBy(RECORDING).agg(
        F.max("sequence").alias("last_sequence"),
        _decoded(last, [k for k, _ in LIFE]).alias("last_kind"),
        F.sum(F.when(kind == "clip_added", 1).otherwise(0)).cast("bigint").alias("n_clips"),
    )
    versions = accepted.filter("kind = 'transcript_committed'").select(RECORDING, "transcript_id")
    return Known(heads, clip_states(accepted).select(*KEY, "status", "start_us", "end_us"), versions)


def one_row_per_sequence(events: DataFrame, position: str | None = None) -> DataFrame:
    """The record each (recording, sequence) is taken from, and how many claim that number.

    With a ``position`` column the first in the file wins; otherwise the pick is by
    content hash, so it does not depend on how the table is split. Numbers are counted on two
    columns first; only rows that share one are brought together whole, and if there are none the
    events are read as they are.
    """
    key = [RECORDING, "sequence"]
    columns = [*key, "kind", *PAYLOAD_COLUMNS, "schema_version"]
    counts = events.groupBy(*key).agg(F.count("*").alias("copies"))
    repeated = written(counts.filter("copies > 1").select(*key), "repeated")
    single = F.lit(1).cast("bigint").alias("copies")
    if repeated.isEmpty():
        return events.select(*columns, single)
    once = events.join(repeated, key, "left_anti").select(*columns, single)
    picked = _picked(events, repeated, position).select(*columns, "copies")
    return once.unionByName(picked)


def _picked(events: DataFrame, repeated: DataFrame, position: str | None = None) -> DataFrame:
    """Of the records that share one of the ``repeated`` numbers, the one that counts, and how many there are."""
    key = [RECORDING, "sequence"]
    shared = events.join(repeated, key, "left_semi")
    tie = F.col(position) if position else _content_hash()
    row = F.struct(tie.alias("tie"), "kind", *PAYLOAD_COLUMNS, "schema_version")
    picked = written(shared.groupBy(*key).agg(F.min(row).alias("r"), F.count("*").alias("copies")), "picked")
    return picked.select(*key, "r.kind", *[f"r.{c}" for c in PAYLOAD_COLUMNS], "r.schema_version", "copies")


def status_after() -> Column:
    """Clip status an event leaves behind, null where it leaves the status alone."""
    kind = F.col("kind")
    return (
        F.when(kind == "clip_added", "pending")
        .when(kind == "transcription_started", "processing")
        .when(kind == "transcription_failed", "failed")
        .when(kind == "clip_deleted", "deleted")
        .when(kind == "transcript_committed", F.when(F.col("provenance") == "user_edit", "edited").otherwise("transcribed"))
    )


def _finding(rank: int, code: str | Column, copy: int | Column = 0) -> Column:
    """Where and why a log stops: earliest sequence first, then the order rules are asked in."""
    return F.struct(
        F.col("sequence"),
        (F.lit(copy) if isinstance(copy, int) else copy).cast("int").alias("copy"),
        F.lit(rank).alias("rank"),
        (F.lit(code) if isinstance(code, str) else code).alias("code"),
    )


def _log_finding(clip_code: Column | None = None) -> Column:
    """What is wrong with a record beside its scans: ``previous_sequence``, ``last_kind``, ``n_clips`` and ``copies``;
    with what is wrong with its clip, if that is known in the same row."""
    kind = F.col("kind")
    is_recording = kind.isin(*RECORDING_KINDS)
    last = F.col("last_kind")
    expected = F.coalesce(F.col("previous_sequence"), F.lit(0).cast("bigint")) + 1
    transition = (
        ((kind == "recording_started") & (last != "recording_created"))
        | ((kind == "recording_saved") & (last != "recording_started"))
        | ((kind == "recording_failed") & ~last.isin("recording_created", "recording_started"))
    )
    checks = [
        (0, F.coalesce(F.col("schema_version"), F.lit(-1)) != SCHEMA_VERSION, "unsupported_schema"),
        (1, F.col("sequence") != expected, "event_out_of_order"),
        (2, F.col("problem").isNotNull(), F.col("problem")),
        (3, (kind == "recording_created") & last.isNotNull(), "recording_already_exists"),
        (3, (kind != "recording_created") & last.isNull(), "recording_not_found"),
        (4, is_recording & (kind != "recording_created") & transition, "invalid_recording_transition"),
        (8, (kind == "clip_moved") & ~F.coalesce(F.col("target_index").between(0, F.col("n_clips") - 1), F.lit(False)), "invalid_clip_index"),
    ]
    if clip_code is not None:
        checks.insert(-1, (5, clip_code.isNotNull(), clip_code))
    found = None
    for rank, bad, code in reversed(checks):
        found = F.when(bad, _finding(rank, code)) if found is None else F.when(bad, _finding(rank, code)).otherwise(found)
    repeated = F.when(F.col("copies") > 1, _finding(1, "event_out_of_order", 1))
    return F.coalesce(found, repeated)


def _log_findings(rows: DataFrame, width: int, known: Known | None = None) -> DataFrame:
    """Version, numbering, payloads on their own, recording life cycle and move targets."""
    kind = F.col("kind")
    is_recording = kind.isin(*RECORDING_KINDS)
    narrow = rows.select(
        RECORDING, "sequence", "kind", "copies", "schema_version", "target_index", payload_code().alias("problem"),
        F.when(kind == "clip_added", 1).otherwise(0).cast("bigint").alias("adds"), F.lit(False).alias("old"),
    )
    if known is not None:
        narrow = narrow.unionByName(known.heads.select(
            RECORDING, F.col("last_sequence").alias("sequence"), F.col("last_kind").alias("kind"), F.col("n_clips").alias("adds"), F.lit(True).alias("old"),
        ), allowMissingColumns=True)
    seen = ordered_scan(
        narrow, [RECORDING], "sequence",
        [Lag("previous_sequence", "sequence"), LastSeen("last_kind", F.when(is_recording, kind)), SumBefore("n_clips", "adds")],
        width,
    ).filter("not old")
    return seen.select(RECORDING, _log_finding().alias("f")).filter("f is not null")


def _clip_code() -> Column:
    """What is wrong with a record of a clip that ``was`` in some status, or null for none."""
    kind = F.col("kind")
    was = F.col("was")
    return (
        F.when(kind == "clip_added", F.when(was.isNotNull(), "clip_already_exists"))
        .when(kind == KNOWN, F.lit(None).cast("string"))
        .when(was.isNull(), "clip_not_found")
        .when((kind == "transcription_started") & ~was.isin(*STARTABLE), "invalid_clip_transition")
        .when((kind == "transcription_failed") & ~was.isin(*SETTLING), "invalid_clip_transition")
        .when((kind == "transcript_committed") & (was == "deleted"), "clip_deleted")
        .when((kind == "transcript_committed") & ~was.isin(*SETTLING), "invalid_clip_transition")
    )


def _clip_findings(rows: DataFrame, width: int, known: Known | None = None) -> DataFrame:
    """Clip existence, uniqueness and transcription life cycle, per clip; unnamed clips are found by their payload."""
    kind = F.col("kind")
    narrow = rows.filter(~kind.isin(*RECORDING_KINDS) & F.col("clip_id").isNotNull()).select(
        *KEY, "sequence", "kind", status_after().alias("after")
    )
    if known is not None:
        named = known.clips.join(narrow.select(*KEY).distinct(), KEY, "left_semi")
        narrow = narrow.unionByName(named.select(
            *KEY, F.lit(0).cast("bigint").alias("sequence"), F.lit(KNOWN).alias("kind"), F.col("status").alias("after")
        ))
    seen = ordered_scan(narrow, KEY, "sequence", [LastSeen("was", "after")], width)
    code = _clip_code()
    return seen.select(RECORDING, F.when(code.isNotNull(), _finding(5, code)).alias("f")).filter("f is not null")


def _transcript_findings(rows: DataFrame, known: Known | None = None) -> DataFrame:
    """A transcript id committed a second time in its recording.

    Only the two earliest uses of an id are kept, and Spark prunes to them before the shuffle.
    """
    ids = [RECORDING, "transcript_id"]
    uses = rows.filter("kind = 'transcript_committed' and transcript_id is not null").select(*ids, "sequence")
    if known is not None:
        named = known.versions.join(uses.select(*ids).distinct(), ids, "left_semi")
        uses = uses.unionByName(named.select(*ids, F.lit(0).cast("bigint").alias("sequence")))
    nth = F.row_number().over(Window.partitionBy(*ids).orderBy("sequence"))
    second = uses.withColumn("nth", nth).filter("nth <= 2").filter("nth = 2")
    return second.select(RECORDING, _finding(7, "transcript_already_exists").alias("f"))


def clip_lives(rows: DataFrame, known: Known | None = None, together: str | None = None) -> DataFrame:
    """Per clip: its range, when it was added and, if ever, first deleted. Clips that are known and
    active were there from the start; they matter only where their recording gets new ones.
    Rows are exchanged by ``together``, if it is given."""
    added = F.col("kind") == "clip_added"
    at = F.when(added, F.col("sequence"))
    steps = rows.filter(F.col("kind").isin("clip_added", "clip_deleted") & F.col("clip_id").isNotNull())
    ends = steps.select(*KEY, "sequence", "kind", "start_us", "end_us")
    if known is not None:
        growing = steps.filter(added).select(RECORDING).distinct()
        there = known.clips.filter("status <> 'deleted'").join(growing, RECORDING, "left_semi")
        ends = ends.unionByName(there.select(
            *KEY, F.lit(0).cast("bigint").alias("sequence"), F.lit("clip_added").alias("kind"), "start_us", "end_us"
        ))
    return (
        (ends.repartition(together) if together else ends).groupBy(*KEY)
        .agg(
            F.min(at).alias("added_at"),
            F.min_by("start_us", at).alias("start_us"),
            F.min_by("end_us", at).alias("end_us"),
            F.min(F.when(~added, F.col("sequence"))).alias("deleted_at"),
        )
        .filter("added_at is not null and start_us >= 0 and end_us > start_us")
    )


def _ever_overlapping(lives: DataFrame, width: int) -> DataFrame:
    """Clips whose range meets that of any other clip of the recording, dead or alive, with ``island``:
    the start of the stretch of source time that meeting ranges cover without a gap."""
    starts = lives.groupBy(RECORDING, "start_us").agg(
        F.max("end_us").alias("max_end"), F.count("*").alias("n")
    )
    seen = ordered_scan(
        starts, [RECORDING], "start_us", [MaxBefore("reach", "max_end"), Lead("next_start", "start_us")], width, share=True
    )
    within = F.coalesce(F.col("reach") > F.col("start_us"), F.lit(False))
    met = within | (F.col("next_start") < F.col("max_end")) | (F.col("n") > 1)
    shores = written(seen.filter(met).select(RECORDING, "start_us", F.when(~within, F.col("start_us")).alias("shore")), "shores")
    placed = ordered_scan(shores, [RECORDING], "start_us", [LastSeen("shore_before", "shore")], width)
    islands = placed.select(RECORDING, "start_us", F.coalesce("shore", "shore_before").alias("island"))
    return lives.join(islands, [RECORDING, "start_us"])


def _small_island_findings(small: DataFrame) -> DataFrame:
    """Overlaps among the few clips of an island, found within one row."""
    clip = F.struct("added_at", "deleted_at", "start_us", "end_us")
    held = small.groupBy(RECORDING, "island").agg(F.collect_list(clip).alias("clips"))

    def meets_active(x):
        return F.exists("clips", lambda y: (
            (y.added_at < x.added_at) & F.coalesce(y.deleted_at > x.added_at, F.lit(True)) & (y.start_us < x.end_us) & (x.start_us < y.end_us)
        ))

    at = F.array_min(F.transform(F.filter("clips", meets_active), lambda x: x.added_at))
    return held.select(RECORDING, at.alias("sequence")).filter("sequence is not null").select(RECORDING, _finding(6, "clip_overlaps").alias("f"))


def _tree_nodes(lives: DataFrame) -> DataFrame:
    """Each range as whole nodes of a decimal tree, and each start as one node per level.

    The nodes of a range tile it exactly, so a start lies in a range if and only if one
    of the start's nodes is one of the range's nodes: containment becomes equality. A
    recording has the levels that its longest range can fill, no others.
    """
    longest = lives.groupBy(RECORDING).agg(F.max(F.expr("end_us - start_us")).alias("longest"))
    spread = lives.join(longest, RECORDING).select(
        *KEY, "added_at", "deleted_at", "start_us", "end_us",
        # digits of the longest range, less one: the highest level with a node inside it
        F.explode(F.sequence(F.lit(0), F.length(F.col("longest").cast("string")) - 1)).alias("level"),
    ).withColumn("unit", F.element_at(F.array(*[F.lit(10**i).cast("bigint") for i in range(19)]), F.col("level") + 1))
    points = spread.select(
        RECORDING, "level", F.expr("start_us div unit").alias("node"), F.lit(1).alias("is_point"), "added_at", "deleted_at"
    )
    # units of this level fully inside the range, minus those a unit of the next level covers
    first, last = "(start_us + unit - 1) div unit", "end_us div unit"
    inside = spread.filter("start_us <= 9223372036854775807 - unit").withColumn("a", F.expr(first)).withColumn("b", F.expr(last)).filter("a < b")
    inside = inside.withColumn("up_a", F.expr("(a + 9) div 10 * 10")).withColumn("up_b", F.expr("b div 10 * 10"))
    pieces = F.expr(
        "case when up_a < up_b then concat("
        "  if(a < up_a, sequence(a, up_a - 1), cast(array() as array<bigint>)),"
        "  if(up_b < b, sequence(up_b, b - 1), cast(array() as array<bigint>)))"
        " else sequence(a, b - 1) end"
    )
    ranges = inside.select(
        RECORDING, "level", F.explode(pieces).alias("node"), F.lit(0).alias("is_point"), "added_at", "deleted_at"
    )
    return points.unionByName(ranges)


def _overlap_findings(met: DataFrame, width: int) -> DataFrame:
    """A clip added while an active clip of its recording overlaps it, among ``met`` that meet another.

    Islands of a few clips, such as a clip and its halves, are settled in place; only clips of
    larger ones are spread over a tree.
    """
    sizes = written(met.groupBy(RECORDING, "island").agg(F.count("*").alias("n")), "islands")
    key = [RECORDING, "island"]
    found = _small_island_findings(met.join(sizes.filter(F.col("n") <= ISLAND).drop("n"), key, "left_semi"))
    large = sizes.filter(F.col("n") > ISLAND).drop("n")
    if large.isEmpty():
        return found
    return found.unionByName(_tree_findings(met.join(large, key, "left_semi"), width))


def _tree_findings(lives: DataFrame, width: int) -> DataFrame:
    """The same over tree nodes, for any number of clips.

    Two ranges overlap when one's start lies in the other. On every tree node, walk
    additions and deletions in sequence order, counting active ranges and active
    starts: a start that arrives while ranges are active there, or a range that
    arrives while starts are, is an overlap. No pair is ever formed.
    """
    nodes = _tree_nodes(lives)
    step = F.explode(F.array(
        F.struct(F.col("added_at").alias("sequence"), F.lit(1).alias("d")),
        F.struct(F.col("deleted_at").alias("sequence"), F.lit(-1).alias("d")),
    ))
    moves = nodes.select(RECORDING, "level", "node", "is_point", step.alias("s")).filter("s.sequence is not null")
    point, added = F.col("is_point") == 1, F.col("s.d") == 1
    zero = F.lit(0).cast("bigint")

    def total(condition: Column, value) -> Column:
        return F.sum(F.when(condition, value).otherwise(zero))

    per_step = moves.groupBy(RECORDING, "level", "node", F.col("s.sequence").alias("sequence")).agg(
        total(point, F.col("s.d")).alias("d_points"),
        total(~point, F.col("s.d")).alias("d_ranges"),
        total(point & added, F.lit(1)).alias("new_points"),
        total(~point & added, F.lit(1)).alias("new_ranges"),
    )
    seen = ordered_scan(
        per_step, [RECORDING, "level", "node"], "sequence",
        [SumBefore("points", "d_points"), SumBefore("ranges", "d_ranges")], width, share=True,
    )
    hit = ((F.col("new_points") > 0) & (F.col("ranges") > 0)) | ((F.col("new_ranges") > 0) & (F.col("points") > 0))
    return seen.filter(hit).select(RECORDING, _finding(6, "clip_overlaps").alias("f"))


def long_stops(rows: DataFrame, width: int, time_width: int, known: Known | None, unique: bool = False, position: str | None = None) -> DataFrame:
    """(recording_id, stop_sequence, stop_copy, reason_code, kind) of the record each bad log stops at, by scans in buckets.
    ``unique`` says that no number is used twice."""
    rest = rows.withColumn("copies", F.lit(1)) if unique else one_row_per_sequence(rows, position)
    stops = written(_long_findings(rest, width, time_width, known), "long-stops")
    return stops.join(rest.select(RECORDING, F.col("sequence").alias("stop_sequence"), "kind"), [RECORDING, "stop_sequence"])


# Logs are counted by this many hashes of their recording first.
COUNTERS = 1 << 18


def long_logs(weights: DataFrame, width: int, stem: str) -> DataFrame:
    """Recordings whose rows of ``weights`` (recording_id, n) come to more than ``width``, as a table.

    Only recordings whose hash has more than that are counted on their own, which most often are none.
    """
    counter = F.pmod(F.xxhash64(RECORDING), F.lit(COUNTERS))
    crowded = written(weights.groupBy(counter.alias("counter")).agg(F.sum("n").alias("n")).filter(F.col("n") > width).select("counter"), "crowded")
    if crowded.isEmpty():
        return written(crowded.select(F.lit("").alias(RECORDING)), stem)
    few = weights.withColumn("counter", counter).join(crowded, "counter", "left_semi")
    return written(few.groupBy(RECORDING).agg(F.sum("n").alias("n")).filter(F.col("n") > width).select(RECORDING), stem)


def together(rows: DataFrame) -> DataFrame:
    """Rows of a recording in one task, known ones first, then in their order. The hash beside the key keeps the exchange:
    Spark drops one by the key itself above a join on it, and adaptive reads may then split a key."""
    ties = [c for c in ("tie", "schema_version") if c in rows.columns]
    place = [c for c in ("fresh", "place") if c in rows.columns] or ["sequence"]
    return rows.repartition(RECORDING, F.xxhash64(RECORDING)).sortWithinPartitions(RECORDING, *place, *ties).drop(*ties)


# Payload that a state table needs beside what the rules ask for.
_OF_TABLE = {"recordings": ("reason", "source_kind", "source_path"), "clips": ("reason",), "transcripts": ("provenance", "text")}


def _payload(tables: Collection[str]) -> list[str]:
    return sorted({column for name in tables for column in _OF_TABLE[name]})


def weighed(rows: DataFrame, payload: Collection[str]) -> DataFrame:
    """How many rows each of ``rows`` counts for in a task: one, and one more for each KB of the long ones of its ``payload``."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c in payload if c in ("text", "reason", "source_path") and c in rows.columns]
    more = F.call_function("div", sum(texts[1:], texts[0]).cast("bigint"), F.lit(1_024)) if texts else F.lit(0)
    return rows.select(RECORDING, (more + F.lit(1)).cast("bigint").alias("n"))


def judged_by(*more: Column | str) -> list[Column | str]:
    """Columns that the rules over several records read."""
    return [*KEY, "kind", "transcript_id", "start_us", "end_us", "target_index", (F.col("provenance") == "user_edit").alias("edited"), *more]


def _folded(rows: DataFrame, facts: DataFrame | None, tables: Collection[str], position: str | None) -> DataFrame:
    """Where logs that one task may hold stop, and the ``tables`` that come of them, over one exchange.

    Of records with one number the one that ``one_row_per_sequence`` picks comes first.
    """
    extra = _payload(tables)
    tie = F.col(position).cast("bigint") if position else _content_hash()
    stale = F.coalesce(F.col("schema_version"), F.lit(-1)) != SCHEMA_VERSION
    base = rows.select(*judged_by(
        *extra, "sequence", "schema_version", tie.alias("tie"), payload_code().alias("problem"), stale.alias("stale"),
    ))
    if facts is not None:
        base = base.withColumns({"place": F.col("sequence"), "fresh": F.lit(True), "status": F.lit(None).cast("string")})
        base = base.unionByName(facts.select(*[c for c in facts.columns if c in base.columns]), allowMissingColumns=True)
    return together(base).mapInArrow(fold_logs(tuple(tables), ISLAND), FOLDED_DDL)


def known_rows(state: Replayed) -> DataFrame:
    """A state as rows that come before a log's records: its recording, its clips in list order, its version ids."""
    life = F.create_map(*[F.lit(x) for kind, status in LIFE for x in (status, kind)])
    old, none = F.lit(False).alias("fresh"), F.lit(0).cast("bigint")

    def own(table: DataFrame, name: str, kind: str = "string") -> Column:
        return (F.col(name) if name in table.columns else F.lit(None)).cast(kind)

    heads, clips = state.recordings, state.clips
    return (
        heads.select(
            RECORDING, F.coalesce("last_sequence", F.lit(UNKNOWN_LAST)).alias("sequence"), life[F.col("status")].alias("kind"), F.lit(-1).cast("bigint").alias("place"),
            own(heads, "failure").alias("reason"), own(heads, "source_kind").alias("source_kind"), own(heads, "source_path").alias("source_path"), old,
        )
        .unionByName(clips.select(
            *KEY, none.alias("sequence"), F.lit("clip_added").alias("kind"), own(clips, "position", "bigint").alias("place"), "status", "start_us", "end_us",
            own(clips, "failure").alias("reason"), old,
        ), allowMissingColumns=True)
        .unionByName(state.transcripts.select(
            RECORDING, none.alias("sequence"), F.lit("transcript_committed").alias("kind"), F.lit(-1).cast("bigint").alias("place"), "transcript_id", old,
        ), allowMissingColumns=True)
    )


def _stops(found: DataFrame) -> DataFrame:
    return found.groupBy(RECORDING).agg(F.min("f").alias("f")).select(
        RECORDING, F.col("f.sequence").alias("stop_sequence"), F.col("f.copy").alias("stop_copy"), F.col("f.code").alias("reason_code")
    )


def _content_hash() -> Column:
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("kind", *PAYLOAD_COLUMNS)])


def _long_findings(rows: DataFrame, width: int, time_width: int, known: Known | None) -> DataFrame:
    """The findings of logs of any length, by scans in buckets."""
    # findings are few; written one after the other, so the exchanges of one check are gone before the next
    found = (
        written(_log_findings(rows, width, known), "log-findings")
        .unionByName(written(_clip_findings(rows, width, known), "clip-findings"))
        .unionByName(written(_transcript_findings(rows, known), "transcript-findings"))
    )
    met = written(_ever_overlapping(clip_lives(rows, known), time_width), "overlapping")
    if not met.isEmpty():  # most logs never have two clips over the same time
        found = found.unionByName(_overlap_findings(met, width))
    return _stops(found)


def replay(
    events: DataFrame,
    position: str | None = None,
    width: int = ORDINAL_BUCKET,
    time_width: int = TIME_BUCKET_US,
    snapshot: Replayed | None = None,
    tables: Collection[str] = ("recordings",),
) -> Replayed:
    """Fold every log up to its first invalid record; that record becomes the log's reject.

    ``events`` is read by every step, each with just its own columns, so it should be a table. Records without a number are
    judged after all others of their log, those without a recording belong to no log. Logs of at most ``width`` rows, what is
    known of them included, are folded whole in one task, longer ones by scans in buckets. ``tables`` names those of
    recordings, clips and transcripts that come out of the same pass; the others are made when they are asked for.

    With ``snapshot``, the state that earlier records left, ``events`` need only hold the records
    after: those numbered up to a recording's ``last_sequence`` are in its state and are passed
    over. The tables then cover all recordings, ``accepted`` and ``rejects`` the new records.
    """
    owned = events.filter(F.col(RECORDING).isNotNull())
    numbered = owned.filter("sequence is not null")
    facts = None
    if snapshot is not None:
        tables = tuple({*tables, "recordings"})
        heads = snapshot.recordings.select(RECORDING, "last_sequence")
        fresh = F.col("last_sequence").isNull() | (F.col("sequence") > F.col("last_sequence")) | (F.col("sequence") < 1)
        numbered = written(numbered.join(heads, RECORDING, "left").filter(fresh).drop("last_sequence"), "fresh")
        named = written(numbered.select(RECORDING).distinct(), "named")
        facts = known_rows(snapshot).join(named, RECORDING, "left_semi")
    weights = weighed(numbered, _payload(tables))
    if facts is not None:
        weights = weights.unionByName(weighed(known_rows(snapshot), _payload(tables)))
    long = long_logs(weights, width, "long-logs")
    all_short = long.isEmpty()
    short = numbered if all_short else numbered.join(long, RECORDING, "left_anti")
    if facts is not None and not all_short:
        facts = facts.join(long, RECORDING, "left_anti")
    with settings(events.sparkSession, COMPILED):
        seen = written(_folded(short, facts, tables, position), "seen")
    stops = seen.filter("what = 'stop'").select(RECORDING, F.col("sequence").alias("stop_sequence"), F.col("copy").alias("stop_copy"), "reason_code", "kind")
    if not all_short:
        rest = numbered.join(long, RECORDING, "left_semi")
        known = None
        if snapshot is not None:
            known = known_state(snapshot)
            known = Known(*(written(getattr(known, n).join(long, RECORDING, "left_semi"), f"known-{n}") for n in ("heads", "clips", "versions")))
        stops = stops.unionByName(written(long_stops(rest, width, time_width, known, position=position), "stops"))
    state = Replayed(
        lambda: made("recordings"), lambda: made("clips"), lambda: made("transcripts"),
        lambda: _rejects(events, owned, stops), lambda: _accepted(numbered, stops, position),
    )
    of_short = seen.filter

    def of_long() -> DataFrame:
        return state.accepted.join(long, RECORDING, "left_semi")

    def made(name: str) -> DataFrame:
        """What the fold of short logs gives, or, if it was not asked for this table, what follows from the accepted records."""
        if name in tables:
            found = [of_short(f"what = '{name[:-1]}'")]
        elif name == "clips":
            found = [written(_folded(short, facts, ("clips",), position), "list-changes").filter("what = 'clip'")]
        else:
            kept = state.accepted if all_short else state.accepted.join(long, RECORDING, "left_anti")
            found = [transcripts_of(kept) if name == "transcripts" else recordings_of(kept)]
        columns = _STATE_COLUMNS[name]
        renamed = {"sequence": "last_sequence" if name == "recordings" else "version_no"}
        found = [t.withColumnsRenamed(renamed).select(*columns) for t in found]
        if not all_short:
            found.append(_long_table(name, snapshot, of_long(), width).select(*columns))
        if snapshot is not None:
            before = getattr(snapshot, name).select(*columns)
            changed = of_short("what = 'recording'").select(RECORDING)
            if not all_short:
                changed = changed.unionByName(of_long().select(RECORDING).distinct())
            found.append(before if name == "transcripts" else before.join(changed, RECORDING, "left_anti"))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    return state


_STATE_COLUMNS = {
    "recordings": [RECORDING, "source_kind", "source_path", "status", "failure", "last_sequence"],
    "clips": [*KEY, "position", "start_us", "end_us", "status", "failure"],
    "transcripts": [RECORDING, "version_no", "transcript_id", "clip_id", "provenance", "text"],
}


def _long_table(name: str, snapshot: Replayed | None, accepted: DataFrame, width: int) -> DataFrame:
    """A state table of logs that no task may hold whole; of transcripts only the new ones."""
    if snapshot is None or name == "transcripts":
        return getattr(state_of(accepted, width), name)
    accepted = written(accepted, "accepted")
    changed = accepted.select(RECORDING).distinct()
    before = Replayed(*(getattr(snapshot, n).join(changed, RECORDING, "left_semi") for n in ("recordings", "clips", "transcripts")))
    return getattr(touched_state(before, accepted, width), name)


def _accepted(numbered: DataFrame, stops: DataFrame, position: str | None) -> DataFrame:
    # before the record a log stops at, no number is used twice
    judged = numbered.join(stops.select(RECORDING, "stop_sequence"), RECORDING, "left")
    accepted = judged.filter(F.col("stop_sequence").isNull() | (F.col("sequence") < F.col("stop_sequence"))).select(*EVENT_COLUMNS)
    repeated = stops.filter("stop_copy = 1").select(RECORDING, F.col("stop_sequence").alias("sequence"))
    if not repeated.isEmpty():
        accepted = accepted.unionByName(_picked(numbered, repeated, position).select(*EVENT_COLUMNS))
    return accepted


def _rejects(events: DataFrame, owned: DataFrame, stops: DataFrame) -> DataFrame:
    rejects = stops.select(RECORDING, F.col("stop_sequence").alias("sequence"), "kind", "reason_code")
    late = F.when(F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)), "event_out_of_order").otherwise("unsupported_schema")
    unnumbered = owned.filter("sequence is null").groupBy(RECORDING).agg(F.min(F.struct("kind", late.alias("code"))).alias("f"))
    nowhere = events.filter(F.col(RECORDING).isNull()).select(RECORDING, "sequence", "kind", F.lit("missing_field").alias("reason_code"))
    return rejects.unionByName(
        unnumbered.join(stops, RECORDING, "left_anti").select(
            RECORDING, F.lit(None).cast("bigint").alias("sequence"), F.col("f.kind").alias("kind"), F.col("f.code").alias("reason_code")
        )
    ).unionByName(nowhere)


def state_of(accepted: DataFrame, width: int = ORDINAL_BUCKET) -> Replayed:
    """State tables of accepted records."""
    return Replayed(recordings_of(accepted), lambda: clips_of(accepted, width), transcripts_of(accepted), None, accepted)


def touched_state(before: Replayed, accepted: DataFrame, width: int = ORDINAL_BUCKET) -> Replayed:
    """State of the recordings that ``accepted`` names; ``before`` holds no others.

    Rows of the state are merged key by key with what the records change, versions are added on.
    """
    was = before.recordings.select(RECORDING, *[F.col(c).alias(f"was_{c}") for c in ("source_kind", "source_path", "status", "failure", "last_sequence")])
    lived = F.col("status").isNotNull()
    recordings = recordings_of(accepted).join(was, RECORDING, "full_outer").select(
        RECORDING, F.coalesce("was_source_kind", "source_kind").alias("source_kind"), F.coalesce("was_source_path", "source_path").alias("source_path"),
        F.coalesce("status", "was_status").alias("status"), F.when(lived, F.col("failure")).otherwise(F.col("was_failure")).alias("failure"),
        F.greatest("last_sequence", "was_last_sequence").alias("last_sequence"),
    )
    old = before.clips.select(*KEY, *[F.col(c).alias(f"was_{c}") for c in ("start_us", "end_us", "status", "failure")])
    states = clip_states(accepted).join(old, KEY, "full_outer").select(
        *KEY, F.coalesce("was_start_us", "start_us").alias("start_us"), F.coalesce("was_end_us", "end_us").alias("end_us"),
        F.coalesce("status", "was_status").alias("status"),
        F.when(F.col("failure_at").isNotNull(), F.col("failure")).otherwise(F.col("was_failure")).alias("failure"),
    )
    clips = _placed(states, list_positions(accepted, width, before.clips))
    versions = transcripts_of(accepted)
    return Replayed(recordings, clips, before.transcripts.select(*versions.columns).unionByName(versions), None, accepted)


def recordings_of(accepted: DataFrame) -> DataFrame:
    kind = F.col("kind")
    own = F.when(kind.isin(*RECORDING_KINDS), F.col("sequence"))
    made = F.when(kind == "recording_created", F.col("sequence"))
    status = F.coalesce(*[F.when(kind == k, F.lit(after)) for k, after in LIFE])
    life = accepted.filter(kind.isin(*RECORDING_KINDS)).groupBy(RECORDING).agg(
        F.min_by("source_kind", made).alias("source_kind"),
        F.min_by("source_path", made).alias("source_path"),
        F.max_by(status, own).alias("status"),
        F.max_by(F.when(kind == "recording_failed", F.col("reason")), own).alias("failure"),
    )
    last = accepted.groupBy(RECORDING).agg(F.max("sequence").alias("last_sequence"))
    return last.join(life, RECORDING, "left").select(RECORDING, "source_kind", "source_path", "status", "failure", "last_sequence")


def clip_states(accepted: DataFrame) -> DataFrame:
    """Clip rows without list positions, from numbers alone: the aggregates hash, and reasons are
    looked up only for clips whose last word was a failure. ``failure_at`` is the record that set or
    cleared the failure, null if none did."""
    kind, sequence = F.col("kind"), F.col("sequence")
    after = status_after()
    code = F.coalesce(*[F.when(after == name, F.lit(i)) for i, name in enumerate(STATUS_CODES)])
    added = F.when(kind == "clip_added", sequence)
    changes = kind.isin("clip_added", "transcription_started", "transcription_failed", "transcript_committed")
    last = F.max(sequence * 8 + code)
    state = accepted.filter(~kind.isin(*RECORDING_KINDS)).groupBy(*KEY).agg(
        F.min_by("start_us", added).alias("start_us"),
        F.min_by("end_us", added).alias("end_us"),
        _decoded(last, STATUS_CODES).alias("status"),
        F.max(F.when(changes, sequence)).alias("failure_at"),
    )
    reasons = accepted.filter(kind == "transcription_failed").select(*KEY, sequence.alias("failure_at"), F.col("reason").alias("failure"))
    return state.join(reasons, [*KEY, "failure_at"], "left").select(*KEY, "start_us", "end_us", "status", "failure", "failure_at")


def _placed(states: DataFrame, positions: DataFrame) -> DataFrame:
    return states.join(positions, KEY).select(*KEY, "position", "start_us", "end_us", "status", "failure")


def clips_of(accepted: DataFrame, width: int = ORDINAL_BUCKET) -> DataFrame:
    """Clip rows with list positions."""
    return _placed(clip_states(accepted), list_positions(accepted, width))


def list_positions(accepted: DataFrame, width: int = ORDINAL_BUCKET, before: DataFrame | None = None) -> DataFrame:
    """Where each clip stands in its recording's list, of which ``before`` has the clips so far."""
    changes = accepted.filter(F.col("kind").isin("clip_added", "clip_moved")).select(
        *KEY, "sequence", "kind", "target_index"
    )
    if before is None:
        # five readers below; each would cut the log off at its stop again. Records after a snapshot are a table already
        changes = written(changes, "list-changes")
    moved = changes.filter("kind = 'clip_moved'").select(RECORDING).distinct()
    walked = changes.select(*KEY, "sequence", F.when(F.col("kind") == "clip_moved", F.col("target_index")).alias("target"))
    still = changes.join(moved, RECORDING, "left_anti").select(*KEY, "sequence", F.lit(1).cast("bigint").alias("takes"), F.lit(False).alias("old"))
    if before is not None:
        # the list so far counts as additions before the first record
        walked = walked.unionByName(before.select(*KEY, (F.col("position") - UNKNOWN_LAST).alias("sequence"), F.lit(None).cast("bigint").alias("target")))
        held = before.groupBy(RECORDING).agg(F.count("*").alias("takes")).join(moved, RECORDING, "left_anti")
        still = still.unionByName(held.select(RECORDING, F.lit("").alias("clip_id"), F.lit(0).cast("bigint").alias("sequence"), "takes", F.lit(True).alias("old")))
    plain = ordered_scan(still, [RECORDING], "sequence", [SumBefore("position", "takes")], width).filter("not old").select(*KEY, "position")
    if before is not None:
        plain = plain.unionByName(before.join(moved, RECORDING, "left_anti").select(*KEY, "position"))
    walked = (
        walked.join(moved, RECORDING, "left_semi")
        # by a hash of the key: Spark drops an exchange by the key itself below a join on it, and
        # adaptive reads may then split a key
        .repartition(F.xxhash64(RECORDING))
        .sortWithinPartitions(RECORDING, "sequence")
        .mapInArrow(_walk_moves, "recording_id string, clip_id string, position bigint")
    )
    return plain.unionByName(walked)


class ListOrder:
    """A list of clip ids in blocks of about the square root of its length.

    An id knows its block, so a move touches two blocks and the lengths of the others.
    """

    def __init__(self):
        self.blocks, self.home, self.size = [[]], {}, 64

    def append(self, clip) -> None:
        block = self.blocks[-1]
        if len(block) >= self.size:
            block = []
            self.blocks.append(block)
        block.append(clip)
        self.home[clip] = block

    def move(self, clip, target: int) -> None:
        self.home[clip].remove(clip)
        for block in self.blocks:
            if target <= len(block):
                break
            target -= len(block)
        block.insert(target, clip)
        self.home[clip] = block
        if len(block) > 2 * self.size:
            self._deal()

    def _deal(self) -> None:
        """All ids in even blocks again; a block must have taken in ``size`` ids since the last time."""
        ids = self.ids()
        self.size = max(64, isqrt(len(ids)))
        self.blocks = [ids[i : i + self.size] for i in range(0, len(ids), self.size)]
        self.home = {clip: block for block in self.blocks for clip in block}

    def ids(self) -> list:
        return [clip for block in self.blocks for clip in block]


def _walk_moves(batches):
    """Stream sorted list changes; only the current recording's clip ids are held, and up to ``WALKED`` rows of finished ones."""
    current, order = None, None
    done = [], [], []

    def flush():
        ids = order.ids()
        for column, values in zip(done, ([current] * len(ids), ids, range(len(ids)))):
            column.extend(values)

    def emptied():
        arrays = [pa.array(column, kind) for column, kind in zip(done, (pa.string(), pa.string(), pa.int64()))]
        for column in done:
            column.clear()
        return pa.RecordBatch.from_arrays(arrays, ["recording_id", "clip_id", "position"])

    for batch in batches:
        for recording, clip, target in zip(*(batch.column(n).to_pylist() for n in ("recording_id", "clip_id", "target"))):
            if recording != current or order is None:
                if order is not None:
                    flush()
                    if len(done[0]) >= WALKED:
                        yield emptied()
                current, order = recording, ListOrder()
            if target is None:
                order.append(clip)
            else:
                order.move(clip, target)
    if order is not None:
        flush()
        yield emptied()


def transcripts_of(accepted: DataFrame) -> DataFrame:
    """Every committed version; its number is the sequence that committed it."""
    return accepted.filter("kind = 'transcript_committed'").select(
        RECORDING, F.col("sequence").alias("version_no"), "transcript_id", "clip_id", "provenance", "text"
    )


def latest_status(events: DataFrame) -> DataFrame:
    """Status columns straight from logs already known to be valid: one aggregation, no checks."""
    return recordings_of(events)


def state_differences(replayed: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Rows on one side only, with the side they are on; empty when the two agree."""
    cols = sorted(replayed.columns)
    left, right = replayed.select(*cols), snapshot.select(*cols)
    return left.exceptAll(right).withColumn("only_in", F.lit("replayed")).unionByName(
        right.exceptAll(left).withColumn("only_in", F.lit("snapshot"))
    )


def transition_audit(events: DataFrame, width: int = ORDINAL_BUCKET) -> DataFrame:
    """Counts of recording status changes, legal and not, taking every event as it comes."""
    kind = F.col("kind")
    to = (
        F.when(kind == "recording_created", "created")
        .when(kind == "recording_started", "recording")
        .when(kind == "recording_saved", "saved")
        .when(kind == "recording_failed", "failed")
    )
    rows = events.filter(kind.isin(*RECORDING_KINDS)).select(RECORDING, "sequence", to.alias("to_status"))
    seen = ordered_scan(rows, [RECORDING], "sequence", [Lag("was", "to_status")], width)
    was = F.coalesce("was", F.lit("none"))
    edge = F.concat_ws(">", was, F.col("to_status"))
    # The legal changes.
    legal = edge.isin(
        "none>created", "created>recording", "recording>saved", "created>failed", "recording>failed"
    )
    return seen.groupBy(was.alias("from_status"), "to_status", legal.alias("legal")).agg(
        F.count("*").alias("n_events")
    )
