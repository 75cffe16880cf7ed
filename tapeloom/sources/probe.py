"""Media-probe text tables to media_meta, as plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.text import trim_unicode
from tapeloom.functions.timecode import clock_sum_us, decimal_seconds_us, frames_in, whole_number
from tapeloom.operators.clips import RECORDING
from tapeloom.plans.once import computed_once

# Order of fields in the comma form.
CSV_FIELDS = ("sample_rate_hz", "channels", "frame_count", "duration")
# Channel counts of named layouts; all but the first match by prefix.
LAYOUTS = {"quad": 4, "2.1": 3, "3.0": 3, "4.0": 4, "5.1": 6, "6.1": 7, "7.1": 8}

# Rates are unsigned 32-bit numbers.
MAX_RATE = 4_294_967_295
# Channel counts are unsigned 16-bit numbers.
MAX_CHANNELS = 65_535
META = ["sample_rate_hz", "channels", "duration_us", "frame_count"]


def _keep(df: DataFrame) -> DataFrame:
    """Rows whose every field could be read, and the others with their text."""
    missing = F.lit(False)
    for name in META:
        missing = missing | F.col(name).isNull()
    return df.withColumn("bad", missing)


def _read_csv(probe: DataFrame, order: tuple[str, ...]) -> DataFrame:
    fields = F.transform(F.split(trim_unicode("text"), ","), lambda x: trim_unicode(x))
    rows = probe.select(RECORDING, "text", fields.alias("fields"))
    rows = rows.select(RECORDING, "text", *[F.get("fields", F.lit(order.index(n))).alias(n) for n in CSV_FIELDS])
    rows = rows.select(
        RECORDING, "text", F.col("frame_count").alias("given"),
        whole_number(F.col("sample_rate_hz")).alias("rate"),
        whole_number(F.col("channels"), "int").alias("channels"),
        decimal_seconds_us(F.col("duration")).alias("duration_us"),
    )
    given = F.col("given")
    return rows.select(
        RECORDING, "text", F.when(F.col("rate") <= MAX_RATE, F.col("rate")).alias("sample_rate_hz"),
        F.when(F.col("channels") <= MAX_CHANNELS, F.col("channels")).alias("channels"), "duration_us",
        F.when(given.isin("", "N/A"), frames_in("duration_us", "rate")).otherwise(whole_number(given)).alias("frame_count"),
    )


def _channels(field: Column) -> Column:
    named = F.when(field == "mono", 1).when(field == "stereo", 2)
    named = named.when(F.endswith(field, F.lit(" channels")), whole_number(F.substring_index(field, " channels", 1), "int"))
    for layout, count in LAYOUTS.items():
        hit = field == layout if layout == "quad" else F.startswith(field, F.lit(layout))
        named = named.when(hit, count)
    return named


def _read_log(probe: DataFrame) -> DataFrame:
    # one step per projection: each later step refers to a column several times
    rows = probe.select(
        RECORDING, "text",
        F.regexp_extract("text", r"Duration: ([^,\n]*)", 1).alias("clock"),
        F.regexp_extract("text", r"Audio:([^\n]*)", 1).alias("details"),
    )
    rows = rows.select(
        RECORDING, "text", F.split(trim_unicode("clock"), ":").alias("clock"),
        F.transform(F.split("details", ","), lambda x: trim_unicode(x)).alias("fields"),
    )
    rows = rows.select(RECORDING, "text", "fields", *[F.get("clock", F.lit(i)).alias(n) for i, n in enumerate("hms")], F.size("clock").alias("n_parts"))
    rows = rows.withColumn("s", F.when(F.contains("s", F.lit(".")), F.col("s")).otherwise(F.concat("s", F.lit(".0"))))
    rows = rows.select(
        RECORDING, "text", "fields", F.when(F.col("n_parts") == 3, clock_sum_us(F.col("h"), F.col("m"), F.col("s"))).alias("duration_us")
    )
    is_rate = lambda x: F.endswith(x, F.lit(" Hz"))
    names = F.filter("fields", lambda x: ~is_rate(x))
    rows = rows.select(
        RECORDING, "text", "duration_us",
        F.transform(
            F.filter("fields", is_rate), lambda x: whole_number(F.substring_index(x, " Hz", 1))
        ).alias("rates"),
        # a field that names no layout is skipped; an unreadable "N channels" makes the probe bad
        F.filter(
            F.transform(names, lambda x: F.struct(_channels(x).alias("n"), F.endswith(x, F.lit(" channels")).alias("must"))),
            lambda c: c["n"].isNotNull() | c["must"],
        ).alias("counts"),
    )
    readable = F.forall("rates", lambda x: x.isNotNull()) & F.forall("counts", lambda c: c["n"].isNotNull())
    # the last mention wins
    rows = rows.select(
        RECORDING, "text", "duration_us",
        F.when(readable, F.try_element_at("rates", F.lit(-1))).alias("rate"),
        F.when(readable, F.try_element_at("counts", F.lit(-1))["n"]).alias("channels"),
    )
    return rows.select(
        RECORDING, "text", F.when(F.col("rate") <= MAX_RATE, F.col("rate")).alias("sample_rate_hz"),
        F.when(F.col("channels") <= MAX_CHANNELS, F.col("channels")).alias("channels"), "duration_us",
        frames_in("duration_us", "rate").alias("frame_count"),
    )


def parse_probe(probe: DataFrame, order: tuple[str, ...] = CSV_FIELDS) -> tuple[DataFrame, DataFrame]:
    """``(recording_id, form, text)`` with form csv or log to (media_meta, rejects).

    csv: comma-separated fields in ``order``; an empty or N/A frame count follows from the
    duration. log: the first ``Duration:`` clock and the first ``Audio:`` line.
    """
    csv = _read_csv(probe.filter("form = 'csv'"), order)
    log = _read_log(probe.filter("form = 'log'"))
    read = _keep(computed_once(csv.unionByName(log), [RECORDING, "text"], [F.col(n) for n in META]))
    good = read.filter("not bad").select(RECORDING, "duration_us", "sample_rate_hz", "channels", "frame_count")
    bad = read.filter("bad").select(RECORDING, F.lit("invalid_probe").alias("reason_code"), F.col("text").alias("raw"))
    return good, bad
