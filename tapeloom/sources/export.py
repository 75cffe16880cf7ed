"""Text exports and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.clips import RECORDING
from tapeloom.operators.views import document_totals, documents_missing, transcript_document
from tapeloom.plans.stage import written
from tapeloom.sources.files import write_files


def export_transcripts(
    recordings: DataFrame, clips: DataFrame, transcripts: DataFrame, root: str
) -> tuple[DataFrame, DataFrame]:
    """One text file per recording: (reports with path and counts, rejects).

    Pieces are written once to a stage table, then streamed to the file in order, a blank line
    between two, a newline at the end. byte_count leaves that last newline out.
    """
    pieces = written(transcript_document(clips, transcripts), "pieces")
    path = F.concat(F.lit(f"{root.rstrip('/')}/recordings/"), F.col(RECORDING), F.lit("/transcripts/transcript.txt"))
    gap = F.when(F.col("byte_offset") > 0, "\n\n").otherwise("")
    body = pieces.select(
        path.alias("path"), F.col("position").alias("part"), F.concat(gap, F.col("piece")).cast("binary").alias("data")
    )
    totals = document_totals(pieces).withColumn("path", path)
    ends = totals.select("path", F.lit(2**62).cast("bigint").alias("part"), F.lit("\n").cast("binary").alias("data"))
    done = write_files(body.unionByName(ends)).select("path")
    report = done.join(totals, "path").select(RECORDING, "path", "transcript_count", "byte_count")
    return report, documents_missing(recordings, pieces)


def write_report(report: DataFrame, path: str, form: str = "json") -> None:
    """Any report as json, csv or text."""
    if form == "json":
        report.write.mode("overwrite").json(path)
    elif form == "csv":
        report.write.mode("overwrite").option("header", "true").csv(path)
    elif form == "text":
        shown = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in report.columns]
        report.select(F.concat_ws(", ", *shown).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown report form {form!r}")
