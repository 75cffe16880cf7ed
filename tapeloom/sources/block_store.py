"""Audio blocks laid out by (recording, block number), so that cutting moves no audio.

The store is a Parquet table in Spark's bucket layout. A join on recording and block number reads
it where it lies: the narrow side is exchanged to meet it, the samples never are. Before that, the
buckets that a set of ranges needs are worked out, and files of other buckets are not opened.
Both keys decide the bucket, so one long recording is spread over all of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators.clips import RECORDING

BLOCK_COLUMNS = "recording_id string, profile string, block_no bigint, first_frame bigint, total_frames bigint, samples array<float>"
KEY = (RECORDING, "block_no")
BUCKETS = 64


@dataclass
class BlockStore:
    """``blocks`` is the whole table at ``path``; ``buckets`` the number its files were dealt into."""

    blocks: DataFrame
    path: str
    buckets: int

    def bucket(self) -> Column:
        """The bucket of a row that has the key columns, as Spark's writer deals them."""
        return F.pmod(F.hash(*KEY), F.lit(self.buckets))

    def holding(self, touched: DataFrame) -> DataFrame:
        """The blocks in the buckets of ``touched(recording_id, block_no)``.

        At most ``buckets`` numbers come to the driver. If every bucket is needed nothing is filtered.
        """
        needed = sorted(r[0] for r in touched.select(self.bucket()).distinct().collect())
        if len(needed) == self.buckets:
            return self.blocks
        names = "|".join(f"{b:05d}" for b in needed) or "none"
        return self.blocks.filter(F.col("_metadata.file_name").rlike(rf"_({names})(\.|$)"))


def store_blocks(blocks: DataFrame, path: str, buckets: int = BUCKETS) -> BlockStore:
    """Write blocks once, one file per bucket, and open them. The only exchange of the samples."""
    names = [c.split()[0] for c in BLOCK_COLUMNS.split(", ")]
    # the exchange deals rows as the bucket layout does, so a task writes one bucket
    dealt = blocks.select(*names).repartition(buckets, *KEY)
    table = f"blocks_{uuid4().hex}"
    dealt.write.option("path", path).bucketBy(buckets, *KEY).sortBy(*KEY).format("parquet").saveAsTable(table)
    return BlockStore(dealt.sparkSession.table(table), path, buckets)


def open_blocks(spark: SparkSession, path: str, buckets: int = BUCKETS) -> BlockStore:
    """A stored table in another session; ``buckets`` must be what it was written with."""
    table = f"blocks_{uuid4().hex}"
    keys = ", ".join(KEY)
    spark.sql(
        f"CREATE TABLE {table} ({BLOCK_COLUMNS}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return BlockStore(spark.table(table), path, buckets)
