"""Ordered scans that stay parallel inside one key.

A plain ``Window.partitionBy(recording_id).orderBy(...)`` sends a recording's rows
to a single task, however long the recording is. Here a key is cut into buckets of
its integer order column. The window runs per (key, bucket), each bucket is reduced
to one summary row, a second window over the summaries yields what every bucket
inherits from the ones before (or after) it, and an equi-join on (key, bucket)
brings that back. Only the summaries of a key ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"


@dataclass(frozen=True)
class Step:
    """One output column of a scan; ``value`` is a column name or expression."""

    out: str
    value: Column | str

    def expr(self) -> Column:
        return F.col(self.value) if isinstance(self.value, str) else self.value


class Lag(Step):
    """Value of the row just before, null at the start of the key."""

    def local(self, before, after, here):
        return F.lag(F.struct(self.expr().alias("v"))).over(here)

    def summary(self, rank):
        return F.max_by(F.struct(self.expr().alias("v")), rank)

    def carry(self, name, before, after, whole):
        return F.lag(name).over(before[1])

    def merge(self, local, carried):
        return F.coalesce(local, carried)["v"]


class Lead(Lag):
    """Value of the row just after, null at the end of the key."""

    def local(self, before, after, here):
        return F.lead(F.struct(self.expr().alias("v"))).over(here)

    def summary(self, rank):
        return F.min_by(F.struct(self.expr().alias("v")), rank)

    def carry(self, name, before, after, whole):
        return F.lead(name).over(before[1])


class LastSeen(Step):
    """Last non-null value strictly before the row."""

    def local(self, before, after, here):
        return F.last(self.expr(), ignorenulls=True).over(before)

    def summary(self, rank):
        return F.max_by(self.expr(), F.when(self.expr().isNotNull(), rank))

    def carry(self, name, before, after, whole):
        return F.last(name, ignorenulls=True).over(before[0])

    def merge(self, local, carried):
        return F.coalesce(local, carried)


class NextSeen(LastSeen):
    """First non-null value strictly after the row."""

    def local(self, before, after, here):
        return F.first(self.expr(), ignorenulls=True).over(after)

    def summary(self, rank):
        return F.min_by(self.expr(), F.when(self.expr().isNotNull(), rank))

    def carry(self, name, before, after, whole):
        return F.first(name, ignorenulls=True).over(after[0])


class SumBefore(Step):
    """Sum over the rows strictly before; 0 at the start of the key."""

    def local(self, before, after, here):
        return F.sum(self.expr()).over(before)

    def summary(self, rank):
        return F.sum(self.expr())

    def carry(self, name, before, after, whole):
        return F.sum(name).over(before[0])

    def merge(self, local, carried):
        return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))


class MaxBefore(Step):
    """Greatest value strictly before the row, null where there is none."""

    def local(self, before, after, here):
        return F.max(self.expr()).over(before)

    def summary(self, rank):
        return F.max(self.expr())

    def carry(self, name, before, after, whole):
        return F.max(name).over(before[0])

    def merge(self, local, carried):
        return F.greatest(local, carried)


class FirstOfKey(Step):
    """First non-null value of the whole key."""

    def local(self, before, after, here):
        return None

    def summary(self, rank):
        return F.min_by(self.expr(), F.when(self.expr().isNotNull(), rank))

    def carry(self, name, before, after, whole):
        return F.first(name, ignorenulls=True).over(whole)

    def merge(self, local, carried):
        return carried


class LastOfKey(FirstOfKey):
    """Last non-null value of the whole key."""

    def summary(self, rank):
        return F.max_by(self.expr(), F.when(self.expr().isNotNull(), rank))

    def carry(self, name, before, after, whole):
        return F.last(name, ignorenulls=True).over(whole)


class SumOfKey(FirstOfKey):
    """Sum over the whole key."""

    def summary(self, rank):
        return F.sum(self.expr())

    def carry(self, name, before, after, whole):
        return F.sum(name).over(whole)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    steps: Sequence[Step],
    width: int,
    ties: Sequence[str] = (),
    share: bool = False,
) -> DataFrame:
    """Add one column per step, reading each key in ``order`` (then ``ties``).

    ``order`` is an integer column; ``width`` is the span of it that one bucket
    holds. Keys must not be null.

    ``df`` feeds both the windows and the summaries. Over files, each reads its own columns.
    With ``share``, for a ``df`` that is costly to compute, both read one exchange instead;
    the caller should then pass only columns it goes on to use, and rows that have their keys.
    """
    keys = list(keys)
    if share:
        # the join would add this filter to one side only, and the exchange could not be shared
        for key in keys:
            df = df.filter(F.col(key).isNotNull())
    offset = F.pmod(F.col(order), F.lit(width))
    base = df.withColumn(BUCKET, F.call_function("div", F.col(order) - offset, F.lit(width)))
    if share:
        base = base.repartition(*keys, BUCKET)
    here = Window.partitionBy(*keys, BUCKET).orderBy(order, *ties)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    after = here.rowsBetween(1, Window.unboundedFollowing)
    rank = F.struct(order, *ties) if ties else F.col(order)

    across = Window.partitionBy(*keys).orderBy(BUCKET)
    across_before = (across.rowsBetween(Window.unboundedPreceding, -1), across)
    across_after = (across.rowsBetween(1, Window.unboundedFollowing), across)
    across_all = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    # the same columns on both sides, or Spark would prune them apart and compute df twice
    touch = [F.max(F.xxhash64(*df.columns)).alias("__touched")] if share else []
    summaries = base.groupBy(*keys, BUCKET).agg(
        *[s.summary(rank).alias(f"__s{i}") for i, s in enumerate(steps)], *touch
    )
    if share:
        summaries = summaries.filter("__touched is not null")
    if not any(isinstance(s, FirstOfKey) for s in steps):
        # a key of one bucket inherits nothing; what is left to join is usually small
        n_buckets = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        summaries = summaries.withColumn("__n", n_buckets).filter("__n > 1")
    carried = summaries.select(
        *keys,
        BUCKET,
        *[
            s.carry(f"__s{i}", across_before, across_after, across_all).alias(f"__c{i}")
            for i, s in enumerate(steps)
        ],
    )
    local = base.select(
        "*",
        *[
            col.alias(f"__l{i}")
            for i, s in enumerate(steps)
            if (col := s.local(before, after, here)) is not None
        ],
    )
    merged = local.join(carried, [*keys, BUCKET], "left")
    outs = []
    for i, s in enumerate(steps):
        local_col = F.col(f"__l{i}") if f"__l{i}" in local.columns else None
        outs.append(s.merge(local_col, F.col(f"__c{i}")).alias(s.out))
    return merged.select(*df.columns, *outs)
