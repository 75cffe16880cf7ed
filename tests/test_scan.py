"""Bucketed scans give the same answers whatever the bucket width, hot keys included."""

import random

import pytest
from pyspark.sql import functions as F

from tapeloom.plans.scan import FirstOfKey, Lag, LastOfKey, LastSeen, Lead, MaxBefore, NextSeen, SumBefore, SumOfKey, ordered_scan
from tapeloom.plans.spread import explode_span


def expected(rows):
    out = set()
    for key in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == key)
        vals = [r[2] for r in own]
        seen = [v for v in vals if v is not None]
        for i, r in enumerate(own):
            before = [v for v in vals[:i] if v is not None]
            after = [v for v in vals[i + 1:] if v is not None]
            out.add((*r, vals[i - 1] if i else None, vals[i + 1] if i + 1 < len(own) else None,
                     before[-1] if before else None, after[0] if after else None, sum(before), i,
                     max(before) if before else None, seen[0] if seen else None, seen[-1] if seen else None, len(own)))
    return out


@pytest.mark.parametrize("width", [1, 3, 8, 10, 65_536])
def test_scan_matches_plain_order(spark, width):
    rng = random.Random(width)
    rows = [("hot", i - 40, rng.choice([None, rng.randint(-5, 5)])) for i in range(0, 140) if rng.random() < 0.7]
    rows += [(f"k{i}", rng.randint(-99, 99), i) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    one = F.lit(1).cast("bigint")
    got = ordered_scan(df, ["k"], "o", [
        Lag("lag", "v"), Lead("lead", "v"), LastSeen("last", "v"), NextSeen("next", "v"), SumBefore("sum", "v"),
        SumBefore("rank", one), MaxBefore("max", "v"), FirstOfKey("first", "v"), LastOfKey("final", "v"), SumOfKey("n", one),
    ], width)
    assert {tuple(r) for r in got.collect()} == expected(rows)


def test_spans(spark):
    df = spark.createDataFrame([("a", 0, 9), ("b", 5, 5)], "k string, lo bigint, hi bigint")
    got = explode_span(df, F.col("lo"), F.col("hi"), "i", ["k"], fan=4)
    assert sorted((r.k, r.i) for r in got.collect()) == [("a", i) for i in range(10)] + [("b", 5)]
