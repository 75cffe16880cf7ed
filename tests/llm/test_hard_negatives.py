"""Hard negatives against brute force over all pairs, and the threshold scan itself."""

import math

import numpy as np
import pytest

from tapeloom.llm import op13_hard_negatives as hard

DDL = "vec_id bigint, embedding array<float>, label int"


def brute(rows):
    """Every score of every anchor, by plain loops over row numbers."""
    sound = [
        (i, [math.floor(256 * float(np.float32(c))) for c in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label)
        for i, v, label in rows
        if v and label is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a, (anchor, x, label) in enumerate(sound):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(p * q for p, q in zip(x, y)), i, other == label) for b, (i, y, other) in enumerate(sound) if b != a]
        for ps, positive, _ in sorted((s for s in scored if s[2]), key=order)[:5]:
            held = sorted((s for s in scored if not s[2] and 80 * ps <= 100 * s[0] <= 100 * ps), key=order)[:5]
            out += [(anchor, positive, k + 1, i, ps, s) for k, (s, i, _) in enumerate(held)]
    return out


def check(spark, rows, parts=3):
    df = spark.createDataFrame(rows, DDL).repartition(parts)
    for name in ("key", "x", "search", "score", "id", "rank", "anchor_id", "positive_score"):
        df = df.withColumn(name, df.label)
    got = [tuple(r) for r in hard.hard_negatives(df).collect()]
    show = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(got, key=show) == sorted(brute(rows), key=show)
    return got


def vectors(n, d, seed, scale=0.3):
    draw = np.random.default_rng(seed)
    return [(i, (draw.standard_normal(d) * scale).astype(np.float32).tolist(), int(draw.integers(0, 10))) for i in range(n)]


@pytest.mark.parametrize("d", [3, 17])
def test_equals_brute_force(spark, d):
    assert len(check(spark, vectors(450, d, d))) > 20


def test_small_blocks_and_anchor_batches(spark, monkeypatch):
    # tasks see these as they are pickled with the function
    monkeypatch.setattr(hard, "BLOCK_ROWS", 7)
    monkeypatch.setattr(hard, "ANCHOR_ROWS", 2)
    assert len(check(spark, vectors(320, 5, 1), 9)) > 10


def test_ties_copies_and_odd_rows(spark):
    same = [(i, [0.5, 0.25], 3) for i in range(1, 40)] + [(i, [0.5, 0.25], 4) for i in range(40, 90)]
    anchors = [(100, [0.5, 0.25], 3), (100, [0.5, 0.25], 3), (200, [0.0, 0.0], 3), (300, [-0.5, -0.25], 3), (700, [0.5, 0.25], 2)]
    odd = [
        (None, [0.5, 0.25], 4), (None, [0.5, 0.25], 3), (400, None, 3), (500, [float("nan"), 1.0], 3), (600, [None, 1.0], 3),
        (800, [0.5, 0.25], None), (900, [float("inf"), 0.0], 1), (1000, [], 1), (1, [0.5, 0.25], 3),
    ]
    got = check(spark, same + anchors + odd)
    assert len([r for r in got if r[0] == 100]) == 50 and {r[3] for r in got if r[0] == 100} == {7, 14, 21, 28, 35}


def test_a_length_of_its_own_takes_no_part(spark):
    rows = vectors(120, 4, 8)
    df = spark.createDataFrame([*rows, (200, [1.0, 1.0], 3), (300, [1.0] * 9, 3)], DDL)
    assert sorted(map(tuple, hard.hard_negatives(df).collect())) == sorted(brute(rows))


def test_nothing_to_mine(spark):
    assert hard.hard_negatives(spark.createDataFrame([], DDL)).count() == 0
    assert hard.hard_negatives(spark.createDataFrame([(1, None, 1), (100, [0.1], None)], DDL)).count() == 0
    assert hard.hard_negatives(spark.createDataFrame([(100, [0.1, 0.2], 1)], DDL)).count() == 0


def test_scores_beyond_a_long_raise(spark):
    with pytest.raises(Exception, match="would not fit a long"):
        hard.hard_negatives(spark.createDataFrame([(100, [1e30, 0.2], 1)], DDL)).count()


def test_whole_numbers_beyond_doubles_stay_exact():
    x = np.array([[2**30, 1], [3, 2**30]])
    assert hard.exact(x).dtype == np.int64 and hard.exact(x // 2**10).dtype == np.float64
    assert (hard.Lists(x, np.arange(2)).x @ x[0]).tolist() == [2**60 + 1, 3 * 2**30 + 2**30]


def test_scan_stops_before_the_end_and_misses_nothing():
    draw = np.random.default_rng(4)
    x = np.floor(draw.standard_normal((5000, 3)) * 100)
    x[:20] += 400  # a few clearly best rows
    lists = hard.Lists(x, np.arange(len(x)))
    anchor = np.array([3.0, 2.0, 1.0])
    search = hard.Search(-np.inf, np.inf, np.arange(len(x)), np.arange(len(x)))
    depth = lists.scan(anchor, lists.thresholds(anchor[None])[0], search)
    assert depth < 500
    want = np.lexsort((np.arange(len(x)), -(x @ anchor)))[:5]
    assert search.rows.tolist() == want.tolist()
