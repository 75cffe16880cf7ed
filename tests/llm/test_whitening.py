"""Whitening against a dense eigendecomposition, and odd rows."""

import math

import numpy as np
import pytest

from tapeloom.llm import op11_whitening as white

DDL = "vec_id bigint, embedding array<float>, label int"


def dense(vectors, wanted=8):
    """Everything from the full covariance, by LAPACK."""
    x = np.floor(1024 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    off = n * x - sums
    v = (off / n).T @ (off / n) / n
    values, turn = np.linalg.eigh(v)
    values, turn = values[::-1][:wanted], turn[:, ::-1][:, :wanted]
    return off / n @ turn / np.sqrt(values), values / np.trace(v), (off.astype(object) ** 2).sum(axis=1)


def compare(rows, vectors, k=8):
    want, explained, deviation = dense(vectors, k)
    got = np.zeros_like(want)
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == len(vectors) and r.deviation == deviation[r.vec_id]
        assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9) and r.identity_error < 1e-9
    assert len(rows) == len(vectors) * k
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * sign).max() < 1e-8


@pytest.mark.parametrize("shape", ["bulk", "steep"])
def test_equals_dense(spark, shape):
    draw = np.random.default_rng(3)
    rows = draw.standard_normal((300, 48)) / 7
    if shape == "steep":
        rows = rows * np.r_[np.geomspace(40, 1, 12), np.full(36, 0.5)]
    rows = rows.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(rows)], DDL).repartition(3)
    compare(white.whitened(df).collect(), rows)


def test_leading_pairs_of_given_spectra():
    draw = np.random.default_rng(5)
    turn = np.linalg.qr(draw.standard_normal((90, 90)))[0]
    for values in (np.linspace(2, 1, 90), np.geomspace(1e6, 1, 90), np.r_[np.full(40, 3.0), np.full(50, 1.0)], np.r_[5.0, 4, 3, np.zeros(87)]):
        v = turn * values @ turn.T
        pairs = white.leading_pairs(lambda q: v @ q, 90)
        real = min(8, int((values > 0).sum()))
        assert np.allclose(pairs.values, values[:real], rtol=1e-12) and pairs.residuals.max() <= 1e-12 * values[0]
        assert np.allclose(pairs.vectors.T @ pairs.vectors, np.eye(real), atol=1e-12)


def test_a_missed_direction_is_found():
    values = np.r_[100.0, 50, np.linspace(2, 1, 88)]
    v = np.diag(values)

    class Blind:
        """A generator whose first block lies outside the leading direction."""

        def __init__(self):
            self.draw, self.first = np.random.default_rng(1), True

        def standard_normal(self, shape):
            block = self.draw.standard_normal(shape)
            if self.first:
                block[0], self.first = 0, False
            return block

    original = np.random.default_rng
    np.random.default_rng = lambda seed: Blind() if seed == 11 else original(seed)
    try:
        found = white.leading_pairs(lambda q: v @ q, 90)
    finally:
        np.random.default_rng = original
    assert np.allclose(found.values[:2], [100, 50])


def test_odd_rows(spark):
    draw = np.random.default_rng(9)
    sound = draw.standard_normal((40, 12)).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(sound)]
    odd = [
        (100, None, 1), (101, [None] * 12, 1), (102, [float("nan")] + [0.0] * 11, 1), (103, [float("inf")] + [0.0] * 11, 1),
        (104, [0.5] * 11, 1), (105, [], None), (106, [1.0] * 5 + [None] + [1.0] * 6, 2),
    ]
    df = spark.createDataFrame(rows + odd, DDL)
    df = df.withColumns({n: df.label for n in ("x", "size", "n", "component", "part", "whitened")})
    compare(white.whitened(df).collect(), sound)


def test_repeated_rows_null_ids_and_ties(spark):
    rows = [(None, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (7, [0.0, 1.0], 1), (8, [-1.0, 0.0], 1), (9, [0.0, -1.0], 1), (9, [0.0, -1.0], 1), (10, [1.0, 0.0], 1), (11, [-1.0, 0.0], 1)]
    found = white.whitened(spark.createDataFrame(rows, DDL)).collect()
    assert len(found) == 16 and sum(r.vec_id is None for r in found) == 2 and sum(r.vec_id == 7 for r in found) == 4
    w = np.array([[r.whitened for r in found if r.component == c] for c in (1, 2)])
    assert np.allclose(w @ w.T / 8, np.eye(2)) and all(abs(r.explained - 0.5) < 1e-12 for r in found)


def test_nothing_to_whiten(spark):
    empty = spark.createDataFrame([], DDL)
    same = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], DDL)
    blank = spark.createDataFrame([(1, [], 1), (2, None, 1)], DDL)
    assert [white.whitened(t).count() for t in (empty, same, blank)] == [0, 0, 0]


def test_deviations_beyond_a_long():
    off = np.array([[3_000_000_000, 0], [3_100_000_000, 0], [1, 2]])
    assert white.squares(off).to_pylist() == [9 * 10**18, None, 5]


def test_many_partitions_are_added_up_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(white, "DIRECT", 32)
    rows = np.random.default_rng(2).standard_normal((200, 40)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(rows)], DDL)
    monkeypatch.setattr(white, "written", lambda d, stem: d.repartition(50).persist())
    compare(white.whitened(df).collect(), rows)
