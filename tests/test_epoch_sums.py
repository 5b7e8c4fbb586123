"""Sums of an epoch against the formulas."""

import numpy as np
import pytest

from paperweave.operators import experiments as T


def test_sums_of_an_epoch(spark):
    draw = np.random.default_rng(1)
    x, y, w = draw.normal(size=(50, 3)), draw.integers(0, 2, 50).astype(float), np.array([0.5, -1.0, 0.25])
    v = [True if i % 5 == 0 else None if i % 7 == 0 else False for i in range(50)]
    frame = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), v)), "x array<double>, y double, v boolean")
    p = 1 / (1 + np.exp(-(x @ w)))
    loss = -(y * np.log(p) + (1 - y) * np.log(1 - p))
    teach, held = np.array([i is False for i in v]), np.array([i is True for i in v])
    (n, t), (k, lost, hits), g = T._epoch_sums(frame, w)
    assert (n, k, hits) == (teach.sum(), held.sum(), ((p >= 0.5) == y)[held].sum())
    assert [t, lost, *g] == pytest.approx([loss[teach].sum(), loss[held].sum(), *((p - y)[teach] @ x[teach])])
