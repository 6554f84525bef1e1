"""Blocked scans against plain loops: short spans, vanishing decays, series of many runs of blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import scan


def frame(spark, decay, add):
    rows = [(c, k, float(d), None if a is None else float(a)) for c in ("a", "b") for k, (d, a) in enumerate(zip(decay, add, strict=True))]
    return spark.createDataFrame(rows, "code string, trade_date int, d double, a double")


def loop(decay, add):
    y, out = 0.0, []
    for d, a in zip(decay, add, strict=True):
        y = d * y + (a or 0.0)
        out.append(y)
    return out


@pytest.mark.parametrize("kind", ["zeros", "tiny", "all zero", "mixed", "long", "negative"])
def test_linear_against_a_loop(spark, kind):
    rng = np.random.default_rng(2)
    n = 9000 if kind == "long" else 300
    decay = {"zeros": np.where(rng.random(n) < 0.05, 0.0, 0.9), "tiny": np.full(n, 1e-7), "all zero": np.zeros(n), "mixed": rng.choice([0.0, 1e-9, 2e-4, 0.5, 1.0], n), "long": np.full(n, 0.999), "negative": rng.choice([-0.5, 0.7], n)}[kind]
    add = [None if rng.random() < 0.05 else x for x in rng.normal(size=n)]
    out = scan.linear(frame(spark, decay, add), "y", F.col("d"), F.col("a")).orderBy("code", "trade_date").collect()
    want = loop(decay, add)
    assert np.allclose([r["y"] for r in out], want + want, rtol=1e-9, atol=1e-9)
    assert out[0].asDict().keys() == {"code", "trade_date", "d", "a", "y"}


@pytest.mark.parametrize("n", [1, 1.0001, 2, 10])
def test_short_spans(spark, n):
    x = np.random.default_rng(3).normal(size=200)
    alpha, want = scan.span(n), [x[0]]
    for v in x[1:]:
        want.append(alpha * v + (1 - alpha) * want[-1])
    out = scan.emas(frame(spark, np.ones(200), x), {"fast": ("a", alpha), "slow": ("a", scan.span(20))}).where("code = 'a'").orderBy("trade_date").collect()
    assert np.allclose([r["fast"] for r in out], want, rtol=1e-9)
    assert all(r["slow"] is not None for r in out)
