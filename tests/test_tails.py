"""Tails against the math library and against sums of their definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import tails


def test_erfc_in_both_tails(spark):
    x = [*np.linspace(-6, 6, 241).tolist(), 0.0, 1e-9, 2.0, 1.9999999, 8.0, 15.0, 25.0]
    got = [r["y"] for r in spark.createDataFrame([(v,) for v in x], "x double").select(tails.erfc(F.col("x")).alias("y")).collect()]
    assert got == pytest.approx([math.erfc(v) for v in x], rel=1e-12, abs=1e-300)
    p = spark.createDataFrame([(None,), (float("nan"),), (1.96,)], "z double").select(tails.normal_two_sided(F.col("z")).alias("p")).collect()
    assert [r["p"] for r in p][:2] == [None, None] and p[2]["p"] == pytest.approx(0.04999579029644087, rel=1e-12)


def test_chi_square_tail(spark):
    rows = [(q, k) for k in (1, 2, 3, 4, 7, 10, 21, 40) for q in (0.0, 0.1, 1.0, 5.0, 30.0, 90.0)]

    def plain(q, k):  # the upper integral, by Simpson's rule far into the tail
        t = np.linspace(math.sqrt(q), math.sqrt(q) + 20, 200_001)  # substituting x = t^2
        y = t ** (k - 1) * np.exp(-t * t / 2) * 2 / (2 ** (k / 2) * math.gamma(k / 2))
        return (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (t[1] - t[0]) / 3

    out = spark.createDataFrame([*rows, (None, 3)], "q double, k int").select(tails.chi_square_tail(F.col("q"), F.col("k")).alias("p")).collect()
    assert [r["p"] for r in out][:-1] == pytest.approx([plain(q, k) for q, k in rows], rel=1e-8) and out[-1]["p"] is None
