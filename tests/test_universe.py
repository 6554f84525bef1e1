"""Weights over a changing universe, by hand."""

import pytest

from panelforge.operators.universe import dynamic_weights

ROW = "code string, trade_date int, month int, r double, w0 double"


def weights(spark, rows, **more):
    out = dynamic_weights(spark.createDataFrame(rows, ROW), "month", **more).collect()
    return {(r["trade_date"], r["code"]): r["w"] for r in out}


def test_codes_come_and_go_inside_a_month(spark):
    rows = [
        ("a", 1, 1, 0.0, 1.0), ("b", 1, 1, 1.0, 1.0), ("c", 1, 1, 0.0, 2.0),
        ("a", 2, 1, 0.1, 9.0), ("b", 2, 1, 0.0, 9.0), ("c", 2, 1, None, 9.0), ("d", 2, 1, 0.5, 9.0),  # c goes, d comes
        ("a", 3, 1, 0.0, 9.0), ("b", 3, 1, 0.0, 9.0), ("c", 3, 1, 0.0, 9.0), ("d", 3, 1, 0.0, 9.0),
        ("a", 4, 2, 0.0, 1.0), ("c", 4, 2, 0.0, 1.0), ("d", 4, 2, 0.0, None),
    ]
    w = weights(spark, rows)
    assert [w[(1, c)] for c in "abc"] == pytest.approx([0.25, 0.25, 0.5])
    assert [w[(2, c)] for c in "abcd"] == pytest.approx([1 / 3, 2 / 3, 0, 0])  # 0.25 and 0.5 after the drift, scaled to one
    a, b = 1.1 / 3, 2 / 3
    assert [w[(3, c)] for c in "abcd"] == pytest.approx([a / (a + b), b / (a + b), 0, 0])
    assert [w[(4, c)] for c in "acd"] == pytest.approx([0.5, 0.5, 0])


def test_cash_below_the_least_and_equal_weights_after_it(spark):
    rows = [("a", 1, 1, 0.0, 3.0), ("b", 1, 1, 0.0, 1.0), ("a", 2, 1, 0.2, 3.0), ("b", 2, 1, None, 1.0), ("a", 3, 1, 0.0, 3.0), ("b", 3, 1, 0.0, 1.0)]
    w = weights(spark, rows)
    assert [w[k] for k in sorted(w)] == pytest.approx([0.75, 0.25, 0, 0, 0.5, 0.5])


def test_strategies_are_apart_and_an_empty_panel_is_empty(spark):
    frame = spark.createDataFrame([("x", "a", 1, 1, 0.0, 1.0), ("x", "b", 1, 1, 0.0, 1.0), ("y", "a", 1, 1, 0.0, 1.0)], "key string, " + ROW)
    got = {(r["key"], r["code"]): r["w"] for r in dynamic_weights(frame, "month", keys=("key",)).collect()}
    assert got == {("x", "a"): 0.5, ("x", "b"): 0.5, ("y", "a"): 0.0}
    assert dynamic_weights(frame.limit(0), "month", keys=("key",)).count() == 0
