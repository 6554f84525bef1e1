"""Subset sums, sign flips and stratified shuffles against plain loops with the same draws; admission under a cap against a plain book."""

import hashlib

import numpy as np
import pytest

from panelforge.operators import admission, extras, permutation, studies


def draw(trial, *parts):
    digest = hashlib.md5(":".join([*map(str, parts), str(trial // 4)]).encode()).hexdigest()
    return digest[8 * (trial % 4) : 8 * (trial % 4) + 8]


def rows_of(n=240, seed=1):
    rng = np.random.default_rng(seed)
    return [(f"k{k % 2}", "abc"[int(rng.integers(0, 3))], k, float(rng.normal()), bool(rng.random() < 0.3)) for k in range(n)]


def subset(rows, k, trial, seed):
    return sum(sorted(r[3:4][0] for r in sorted(rows, key=lambda r: (draw(trial, seed, r[0], r[2]), r[2]))[:k]))


@pytest.mark.parametrize(("sigmas", "held"), [(5.0, 4096), (5.0, 0), (0.0, 0)])
def test_subset_sums_hold_exactly_k_rows(spark, monkeypatch, sigmas, held):
    monkeypatch.setattr(permutation, "SIGMAS", sigmas)  # 0: most cuts miss, and the trials are drawn again
    monkeypatch.setattr(permutation, "GROUP_ROWS", held)  # 0: every group is dealt over the tasks
    rows, trials = rows_of(), 60
    pool = spark.createDataFrame([(a, i, v) for a, _, i, v, _ in rows], "key string, id long, v double")
    wanted = spark.createDataFrame([("k0", 17), ("k1", 1)], "key string, k long")
    got = {(r["key"], r["trial"]): r["total"] for r in permutation.subset_sums(pool, wanted, "v", "id", trials, 4, ("key",)).collect()}
    want = {(key, t): subset([r for r in rows if r[0] == key], k, t, 4) for key, k in (("k0", 17), ("k1", 1)) for t in range(trials)}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-9) for x in want)


def test_flips_share_the_signs_of_a_unit(spark):
    rows, trials = rows_of(50), 70
    frame = spark.createDataFrame([(a, i % 7, v) for a, _, i, v, _ in rows], "key string, unit long, v double")
    got = {(r["key"], r["trial"]): r["total"] for r in permutation.flip_sums(frame, "v", "unit", trials, 3, ("key",)).collect()}
    for key in ("k0", "k1"):
        for t in range(trials):
            bit = lambda u: int(hashlib.md5(f"3:{u}:{t // 52}".encode()).hexdigest()[:13], 16) >> (t % 52) & 1
            want = sum(-v if bit(i % 7) else v for a, _, i, v, _ in rows if a == key)
            assert got[(key, t)] == pytest.approx(want, abs=1e-9)


def plain_p(rows, trials, seed):
    v, f = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    if not f.any() or f.all():
        return None
    real = v[f].mean() - v[~f].mean()
    exceed = 0
    for t in range(trials):
        label = np.zeros(len(rows), bool)
        for s in {r[1] for r in rows}:
            own = [k for k, r in enumerate(rows) if r[1] == s]
            own.sort(key=lambda k: (draw(t, seed, rows[k][0], rows[k][1], rows[k][2]), rows[k][2]))
            label[own[: sum(rows[k][4] for k in own)]] = True
        exceed += abs(v[label].mean() - v[~label].mean()) >= abs(real) - 1e-12
    return (exceed + 1) / (trials + 1)


def test_stratified_p_against_plain_shuffles(spark):
    rows = rows_of()
    rows += [("k0", "none", 900 + k, 1.0, False) for k in range(4)] + [("k0", "all", 950 + k, -1.0, True) for k in range(3)]
    rows += [("one", "a", 1000 + k, float(k), True) for k in range(3)] + [("fixed", "ab"[k % 2], 1100 + k, float(k), k % 2 == 0) for k in range(6)]
    frame = spark.createDataFrame([*rows, ("k0", "a", 2000, None, True), ("k1", "a", 2001, 1.0, None)], "key string, s string, id long, v double, f boolean")
    got = {r["key"]: r for r in permutation.stratified_p(frame, "v", "f", "s", "id", 99, 7, ("key",)).collect()}
    for key in ("k0", "k1", "fixed"):
        own = [r for r in rows if r[0] == key]
        assert got[key]["p"] == pytest.approx(plain_p(own, 99, 7))
        assert got[key]["n_in"] == sum(r[4] for r in own)
    assert got["fixed"]["p"] == 1.0 and got["one"]["p"] is None
    assert permutation.stratified_p(frame.limit(0), "v", "f", "s", "id", 9, 7, ("key",)).count() == 0


def test_event_study_of_the_whole_pool(spark):
    pool = spark.createDataFrame([("a", f"2020-01-{k + 1:02d}", float(k)) for k in range(20)], "code string, trade_date string, fwd double")
    out = studies.event_study(pool.where("fwd > 17"), pool, 200).first()
    assert out["n"] == 2 and out["p"] < 0.05
    assert studies.event_study(pool, pool, 20).first()["p"] == 1.0


def test_skip_admits_what_still_fits(spark):
    rows = [("a", 0.7, 3.0), ("b", 0.5, 2.0), ("c", 0.2, 1.0)]
    frame = spark.createDataFrame([(1, c, w, s) for c, w, s in rows], "trade_date int, code string, w double, score double")
    kept = {r["code"]: r["w"] for r in extras.over_cap(frame, "skip").collect()}
    assert kept == {"a": 0.7, "b": 0.0, "c": 0.2}


ROW = "policy string, trade_date int, code string, active boolean, target double, price double, score double"


def by_date(spark, rows, **more):
    frame = spark.createDataFrame(rows, ROW)
    out = admission.admitted(frame, ("policy",), **more).collect()
    return {(r["policy"], r["trade_date"], r["code"]): (round(r["weight"], 9), r["event"]) for r in out}, admission.admitted(frame, ("policy",), **more)


def test_admission_of_entries_over_the_cap(spark):
    day1 = [("a", True, 0.7, 10.0, 3.0), ("b", True, 0.5, 10.0, 2.0), ("c", True, 0.2, 10.0, 1.0), ("d", False, 0.9, 10.0, 9.0)]
    rows = [(p, 1, *r) for p in admission.POLICIES for r in day1]
    got, frame = by_date(spark, rows, most=1.3)
    assert [got[("skip", 1, c)] for c in "abcd"] == [(0.7, "enter"), (0.0, "skip"), (0.2, "enter"), (0.0, None)]
    assert got[("replace", 1, "a")] == (0.0, "enter+replaced") and got[("replace", 1, "b")] == (0.5, "enter_replace+evicts") and got[("replace", 1, "c")] == (0.2, "enter")
    assert sum(got[("scale", 1, c)][0] for c in "abc") == pytest.approx(1.0)
    assert sum(got[("leverage", 1, c)][0] for c in "abc") == pytest.approx(1.3)
    counts = {r["policy"]: tuple(r)[1:] for r in admission.admission_summary(frame, ("policy",)).collect()}
    assert counts["skip"] == (2, 1, 0, 0, pytest.approx(0.9)) and counts["replace"] == (3, 0, 1, 1, pytest.approx(0.7))
    assert counts["leverage"] == (3, 0, 0, 2, pytest.approx(1.3)) and counts["scale"] == (3, 0, 0, 2, pytest.approx(1.0))


def test_admission_carries_positions(spark):
    rows = [
        ("replace", 1, "a", True, 0.5, 10.0, 2.0), ("replace", 1, "b", True, 0.5, 10.0, 1.0),
        ("replace", 2, "a", True, 0.5, 9.0, 2.0), ("replace", 2, "b", True, 0.5, 11.0, 1.0), ("replace", 2, "c", True, 0.5, 5.0, 0.0),
        ("replace", 3, "b", False, 0.5, 11.0, 1.0),
        ("replace", 4, "d", True, 0.4, 1.0, 1.0), ("replace", 4, "c", True, 0.5, 1.0, 1.0),
    ]
    got, _ = by_date(spark, rows)
    assert got[("replace", 2, "a")] == (0.0, "replaced") and got[("replace", 2, "c")] == (0.5, "enter_replace+evicts")  # a has lost most
    assert got[("replace", 3, "b")] == (0.0, "exit")
    assert got[("replace", 4, "c")] == (0.5, None) and got[("replace", 4, "d")] == (0.4, "enter")  # c had no row on day 3 and stayed


def test_dated_scan_over_many_batches(spark):
    """Dates cut by Arrow batches reach the step whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [("skip", d, f"c{k}", True, 0.01, 1.0, float(k)) for d in range(5) for k in range(7)]
        got, _ = by_date(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 35 and all(w == 0.01 for w, _ in got.values()) and sum(e == "enter" for _, e in got.values()) == 7
