"""Cohorts, samples, clocks, and resampling against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fidelis.functions.scalars import duration, in_trouble, scramble
from fidelis.operators import cohorts, inference, sessions
from fidelis.operators.simulators import fit_irt
from fidelis.sources import sinks


def test_cohorts(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "p string, v int"), spark.createDataFrame([("y",), ("z",), (None,)], "p string")
    rows = cohorts.united([("one", a), ("two", b)])
    assert {(r["cohort"], r["p"]) for r in cohorts.earliest_cohort(rows, "p").collect()} == {("one", "x"), ("one", "y"), ("two", "z")}
    assert {(r["cohort"], r["users"], r["kept"]) for r in cohorts.dropped(rows.dropna(subset=["p"]), "p").collect()} == {("one", 2, 2), ("two", 2, 1)}


def test_labels_and_picks(spark):
    df = spark.createDataFrame([("g", "b", 1.0, 5.0), ("g", "a", 1.0, 7.0), ("g", "c", 2.0, 9.0)], "g string, k string, s double, v double")
    assert [tuple(r) for r in cohorts.top_pick(df, ["g"], "k", "s", "v").collect()] == [("g", "a", 2)]
    assert [r[0] for r in df.orderBy("k").select(cohorts.label_order("k", ["c", "b", "a"])).collect()] == [2, 1, 0]
    with pytest.raises(PySparkException):
        df.select(cohorts.label_order("k", ["a", "b"])).collect()


def test_clocks(spark):
    df = spark.createDataFrame([([1.5, None, 2.0], [60.0, 10.0]), ([], [11.0, None]), (None, None)], "spent array<double>, clocks array<double>")
    assert [tuple(r) for r in df.select(duration("spent"), scramble("clocks"), in_trouble(F.get("clocks", F.lit(1)))).collect()] == [(3.5, True, True), (0.0, False, False), (0.0, False, False)]


def test_samples(spark, tmp_path):
    df = spark.createDataFrame([("r", "A3", 0, "x"), ("r", "A3", 1, "y")], "row string, arm string, k int, text string")
    sinks.write_samples(df, str(tmp_path / "s"), ["row", "arm", "k"])
    assert list((tmp_path / "s").glob("*.json.gz")) and {tuple(r) for r in spark.read.json(str(tmp_path / "s")).select("row", "arm", "k", "text").collect()} == {tuple(r) for r in df.collect()}
    with pytest.raises(ValueError, match="repeated"):
        sinks.write_samples(df.union(df), str(tmp_path / "t"), ["row", "arm", "k"])
    assert not (tmp_path / "t").exists()


def test_resampling_in_buckets(spark):
    """Buckets of 16 values give the spread of the plain bootstrap; results don't depend on the number of partitions; repeated values, nulls and empty groups hold."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0.3, 1, 90), np.full(45, 2.0)])
    rows = [("a", float(v)) for v in x] + [("a", None), (None, 1.0), (None, 3.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in inference.bootstrap_ci(df, ["g"], "v", n_resamples=4000, per_task=16).collect()}
    again = {r["g"]: r for r in inference.bootstrap_ci(df.repartition(5), ["g"], "v", n_resamples=4000, per_task=16).collect()}
    plain = np.percentile(x[rng.integers(0, len(x), (4000, len(x)))].mean(1), [2.5, 97.5])
    assert got["a"]["n_units"] == 135 and got["a"]["point"] == pytest.approx(x.mean())
    assert [got["a"]["low"], got["a"]["high"]] == pytest.approx(list(plain), abs=0.03)
    assert (got[None]["n_units"], got[None]["point"], got["b"]["n_units"], got["b"]["low"]) == (2, 2.0, 0, None)
    assert all(got[g]["low"] == pytest.approx(again[g]["low"]) for g in ("a", None))
    p = {r["g"]: r["p_flip"] for r in inference.signflip_p(df, ["g"], "v", n_flips=4000, per_task=16).collect()}
    flips = np.abs(((rng.integers(0, 2, (4000, len(x))) * 2 - 1) * x).mean(1)) >= abs(x.mean())
    assert p["a"] == pytest.approx((1 + flips.sum()) / 4001, abs=0.01) and p[None] == pytest.approx(0.5, abs=0.05) and math.isnan(p["b"])


def test_ratio_and_hierarchy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(2, 1, 200), rng.normal(4, 1, 200)
    r = inference.ratio_ci(spark.createDataFrame([("g", float(x), float(y)) for x, y in zip(a, b, strict=True)], "g string, a double, b double"), ["g"], "a", "b", per_task=32).first()
    at = rng.integers(0, 200, (2000, 200))
    assert r["point"] == pytest.approx(a.mean() / b.mean()) and [r["low"], r["high"]] == pytest.approx(list(np.percentile(a[at].mean(1) / b[at].mean(1), [2.5, 97.5])), abs=0.02)
    m = rng.normal(1, 1, (60, 1)) + np.array([[0.0, 0.5, -0.2]]) + rng.normal(0, 0.1, (60, 3))
    df = spark.createDataFrame([("g", u, s, float(m[u, s])) for u in range(60) for s in range(3)], "g string, u int, s int, v double")
    h = inference.hierarchical_ci(df, ["g"], "u", "s", "v").first()
    both = [m[np.ix_(rng.integers(0, 60, 60), rng.integers(0, 3, 3))].mean() for _ in range(2000)]
    loso = [np.delete(m, j, 1).mean() for j in range(3)]
    assert h["point"] == pytest.approx(m.mean()) and [h["low"], h["high"]] == pytest.approx(list(np.percentile(both, [2.5, 97.5])), abs=0.1)
    assert h["loso_range"] == pytest.approx(max(loso) - min(loso)) and h["width_ratio"] > 1


def test_irt(spark):
    """Equal to alternating Newton steps in numpy, and difficulties in the order they were made in."""
    rng = np.random.default_rng(2)
    theta, b = rng.normal(0, 1, 40), np.array([-1.0, 0.0, 1.5])
    y = (rng.random((40, 3, 6)) < 1 / (1 + np.exp(b[None, :, None] - theta[:, None, None]))).astype(int)
    df = spark.createDataFrame([(u, i, int(v)) for u in range(40) for i in range(3) for v in y[u, i]], "u int, i int, y int")
    t, d, c = np.zeros(40), np.zeros(3), y.sum(2)
    for _ in range(4):
        p = 1 / (1 + np.exp(d[None] - t[:, None]))
        t = t + ((c - 6 * p).sum(1) - 1e-4 * t) / ((6 * p * (1 - p)).sum(1) + 1e-4)
        p = 1 / (1 + np.exp(d[None] - t[:, None]))
        d = d - ((c - 6 * p).sum(0) + 1e-4 * d) / ((6 * p * (1 - p)).sum(0) + 1e-4)
    got = {r["i"]: r["b"] for r in fit_irt(df, "u", "i", "y", rounds=4)[1].collect()}
    assert [got[i] for i in range(3)] == pytest.approx(list(d)) and got[0] < got[1] < got[2]


def test_tertiles_over_ranges(spark):
    rows = [(i, float(i % 7)) for i in range(101)]
    got = {r["u"]: r["c"] for r in sessions.with_tertile(spark.createDataFrame(rows, "u int, x double").repartition(6), ["x", "u"], "c").collect()}
    want = {u: min(2, at * 3 // 101) for at, (x, u) in enumerate(sorted((x, u) for u, x in rows))}
    assert got == want


def test_pooled_memory(spark):
    """The memory of a pooled stream, step by step in plain Python."""
    import hashlib
    import math

    from fidelis.operators import cohorts

    rows = [(c, u, t, 4 + u, float((u * 7 + t * 3) % 2), 0.1 * (u + 1)) for c in (0, 1) for u in range(5) if u % 2 == c for t in range(9)]
    df = spark.createDataFrame(rows, "cell long, u long, t long, k long, y double, d double")
    got = {(r["cell"], r["t"]): r for r in cohorts.pooled_memory(df, "cell", "u", "t", "k", "y", "d").collect()}
    for c in (0, 1):
        n, total, ewma, last, recent = 0, 0.0, 0.5, 0.0, []
        horizon = max(k for cell, _, _, k, _, _ in rows if cell == c)
        for t in range(horizon):
            r = got.pop((c, t))
            assert (r["f_volume"], r["f_mean"], r["f_ewma"], r["f_lag"], r["f_last10"]) == pytest.approx((math.log1p(n) / 6, total / n if n else 0.5, ewma if n else 0.5, last, sum(recent) / len(recent) if recent else 0.5))
            pool = [(hashlib.md5(f"0|{t}|{u}".encode()).hexdigest(), u, y) for cell, u, s, k, y, _ in rows if cell == c and s == t and t < k]
            y = min(pool)[2]
            n, total, ewma, last, recent = n + 1, total + y, y if n == 0 else 0.9 * ewma + 0.1 * y, y, [*recent[-9:], y]
    assert not got
