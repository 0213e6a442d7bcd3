"""Verdict operators against plain Python and NumPy intervals."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException

from fidelis.operators import verdicts


def near_interval(row, values, low="low", high="high", slack=0.35):
    x = np.array(values)
    se = x.std() / math.sqrt(len(x))
    assert row[low] == pytest.approx(x.mean() - 1.96 * se, abs=slack * se + 1e-12) and row[high] == pytest.approx(x.mean() + 1.96 * se, abs=slack * se + 1e-12)


ITEMS = "persona long, item long, arm string, predicted string, correct_answer string"


def test_screen(spark):
    rng = random.Random(1)
    rows = [(p, i, "A0", rng.choice(["(a)", "(b)", "(c)", None] if p == 0 else ["(a)", "(b)", "(c)"]), "(a)") for p in range(30) for i in range(8)]
    df = spark.createDataFrame(rows, ITEMS)
    wrong = [(p, i) for p, i, _, g, c in rows if g is not None and g != c]
    assert sorted((r["persona"], r["item"]) for r in verdicts.survivors(df, "persona").collect()) == wrong
    g = verdicts.screen_gates(df, "persona").first()
    per = defaultdict(int)
    for p, _ in wrong:
        per[p] += 1
    assert (g["n_items"], g["n_survivors"], g["n_persons"]) == (240, len(wrong), sum(n >= 3 for n in per.values()))
    assert g["valid_rate"] == pytest.approx(sum(r[3] is not None for r in rows) / 240) and g["go"]
    assert not verdicts.screen_gates(df.filter("persona < 5"), "persona").first()["go"]
    none = verdicts.screen_gates(df.filter("false"), "persona").first()
    assert (none["n_items"], none["n_survivors"], none["go"], none["valid_rate"]) == (0, 0, False, None)


@pytest.mark.parametrize("lost", [0.0, 0.1])
def test_known_signal(spark, lost):
    rng = random.Random(2)
    rows = []
    for p in range(60):
        for i in range(6):
            rows.append((p, i, "A3", "x" if rng.random() < 0.3 else "y", "x"))
            rows.append((p, i, "A4", None if rng.random() < lost else "x" if rng.random() < 0.7 else "y", "x"))
    rows += [(99, 0, "A3", "x", "x"), (98, 0, "A4", None, "x"), (1, 9, "A0", None, "x")]
    r = verdicts.known_signal(spark.createDataFrame(rows, ITEMS), "persona", n_resamples=3000).first()
    acc = {a: {} for a in ("A3", "A4")}
    for a in acc:
        for p in {x[0] for x in rows}:
            v = [g == c for q, _, b, g, c in rows if q == p and b == a and g is not None]
            if v:
                acc[a][p] = sum(v) / len(v)
    both = sorted(set(acc["A3"]) & set(acc["A4"]))
    d = [acc["A4"][p] - acc["A3"][p] for p in both]
    assert r["n_persons"] == len(both) == 60 and r["effect"] == pytest.approx(np.mean(d))
    near_interval(r, d)
    for a in ("A3", "A4"):
        mine = [x for x in rows if x[2] == a]
        assert r[f"valid_{a.lower()}"] == pytest.approx(sum(x[3] is not None for x in mine) / len(mine)) and r[f"accuracy_{a.lower()}"] == pytest.approx(np.mean(list(acc[a].values())))
    assert r["positive"] and r["valid_parsing"] == (lost == 0.0)


def test_matchers(spark):
    rng = np.random.default_rng(3)
    means = {("c1", "registered"): -1.0, ("c1", "nearest"): -0.5, ("c1", "hardest"): 0.8, ("c2", "registered"): 0.0}
    data = {k: (m + rng.normal(size=80)).tolist() for k, m in means.items()}
    rows = [(c, m, float(v)) for (c, m), vs in data.items() for v in vs] + [("c2", "nearest", None), ("c1", "nearest", None)]
    df = spark.createDataFrame(rows, "combo string, matcher string, v double")
    each = {(r["combo"], r["matcher"]): r for r in verdicts.matcher_intervals(df, "combo", "matcher", "v", 3000).collect()}
    assert each.keys() == means.keys()
    for k, r in each.items():
        assert r["n"] == 80
        near_interval(r, data[k])
    got = {r["combo"]: (r["matchers_reported"], r["k_of_matchers"]) for r in verdicts.matcher_hierarchy(df, "combo", "matcher", "v", 3000).collect()}
    assert got == {"c1": (3, 2), "c2": (1, int(each["c2", "registered"]["high"] < 0))}


def test_residuals(spark):
    rng = np.random.default_rng(4)
    rows, base = [], []
    for combo, gain in (("sure", -0.5), ("open", 0.0)):
        for u in range(90):
            a3 = float(rng.normal() + 2)
            a4 = float(a3 + gain + rng.normal() * 0.4)
            rows.append((combo, f"u{u}", a3, a4, float(a4 + 0.1 + rng.normal() * 0.05)))
            if u % 3:
                base.append((combo, f"u{u}", float(rng.normal() * 0.1 - 0.2)))
    base.append(("sure", "stranger", 9.0))
    arms = spark.createDataFrame(rows, "combo string, user string, a3 double, a4 double, a4f double")
    marginal = spark.createDataFrame(base, "combo string, user string, marginal double")
    for timing in (False, True):
        got = {r["combo"]: r for r in verdicts.residuals(arms, marginal, "combo", "user", timing, 3000).collect()}
        for combo in ("sure", "open"):
            mine = {u: (a3, a4, f) for c, u, a3, a4, f in rows if c == combo}
            m = {u: x for c, u, x in base if c == combo and u in mine}
            r = got[combo]
            assert r["n_common"] == 60 and r["marginal"] == pytest.approx(np.mean(list(m.values())))
            drift = np.mean([f - a4 for _, a4, f in mine.values()])
            assert r["drift"] == pytest.approx(drift) and r["individual"] == pytest.approx(np.mean([f - a3 for a3, _, f in mine.values()]))
            near_interval(r, [f - a3 for a3, _, f in mine.values()])
            if timing:
                live = np.mean([mine[u][1] - mine[u][0] - m[u] for u in m])
                assert r["residual_live"] == pytest.approx(live) and r["residual"] == pytest.approx(live + drift)
            else:
                assert r["residual_live"] is None and r["residual"] == pytest.approx(np.mean([mine[u][2] - mine[u][0] - m[u] for u in m]))
        assert not got["sure"]["nd"] and got["open"]["nd"] == (got["open"]["low"] <= 0 <= got["open"]["high"])
    cells = spark.createDataFrame([(0.1, False, True), (-0.1, False, True), (-0.2, True, False), (0.0, False, False)], "residual double, nd boolean, holm boolean")
    s = verdicts.residual_summary(cells, "holm").first()
    assert tuple(s) == (4, 3, 2, 1, 2, 1)


def test_shift_status(spark):
    rng = np.random.default_rng(6)
    old, new = rng.normal(size=100) - 1, rng.normal(size=100) + 1
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in zip(old, new)] + [("a", None, 1.0)] + [("b", float(x) + 1, float(x) + 1) for x in old], "g string, o double, n double")
    got = {r["g"]: r for r in verdicts.shift_status(df, ["g"], "o", "n", 2000).collect()}
    a = got["a"]
    assert a["n"] == 100 and (a["old_status"], a["new_status"], a["changed"]) == ("favourable", "adverse", True) and a["shift"] == pytest.approx((new - old).mean())
    near_interval(a, new - old, "shift_low", "shift_high")
    assert got["b"]["shift_low"] == got["b"]["shift_high"] == 0 and not got["b"]["changed"]


def test_content(spark):
    rng = random.Random(5)
    rows = [(s, u, t, a, rng.random()) for s in ("p", "q") for u in range(6) for t in range(3) for a in ("A3", "A4") for _ in range(8)]
    df = spark.createDataFrame(rows, "sim string, user_id long, turn int, arm string, similarity double")
    c = verdicts.content_rows(df, ["sim", "user_id", "turn"], "arm", "similarity")
    want = defaultdict(list)
    for s, u, t, a, x in rows:
        want[s, u, t, a].append(1 - x)
    for r in c.collect():
        for a in ("A3", "A4"):
            v = want[r["sim"], r["user_id"], r["turn"], a]
            assert r[f"D_{a}"] == pytest.approx(sum(v) / 8) and r[f"best_{a}"] == pytest.approx(min(v))
    got = {(r["sim"], r["contrast"]): r for r in verdicts.content_readout(c, n_resamples=500).collect()}
    points = {(r["sim"], r["contrast"]): r["point"] for r in verdicts.content_readout(c, intervals=False).collect()}
    mean = lambda v: sum(v) / len(v)
    for s in ("p", "q"):
        per = [mean([mean(want[s, u, t, "A4"]) - mean(want[s, u, t, "A3"]) for t in range(3)]) for u in range(6)]
        best = [mean([min(want[s, u, t, "A4"]) - min(want[s, u, t, "A3"]) for t in range(3)]) for u in range(6)]
        afc = [mean([float(mean(want[s, u, t, "A4"]) < mean(want[s, u, t, "A3"])) for t in range(3)]) for u in range(6)]
        for name, v in (("delta", per), ("best", best), ("afc", afc)):
            assert got[s, name]["point"] == pytest.approx(mean(v)) == pytest.approx(points[s, name]) and got[s, name]["n_units"] == 6
    with pytest.raises(PySparkException, match="a set of 7 samples"):
        verdicts.content_rows(spark.createDataFrame(rows[:-1], df.schema), ["sim", "user_id", "turn"], "arm", "similarity").collect()
