"""Digests of ordered rows, keys that must agree, the trial table."""

import hashlib
import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from fidelis.operators import contracts


def by_hand(rows):
    sums = [0] * 4
    for i, row in enumerate(rows):
        name = "".join("-" if v is None else f"{len(str(v))}:{v}" for v in row)
        h = hashlib.sha256(f"{i}|{name}".encode()).hexdigest()
        for j in range(4):
            sums[j] += int(h[15 * j : 15 * j + 15], 16)
    return hashlib.sha256("|".join(map(str, [len(rows), *sums])).encode()).hexdigest()


def digests(df, **kw):
    return {r["g"]: (r["n_rows"], r["digest"]) for r in contracts.row_digests(df, "g", ["k"], ["k", "x"], **kw).collect()}


def test_digest(spark):
    rng = random.Random(5)
    rows = [(g, k, rng.choice([None, "", "a", "1:a", "ä"])) for g, n in (("a", 3000), ("b", 1), (None, 20)) for k in rng.sample(range(10_000), n)]
    df = spark.createDataFrame(rows, "g string, k long, x string")
    got = digests(df.repartition(6))
    for g in ("a", "b", None):
        mine = sorted((k, x) for v, k, x in rows if v == g)
        assert got[g] == (len(mine), by_hand(mine))
    assert digests(df.repartition(2).orderBy("x")) == got
    with_place = df.filter("g = 'a'").selectExpr("*", "row_number() OVER (ORDER BY k) - 1 AS p")
    assert digests(with_place, at="p")["a"] == got["a"]


def test_digest_tells_order_and_values(spark):
    one = [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z")]
    schema = "g string, k long, x string"
    base = digests(spark.createDataFrame(one, schema))["a"]
    for other in ([("a", 1, "y"), ("a", 2, "x"), ("a", 3, "z")], one[:2], [*one, ("a", 4, None)], [("a", 1, "x"), ("a", 2, "y"), ("a", 4, "z")], [("a", 1, "x"), ("a", 2, None), ("a", 3, "z")]):
        assert digests(spark.createDataFrame(other, schema))["a"] != base
    pairs = spark.createDataFrame([(1, "a", "b1:c"), (2, "ab", "1:c"), (3, None, "-"), (4, "-", None)], "k int, x string, y string")
    assert pairs.select(contracts.row_name(["x", "y"]).alias("n")).distinct().count() == 4


def test_unique_and_covering(spark):
    left = spark.createDataFrame([(1, "a", "l1"), (2, None, "l2"), (3, "c", "l3")], "k int, j string, lv string")
    right = spark.createDataFrame([(1, "a", "r1"), (2, None, "r2"), (3, "c", "r3")], "k int, j string, rv string")
    assert sorted(tuple(r) for r in contracts.covering(left, right, ["k", "j"]).collect()) == [(1, "a", "l1", "r1"), (2, None, "l2", "r2"), (3, "c", "l3", "r3")]
    with pytest.raises(PySparkException, match="right side alone"):
        contracts.covering(left.filter("k < 3"), right, ["k", "j"]).collect()
    with pytest.raises(PySparkException, match="left side alone"):
        contracts.covering(left, right.filter("k > 1"), ["k", "j"]).collect()
    seen = Observation("keys")
    loose = contracts.covering(left.filter("k < 3"), right.filter("k > 1"), ["k", "j"], seen, strict=False).collect()
    assert [r["lv"] for r in loose] == ["l2"] and seen.get == {"both": 1, "left_only": 1, "right_only": 1}
    assert contracts.unique(left, ["k", "j"]).columns == left.columns and contracts.unique(left, ["k", "j"]).count() == 3
    assert sorted(r["lv"] for r in contracts.unique(left, ["k"]).collect()) == ["l1", "l2", "l3"]
    with pytest.raises(PySparkException, match="repeated key"):
        contracts.unique(left.unionByName(left.filter("k = 2")), ["k", "j"]).collect()


def scores(spark, rows):
    return spark.createDataFrame(rows, "sim string, user string, t int, arm string, nll double")


def test_trial_table(spark):
    rng = random.Random(9)
    rows = [(s, f"u{u}", t, a, rng.random() + (0.3 if a == "A0" else 0.0)) for s in ("p|q", "r") for u in range(30) for t in range(1 + u % 4) for a in ("A0", "A3", "A4", "A1")]
    got = {r["sim"]: r for r in contracts.trial_table(scores(spark, rows).repartition(5), "sim", "user", ["t"], "arm", "nll", "p|q", n_resamples=2000).collect()}
    mean = lambda v: sum(v) / len(v)
    for s in ("p|q", "r"):
        per = [mean([x for q, v, _, a, x in rows if (q, v, a) == (s, f"u{u}", "A4")]) - mean([x for q, v, _, a, x in rows if (q, v, a) == (s, f"u{u}", "A0")]) for u in range(30)]
        r = got[s]
        assert r["n_users"] == 30 and r["n_rows"] == sum(1 + u % 4 for u in range(30)) and r["d_total"] == pytest.approx(mean(per))
        se = math.sqrt(sum((x - mean(per)) ** 2 for x in per)) / 30
        assert r["d_total_low"] == pytest.approx(mean(per) - 1.96 * se, abs=0.35 * se) and r["d_indiv_low"] < r["d_indiv"] < r["d_indiv_high"]
    keys = sorted((f"u{u}", t) for u in range(30) for t in range(1 + u % 4))
    assert got["r"]["row_digest"] == got["p|q"]["row_digest"] == by_hand(keys)


@pytest.mark.parametrize("change", ["row lost", "row moved", "arm lost", "row added"])
def test_trial_table_refuses(spark, change):
    rows = [(s, f"u{u}", t, a, 1.0) for s in ("p", "r") for u in range(5) for t in range(3) for a in ("A0", "A3", "A4")]
    broken = {
        "row lost": lambda: rows[:-1],
        "row moved": lambda: [(s, u, 7 if (s, u, t) == ("r", "u2", 1) else t, a, x) for s, u, t, a, x in rows],
        "arm lost": lambda: [r for r in rows if r[0] == "p" or r[3] != "A3"],
        "row added": lambda: [*rows, *[("r", "u9", 0, a, 1.0) for a in ("A0", "A3", "A4")]],
    }[change]()
    with pytest.raises(PySparkException, match="r: scored rows differ"):
        contracts.trial_table(scores(spark, broken), "sim", "user", ["t"], "arm", "nll", "p", intervals=False).collect()
    assert contracts.trial_table(scores(spark, rows), "sim", "user", ["t"], "arm", "nll", "p", intervals=False).filter(F.col("n_rows") == 15).count() == 2
