"""Folds of any length against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from fidelis.operators import folds


def loop(xs, keep, start=0.0):
    z, out = start, []
    for x in xs:
        z = keep * z + (1 - keep) * (x or 0.0)
        out.append(z)
    return out


@pytest.mark.parametrize("keep", [0.6, 0.05, 0.98, 0.9997])
def test_long_histories(spark, keep):
    rng = random.Random(7)
    lengths = {1: 10_000, 2: 1, 3: 449, 4: 450, 5: 451, 6: 2000}
    xs = {u: [rng.choice([None, 0.0, 1.0, -1.0, rng.random()]) for _ in range(n)] for u, n in lengths.items()}
    xs[6] = [1.0] + [0.0] * 1999
    rows = [(u, t, x) for u, v in xs.items() for t, x in enumerate(v)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([*rows, (None, 0, 5.0)], "u long, t long, x double").repartition(7)
    got = folds.affine_fold(df, "u", "t", {"z": "x", "y": F.col("x") * 2}, keep, start=0.25).collect()
    assert len(got) == len(rows)
    want = {u: loop(v, keep, 0.25) for u, v in xs.items()}
    for r in got:
        assert r["z"] == pytest.approx(want[r["u"]][r["t"]], rel=1e-9, abs=1e-13)
    twice = {u: loop([2 * (x or 0) for x in v], keep, 0.25) for u, v in xs.items()}
    assert all(r["y"] == pytest.approx(twice[r["u"]][r["t"]], rel=1e-9, abs=1e-13) for r in got)


def test_nothing_is_cut_off(spark):
    """One answer long ago is felt as far as doubles go."""
    df = spark.range(1300).select(F.lit(1).alias("u"), F.col("id").alias("t"), (F.col("id") == 0).cast("double").alias("x"))
    got = {r["t"]: r["z"] for r in folds.affine_fold(df, "u", "t", {"z": "x"}).collect()}
    want = loop([1.0] + [0.0] * 1299, 0.6)
    assert all(got[t] == pytest.approx(want[t], rel=1e-9, abs=0) for t in (0, 1, 449, 450, 451, 899, 900, 1299)) and want[1299] > 0
    with pytest.raises(ValueError):
        folds.affine_fold(df, "u", "t", {"z": "x"}, keep=1.0)
    assert folds.affine_fold(df.filter("false"), "u", "t", {"z": "x"}).collect() == []


def test_a_history_lies_in_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).select(F.lit("one").alias("u"), F.col("id").alias("t"), F.rand(1).alias("x"))
        z = folds.affine_fold(df, "u", "t", {"z": "x"})
        sizes = [r["n"] for r in z.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert len(sizes) > 4 and max(sizes) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_places(spark):
    rng = random.Random(3)
    rows = [(u, x) for u, n in ((None, 30), ("a", 5000), ("b", 1), ("c", 700)) for x in rng.sample(range(100_000), n)]
    got = folds.places(spark.createDataFrame(rows, "u string, x long").repartition(5), "u", ["x"]).collect()
    want = {u: {x: i for i, x in enumerate(sorted(x for v, x in rows if v == u))} for u in {r[0] for r in rows}}
    assert len(got) == len(rows) and all(want[r["u"]][r["x"]] == r["t"] for r in got)


def test_notes(spark):
    rows = [(0.51, 0.5, 0.9, 0.4), (0.5, 0.6, 0.0, 0.41), (0.0, 0.0, 0.0, -0.41), (0.0, 0.0, 0.0, -0.4)]
    note = folds.state_note({"time_pressure": "a", "post_loss": "b", "fatigue": "c", "momentum": "m"})
    got = [r["n"] for r in spark.createDataFrame(rows, "a double, b double, c double, m double").coalesce(1).select(note.alias("n")).collect()]
    assert got == [
        "Current player state: under time pressure (rushing, more errors likely); deep into the session (fatigued, slower decline).",
        "Current player state: just lost (may be tilted / over-aggressive); on a winning streak (confident).",
        "Current player state: on a losing streak (shaken).",
        "Current player state: composed, near baseline form.",
    ]
