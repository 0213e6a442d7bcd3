"""Readouts, coverage, shopping features, sinks and the command line."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fidelis import cli
from fidelis.operators import coverage, readouts, shopping
from fidelis.sources import sinks


def test_persona(spark):
    survey = {
        "Demographic Information": {"Age": "25-34 years old", "Gender": "Female"},
        "Shopping Preference": {"Online shopping frequency": "Several times a week", "Monthly online shopping spend $": "1000", "Amazon Prime membership": "Yes", "To what extent do you agree with the following statements": {"I research products": "Strongly agree with it", "Holiday sales": "neutral"}},
        "Personality": {"Big Five Scores": {"Openness": "very high", "Conscientiousness": "Low", "Emotional stability": "high"}},
    }
    df = spark.createDataFrame([(json.dumps(survey),), ("nonsense",), (None,)], "s string")
    rows = [r["p"] for r in df.select(shopping.persona("s").alias("p")).collect()]
    assert list(rows[0]) == pytest.approx([29.5 / 80, 1, 0.9, 0.25, 0.5, 0.5, 0.25, 0.75, 1.0, 1.0, 0.8, 0.5, 0.5])
    assert list(rows[1]) == list(rows[2]) == pytest.approx([0.5, 0, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.2, 0, 0.5, 0.5, 0.5])


def test_judgements(spark):
    nested = {"match": dict.fromkeys(readouts.DIMENSIONS, True) | {"pacing": False}, "alignment": 0.4}
    flat = dict.fromkeys(readouts.DIMENSIONS, False) | {"alignment_score": 0.05}
    body = lambda kind, x: json.dumps({"output": [{"type": "reasoning"}, {"type": "message", "content": [{"type": kind, "text" if kind == "output_text" else "refusal": x}]}]})
    df = spark.createDataFrame([("m::A3::k1", body("output_text", json.dumps(nested))), ("m::A4::k1", body("output_text", json.dumps(flat))), ("m::A4::k2", body("refusal", "no")), ("m::A3::k2", "{}")], "custom_id string, body string")
    rows = {(r["arm"], r["key"]): r for r in readouts.judgements(df).collect()}
    assert (rows["A3", "k1"]["fidelity_index"], rows["A3", "k1"]["alignment"], rows["A3", "k1"]["normalised"]) == (0.8, 0.4, False)
    assert (rows["A4", "k1"]["fidelity_index"], rows["A4", "k1"]["alignment"], rows["A4", "k1"]["normalised"]) == (0.0, 0.05, True)
    assert rows["A4", "k2"]["error"] == "refusal: no" and rows["A3", "k2"]["error"] == "no output"
    expected = df.select(*[F.split_part("custom_id", F.lit("::"), F.lit(i + 1)).alias(c) for i, c in enumerate(("candidate", "arm", "key"))])
    assert readouts.missing_judgements(expected, readouts.judgements(df)).count() == 2


def test_arms_and_pairs(spark):
    rows = [("c", arm, seed, p, 0, v) for (arm, v), seed, p in itertools.product((("A3", 1.0), ("A4", 0.5)), (0, 1), "abc")]
    s = spark.createDataFrame(rows, "combo string, arm string, seed int, player string, row int, nll double")
    assert readouts.user_arms(readouts.seed_means(s, ["combo", "arm", "player", "row"]), ["A3", "A4"]).count() == 3
    rng = np.random.default_rng(1)
    users = spark.createDataFrame([(f"s{k}", u, float(k + rng.normal(0, 0.3))) for k in range(6) for u in range(30)], "sim string, user_id int, delta double")
    order = spark.createDataFrame([(f"s{k}", float(k)) for k in range(6)], "sim string, score double")
    pairs = readouts.pair_readout(users, order, n_resamples=300)
    assert pairs.count() == 15 and readouts.classify(pairs).first()["verdict"] == "support"
    assert readouts.classify(readouts.pair_readout(users, order.withColumn("score", -F.col("score")), n_resamples=300)).first()["verdict"] == "refute"
    ci = spark.createDataFrame([("x", -1.0, -2.0, -0.5)], "dataset string, point double, low double, high double")
    assert readouts.report_intervals(ci).first()[1:] == (1.0, 0.5, 2.0)
    assert {(r["dataset"], r["favourable"]) for r in readouts.gains_table(ci).collect()} == {("x", 1), ("all", 1)}


def test_pooled_gains(spark):
    rows = [(u, arm, y, [2.0, 0.0] if (arm == "A4") == (y == 0) else [0.0, 2.0]) for u in range(20) for arm in ("A3", "A4") for y in (0, 0, 1)]
    df = spark.createDataFrame(rows, "player int, arm string, label_idx int, logp array<double>")
    got = readouts.pooled_gains(readouts.option_user_totals(df), "A4", "A3", n_resamples=50).toPandas().set_index("metric")
    assert got.loc["accuracy", "point"] == pytest.approx(1.0)
    assert got.loc["accuracy", "low"] == pytest.approx(1.0)
    right = 1 / (1 + np.exp(-2))
    share = {"A4": (2 * right + 1 - right) / 3, "A3": (2 * (1 - right) + right) / 3}  # of the first label; its true share is 2 / 3
    assert got.loc["tvd", "point"] == pytest.approx(abs(2 / 3 - share["A3"]) - abs(2 / 3 - share["A4"]))


def test_coverage(spark):
    rng = np.random.default_rng(0)
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5]])
    assert coverage.hull_area(square) == pytest.approx(1.0)
    x = rng.normal(size=(60, 2))
    assert coverage.precision_recall(x, x) == (1.0, 1.0) and coverage.precision_recall(x, x + 100) == (0.0, 0.0)
    assert coverage.js_bits(x, x) == 0 and coverage.wasserstein(x, x + 1) == pytest.approx(1.0)
    rows = [(0, s, v.tolist()) for s, part in ((0, x), (1, np.repeat(x[:1], 60, 0))) for v in part]
    z = {r["metric"]: r["z"] for r in coverage.basket(spark.createDataFrame(rows, "cell int, side int, v array<double>"), "cell", "side", "v", n_null=8, n_reps=3).collect()}
    assert set(z) == set(coverage.ORIENTATION) and z["recall"] < -3 and z["wasserstein"] < -3


def test_coverage_draws(spark):
    """The query runs with the whole numbers of draws, in all dimensions; draws dealt over tasks give what one loop gives."""
    import inspect

    from fidelis.plans import chat

    defaults = {k: v.default for k, v in inspect.signature(coverage.basket).parameters.items()}
    assert (defaults["n_null"], defaults["n_reps"], defaults["n_probe"], defaults["pca_dims"]) == (200, 1000, 2048, None)
    assert not any(f"{k}=" in inspect.getsource(chat.coverage_basket) for k in ("n_null", "n_reps", "n_probe", "pca_dims"))
    rng = np.random.default_rng(3)
    real, made = (np.array(sorted(rng.normal(size=(n, 12)).tolist())) for n in (30, 25))
    df = spark.createDataFrame([("c", s, v.tolist()) for s, part in ((0, real), (1, made)) for v in part], "cell string, side int, v array<double>")
    rows = {r["metric"]: r for r in coverage.basket(df, "cell", "side", "v", n_null=7, n_reps=23, n_probe=64, per_task=2).collect()}
    radius = np.mean(coverage.radius_draws(real, 25, list(range(23))))
    probes = coverage.box_sample(real, 64, np.random.default_rng([0, 2]))
    one = [coverage.metrics_row(real, x, probes, 3, radius) for x in (made, *(real[np.random.default_rng([0, 3, i]).integers(0, 30, 25)] for i in range(1, 8)))]
    for m, more in coverage.ORIENTATION.items():
        null = [x[m] for x in one[1:]]
        z = np.clip((one[0][m] - np.mean(null)) / max(np.std(null, ddof=1), 1e-3) * (1 if more else -1), -10, 10)
        assert (rows[m]["value"], rows[m]["null_mean"], rows[m]["z"]) == pytest.approx((one[0][m], np.mean(null), z))
        assert rows[m]["aggregate_z"] == pytest.approx(np.mean([r["z"] for r in rows.values()]))
    # points of a box in many dimensions are not correlated
    assert np.abs(np.corrcoef(coverage.halton(2048, 64, rng).T) - np.eye(64)).max() < 0.15


def test_sinks(spark, tmp_path):
    a = sinks.record_run(spark, str(tmp_path), "e", {"k": 1}, {"m": 0.5})
    assert a.endswith(sinks.run_id("e", {"k": 1}).rsplit("__", 1)[1])
    assert spark.read.parquet(str(tmp_path / "metrics")).first()["value"] == 0.5
    rows = spark.createDataFrame([("r", "A3", 1, None, "x"), ("r", "A3", 2, "bad", "y"), ("r", "A3", 3, None, "z")], "row_id string, arm string, at int, error string, response string")
    out = sinks.append_then_compact(rows, str(tmp_path / "log"), ["row_id", "arm"], "at", str(tmp_path / "done"))
    assert [r["response"] for r in out.collect()] == ["z"]


def test_ingest(spark, tmp_path):
    game = '[Event "a"]\n[White "{w}"]\n[Black "{b}"]\n[Result "1-0"]\n[WhiteElo "1500"]\n[BlackElo "1400"]\n[TimeControl "180+2"]\n[UTCDate "2020.01.0{d}"]\n[UTCTime "00:00:10"]\n\n1. e4 {{ [%clk 0:03:00] }} 1... e5 {{ [%clk 0:02:58] }} 1-0\n\n'
    path = tmp_path / "g.pgn"
    path.write_text("".join(game.format(w="ann" if d % 2 else "bob", b=f"p{d}", d=d) for d in (1, 2, 3, 5)))
    facts = cli.ingest(spark, str(path), str(tmp_path / "out"), min_games=3, min_sessions=3)
    assert facts["players"] == 1 and facts["decisions"] == 3
    rows = spark.read.parquet(str(tmp_path / "out/decisions")).orderBy("t").collect()
    assert [(r["t"], r["action"], r["session"]) for r in rows] == [(0, "e4", 0), (1, "e4", 1), (2, "e4", 2)]
