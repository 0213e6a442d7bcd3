"""Hand-computed cases and properties of the audit operators."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fidelis.functions import scalars as sc
from fidelis.functions import text as tx
from fidelis.operators import arms, features, inference, metrics, panel, sessions, simulators
from fidelis.sources import readers


def population(spark, users, steps, lam, seed=0, drift=0.0, train=0.7):
    """user_id, t, k, p, y: Bernoulli draws of simulated users, q from Beta(4, 2), p = (1 - lam) * mean + lam * q, plus a drift per step."""
    import numpy as np
    import pandas as pd

    mean, k = 4 / 6, round(train * steps)

    def run(batches):
        for pdf in batches:
            out = []
            for u in pdf["id"]:
                rng = np.random.default_rng([seed, int(u)])
                p = (1 - lam) * mean + lam * rng.beta(4, 2)
                t = np.arange(steps)
                rate = np.clip(p + drift * (t - (k - 1) / 2), 0.02, 0.98)
                out.append(pd.DataFrame({"user_id": int(u), "t": t, "k": k, "p": rate, "y": (rng.random(steps) < rate).astype(int)}))
            yield pd.concat(out) if out else pd.DataFrame({c: [] for c in ("user_id", "t", "k", "p", "y")})

    return spark.range(users).mapInPandas(run, "user_id long, t long, k long, p double, y int")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_time_controls(spark):
    df = spark.createDataFrame([("180+2",), ("-",), ("300",), ("abc",), ("15+0",), ("60+0",), ("180+0",), ("480+0",), ("1500+0",), (None,)], "tc string")
    got = [(r["t"]["base"], r["t"]["inc"], r["s"]) for r in df.select(sc.time_control("tc").alias("t"), sc.speed_class("tc").alias("s")).collect()]
    assert got[:4] == [(180, 2, "blitz"), (None, None, "correspondence"), (300, 0, "blitz"), (None, None, "correspondence")]
    assert [g[2] for g in got[4:]] == ["ultrabullet", "bullet", "blitz", "rapid", "classical", "correspondence"]


def test_buckets_and_losses(spark):
    assert [one(spark, sc.bucket_label(F.lit(x), sc.CHESS_EDGES)) for x in (0.99, 1.0, 8.0, 20.0)] == ["under 1s", "1 to 3s", "8 to 20s", "over 20s"]
    assert one(spark, sc.lognormal_nll(F.lit(2.0), F.lit(0.5), F.lit(0.8))) == pytest.approx(0.5 * ((math.log(2) - 0.5) / 0.8) ** 2 + math.log(0.8) + 0.5 * math.log(2 * math.pi) + math.log(2))
    p = one(spark, sc.lognormal_bucket_probs(F.lit(0.5), F.lit(1.0), sc.CHESS_EDGES))
    cdf = [0, *(0.5 * (1 + math.erf((math.log(e) - 0.5) / math.sqrt(2))) for e in sc.CHESS_EDGES), 1]
    assert p == pytest.approx(np.diff(cdf), abs=2e-7)
    assert one(spark, sc.map_prob(F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(3.0)), F.lit("b"))) == 0.75
    assert one(spark, sc.letter_nll(F.create_map(F.lit("A"), F.lit(-0.1)), F.lit("A"), ["A", "B"])) == pytest.approx(math.log(math.exp(-0.1) + math.exp(-15)) + 0.1)


def test_text(spark):
    assert one(spark, tx.norm_text(F.lit(" A​b   C\n"))) == "a b c"
    assert one(spark, tx.jaccard(tx.token_set(F.lit("a b c")), tx.token_set(F.lit("b c d")))) == 0.5
    assert one(spark, tx.jaccard(tx.token_set(F.lit("")), tx.token_set(F.lit("")))) == 1.0
    assert [one(spark, tx.is_code(F.lit(t))) for t in ("x = 1;\ny = 2;", "a;", "```")] == [True, False, True]
    assert [one(spark, tx.page_type(F.lit(u))) for u in ("https://a.com/s?k=a", "https://a.com/dp/B0", "https://a.com/cart", "https://a.com/")] == ["search results", "product page", "cart", "home"]
    said = ["<final_answer>(b)", "The answer is c", "The answer is: c", "the answer is correct", "(a) or (b)"]
    assert [one(spark, tx.parse_answer(F.lit(t))) for t in said] == ["(b)", "(c)", None, "(c)", None]
    assert one(spark, tx.cart_size(F.lit(json.dumps(json.dumps({"cart_items": [1, 2]}))))) == 2
    assert one(spark, tx.generated_text(F.lit("x<response> a<think>b\nc</think>d </response>"))) == "ad"


def test_sessions(spark):
    rows = [(1, 0.0, 0.0), (1, 1800.0, 1800.0), (1, 3599.0, 3599.0), (1, 5400.0, 5400.0), (2, 0.0, 600.0), (2, 2300.0, 2400.0), (2, 4200.0, 4300.0)]
    df = sessions.decisions(spark.createDataFrame(rows, "u long, s double, e double"), "u", ["s"])
    got = {(r["u"], r["t"]): r["session"] for r in sessions.with_sessions(df, "u", "s", 1800, "e").collect()}
    assert [got[1, i] for i in range(4)] == [0, 1, 1, 2]
    assert [got[2, i] for i in range(3)] == [0, 0, 1]


def test_split(spark):
    rows = [(f"a{n}", i, 0) for n in (1, 2, 10, 15) for i in range(n)] + [(f"s{n}", i, i // 2) for n in (2, 3, 5) for i in range(2 * n)]
    got = {r["u"]: r["k"] for r in sessions.session_split(spark.createDataFrame(rows, "u string, t long, session long"), "u").collect()}
    assert [got[f"a{n}"] for n in (1, 2, 10, 15)] == [1, 1, 7, 10]
    assert [got[f"s{n}"] for n in (2, 3, 5)] == [2, 4, 8]


def test_donors(spark):
    cells = spark.createDataFrame([(i, 0 if i < 7 else 1 if i < 9 else 2) for i in range(10)], "user_id long, cell long")
    rows = arms.donors(cells).collect()
    assert sorted(r["donor"] for r in rows) == list(range(10))
    assert [r["user_id"] for r in rows if r["user_id"] == r["donor"]] == [9]
    kept = arms.restrict_donors(cells, cells.filter("user_id != 3")).collect()
    full = {r["user_id"]: r["donor"] for r in rows}
    for r in kept:
        d = full[r["user_id"]]
        assert r["donor"] == (full[d] if d == 3 else d)


def test_memory_row(spark):
    ys = [1, 1, 0, 1, 1, 0, 0, 1, 1]
    df = spark.createDataFrame([(1, t, y, 0.5) for t, y in enumerate(ys)], "u long, t long, y int, d double")
    rows = sorted(features.memory_row(df, "u", ["t"], "y", "d").collect(), key=lambda r: r["t"])
    assert [round(5 * math.atanh(r["f_streak"])) for r in rows] == [0, 1, 2, -1, 0, 1, -1, -2, 1]
    e, want = None, []
    for y in ys:
        want.append(0.5 if e is None else e)
        e = y if e is None else 0.9 * e + 0.1 * y
    assert [r["f_ewma"] for r in rows] == pytest.approx(want)


def test_long_ewma(spark):
    ys = [random.Random(1).random() for _ in range(3500)]
    df = spark.createDataFrame([(1, t, y) for t, y in enumerate(ys)], "u long, t long, y double")
    got = [r["e"] for r in sorted(features.with_ewma(df, "y", "u", ["t"], "e").collect(), key=lambda r: r["t"])]
    e = ys[0]
    for t in range(1, 3500):
        assert got[t] == pytest.approx(e, abs=1e-12)
        e = 0.9 * e + 0.1 * ys[t]


def test_inference(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([("x", float(v)) for v in rng.normal(-0.4, 1, 80)] + [("c", 2.0)] * 5, "g string, v double")
    ci = {r["g"]: r for r in inference.bootstrap_ci(df, ["g"], "v").collect()}
    assert ci["c"]["low"] == ci["c"]["high"] == 2.0
    assert ci["x"]["low"] < ci["x"]["point"] < ci["x"]["high"]
    p = {r["g"]: r["p_flip"] for r in inference.signflip_p(df, ["g"], "v").collect()}
    assert p["x"] < 0.02 and p["c"] == pytest.approx(1 / 16, abs=0.01)
    tests = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.005,)], "p double")
    assert {r["p"]: r["holm"] for r in inference.holm(tests, "p").collect()} == {0.01: True, 0.04: False, 0.03: False, 0.005: True}
    k = spark.createDataFrame([(0, i, x, y) for i, (x, y) in enumerate([(1, 1), (2, 3), (3, 2)])], "g int, i int, x int, y int")
    assert inference.kendall(k, ["g"], "i", "x", "y").first()["tau_a"] == pytest.approx(1 / 3)


def test_distances(spark):
    d = spark.createDataFrame([(0, "a", 0.5, 1.0), (0, "b", 0.5, 0.0)], "g int, l string, p double, q double")
    r = metrics.distribution_distances(d, ["g"], "p", "q").first()
    assert r["tvd"] == 0.5 and r["js"] == pytest.approx(0.215762, abs=1e-6)


def test_null_population_and_signal(spark):
    share = {}
    for lam in (0.0, 1.0):
        rows = population(spark, 200, 60, lam, seed=3)
        cells = arms.donors(rows.select("user_id").distinct().withColumn("cell", F.lit(0)))
        m = simulators.bernoulli_marginal(rows, cells, "y").select((F.col("own") - F.col("other")).alias("d")).agg(F.avg("d")).first()[0]
        share[lam] = m
    assert abs(share[0.0]) < 0.02 and share[1.0] < -0.05


def test_logistic(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 2))
    y = (rng.random(3000) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -2.0])))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int")
    assert simulators.fit_logistic(df, ["a", "b"], "y") == pytest.approx([0.3, 1.0, -2.0], abs=0.25)


def test_hungarian():
    import itertools

    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 5, 6):
        cost = rng.random((n, n))
        got = panel.hungarian(cost)
        assert sorted(got) == list(range(n))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert cost[np.arange(n), got].sum() == pytest.approx(best)


def test_folds(spark):
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate([50, 70, 20, 30, 5])], "u int, i int, n long")
    got = [r["taken"] for r in sorted(panel.budget_fill(df, "u", ["i"], "n", 100, stop=20).collect(), key=lambda r: r["i"])]
    assert got == [True, False, True, True, False]
    vec = [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0], [1.0, 0.0]]
    df = spark.createDataFrame([(0, i, t, v) for i, (t, v) in enumerate(zip(["a b c d", "a b c d e", "z", "A b  c d"], vec, strict=True))], "u int, i int, t string, v array<double>")
    assert [r["verdict"] for r in sorted(panel.greedy_dedup(df, "u", ["i"], "t", "v").collect(), key=lambda r: r["i"])] == ["kept", "near", "kept", "exact"]


def test_games(spark, tmp_path):
    text = '[Event "a"]\n[White "x"]\n[Black "y"]\n[Result "1-0"]\n[WhiteElo "1500"]\n[BlackElo "?"]\n[TimeControl "180+2"]\n[UTCDate "2020.01.01"]\n[UTCTime "00:00:10"]\n\n1. e4 { [%clk 0:03:00] } 1... e5 { [%clk 0:02:58] } 2. Nf3 { [%clk 0:02:57] } 1-0\n\n'
    path = tmp_path / "g.pgn"
    path.write_text(text + text.replace('"x"', '"z"'))
    games = readers.game_headers(readers.pgn_games(spark, str(path)))
    rows = sorted(games.collect(), key=lambda r: r["white"])
    assert [(r["white"], r["white_elo"], r["black_elo"], r["speed"], r["utc_start"]) for r in rows] == [("x", 1500, None, "blitz", 1577836810.0), ("z", 1500, None, "blitz", 1577836810.0)]
    plies = readers.game_plies(games.filter("white = 'x'"), ["white"]).orderBy("ply").collect()
    assert [(p["side"], p["san"], p["clock_before"], p["time_spent"]) for p in plies] == [("white", "e4", 180.0, 2.0), ("black", "e5", 180.0, 4.0), ("white", "Nf3", 180.0, 5.0)]
    assert readers.real_players(readers.both_players(games)).filter("player = 'y' and won = false").count() == 2


def test_response_log(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("order_id,user_id,problem_id,correct,skill_id,ms_first_response\n2,u,p,1,s,900\n2,u,p,0,s,1\n1,u,p,0.5,s,1\n1,u,p,0,s,400000\n3,u,p,1,,5\n", encoding="iso-8859-1")
    rows = readers.responses_csv(spark, str(path))
    assert sorted((r["order_id"], r["correct"], r["ms"]) for r in rows.collect()) == [(1, 0, 400000.0), (2, 1, 900.0)]
    t = readers.response_trajectories(rows, "user_id", ["order_id"], "correct", "skill_id", "ms", least=2).orderBy("t").collect()
    assert [(r["t"], r["k"], r["seconds"], r["difficulty"]) for r in t] == [(0, 1, 300.0, 1.0), (1, 1, 0.9, 1.0)]


def test_trajectory_store(spark, tmp_path):
    d = {"game": "chess", "state": "s", "legal_actions": ["a", "b"], "time_signal": {"time_remaining": 9.0, "move_number": 1}, "recent_outcomes": 0, "context": {"elo": "1500"}}
    line = {"player_id": "p", "streams": [{"recent": [{"won": True}], "session_position": 0}], "decisions": [d], "observations": [{"move": "a", "time_spent": 1.5}]}
    path = tmp_path / "t.jsonl"
    path.write_text(json.dumps({"schema_version": 1, "n_trajectories": 1}) + "\n" + json.dumps(line) + "\n")
    store = readers.trajectories(spark, str(path))
    row = readers.trajectory_rows(store).first()
    assert (row["player_id"], row["t"], row["action"], row["recent"]["recent"][0]["won"]) == ("p", 0, "a", True)
    readers.write_trajectories(store, str(tmp_path / "out"))
    assert readers.trajectories(spark, str(tmp_path / "out")).count() == 1
    path.write_text(json.dumps({"schema_version": 7}) + "\n")
    with pytest.raises(ValueError, match="version"):
        readers.trajectories(spark, str(path))


def test_stream_sessions(spark, sf, tmp_path):
    from fidelis.plans.trial import GAP, events
    from fidelis.streaming.sessions import stream_sessions

    batch = events(spark, sf).select("user_id", "event_id", "start", "session", "session_pos").persist()
    batch.select("user_id", "event_id", "start").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, event_id long, start double").parquet(str(tmp_path / "in"))
    q = stream_sessions(stream, "user_id", "event_id", "start", GAP).writeStream.format("memory").queryName("stream_sessions").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda rows: sorted((r["user_id"], r["event_id"], r["session"], r["session_pos"]) for r in rows)
    assert key(spark.table("stream_sessions").collect()) == key(batch.collect())


def test_alone_in_a_cell(spark):
    """The user of a cell of one is in no contrast."""
    from fidelis.operators import arms

    users = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "user_id long, cell long")
    assert {r["user_id"] for r in arms.matched(arms.donors(users)).collect()} == {1, 2}
    rows = spark.createDataFrame([(u, t, 2, "a" if (u + t) % 2 else "b") for u in (1, 2, 3) for t in range(4)], "user_id long, t long, k long, label string")
    assert {r["user_id"] for r in arms.arm_scores(arms.user_counts(rows, "label", ["a", "b"]), arms.donors(users), ["a", "b"]).collect()} == {1, 2}
