"""Cards against Python's own formatting."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fidelis.functions import cards


def test_cards(spark):
    rng = random.Random(4)
    rows = [[rng.choice([0.0, 1.0]), rng.uniform(900, 2400), *[rng.uniform(0, 30) for _ in range(3)], rng.random(), rng.uniform(0, 30)] + [rng.uniform(-1, 1) for _ in range(6)] + [rng.random() for _ in range(13)] for _ in range(200)]
    names = ["m_has_history", "m_elo", "m_median", "m_last5", "m_last", "m_fast", "m_pressure", "f_mean", "f_last10", "f_lag", "f_streak", "f_res_ewma", "f_x"]
    df = spark.createDataFrame([(*r[:13], r[13:]) for r in rows], ", ".join(f"{n} double" for n in names) + ", p array<double>").coalesce(1)
    m = {n: F.col(n) for n in names}
    s = {"s_clicks": m["m_fast"], "s_views": F.col("p")[1], "s_cart": F.col("p")[2], "s_pause": F.col("p")[3]}
    shopper, session = cards.shopper_card(F.col("p")), cards.session_card("m_has_history", s)
    got = df.select(cards.player_card(m).alias("a"), cards.answers_card(m | {"f_has_history": m["m_has_history"]}).alias("b"), shopper.alias("c"), session.alias("d"), cards.rendered("combined", shopper, session).alias("e"), cards.question_base("m_fast", F.lit(4)).alias("q")).collect()
    for r, g in zip(rows, got, strict=True):
        h, elo, med, l5, l1, fast, press, mean, rec, lag, streak, trend, _ = r[:13]
        p = r[13:]
        assert g["a"] == (f"Player profile: rating about {elo:.0f}; no move history yet." if h < 0.5 else f"Player profile: rating about {elo:.0f}; typical think time {med:.1f}s (median), last 5 moves average {l5:.1f}s, last move {l1:.1f}s; {100 * fast:.0f}% of moves under 2s; under time pressure thinks {press:.1f}s.")
        assert g["b"] == f"Student state ({'no answers yet' if h < 0.5 else 'answers so far'}): overall accuracy {mean:.2f}, recent accuracy {rec:.2f}, last answer {'correct' if lag > 0.5 else 'incorrect'}, streak {streak:+.2f}, skill-adjusted trend {trend:+.2f}."
        assert g["c"] == f"Shopper: age ~{p[0] * 80:.0f}, {'female' if p[1] > 0.5 else 'male'}; shops online (freq {p[7]:.2f}), ~${p[8] * 500:.0f}/mo, Prime {'yes' if p[9] > 0.5 else 'no'}; Big-Five O/C/E/A/N {p[2]:.2f}/{p[3]:.2f}/{p[4]:.2f}/{p[5]:.2f}/{p[6]:.2f}; researches-before-buying {p[10]:.2f}, ad-attentive {p[11]:.2f}, holiday-shopper {p[12]:.2f}."
        assert g["d"] == ("Session just started." if h < 0.5 else f"Session so far: {fast * 100:.0f}% clicks, ~{p[1] * 50:.0f} product views, cart {p[2] * 10:.0f}; recent pause ~{p[3] * 60:.0f}s.")
        assert g["e"] == g["c"] + " " + g["d"]
        assert g["q"] == f"Predict whether this student answers the next question correctly.\nQuestion difficulty: {fast:.2f} (0 = easiest, 1 = hardest). Attempt 5."
    two = {"placebo": F.lit("p"), "group": F.lit("g"), "self": F.lit("s")}
    conditions = spark.createDataFrame([("none",), ("placebo",), ("group",), ("self",)], "c string").coalesce(1)
    assert [r[0] for r in conditions.select(cards.card_for(F.col("c"), two)).collect()] == [None, "p", "g", "s"]
    with pytest.raises(PySparkException, match="unknown condition"):
        spark.range(1).select(cards.card_for("other", two)).collect()
    assert [spark.range(1).select(cards.fixed(F.lit(x), 2, True).alias("x")).first()[0] for x in (0.125, 0.135, -0.001, 2.0)] == ["+0.12", "+0.14", "-0.00", "+2.00"]
