"""Texts of numeric states: what a prompt is told about a person. Numbers are rounded half to even, after nine decimals, so that a value that two engines
add up in different orders gives one text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fidelis.functions.scalars import col


def fixed(x: str | Column, digits: int, sign: bool = False) -> Column:
    """x with this many decimals, and a plus sign if asked for."""
    scale = 10.0**digits
    return F.format_string(f"%{'+' if sign else ''}.{digits}f", F.rint(F.round(col(x).cast("double"), 9) * scale) / scale)


def written(template: str, **parts: Column) -> Column:
    """The template with each {name} replaced by the text of that part."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), parts[name]]
    return F.concat(*out, F.lit(rest))


# The wording of cards and questions.
ANSWERS = "Student state ({seen}): overall accuracy {mean}, recent accuracy {recent}, last answer {last}, streak {streak}, skill-adjusted trend {trend}."
QUESTION = "Predict whether this student answers the next question correctly.\nQuestion difficulty: {difficulty} (0 = easiest, 1 = hardest). Attempt {attempt}."
NEW_PLAYER = "Player profile: rating about {elo}; no move history yet."
PLAYER = "Player profile: rating about {elo}; typical think time {median}s (median), last 5 moves average {last5}s, last move {last}s; {fast}% of moves under 2s; under time pressure thinks {pressure}s."
SHOPPER = "Shopper: age ~{age}, {gender}; shops online (freq {freq}), ~${spend}/mo, Prime {prime}; Big-Five O/C/E/A/N {traits}; researches-before-buying {research}, ad-attentive {ads}, holiday-shopper {holiday}."
NEW_SESSION = "Session just started."
SESSION = "Session so far: {clicks}% clicks, ~{views} product views, cart {cart}; recent pause ~{pause}s."


def answers_card(m: dict[str, Column]) -> Column:
    """A memory of answers: f_mean, f_last10, f_lag, f_streak, f_res_ewma and f_has_history."""
    return written(
        ANSWERS, seen=F.when(m["f_has_history"] < 0.5, "no answers yet").otherwise("answers so far"), mean=fixed(m["f_mean"], 2), recent=fixed(m["f_last10"], 2),
        last=F.when(m["f_lag"] > 0.5, "correct").otherwise("incorrect"), streak=fixed(m["f_streak"], 2, True), trend=fixed(m["f_res_ewma"], 2, True),
    )


def question_base(difficulty: str | Column, t: str | Column) -> Column:
    return written(QUESTION, difficulty=fixed(difficulty, 2), attempt=(col(t) + 1).cast("string"))


def player_card(m: dict[str, Column]) -> Column:
    """A row of think times: m_has_history, m_elo, m_median, m_last5, m_last, m_fast, m_pressure."""
    elo = fixed(m["m_elo"], 0)
    known = written(PLAYER, elo=elo, median=fixed(m["m_median"], 1), last5=fixed(m["m_last5"], 1), last=fixed(m["m_last"], 1), fast=fixed(100 * m["m_fast"], 0), pressure=fixed(m["m_pressure"], 1))
    return F.when(m["m_has_history"] < 0.5, written(NEW_PLAYER, elo=elo)).otherwise(known)


def shopper_card(p: Column) -> Column:
    """An array of thirteen numbers: age, female, five traits, frequency, spending, membership, research, adverts, holidays."""
    at = lambda i: F.element_at(p, i + 1)
    traits = F.concat_ws("/", *[fixed(at(i), 2) for i in range(2, 7)])
    return written(
        SHOPPER, age=fixed(at(0) * 80, 0), gender=F.when(at(1) > 0.5, "female").otherwise("male"), freq=fixed(at(7), 2), spend=fixed(at(8) * 500, 0), prime=F.when(at(9) > 0.5, "yes").otherwise("no"),
        traits=traits, research=fixed(at(10), 2), ads=fixed(at(11), 2), holiday=fixed(at(12), 2),
    )


def session_card(has_history: str | Column, s: dict[str, Column]) -> Column:
    """A session's state: s_clicks, s_views, s_cart and s_pause as shares of their scales."""
    known = written(SESSION, clicks=fixed(s["s_clicks"] * 100, 0), views=fixed(s["s_views"] * 50, 0), cart=fixed(s["s_cart"] * 10, 0), pause=fixed(s["s_pause"] * 60, 0))
    return F.when(col(has_history) < 0.5, NEW_SESSION).otherwise(known)


def rendered(config: str, persona: Column, state: Column) -> Column:
    """static: who they are; dynamic: what they do; combined: both."""
    return {"static": persona, "dynamic": state, "combined": F.concat(persona, F.lit(" "), state)}[config]


def card_for(condition: str | Column, cards: dict[str, Column]) -> Column:
    """The card that a condition serves: none (null), placebo, group or self; another condition is an error."""
    c = col(condition) if isinstance(condition, Column) else F.lit(condition)
    return F.when(c == "none", F.lit(None).cast("string")).when(c == "placebo", cards["placebo"]).when(c == "group", cards["group"]).when(c == "self", cards["self"]).otherwise(F.raise_error(F.concat(F.lit("unknown condition "), c)))
