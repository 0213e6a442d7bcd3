"""Shopping histories: persona features from survey JSON, causal state rows, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelis.functions.scalars import col
from fidelis.functions.text import action_label, cart_size, page_type, search_term
from fidelis.operators.sessions import by_user

# Answers and their numbers, in the order in which parts of an answer are looked for.
LEVELS = {"extremely low": 0.0, "very low": 0.12, "low": 0.25, "medium": 0.5, "moderate": 0.5, "average": 0.5, "high": 0.75, "very high": 0.9, "extremely high": 1.0}
AGREEMENT = {"strongly disagree": 0.0, "disagree": 0.2, "somewhat disagree": 0.35, "neutral": 0.5, "neither": 0.5, "somewhat agree": 0.65, "agree": 0.8, "strongly agree": 1.0}
# Names of survey fields.
DEMOGRAPHY, SHOPPING, PERSONALITY = "Demographic Information", "Shopping Preference", "Personality"
STATEMENTS = "To what extent do you agree with the following statements"
PERSONA = ("age", "female", "openness", "conscientiousness", "extraversion", "agreeableness", "neuroticism", "frequency", "spend", "prime", "research", "ads", "holiday")


def graded(answer: Column, table: dict[str, float]) -> Column:
    """The number of an answer: an exact match, else the first entry that is part of it, else one half."""
    a = F.trim(F.lower(answer))
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), a)
    part = F.coalesce(*[F.when(F.contains(a, F.lit(k)), v) for k, v in table.items()])
    return F.coalesce(exact, part, F.lit(0.5))


def _field(survey: Column, *path: str) -> Column:
    return F.get_json_object(survey, "$" + "".join(f"['{p}']" for p in path))


def _first_value(block: Column, needles: tuple[str, ...]) -> Column:
    """The value of the first key of a JSON object that holds one of the needles."""
    keys = F.json_object_keys(block)
    hit = F.get(F.filter(keys, lambda k: F.exists(F.array(*[F.lit(n) for n in needles]), lambda n: F.contains(F.lower(k), n))), F.lit(0))
    return F.try_element_at(F.from_json(block, "map<string,string>"), hit)


def frequency(answer: Column) -> Column:
    a = F.lower(F.coalesce(answer, F.lit("")))
    has = lambda *names: F.greatest(*[F.contains(a, F.lit(n)) for n in (*names, names[0])])
    week = F.when(has("couple", "every other", "two"), 0.4).when(has("twice", "several", "few"), 0.75).otherwise(0.6)
    return (
        F.when(has("day", "daily"), F.when(has("multiple", "several"), 1.0).otherwise(0.85))
        .when(has("week"), week)
        .when(has("month"), F.when(has("less", "once"), 0.2).otherwise(0.3))
        .when(has("rare", "seldom"), 0.1)
        .otherwise(0.5)
    )


def persona(survey: str | Column) -> Column:
    """The 13 features in [0, 1] of a survey in JSON; what is missing or does not parse counts as one half (spend as 0.2, flags as 0)."""
    s = col(survey)
    ages = F.transform(F.regexp_extract_all(_field(s, DEMOGRAPHY, "Age"), F.lit(r"(\d+)"), 1), lambda x: x.cast("double"))
    age = F.when(F.size(ages) > 0, F.aggregate(ages, F.lit(0.0), lambda t, v: t + v) / F.size(ages) / 80.0).otherwise(0.5)
    traits = _field(s, PERSONALITY, "Big Five Scores")
    trait = lambda *names: graded(_first_value(traits, names), LEVELS)
    said = _field(s, SHOPPING, STATEMENTS)
    agrees = lambda name: graded(_first_value(said, (name,)), AGREEMENT)
    flag = lambda c, word: F.when(F.contains(F.lower(c), F.lit(word)), 1.0).otherwise(0.0)
    spend = F.coalesce(_field(s, SHOPPING, "Monthly online shopping spend $").try_cast("double"), F.lit(100.0))
    values = (
        F.coalesce(age, F.lit(0.5)), flag(_field(s, DEMOGRAPHY, "Gender"), "female"), trait("intellect", "openness"), trait("conscien"), trait("extra"), trait("agree"), 1 - trait("emotional", "stability", "neurotic"),
        frequency(_field(s, SHOPPING, "Online shopping frequency")), F.least(F.lit(1.0), spend / 500), flag(_field(s, SHOPPING, "Amazon Prime membership"), "yes"), agrees("research"), agrees("ads"), agrees("holiday"),
    )
    return F.struct(*[v.cast("double").alias(n) for v, n in zip(values, PERSONA, strict=True)])


def shopping_rows(actions: DataFrame, user: str = "user_id", session: str = "session_id", at: str = "ts") -> DataFrame:
    """Causal state before each action. actions: user, session, ts (seconds), action_type, click_type, url, page_meta; order: session id, then ts.

    Adds t, label, page, term, cart, dwell, recent (labels of the last three), and s_history, s_place, s_clicks, s_products, s_cart, s_searches, s_pause."""
    order = [session, at]
    rows = actions.withColumn("t", (F.row_number().over(by_user(user, *order)) - 1).cast("long"))
    w, prior = by_user(user, "t"), by_user(user, "t").rowsBetween(Window.unboundedPreceding, -1)
    in_session = Window.partitionBy(user, session).orderBy("t")
    rows = rows.select("*", action_label("action_type", "click_type").alias("label"), page_type("url").alias("page"), F.substring(F.coalesce(search_term("page_meta"), F.lit("")), 1, 40).alias("term"), cart_size("page_meta").alias("cart"), (F.col(at) - F.lag(at).over(in_session)).alias("dwell"))
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)).over(prior), F.lit(0))
    total = F.greatest(F.col("t"), F.lit(1))
    # the last five dwells that are known: number the known ones, sum them up, and look back by number
    rows = rows.withColumn("_known", F.sum(F.when(F.col("dwell").isNotNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_sum", F.sum(F.coalesce("dwell", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before_known, before_sum = F.coalesce(F.lag("_known").over(w), F.lit(0)), F.coalesce(F.lag("_sum").over(w), F.lit(0.0))
    rows = rows.withColumn("_n", before_known).withColumn("_s", before_sum)
    # the running sum five known dwells ago, by equality of counts
    marks = rows.filter(F.col("dwell").isNotNull()).select(F.col(user).alias("_u"), F.col("_known").alias("_k"), F.col("_sum").alias("_then"))
    rows = rows.join(marks, (F.col(user) == F.col("_u")) & (F.col("_n") - 5 == F.col("_k")), "left")
    pause = F.when(F.col("_n") > 0, (F.col("_s") - F.coalesce("_then", F.lit(0.0))) / F.least(F.col("_n"), F.lit(5)) / 60).otherwise(0.0)
    return rows.select(
        *actions.columns, "t", "label", "page", "term", "cart", "dwell",
        F.collect_list("label").over(w.rowsBetween(-3, -1)).alias("recent"),
        F.when(F.col("t") > 0, 1.0).otherwise(0.0).alias("s_history"),
        F.least(F.lit(1.0), (F.row_number().over(in_session) - 1) / 30).alias("s_place"),
        (count(F.col("action_type") == "click") / total).alias("s_clicks"),
        F.least(F.lit(1.0), count(F.col("page") == "product page") / 50).alias("s_products"),
        F.least(F.lit(1.0), F.col("cart") / 10).alias("s_cart"),
        (count(F.contains(F.coalesce("click_type", F.lit("")), F.lit("search"))) / total).alias("s_searches"),
        F.least(F.lit(1.0), pause).alias("s_pause"),
    )
