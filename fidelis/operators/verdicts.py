"""Verdicts on a method: does it find a signal that is known to be there, does it hold against harder look-alikes, what is left beyond a simple baseline.

People are resampled, never rows. A result is favourable if its interval lies below 0 (differences of losses), positive if above 0 (differences of accuracy)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.operators.inference import bootstrap_ci, two_afc

# The gates of the leakage screen and of the known signal.
LEAST_VALID, LEAST_ITEMS, LEAST_PERSONS, ITEMS_EACH = 0.95, 80, 15, 3


def survivors(rows: DataFrame, person: str, predicted: str = "predicted", correct: str = "correct_answer") -> DataFrame:
    """Items that a model without information answers, and answers wrong: rows that parse (predicted is not null) and differ from the answer."""
    return rows.filter(F.col(predicted).isNotNull() & (F.col(predicted) != F.col(correct)))


def screen_gates(rows: DataFrame, person: str, predicted: str = "predicted", correct: str = "correct_answer") -> DataFrame:
    """One row: n_items, valid_rate, n_survivors, n_persons with enough survivors, and go: whether the powered stage may follow."""
    wrong = F.coalesce(F.col(predicted) != F.col(correct), F.lit(False))
    per = rows.groupBy(person).agg(F.count(F.lit(1)).alias("_n"), F.count(predicted).alias("_v"), F.count_if(wrong).alias("_w"))
    g = per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_items"), F.try_divide(F.sum("_v"), F.sum("_n")).alias("valid_rate"), F.coalesce(F.sum("_w"), F.lit(0)).alias("n_survivors"), F.count_if(F.col("_w") >= ITEMS_EACH).alias("n_persons"))
    return g.withColumn("go", F.coalesce((F.col("valid_rate") >= LEAST_VALID) & (F.col("n_survivors") >= LEAST_ITEMS) & (F.col("n_persons") >= LEAST_PERSONS), F.lit(False)))


def person_accuracy(rows: DataFrame, person: str, arm: str = "arm", predicted: str = "predicted", correct: str = "correct_answer") -> DataFrame:
    """person, arm, n rows, valid rows, accuracy over valid rows (null without one)."""
    right = F.when(F.col(predicted).isNotNull(), (F.col(predicted) == F.col(correct)).cast("double"))
    return rows.groupBy(person, arm).agg(F.count(F.lit(1)).alias("n"), F.count(predicted).alias("valid"), F.avg(right).alias("accuracy"))


def known_signal(rows: DataFrame, person: str, intervals: bool = True, n_resamples: int = 10_000) -> DataFrame:
    """One row: n_persons with valid rows in both arms, valid rates and mean accuracies of A3 and A4 (over persons with valid rows), effect = mean over persons of
    A4 - A3; with intervals also low, high and the gates valid_parsing (both arms) and positive (low above 0)."""
    per = person_accuracy(rows.filter(F.col("arm").isin("A3", "A4")), person)
    at = lambda a, c: F.when(F.col("arm") == a, F.col(c))
    arms = per.agg(*[F.try_divide(F.sum(at(a, "valid")), F.sum(at(a, "n"))).alias(f"valid_{a.lower()}") for a in ("A3", "A4")], *[F.avg(at(a, "accuracy")).alias(f"accuracy_{a.lower()}") for a in ("A3", "A4")])
    wide = per.groupBy(person).agg((F.max(at("A4", "accuracy")) - F.max(at("A3", "accuracy"))).alias("_d")).dropna(subset=["_d"])
    if not intervals:
        return wide.agg(F.count(F.lit(1)).alias("n_persons"), F.avg("_d").alias("effect")).crossJoin(F.broadcast(arms))  # one row each
    ci = bootstrap_ci(wide.withColumn("_all", F.lit("all")), ["_all"], "_d", n_resamples).select(F.col("n_units").alias("n_persons"), F.col("point").alias("effect"), "low", "high")
    return ci.crossJoin(F.broadcast(arms)).withColumn("valid_parsing", (F.col("valid_a3") >= LEAST_VALID) & (F.col("valid_a4") >= LEAST_VALID)).withColumn("positive", F.col("low") > 0)


def matcher_intervals(differences: DataFrame, combo: str, matcher: str, value: str, n_resamples: int = 10_000) -> DataFrame:
    """combo, matcher, n, point, low, high, favourable. differences: a row per user, combo and matcher; users without a value for a matcher have no part in its interval."""
    ci = bootstrap_ci(differences, [combo, matcher], value, n_resamples)
    return ci.filter("n_units > 0").select(combo, matcher, F.col("n_units").alias("n"), "point", "low", "high", (F.col("high") < 0).alias("favourable"))


def matcher_hierarchy(differences: DataFrame, combo: str, matcher: str, value: str, n_resamples: int = 10_000) -> DataFrame:
    """combo, matchers_reported, k_of_matchers: how many matchers' look-alikes one's own information beats."""
    each = matcher_intervals(differences, combo, matcher, value, n_resamples)
    return each.groupBy(combo).agg(F.count(F.lit(1)).alias("matchers_reported"), F.count_if("favourable").alias("k_of_matchers"))


def status(low: str | Column = "low", high: str | Column = "high") -> Column:
    """favourable, adverse, or open where the interval holds 0; null without an interval."""
    low, high = (F.col(c) if isinstance(c, str) else c for c in (low, high))
    return F.when(high < 0, "favourable").when(low > 0, "adverse").when(low.isNotNull(), "open")


def residuals(arms: DataFrame, baseline: DataFrame, combo: str, user: str, timing: bool, n_resamples: int = 2000) -> DataFrame:
    """combo, n_common, individual (mean of A4frozen - A3 over all users) with interval, marginal, residual_live (timing alone), drift, residual, nd.

    arms: combo, user, a3, a4, a4f; baseline: combo, user, marginal (the baseline's own - other). Discrete channels: the mean over common users of
    (A4frozen - A3) - marginal. Timing channels, whose baseline follows the live stream: the mean over common users of (A4 - A3) - marginal, plus the
    drift, A4frozen - A4, over all users. nd: the interval of A4frozen - A3 holds 0, so that a share of it has no stable reading."""
    a = arms.select(combo, user, (F.col("a4f") - F.col("a3")).alias("_f"), (F.col("a4") - F.col("a3")).alias("_l"), (F.col("a4f") - F.col("a4")).alias("_d"))
    whole = a.groupBy(combo).agg(F.avg("_d").alias("drift"))
    ci = bootstrap_ci(a, [combo], "_f", n_resamples).select(combo, F.col("point").alias("individual"), "low", "high")
    j = a.join(baseline.select(combo, user, "marginal"), [combo, user])
    live = F.avg(F.col("_l") - F.col("marginal"))
    m = j.groupBy(combo).agg(F.count(F.lit(1)).alias("n_common"), F.avg("marginal").alias("marginal"), (live if timing else F.lit(None).cast("double")).alias("residual_live"), F.avg(F.col("_f") - F.col("marginal")).alias("_final"))
    out = m.join(whole, combo).join(ci, combo)
    final = F.col("residual_live") + F.col("drift") if timing else F.col("_final")
    nd = ~((F.col("high") < 0) | (F.col("low") > 0))
    return out.select(combo, "n_common", "individual", "low", "high", "marginal", "residual_live", "drift", final.alias("residual"), nd.alias("nd"))


def residual_summary(cells: DataFrame, passed: str | None = None) -> DataFrame:
    """One row over cells of residuals: n_cells, interpretable (not nd), matched (residual of at least 0), favourable (below 0), and how many of those that
    passed (a boolean column) are matched."""
    ok = ~F.col("nd")
    more = [F.count_if(passed).alias("n_passed"), F.count_if(F.col(passed) & (F.col("residual") >= 0)).alias("passed_matched")] if passed else []
    return cells.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(ok).alias("interpretable"), F.count_if(ok & (F.col("residual") >= 0)).alias("matched"), F.count_if(ok & (F.col("residual") < 0)).alias("favourable"), *more)


def shift_status(df: DataFrame, by: list[str], old: str, new: str, n_resamples: int = 2000) -> DataFrame:
    """by, n, then for old, new and their paired difference point, low, high; status of both and changed. Users with both values count."""
    both = df.filter(F.col(old).isNotNull() & F.col(new).isNotNull()).select(*by, F.col(old).alias("old"), F.col(new).alias("new"), (F.col(new) - F.col(old)).alias("shift"))
    out = None
    for c in ("old", "new", "shift"):
        ci = bootstrap_ci(both, by, c, n_resamples).select(*by, *([F.col("n_units").alias("n")] if out is None else []), F.col("point").alias(c), F.col("low").alias(f"{c}_low"), F.col("high").alias(f"{c}_high"))
        out = ci if out is None else out.join(ci, by)
    out = out.withColumn("old_status", status("old_low", "old_high")).withColumn("new_status", status("new_low", "new_high"))
    return out.withColumn("changed", F.col("old_status") != F.col("new_status"))


def content_rows(samples: DataFrame, keys: list[str], arm: str, similarity: str, k: int = 8) -> DataFrame:
    """keys and D_A3, D_A4, best_A3, best_A4: mean and smallest distance (1 - similarity) over the k samples of each arm; a set of another size is an error."""
    d = 1 - F.col(similarity)
    g = samples.filter(F.col(arm).isin("A3", "A4")).groupBy(*keys, arm).agg(F.count(F.lit(1)).alias("_n"), F.avg(d).alias("_d"), F.min(d).alias("_b"))
    full = F.when(F.col("_n") == k, F.col("_d")).otherwise(F.raise_error(F.concat(F.lit("a set of "), F.col("_n").cast("string"), F.lit(" samples"))).cast("double"))
    g = g.withColumn("_d", full)
    at = lambda a, c: F.max(F.when(F.col(arm) == a, F.col(c)))
    return g.groupBy(*keys).agg(at("A3", "_d").alias("D_A3"), at("A4", "_d").alias("D_A4"), at("A3", "_b").alias("best_A3"), at("A4", "_b").alias("best_A4"))


def content_readout(content: DataFrame, user: str = "user_id", sim: str = "sim", n_resamples: int = 10_000, intervals: bool = True) -> DataFrame:
    """sim, contrast (delta: D_A4 - D_A3, afc: forced choice between them, best: best_A4 - best_A3 where given), n_units and point over users, with intervals if asked for."""
    values = {"delta": F.col("D_A4") - F.col("D_A3"), "afc": two_afc("D_A4", "D_A3")} | ({"best": F.col("best_A4") - F.col("best_A3")} if "best_A4" in content.columns else {})
    users = content.groupBy(sim, user).agg(*[F.avg(v).alias(n) for n, v in values.items()])
    long = users.select(sim, F.explode(F.array(*[F.struct(F.lit(n).alias("contrast"), F.col(n).alias("v")) for n in values])).alias("x")).select(sim, "x.*")
    if not intervals:
        return long.groupBy(sim, "contrast").agg(F.count("v").alias("n_units"), F.avg("v").alias("point"))
    return bootstrap_ci(long, [sim, "contrast"], "v", n_resamples)
