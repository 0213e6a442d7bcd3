"""Readouts R2 to R5: does a selector order simulators as their content gains do, on people it was not chosen on?

A selector and an outcome each have one value per simulator and person, lower is better. Simulators are a short closed list, so
people are rows with a value per simulator: means of a resample are sums over those rows, which tasks make in buckets, and every
comparison of orders works on one row per resample and simulator."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidelis.operators.inference import bootstrap_ci, kendall, resampled, spearman, two_afc
from fidelis.operators.readouts import classify, pair_readout

#: People of one simulator whose ranks one task holds (two doubles each).
MOST_PEOPLE = 2_000_000


def agreement(outcome: DataFrame, selector: DataFrame, sim: str = "sim", user: str = "user_id", value: str = "value", n_resamples: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """R2 (outcome: content gains) and R3 (outcome: distances of A4): the pairs of simulators, and their counts with the verdict."""
    users = outcome.select(F.col(sim).alias("sim"), F.col(user).alias("user_id"), F.col(value).alias("delta"))
    scores = selector.groupBy(F.col(sim).alias("sim")).agg(F.avg(value).alias("score"))
    pairs = pair_readout(users, scores, n_resamples)
    return pairs, classify(pairs)


def orders(selector: DataFrame, outcome: DataFrame, folds: DataFrame, sim: str = "sim", user: str = "user_id", value: str = "value") -> DataFrame:
    """direction (A to B: selector on fold A, outcome on fold B; and back), sim, chosen (mean of the selector) and judged (mean of the outcome)."""
    out = None
    for source, target in (("A", "B"), ("B", "A")):
        mean = lambda df, fold, name: df.join(folds.filter(F.col("fold") == fold).select(user), user, "left_semi").groupBy(sim).agg(F.avg(value).alias(name))
        one = mean(selector, source, "chosen").join(mean(outcome, target, "judged"), sim).select(F.lit(f"{source} to {target}").alias("direction"), sim, "chosen", "judged")
        out = one if out is None else out.unionByName(one)
    return out


def crossfit(selector: DataFrame, outcome: DataFrame, folds: DataFrame, sim: str = "sim", user: str = "user_id", value: str = "value") -> DataFrame:
    """direction, n (simulators), tau_a, tau_b, pick (what the selector puts first, ties by name) and pick_rank (its place by the outcome, 1 is best)."""
    o = orders(selector, outcome, folds, sim, user, value)
    t = kendall(o, ["direction"], sim, "chosen", "judged")
    w = Window.partitionBy("direction")  # a row per simulator
    p = o.withColumn("_rank", F.row_number().over(w.orderBy("judged", sim))).groupBy("direction").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(F.col(sim).alias("s"), "_rank"), F.struct("chosen", sim)).alias("_p"))
    return t.join(p, "direction").select("direction", "n", "tau_a", "tau_b", F.col("_p.s").alias("pick"), F.col("_p._rank").alias("pick_rank"))


def crossfit_interval(selector: DataFrame, outcome: DataFrame, folds: DataFrame, sim: str = "sim", user: str = "user_id", value: str = "value", n_resamples: int = 2000, seed: int = 0) -> DataFrame:
    """direction, point, low, high of tau_b when the people of both folds are resampled, each fold by itself. People with a value of every simulator count."""
    sims = sorted(r[0] for r in selector.select(sim).distinct().limit(1001).collect())
    if len(sims) > 1000:
        raise ValueError("more than 1000 simulators")
    names = [f"_v{i}" for i in range(len(sims))]

    def draws(df: DataFrame, fold: str, name: str, at: int) -> DataFrame:
        inside = df.join(folds.filter(F.col("fold") == fold).select(user), user, "left_semi")
        wide = inside.groupBy(user).agg(*[F.avg(F.when(F.col(sim) == s, F.col(value))).alias(n) for s, n in zip(sims, names, strict=True)]).withColumn("_all", F.lit(1))
        m = resampled(wide, ["_all"], names, n_resamples, seed + at)
        return m.select("_draw", F.posexplode(F.array(*names)).alias("_i", name))

    out = None
    for at, (source, target) in enumerate((("A", "B"), ("B", "A"))):
        both = draws(selector, source, "x", 2 * at).join(draws(outcome, target, "y", 2 * at + 1), ["_draw", "_i"])
        t = kendall(both, ["_draw"], "_i", "x", "y")
        tail = F.percentile(F.when(F.col("_draw") > 0, F.col("tau_b")), F.array(F.lit(0.025), F.lit(0.975)))
        one = t.agg(F.max(F.when(F.col("_draw") == 0, F.col("tau_b"))).alias("point"), tail.alias("_t")).select(F.lit(f"{source} to {target}").alias("direction"), "point", F.col("_t")[0].alias("low"), F.col("_t")[1].alias("high"))
        out = one if out is None else out.unionByName(one)
    return out


def halves(rows: DataFrame, user: str, order: list[str]) -> DataFrame:
    """Adds half: a person's first, third, ... row is odd, the others are even."""
    return rows.withColumn("half", F.when(F.row_number().over(Window.partitionBy(user).orderBy(*order)) % 2 == 1, "odd").otherwise("even"))


def people_by_half(rows: DataFrame, sim: str, user: str, selector: str, outcome: str) -> DataFrame:
    """sim, user, direction, x (mean of the selector over one half of a person's rows), y (mean of the outcome over the other half). rows: with half.
    People without rows in a half have no row in either direction."""
    at = lambda c, h: F.avg(F.when(F.col("half") == h, F.col(c)))
    g = rows.groupBy(sim, user).agg(at(selector, "odd").alias("_so"), at(selector, "even").alias("_se"), at(outcome, "odd").alias("_oo"), at(outcome, "even").alias("_oe"))
    ways = F.explode(F.array(F.struct(F.lit("odd to even").alias("direction"), F.col("_so").alias("x"), F.col("_oe").alias("y")), F.struct(F.lit("even to odd").alias("direction"), F.col("_se").alias("x"), F.col("_oo").alias("y"))))
    return g.select(sim, user, ways.alias("_w")).select(sim, user, "_w.*").filter("x is not null and y is not null")


def odd_even(rows: DataFrame, sim: str, user: str, selector: str, outcome: str) -> DataFrame:
    """R4: sim, direction, n people, spearman (null for fewer than three people or where a side is constant)."""
    s = spearman(people_by_half(rows, sim, user, selector, outcome), [sim, "direction"], "x", "y")
    return s.withColumn("spearman", F.when(F.col("n") >= 3, F.nanvl("spearman", F.lit(None).cast("double"))))


def odd_even_interval(rows: DataFrame, sim: str, user: str, selector: str, outcome: str, n_resamples: int = 2000, seed: int = 0, per_task: int = 200) -> DataFrame:
    """sim, direction, low, high of the rank correlation over resampled people. Draws are dealt over tasks; each holds the people of one simulator, at most
    MOST_PEOPLE (more is an error: ranks of a resample need all of them). Resamples in which a side is constant are skipped."""
    people = people_by_half(rows, sim, user, selector, outcome)
    packed = people.groupBy(sim, "direction").agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(F.struct("x", "y"))).alias("_p"))
    packed = packed.select(sim, "direction", F.when(F.col("_n") <= MOST_PEOPLE, F.col("_p")).otherwise(F.raise_error(F.lit(f"more than {MOST_PEOPLE} people"))).alias("_p"))
    dealt = packed.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit((n_resamples - 1) // per_task)))).repartition(sim, "direction", "_b")

    def ranks(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Mean ranks of values that occur w times."""
        values, at = np.unique(v, return_inverse=True)
        count = np.bincount(at, weights=w, minlength=len(values))
        return (np.cumsum(count) - count / 2 + 0.5)[at]

    def run(batches):
        for pdf in batches:
            out = []
            for s, d, p, b in zip(pdf[sim], pdf["direction"], pdf["_p"], pdf["_b"], strict=True):
                x, y = np.array([r["x"] for r in p]), np.array([r["y"] for r in p])
                for i in range(int(b) * per_task, min(n_resamples, (int(b) + 1) * per_task)):
                    w = np.random.default_rng([seed, i]).multinomial(len(x), np.full(len(x), 1 / len(x))).astype(float)
                    rx, ry = ranks(x, w), ranks(y, w)
                    mx, my = np.average(rx, weights=w), np.average(ry, weights=w)
                    vx, vy = np.average((rx - mx) ** 2, weights=w), np.average((ry - my) ** 2, weights=w)
                    if vx > 1e-12 and vy > 1e-12:
                        out.append((s, d, float(np.average((rx - mx) * (ry - my), weights=w) / np.sqrt(vx * vy))))
            yield pd.DataFrame(out, columns=[sim, "direction", "r"])

    kind = dict(people.dtypes)[sim]
    drawn = dealt.mapInPandas(run, f"`{sim}` {kind}, direction string, r double")
    got = drawn.groupBy(sim, "direction").agg(F.percentile("r", F.array(F.lit(0.025), F.lit(0.975))).alias("_t"))
    return got.select(sim, "direction", F.col("_t")[0].alias("low"), F.col("_t")[1].alias("high"))


def form_readout(rows: DataFrame, sim: str, user: str, p3: str, p4: str, intervals: bool = True, n_resamples: int = 10_000) -> DataFrame:
    """R5: sim, contrast, n_units, point over people, of the probabilities that both arms' samples give the label that came true: delta = ln p3 - ln p4 (below 0:
    one's own information helps) and afc = the share of rows on which p4 is the smaller (ties count half; chance is 0.5). With intervals low, high, p_below_zero."""
    log = lambda p: F.log(F.greatest(F.col(p), F.lit(1e-12)))
    people = rows.groupBy(sim, user).agg(F.avg(log(p3) - log(p4)).alias("delta"), F.avg(two_afc(p4, p3)).alias("afc"))
    long = people.select(sim, F.explode(F.array(*[F.struct(F.lit(n).alias("contrast"), F.col(n).alias("v")) for n in ("delta", "afc")])).alias("x")).select(sim, "x.*")
    if intervals:
        return bootstrap_ci(long, [sim, "contrast"], "v", n_resamples)
    return long.groupBy(sim, "contrast").agg(F.count("v").alias("n_units"), F.avg("v").alias("point"))
