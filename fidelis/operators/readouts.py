"""Readouts over scores of simulators, selectors and judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.functions.scalars import softmax
from fidelis.operators.inference import bootstrap_ci, interval, resampled

# Parts of a judgement, and the shares that decide a readout.
DIMENSIONS = ("persona_affect", "linguistic_style", "tech_competency", "interaction_flow", "pacing")
SUPPORT, REFUTE, LEAST_PAIRS = 0.70, 0.50, 10


def seed_means(scores: DataFrame, keys: list[str], seed: str = "seed", value: str = "nll") -> DataFrame:
    """Mean over seeds; seeds that do not cover the same keys raise an error at run time."""
    g = scores.groupBy(*keys).agg(F.avg(value).alias(value), F.countDistinct(seed).alias("_s"))
    most = scores.agg(F.countDistinct(seed).alias("_all"))
    checked = g.crossJoin(F.broadcast(most))
    return checked.select(*keys, F.when(F.col("_s") == F.col("_all"), F.col(value)).otherwise(F.raise_error(F.lit("seeds cover different keys")).cast("double")).alias(value))


def user_arms(scores: DataFrame, arms: list[str], combo: str = "combo", user: str = "player", value: str = "nll") -> DataFrame:
    """combo, user and one column per arm: per-user means of known scores, for users that have every arm."""
    wide = scores.filter(F.col(value).isNotNull()).groupBy(combo, user).pivot("arm", arms).agg(F.avg(value))
    return wide.dropna(subset=arms)


def pair_readout(users: DataFrame, selector: DataFrame, n_resamples: int = 10_000) -> DataFrame:
    """left, right, resolvable, agreement for all pairs of simulators. users: sim, user_id, delta; selector: sim, score.

    A pair is resolvable if the interval of its paired difference excludes 0; it agrees if the selector prefers the same one."""
    sims = selector.select("sim", "score")
    a, b = users.select(F.col("sim").alias("left"), "user_id", F.col("delta").alias("_l")), users.select(F.col("sim").alias("right"), "user_id", F.col("delta").alias("_r"))
    paired = a.join(b, "user_id").filter("left < right").select("left", "right", (F.col("_l") - F.col("_r")).alias("d"))
    ci = bootstrap_ci(paired, ["left", "right"], "d", n_resamples=n_resamples)
    s = ci.join(sims.select(F.col("sim").alias("left"), F.col("score").alias("_sl")), "left").join(sims.select(F.col("sim").alias("right"), F.col("score").alias("_sr")), "right")
    resolvable = (F.col("high") < 0) | (F.col("low") > 0)
    same = F.signum(F.col("_sl") - F.col("_sr"))
    return s.select("left", "right", F.col("point").alias("difference"), "low", "high", resolvable.alias("resolvable"), (resolvable & (same != 0) & (same == F.signum("point"))).alias("agreement"))


def classify(pairs: DataFrame) -> DataFrame:
    """n_resolvable, n_agree, share, verdict."""
    c = pairs.agg(F.count_if("resolvable").alias("n_resolvable"), F.count_if("agreement").alias("n_agree"))
    share = F.try_divide("n_agree", "n_resolvable")
    verdict = F.when(F.col("n_resolvable") < LEAST_PAIRS, "underpowered").when(share >= SUPPORT, "support").when(share <= REFUTE, "refute").otherwise("inconclusive")
    return c.select("*", share.alias("share"), verdict.alias("verdict"))


def judgements(bodies: DataFrame, key: str = "custom_id", body: str = "body") -> DataFrame:
    """candidate, arm, key, match fields, fidelity_index, alignment, normalised, error of judge responses in JSON. Flat answers are accepted; what does not parse has an error and nulls."""
    schema = "output array<struct<type:string,content:array<struct<type:string,text:string,refusal:string>>>>"
    messages = F.filter(F.from_json(body, schema)["output"], lambda o: o["type"] == "message")
    content = F.flatten(F.transform(messages, lambda o: o["content"]))
    said = F.get(F.filter(content, lambda c: c["type"] == "output_text"), F.lit(0))["text"]
    refusal = F.get(F.filter(content, lambda c: c["type"] == "refusal"), F.lit(0))["refusal"]
    flags = ", ".join(f"{d} boolean" for d in DIMENSIONS)
    inner = ",".join(f"{d}:boolean" for d in DIMENSIONS)
    rows = bodies.select(F.split_part(key, F.lit("::"), F.lit(1)).alias("candidate"), F.split_part(key, F.lit("::"), F.lit(2)).alias("arm"), F.split_part(key, F.lit("::"), F.lit(3)).alias("key"), F.from_json(said, f"match struct<{inner}>, alignment double, alignment_score double, {flags}").alias("p"), refusal.alias("_refusal"), said.alias("_said"))
    fields = [F.coalesce(F.col("p.match")[d], F.col("p")[d]) for d in DIMENSIONS]
    complete = fields[0].isNotNull()
    for f in fields[1:]:
        complete = complete & f.isNotNull()
    alignment = F.coalesce("p.alignment", "p.alignment_score")
    index = sum((f.cast("int") for f in fields), F.lit(0)) / len(DIMENSIONS)
    error = F.when(F.col("_refusal").isNotNull(), F.concat(F.lit("refusal: "), F.col("_refusal"))).when(F.col("_said").isNull(), "no output").when(~complete | alignment.isNull(), "incomplete")
    return rows.select("candidate", "arm", "key", *[f.alias(d) for f, d in zip(fields, DIMENSIONS, strict=True)], index.alias("fidelity_index"), alignment.alias("alignment"), (F.col("p.match").isNull() & complete).alias("normalised"), error.alias("error"))


def missing_judgements(expected: DataFrame, seen: DataFrame) -> DataFrame:
    return expected.join(seen.filter("error is null").select("candidate", "arm", "key"), ["candidate", "arm", "key"], "left_anti")


def empty_rates(samples: DataFrame, cap: int = 96) -> DataFrame:
    """Per simulator and arm: n, samples that ended at once, with at most one token, at the cap."""
    return samples.groupBy("sim", "arm").agg(F.count(F.lit(1)).alias("n"), F.count_if("terminal").alias("n_terminal"), F.count_if(F.col("generated_tokens") <= 1).alias("n_empty"), F.count_if(F.col("generated_tokens") == cap).alias("n_cap"))


def form_histogram(samples: DataFrame, by: list[str], label: str, labels: list) -> DataFrame:
    """by and one smoothed share per label: (count + 0.5) / (n + labels / 2)."""
    return samples.groupBy(*by).agg(*[((F.count_if(F.col(label) == x) + 0.5) / (F.count(F.lit(1)) + 0.5 * len(labels))).alias(f"p_{x}") for x in labels])


def option_user_totals(options: DataFrame, arm: str = "arm", user: str = "player") -> DataFrame:
    """Per user, arm and label: n rows, right answers, label count and summed probability: all that a weighted resample needs. options: logp array, label_idx."""
    p = softmax("logp")
    hit = (F.array_position("logp", F.array_max("logp")) - 1 == F.col("label_idx")).cast("int")
    e = options.select(user, arm, "label_idx", hit.alias("_hit"), F.posexplode(p).alias("label", "_p"))
    return e.groupBy(user, arm, "label").agg(F.count(F.lit(1)).alias("n"), F.sum("_hit").alias("hits"), F.count_if(F.col("label") == F.col("label_idx")).alias("n_label"), F.sum("_p").alias("p_sum"))


def pooled_gains(totals: DataFrame, better: str, worse: str, arm: str = "arm", user: str = "player", n_resamples: int = 2000, seed: int = 0) -> DataFrame:
    """metric, point, low, high: accuracy and total-variation gain of arm `better` over `worse`. A user is one row of totals per arm and label, and is resampled
    whole; labels (a closed list) are read by the driver. A user without an arm counts 0 there."""
    labels, parts = sorted(r[0] for r in totals.select("label").distinct().collect()), ("n", "hits", "n_label", "p_sum")
    name = lambda a, x, c: f"_{(worse, better).index(a)}_{x}_{c}"
    at = {name(a, x, c): F.coalesce(F.sum(F.when((F.col(arm) == a) & (F.col("label") == x), F.col(c))), F.lit(0)).cast("double") for a in (better, worse) for x in labels for c in parts}
    users = totals.filter(F.col(arm).isin(better, worse)).groupBy(user).agg(*[v.alias(k) for k, v in at.items()]).withColumn("_all", F.lit(1))
    m = resampled(users, ["_all"], list(at), n_resamples, seed)
    total = lambda a, c: sum((F.col(name(a, x, c)) for x in labels), F.lit(0.0))
    accuracy = lambda a: F.try_divide(total(a, "hits"), total(a, "n"))
    tvd = lambda a: F.try_divide(sum((F.abs(F.col(name(a, x, "n_label")) - F.col(name(a, x, "p_sum"))) for x in labels), F.lit(0.0)) * len(labels) / 2, total(a, "n"))
    gains = F.array(F.struct(F.lit("accuracy").alias("metric"), (accuracy(better) - accuracy(worse)).alias("_g")), F.struct(F.lit("tvd").alias("metric"), (tvd(worse) - tvd(better)).alias("_g")))
    each = m.select("_draw", F.explode(gains).alias("_x")).select("_draw", "_x.*")
    got = each.groupBy("metric").agg(F.max(F.when(F.col("_draw") == 0, F.col("_g"))).alias("point"), interval("_g").alias("_i"))
    return got.select("metric", "point", F.col("_i")[0].alias("low"), F.col("_i")[1].alias("high"))


def marginal_residual(model: DataFrame, marginal: DataFrame, user: str = "player") -> DataFrame:
    """Mean over users of the model's own - donor difference less the marginal's. model: a3, a4f; marginal: own, other."""
    j = model.join(marginal, user)
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("a4f") - F.col("a3")).alias("model"), F.avg(F.col("own") - F.col("other")).alias("marginal"), F.avg((F.col("a4f") - F.col("a3")) - (F.col("own") - F.col("other"))).alias("residual"))


def gain_flags(low: str = "low", high: str = "high") -> tuple[Column, Column]:
    """Favourable and adverse: the interval lies strictly below or above 0."""
    return F.col(high) < 0, F.col(low) > 0


def gains_table(ci: DataFrame) -> DataFrame:
    """Counts of favourable and adverse combinations per dataset and in all."""
    fav, adv = gain_flags()
    return ci.rollup("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if(fav).alias("favourable"), F.count_if(adv).alias("adverse")).select(F.coalesce("dataset", F.lit("all")).alias("dataset"), "n", "favourable", "adverse")


def report_intervals(ci: DataFrame) -> DataFrame:
    """Gains for reports: signs turned, interval ends exchanged."""
    return ci.select(*[c for c in ci.columns if c not in ("point", "low", "high")], (-F.col("point")).alias("point"), (-F.col("high")).alias("low"), (-F.col("low")).alias("high"))
