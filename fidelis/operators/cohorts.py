"""Cohorts, reused arms, samples and records of decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelis.operators.arms import seeded
from fidelis.operators.features import memory_row


def united(parts: list[tuple[str, DataFrame]], name: str = "cohort") -> DataFrame:
    """All rows of all cohorts with the cohort's name and its place in the list (_place). Columns that a cohort lacks are null."""
    tagged = [df.withColumn(name, F.lit(n)).withColumn("_place", F.lit(i)) for i, (n, df) in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def earliest_cohort(rows: DataFrame, user: str) -> DataFrame:
    """Rows of united cohorts whose user is not in a cohort before: a user stays in the first one alone."""
    first = rows.groupBy(user).agg(F.min("_place").alias("_first"))
    return rows.join(first, user).filter("_place = _first").drop("_first")


def dropped(rows: DataFrame, user: str, name: str = "cohort") -> DataFrame:
    """cohort, users, kept: distinct users of each cohort, and how many of them stay."""
    first = rows.groupBy(user).agg(F.min("_place").alias("_first"))
    each = rows.select(user, name, "_place").distinct().join(first, user)
    return each.groupBy(name).agg(F.count(F.lit(1)).alias("users"), F.count_if(F.col("_place") == F.col("_first")).alias("kept"))


def reused_arm(scores: DataFrame, keys: list[str], config: str, source: str, arm: str, arms: list[str], value: str) -> DataFrame:
    """keys, config and one column per arm, where `arm` comes from the config `source` for all of them: it does not depend on the config. Keys that the source lacks are left out."""
    shared = scores.filter((F.col(config) == source) & (F.col("arm") == arm)).select(*keys, F.col(value).alias(arm))
    others = [a for a in arms if a != arm]
    wide = scores.filter(F.col("arm").isin(others)).groupBy(*keys, config).pivot("arm", others).agg(F.avg(value))
    return wide.join(shared, keys)


def few_shot(df: DataFrame, user: str, key: str, n: int = 4, seed: int = 7) -> DataFrame:
    """The first n of each user's rows in seeded order, with shot: the place in that order."""
    w = Window.partitionBy(user).orderBy(seeded(key, seed), key)
    return df.withColumn("shot", F.row_number().over(w)).filter(F.col("shot") <= n)


def label_order(label: str, labels: list[str]) -> Column:
    """0-based place of a label in a closed list; a label outside it is an error at run time, null stays null."""
    at = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)) - 1
    return F.when(at < 0, F.raise_error(F.concat(F.lit("unknown label "), F.col(label))).cast("long")).otherwise(at)


def top_pick(df: DataFrame, by: list[str], key: str, selector: str, gain: str) -> DataFrame:
    """by, pick (least selector, ties by key) and rank: its place by falling gain, 1 is best, ties by key."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(gain), key))
    return df.withColumn("_rank", rank).groupBy(*by).agg(F.min_by(F.struct(key, "_rank"), F.struct(selector, key)).alias("_x")).select(*by, F.col("_x")[key].alias("pick"), F.col("_x._rank").alias("rank"))


def shortest_items(df: DataFrame, user: str, size: str, key: str, most_size: int = 300_000, most_users: int = 140) -> DataFrame:
    """Each user's shortest row within most_size, of the most_users users for whom it is shortest: a readout on a slice."""
    one = df.filter((F.col(size) > 0) & (F.col(size) <= most_size)).groupBy(user).agg(F.min(F.struct(size, key)).alias("_x"))
    return one.select(user, F.col("_x")[key].alias(key), F.col("_x")[size].alias(size)).orderBy(size, key).limit(most_users)


def paired_shift(df: DataFrame, by: list[str], old: str, new: str) -> DataFrame:
    """by, n, old, new, shift (means over users with both) and turned: whether the sign of the mean changes."""
    both = df.filter(F.col(old).isNotNull() & F.col(new).isNotNull())
    m = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(old).alias("old"), F.avg(new).alias("new"), F.avg(F.col(new) - F.col(old)).alias("shift"))
    return m.withColumn("turned", F.signum("old") != F.signum("new"))


def pooled_stream(df: DataFrame, group: str, user: str, t: str, k: str, value: str, seed: int = 0) -> DataFrame:
    """group, t, user, value: at every step the training row of one member, drawn in seeded order among those that have one."""
    pick = F.min_by(F.struct(F.col(user).alias("u"), F.col(value).alias("v")), F.struct(F.md5(F.concat_ws("|", F.lit(seed), F.col(t), F.col(user))), F.col(user)))
    return df.filter(F.col(t) < F.col(k)).groupBy(group, t).agg(pick.alias("_x")).select(group, t, F.col("_x.u").alias(user), F.col("_x.v").alias(value))


def pooled_memory(df: DataFrame, group: str, user: str, t: str, k: str, y: str, difficulty: str, seed: int = 0) -> DataFrame:
    """group, t and the ten features of a memory that learns from the pooled stream: at every step the training answer of one member, drawn as in pooled_stream."""
    both = df.withColumn("_both", F.struct(F.col(y).alias("y"), F.col(difficulty).alias("d")))
    s = pooled_stream(both, group, user, t, k, "_both", seed).select(group, t, F.col("_both.y").alias(y), F.col("_both.d").alias(difficulty))
    return memory_row(s, group, [t], y, difficulty).drop(y, difficulty)


def card(n: Column, mean: Column) -> Column:
    """The text of a numeric state; without history that of the neutral one. Hundredths are rounded half to even."""
    return F.when(n > 0, F.format_string("events %d; mean %.2f", n, F.rint(mean * 100) / 100)).otherwise(F.lit("no history"))


def records(rows: DataFrame, cells: DataFrame, value: str, label: str, user: str = "user_id", t: str = "t", k: str = "k") -> DataFrame:
    """user, t, part, label and the cards of each decision: self (all rows before it), frozen (training rows before it), group (training rows of the cell),
    placebo (the donor's state at the same step, at most its last training row). part: train before k, else eval. Users who are their own donor have no record. Means are sums of values in
ten-thousandths, so that texts do not depend on the order of addition."""
    exact = lambda c: F.sum(c.cast("decimal(20,4)"))
    before = Window.partitionBy(user).orderBy(t).rowsBetween(Window.unboundedPreceding, -1)
    trained = F.when(F.col(t) < F.col(k), F.col(value))
    s = rows.select(user, t, k, label, value).withColumn("_n", F.count(value).over(before)).withColumn("_m", F.try_divide(exact(F.col(value)).over(before).cast("double"), F.col("_n"))).withColumn("_fn", F.count(trained).over(before)).withColumn("_fm", F.try_divide(exact(trained).over(before).cast("double"), F.col("_fn")))
    j = s.join(cells.filter(F.col("donor") != F.col(user)).select(user, "cell", "donor"), user)
    group = j.filter(F.col(t) < F.col(k)).groupBy("cell").agg(F.count(value).alias("_gn"), F.try_divide(exact(F.col(value)).cast("double"), F.count(value)).alias("_gm"))
    end = rows.groupBy(F.col(user).alias("donor")).agg(F.max(k).alias("_end"))
    state = s.select(F.col(user).alias("donor"), F.col(t).alias("_at"), F.col("_fn").alias("_dn"), F.col("_fm").alias("_dm"))
    j = j.join(group, "cell").join(end, "donor").withColumn("_at", F.least(F.col(t), F.col("_end") - 1)).join(state, ["donor", "_at"])
    return j.select(user, t, F.when(F.col(t) < F.col(k), "train").otherwise("eval").alias("part"), label, card(F.col("_n"), F.col("_m")).alias("self_card"), card(F.col("_fn"), F.col("_fm")).alias("frozen_card"), card(F.col("_gn"), F.col("_gm")).alias("group_card"), card(F.col("_dn"), F.col("_dm")).alias("placebo_card"))
