"""Contracts between tables: digests of ordered rows, keys that must agree, and the trial table that rests on both.

Checks run inside the job that uses the rows: a broken contract raises an error where the rows are made, and no job of its own
looks for it. An Observation that the caller passes in counts what was seen, in the same job too.

A digest names the rows of a group and their order. Every row is hashed together with its place, the hashes are summed in four
parts of sixty bits, and the sums and the count are hashed once more. Sums of ranges compose, so rows lie in any number of tasks
and any order; only the places follow the order. Two groups have one digest if they hold the same rows in the same order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fidelis.operators.folds import places
from fidelis.operators.inference import bootstrap_ci

PARTS = 4


def row_name(columns: list[str]) -> Column:
    """The values of a row in one string that no other values give: each with its length, null apart. Of texts any length."""
    return F.concat(*[F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns])


def row_digests(df: DataFrame, by: str, order: list[str], columns: list[str], at: str | None = None) -> DataFrame:
    """by, n_rows, digest of the rows of each group in this total order. at: a column with the 0-based places, where they are known.

    Columns are compared as strings: take integers, strings and dates. by may be null, which is a group."""
    rows = df if at else places(df.select(*dict.fromkeys([by, *order, *columns])), by, order, "_at")
    h = F.sha2(F.concat(F.col(at or "_at").cast("string"), F.lit("|"), row_name(columns)), 256)
    part = lambda i: F.conv(F.substring("_h", 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")
    sums = rows.select(by, h.alias("_h")).groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(part(i)).alias(f"_s{i}") for i in range(PARTS)])
    return sums.select(by, "n_rows", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(PARTS)]), 256).alias("digest"))


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, of which each key has one row; two rows with a key are an error where they meet. Null is a key. Costs the shuffle by key that a join needs anyway."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(F.lit(1).alias("_one"), *rest)).alias("_r"))
    said = F.concat(F.lit("repeated key "), F.to_json(F.struct(*keys)))
    return g.select(*keys, F.when(F.col("_n") == 1, F.col("_r")).otherwise(F.raise_error(said)).alias("_r")).select(*keys, "_r.*").drop("_one").select(*df.columns)


def covering(left: DataFrame, right: DataFrame, keys: list[str], observed: Observation | None = None, strict: bool = True) -> DataFrame:
    """left and right joined on keys that must be the same on both sides; a null equals a null.

    strict: a key of one side alone is an error. Otherwise such keys are left out, and counted. observed gets both, left_only and right_only."""
    l = left.select(*[F.col(c) for c in left.columns], F.lit(True).alias("_l"))
    names = [c for c in right.columns if c not in keys]
    r = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *names, F.lit(True).alias("_r"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    j = l.join(r, on, "full_outer")
    if observed is not None:
        j = j.observe(observed, F.count_if(F.col("_l") & F.col("_r")).alias("both"), F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"))
    side = F.when(F.col("_l").isNull(), "right").otherwise("left")
    said = F.concat(F.lit("key on the "), side, F.lit(" side alone: "), F.to_json(F.struct(*[F.coalesce(k, f"_k_{k}").alias(k) for k in keys])))
    both = F.col("_l") & F.col("_r")
    checked = j.filter(F.coalesce(both, F.raise_error(said).cast("boolean") if strict else F.lit(False)))
    return checked.select(*left.columns, *names)


def trial_table(scores: DataFrame, sim: str, user: str, order: list[str], arm: str, value: str, expected: str, intervals: bool = True, n_resamples: int = 10_000) -> DataFrame:
    """sim, n_users, n_rows, row_digest and the means over users of A4 - A3 (d_indiv) and A4 - A0 (d_total), with intervals if asked for.

    scores: one row per sim, user, order (the rows' keys within a user, in order) and arm. The rows of every simulator and arm must be those of the
    simulator `expected`, by digest; another digest is an error where the table is made."""
    rows = scores.filter(F.col(arm).isin("A0", "A3", "A4")).withColumn("_g", F.concat_ws("|", sim, arm))
    d = row_digests(rows, "_g", [user, *order], [user, *order]).select(F.substring_index("_g", "|", -1).alias("_arm"), F.expr("substr(_g, 1, length(_g) - length(substring_index(_g, '|', -1)) - 1)").alias(sim), "n_rows", "digest")
    right = d.filter((F.col(sim) == expected) & (F.col("_arm") == "A4")).select(F.col("digest").alias("_want"))
    checked = d.crossJoin(F.broadcast(right)).groupBy(sim).agg(F.max("n_rows").alias("n_rows"), F.max("_want").alias("row_digest"), F.bool_and(F.col("digest") == F.col("_want")).alias("_same"), F.count(F.lit(1)).alias("_arms"))
    said = F.concat(F.col(sim), F.lit(": scored rows differ from those of "), F.lit(expected))
    checked = checked.select(sim, "n_rows", F.when(F.col("_same") & (F.col("_arms") == 3), F.col("row_digest")).otherwise(F.raise_error(said)).alias("row_digest"))
    mean = lambda a: F.avg(F.when(F.col(arm) == a, F.col(value)))
    users = rows.groupBy(sim, user).agg((mean("A4") - mean("A3")).alias("d_indiv"), (mean("A4") - mean("A0")).alias("d_total"))
    means = users.groupBy(sim).agg(F.count(F.lit(1)).alias("n_users"), F.avg("d_indiv").alias("d_indiv"), F.avg("d_total").alias("d_total"))
    out = means.join(checked, sim).select(sim, "n_users", "n_rows", "row_digest", "d_indiv", "d_total")
    for c in ("d_indiv", "d_total") if intervals else ():
        ci = bootstrap_ci(users, [sim], c, n_resamples).select(sim, F.col("low").alias(f"{c}_low"), F.col("high").alias(f"{c}_high"))
        out = out.join(ci, sim)
    return out
