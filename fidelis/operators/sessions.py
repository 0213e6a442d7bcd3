"""Ordered events: sessions, dwell times, splits, and the windows that share one partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelis.operators.settle import ranged


def by_user(user: str, *order: str):
    return Window.partitionBy(user).orderBy(*order)


def decisions(df: DataFrame, user: str, order: list[str]) -> DataFrame:
    """Adds t: the 0-based place of a row in its user's history. Order must be total."""
    return df.withColumn("t", (F.row_number().over(by_user(user, *order)) - 1).cast("long"))


def with_sessions(df: DataFrame, user: str, start: str, gap: float, end: str | None = None, tie: str = "t") -> DataFrame:
    """Adds session (0-based) and session_pos. A session opens where start - end of the row before >= gap; start and end in seconds."""
    w = by_user(user, start, tie)
    new = F.when(F.lag(F.col(end or start)).over(w).isNull(), 0).when(F.col(start) - F.lag(F.col(end or start)).over(w) >= gap, 1).otherwise(0)
    out = df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")
    return out.withColumn("session_pos", (F.row_number().over(Window.partitionBy(user, "session").orderBy(start, tie)) - 1).cast("long"))


def dwell(start: str, partition: list[str], order: list[str]) -> Column:
    """Seconds since the row before in its partition; null for the first."""
    return F.col(start) - F.lag(start).over(Window.partitionBy(*partition).orderBy(*order))


def player_stats(df: DataFrame, user: str, start: str, session: str = "session") -> DataFrame:
    """n, sessions and span in days of each user; rows without a start count in n alone."""
    timed = F.col(start).isNotNull()
    return df.groupBy(user).agg(
        F.count(F.lit(1)).alias("n_games"),
        F.countDistinct(F.when(timed, F.col(session))).alias("n_sessions"),
        F.when(F.count(start) >= 2, (F.max(start) - F.min(start)) / 86400).otherwise(0.0).alias("span_days"),
    )


def session_split(df: DataFrame, user: str, frac: float = 0.7) -> DataFrame:
    """user, n, k: rows with t < k are for training. The edge of a session near frac of the sessions; with one session frac of the rows.
    Rounding is half to even."""
    half_even = lambda c: F.bround(c, 0).cast("long")
    sizes = df.groupBy(user).agg(F.count(F.lit(1)).alias("n"), (F.max("session") + 1).alias("s"))
    cut = F.greatest(F.lit(1), F.least(F.col("s") - 1, half_even(F.lit(frac) * F.col("s"))))
    starts = df.groupBy(user, "session").agg(F.min("t").alias("_first"))
    edge = starts.join(sizes.withColumn("_cut", cut), user).filter(F.col("session") == F.col("_cut")).select(user, "_first")
    whole = F.greatest(F.lit(1), F.least(F.col("n") - 1, half_even(F.lit(frac) * F.col("n"))))
    at_edge = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.col("_first")))
    k = F.when(F.col("n") < 2, F.col("n")).when(F.col("s") < 2, whole).otherwise(at_edge)
    return sizes.join(edge, user, "left").select(user, "n", k.cast("long").alias("k"))


def with_split(df: DataFrame, user: str, frac: float = 0.7) -> DataFrame:
    """Rows with n and k of session_split, by windows that share the partitioning by user: no join, no exchange more."""
    w = Window.partitionBy(user)
    half_even = lambda c: F.bround(c, 0).cast("long")
    d = df.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("_s", F.max("session").over(w) + 1)
    cut = F.greatest(F.lit(1), F.least(F.col("_s") - 1, half_even(F.lit(frac) * F.col("_s"))))
    d = d.withColumn("_first", F.min(F.when(F.col("session") == cut, F.col("t"))).over(w))
    inside = lambda c: F.greatest(F.lit(1), F.least(F.col("n") - 1, c))
    k = F.when(F.col("n") < 2, F.col("n")).when(F.col("_s") < 2, inside(half_even(F.lit(frac) * F.col("n")))).otherwise(inside(F.col("_first")))
    return d.withColumn("k", k.cast("long")).drop("_s", "_first")


def first_seen_split(df: DataFrame, user: str, session_key: str, frac: float = 0.7) -> DataFrame:
    """user, n, k: rows of the first max(1, round(frac * sessions)) sessions by first appearance; one session: round(frac * n)."""
    seen = df.groupBy(user, session_key).agg(F.min("t").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    ranked = seen.withColumn("_rank", F.row_number().over(Window.partitionBy(user).orderBy("_first"))).withColumn("_s", F.count(F.lit(1)).over(Window.partitionBy(user)))
    keep = F.greatest(F.lit(1.0), F.bround(F.lit(frac) * F.col("_s"), 0))
    return ranked.groupBy(user).agg(
        F.sum("_rows").alias("n"), F.when(F.max("_s") < 2, F.bround(F.lit(frac) * F.sum("_rows"), 0)).otherwise(F.sum(F.when(F.col("_rank") <= keep, F.col("_rows")).otherwise(0))).cast("long").alias("k")
    )


def tertile(order: list, n_bins: int = 3, partition: list[str] | None = None) -> Column:
    """least(n_bins - 1, rank * n_bins div n) over users in this order: one row per user meets in the window."""
    w = Window.partitionBy(*(partition or [F.lit(1)]))
    rank = F.row_number().over(w.orderBy(*order)) - 1
    return F.least(F.lit(n_bins - 1), F.floor(rank * n_bins / F.count(F.lit(1)).over(w))).cast("long")


def with_tertile(df: DataFrame, order: list[str], name: str, n_bins: int = 3) -> DataFrame:
    """Adds least(n_bins - 1, rank * n_bins div n) over all rows in this total order: ranks within ranges plus what stands before them, so no task holds all rows."""
    r = ranged(df, order)
    sizes = r.groupBy("_p").agg(F.count(F.lit(1)).alias("_rows"))
    w = Window.orderBy("_p")  # one row per range
    before = sizes.select("_p", (F.sum("_rows").over(w) - F.col("_rows")).alias("_before"), F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    out = r.withColumn("_rank", rank).join(F.broadcast(before), "_p")
    return out.withColumn(name, F.least(F.lit(n_bins - 1), F.floor((F.col("_rank") + F.col("_before")) * n_bins / F.col("_all"))).cast("long")).drop("_p", "_rank", "_before", "_all")


def first_rows(df: DataFrame, partition: list[str], order: list, n: int = 1) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def until_budget(df: DataFrame, partition: list[str], order: list, size: str, budget: int) -> DataFrame:
    """Rows from the first in this order on while their sizes sum to at most budget."""
    run = F.sum(size).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_run", run).filter(F.col("_run") <= budget).drop("_run")
