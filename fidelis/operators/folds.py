"""Ordered folds of any length as prefix scans: no task holds a user's history, and nothing is cut off.

An update z <- keep * z + (1 - keep) * x is affine, so updates compose: n of them shrink the state before them to keep ** n of
itself and add a sum of their own. Histories are cut into blocks of so many rows that keep ** -rows stays far from overflow.
Rows are shuffled by (user, block), so a long history is spread over tasks. Within a block a running sum of weighted values gives
the block's own part; each full block hands its last state on to the blocks that it can still be felt in, which are a handful
whatever keep is, because a block shrinks a state by 1e-100 and doubles end at 1e-324."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelis.operators.settle import ranged, settle, written

SHRINK = 100 * math.log(10)
SMALLEST = 745.0

# What a note says of a state beyond a threshold. Of one dimension the first that holds is said.
NOTES = (
    ("time_pressure", ">", 0.5, "under time pressure (rushing, more errors likely)"),
    ("post_loss", ">", 0.5, "just lost (may be tilted / over-aggressive)"),
    ("fatigue", ">", 0.5, "deep into the session (fatigued, slower decline)"),
    ("momentum", ">", 0.4, "on a winning streak (confident)"),
    ("momentum", "<", -0.4, "on a losing streak (shaken)"),
)
CALM, NOTE = "composed, near baseline form", "Current player state: {}."


def places(df: DataFrame, user: str, order: list[str], name: str = "t") -> DataFrame:
    """Adds name: the 0-based place of a row among its user's, in this total order. Rows are sorted in ranges; a user may lie in several, each
    counts what the ranges before it hold of that user (a row per range and user)."""
    r = ranged(df, [user, *order], written)
    mine = r.groupBy("_p", F.col(user).alias("_u")).agg(F.count(F.lit(1)).alias("_rows"))
    before = mine.select("_p", "_u", (F.sum("_rows").over(Window.partitionBy("_u").orderBy("_p")) - F.col("_rows")).alias("_before")).filter("_before > 0")
    at = F.row_number().over(Window.partitionBy("_p", user).orderBy(*order)) - 1
    j = r.withColumn(name, at).join(before.withColumnRenamed("_p", "_q"), (F.col("_p") == F.col("_q")) & F.col(user).eqNullSafe(F.col("_u")), "left")
    return j.withColumn(name, (F.col(name) + F.coalesce("_before", F.lit(0))).cast("long")).drop("_p", "_q", "_u", "_before")


def affine_fold(df: DataFrame, user: str, at: str, xs: dict[str, str | Column], keep: float = 0.6, start: float = 0.0) -> DataFrame:
    """Adds a column per entry of xs: the state after each row of z <- keep * z + (1 - keep) * x from start.

    at: the 0-based place of a row in its user's history, without gaps. A null x counts as 0. Rows without a user are left out. 0 < keep < 1."""
    if not 0 < keep < 1:
        raise ValueError("keep must lie between 0 and 1")
    size = max(1, int(SHRINK / -math.log(keep)))
    reach = int(SMALLEST / (size * -math.log(keep))) + 2
    power = lambda n: F.pow(F.lit(keep), n)
    rows = df.filter(F.col(user).isNotNull()).withColumn("_k", F.floor(F.col(at) / size)).withColumn("_i", F.pmod(F.col(at), F.lit(size)).cast("double"))
    rows = settle(rows.withColumns({f"_x_{n}": F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(0)).cast("double") * (1 - keep) * power(-F.col("_i")) for n, x in xs.items()}))
    ends = rows.groupBy(user, "_k").agg(F.count(F.lit(1)).alias("_n"), *[(F.sum(f"_x_{n}") * power(F.lit(size - 1.0))).alias(f"_z_{n}") for n in xs]).filter(F.col("_n") == size)
    felt = ends.withColumn("_m", F.explode(F.sequence(F.lit(1), F.lit(reach))))
    carried = felt.groupBy(user, (F.col("_k") + F.col("_m")).alias("_k")).agg(*[F.sum(F.col(f"_z_{n}") * power(size * (F.col("_m") - 1).cast("double"))).alias(f"_z_{n}") for n in xs])
    run = Window.partitionBy(user, "_k").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({f"_x_{n}": F.sum(f"_x_{n}").over(run) * power(F.col("_i")) for n in xs})
    back = own.join(carried, [user, "_k"], "left")
    after = {n: F.col(f"_x_{n}") + F.coalesce(f"_z_{n}", F.lit(0.0)) * power(F.col("_i") + 1) + (start * power(F.col(at) + 1.0) if start else 0.0) for n in xs}
    return back.withColumns(after).select(*df.columns, *xs)


def state_note(columns: dict[str, str]) -> Column:
    """The state in words. columns: dimension -> column; dimensions that are not given are not spoken of. States are compared at nine decimals, so that one
    that equals a threshold does not depend on the order of additions."""
    said: dict[str, Column] = {}
    for dim, sign, edge, text in NOTES:
        if dim in columns:
            state = F.round(columns[dim], 9)
            holds = state > edge if sign == ">" else state < edge
            said[dim] = said[dim].when(holds, text) if dim in said else F.when(holds, text)
    parts = F.array_compact(F.array(*said.values()))
    head, tail = NOTE.split("{}")
    return F.concat(F.lit(head), F.when(F.size(parts) == 0, CALM).otherwise(F.array_join(parts, "; ")), F.lit(tail))
