"""Causal features: what is known before each decision. All windows share one partitioning and order, so one exchange serves them."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelis.functions.scalars import NEUTRAL_ELO
from fidelis.operators.sessions import by_user


def before(user: str, order: list[str], n: int | None = None):
    """The rows before this one, or the last n of them."""
    return by_user(user, *order).rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def with_ewma(df: DataFrame, x: str, user: str | list[str], order: list[str], name: str, decay: float = 0.9, start: float = 0.5) -> DataFrame:
    """Adds name: the moving average before each row; start where there is no row before."""
    out = in_blocks(df, user, order)
    return with_ewmas(out, user, order, {name: (x, start)}, decay).drop("_at", "_block")


def in_blocks(df: DataFrame, user: str | list[str], order: list[str]) -> DataFrame:
    """Adds _at, the 1-based place of a row in its stream, and _block, a thousand places each. Blocks follow the order, so windows ordered by (_block, order)
    and windows within a block need one sort together."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(user).orderBy(*order))).withColumn("_block", F.floor((F.col("_at") - 1) / 1000))


def with_ewmas(df: DataFrame, user: str | list[str], order: list[str], xs: dict[str, tuple[str, float]], decay: float = 0.9) -> DataFrame:
    """Adds a column per entry of xs (name: value, start) to rows of in_blocks: the moving average of the value before each row."""
    keys = [user] if isinstance(user, str) else user
    w = Window.partitionBy(keys).orderBy("_block", *order)
    here = Window.partitionBy([*keys, "_block"]).orderBy(*order)
    # weights relative to blocks of 1000 rows, so that no power overflows: what older blocks weigh is below 1e-45
    place = F.pmod(F.col("_at") - 1, F.lit(1000)).cast("double")
    weight = F.pow(F.lit(1 / decay), place)
    out = df.withColumns({f"_w_{n}": F.when(F.col("_at") == 1, F.col(x)).otherwise((1 - decay) * F.col(x)) * weight for n, (x, _) in xs.items()})
    out = out.withColumns({f"_in_{n}": F.coalesce(F.sum(f"_w_{n}").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) for n in xs})
    # a block's last row knows the whole block; the next block's first row hands it on to the rest of that block
    out = out.withColumns({f"_old_{n}": F.coalesce(F.lag(F.col(f"_in_{n}") + F.col(f"_w_{n}"), 1).over(w), F.lit(0.0)) for n in xs})
    out = out.withColumns({f"_old_{n}": F.when(F.col("_block") == 0, 0.0).otherwise(F.first(f"_old_{n}").over(here.rowsBetween(Window.unboundedPreceding, 0))) for n in xs})
    value = lambda n: F.col(f"_in_{n}") * F.pow(F.lit(decay), place - 1) + F.col(f"_old_{n}") * F.pow(F.lit(decay), place + 999)
    out = out.withColumns({n: F.when(F.col("_at") == 1, start).otherwise(value(n)) for n, (_, start) in xs.items()})
    return out.drop(*[f"{c}_{n}" for n in xs for c in ("_w", "_in", "_old")])


def memory_row(df: DataFrame, user: str | list[str], order: list[str], y: str, difficulty: str) -> DataFrame:
    """Ten features of a response stream before each row: y in {0, 1}, difficulty in [0, 1]. user: the columns that name a stream.

    Runs of equal answers follow from the places where they begin, so every window has the same order: rows are sorted twice, once for their places."""
    keys = [user] if isinstance(user, str) else user
    w = Window.partitionBy(keys).orderBy("_block", *order)
    prior, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    rows = in_blocks(df, user, order).withColumn("_res", F.col(y) - (1 - F.col(difficulty))).withColumn("_y", F.col(y).cast("double"))
    rows = with_ewmas(rows, user, order, {"f_ewma": ("_y", 0.5), "f_res_ewma": ("_res", 0.0)})
    rows = rows.withColumn("_before", F.lag(y).over(w))
    rows = rows.withColumn("_begins", F.when(F.col("_before").isNull() | (F.col("_before") != F.col(y)), F.col("_at")))
    rows = rows.withColumn("_first", F.last("_begins", ignorenulls=True).over(upto)).withColumn("_len", F.col("_at") - F.col("_first") + 1)
    # runs of equal answers; a right answer after one single wrong one starts at 0
    rows = rows.withColumn("_single", F.when(F.col("_begins").isNotNull(), (F.col("_before") == 0) & (F.lag("_len").over(w) == 1)))
    rows = rows.withColumn("_single", F.coalesce(F.last("_single", ignorenulls=True).over(upto), F.lit(False)))
    rows = rows.withColumn("_streak", F.when(F.col(y) == 1, F.col("_len") - F.when(F.col("_single"), 1).otherwise(0)).otherwise(-F.col("_len")))
    return rows.select(
        *df.columns,
        (F.log1p(F.col("_at") - 1) / 6).alias("f_volume"),
        F.coalesce(F.avg("_y").over(prior), F.lit(0.5)).alias("f_mean"),
        "f_ewma",
        F.coalesce(F.avg("_y").over(w.rowsBetween(-10, -1)), F.lit(0.5)).alias("f_last10"),
        F.coalesce(F.lag("_y").over(w), F.lit(0.0)).alias("f_lag"),
        F.tanh(F.coalesce(F.lag("_streak").over(w), F.lit(0)) / 5).alias("f_streak"),
        F.coalesce(F.avg("_res").over(prior), F.lit(0.0)).alias("f_res_mean"),
        "f_res_ewma",
        F.coalesce(F.lag("_res").over(w), F.lit(0.0)).alias("f_res_lag"),
        F.when(F.col("_at") > 1, 1.0).otherwise(0.0).alias("f_has_history"),
    )


def history_features(df: DataFrame, user: str, order: list[str], won: str, session_pos: str) -> DataFrame:
    """post_loss, fatigue, momentum before each row. won is null for a draw."""
    w, prior = by_user(user, *order), before(user, order)
    rows = df.withColumn("_at", F.row_number().over(w)).withColumn("_lost", F.when(~F.col(won), F.col("_at")))
    since = F.col("_at") - 1 - F.last("_lost", ignorenulls=True).over(prior)
    rate = F.avg(F.col(won).cast("double")).over(before(user, order, 5))
    return rows.select(
        *df.columns,
        F.coalesce(F.greatest(F.lit(0.0), 1 - since / 3), F.lit(0.0)).alias("post_loss"),
        F.least(F.lit(1.0), F.col(session_pos) / 20).alias("fatigue"),
        F.coalesce((rate - 0.5) * 2, F.lit(0.0)).alias("momentum"),
    )


def time_pressure(remaining: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col(remaining) / 30))


def running_row(df: DataFrame, user: str, order: list[str], x: str, quick: float) -> DataFrame:
    """Before each row: exact running median, mean of the last five, last value, share below quick."""
    prior = before(user, order)
    return df.select(
        "*",
        F.percentile(x, F.lit(0.5)).over(prior).alias("r_median"),
        F.avg(x).over(before(user, order, 5)).alias("r_last5"),
        F.lag(x).over(by_user(user, *order)).alias("r_last"),
        F.avg(F.when(F.col(x) < quick, 1.0).otherwise(0.0)).over(prior).alias("r_quick"),
    )


def think_row(df: DataFrame, user: str, order: list[str], spent: str, remaining: str | None = None, elo: str | None = None, fast: float = 2.0, pressure: float = 60.0) -> DataFrame:
    """Before each row: m_has_history, m_elo (null and 0 as 1500), m_median, m_last5, m_last, m_fast (share below `fast`) and m_pressure (mean over rows with less
    than `pressure` left on the clock, the median where there is none yet) of the time spent; all but the rating 0 without history. A null time counts as 0.

    The rows of a user are read once, in order, as a stream; the running median is kept in two heaps of the values so far, so a row costs a logarithm and
    a user eight bytes a row."""
    kinds = dict(df.dtypes)
    names = ["m_has_history", "m_median", "m_last5", "m_last", "m_fast", "m_pressure"]
    keys = list(dict.fromkeys([user, *order]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, low, high, last, n, quick, pressed, held = object(), [], [], [], 0, 0, 0, 0.0
        for pdf in batches:
            out = []
            for u, x, left in zip(pdf[user], pdf["_x"], pdf["_left"], strict=True):
                if u != who:
                    who, low, high, last, n, quick, pressed, held = u, [], [], [], 0, 0, 0, 0.0
                if not n:
                    out.append((0.0,) * 6)
                else:
                    median = float(-low[0]) if n % 2 else (high[0] - low[0]) / 2
                    out.append((1.0, median, sum(last) / len(last), last[-1], quick / n, held / pressed if pressed else median))
                # low: the smaller half, negated; high: the larger half; low has as many values or one more
                heapq.heappush(high, -heapq.heappushpop(low, -x))
                if len(high) > len(low):
                    heapq.heappush(low, -heapq.heappop(high))
                n, quick, last = n + 1, quick + (x < fast), [*last[-4:], x]
                if left < pressure:
                    pressed, held = pressed + 1, held + x
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    left = F.coalesce(F.col(remaining).cast("double"), F.lit(float("inf"))) if remaining else F.lit(float("inf"))
    slim = df.filter(F.col(user).isNotNull()).select(*keys, F.coalesce(F.col(spent).cast("double"), F.lit(0.0)).alias("_x"), left.alias("_left"))
    made = slim.repartition(user).sortWithinPartitions(user, *order).mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", " + ", ".join(f"{c} double" for c in names))
    rating = F.coalesce(F.nullif(F.col(elo).cast("double"), F.lit(0.0)), F.lit(NEUTRAL_ELO)) if elo else F.lit(NEUTRAL_ELO)
    return df.withColumn("m_elo", rating).join(made, keys)


def live_window_rate(df: DataFrame, user: str, order: list[str], y: str, n: int = 40) -> DataFrame:
    """Adds live_p: Laplace rate over the last n rows before, across the split."""
    w = before(user, order, n)
    return df.withColumn("live_p", (F.coalesce(F.sum(y).over(w), F.lit(0)) + 1) / (F.count(y).over(w) + 2))
