"""Resampling inference and rank statistics over per-user values.

Users are the unit. Equal values are counted first, the distinct ones of a combination are dealt into buckets by hash, and every
bucket is resampled in a task of its own; sums per resample are added by Spark. The number of draws that fall into a bucket comes
from one stream that all buckets share, so the whole is the ordinary bootstrap whatever the number of partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidelis.operators.settle import same_keys, settle

PER_TASK = 200_000
BLOCK = 4_000_000


def typed(df: DataFrame, by: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in by)


def dealt(df: DataFrame, by: list[str], values: list[str], per_task: int = PER_TASK) -> DataFrame:
    """by, values as doubles, _c rows that have them, _b bucket of at most about per_task distinct values. Rows with a null value are dropped."""
    rows = df.select(*by, *[F.col(v).cast("double").alias(v) for v in values]).dropna(subset=values)
    c = settle(rows.groupBy(*by, *values).agg(F.count(F.lit(1)).alias("_c")))
    size = c.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / per_task).alias("_m"))
    return same_keys(c, size, by).withColumn("_b", F.pmod(F.xxhash64(*values), F.col("_m")).cast("int")).drop("_m")


def draws(counts: np.ndarray, sizes: np.ndarray, x: np.ndarray, at: int, n_resamples: int, seed: int, bucket: int) -> np.ndarray:
    """Sums of resamples of one bucket, one row per resample. counts: rows per distinct value; sizes: rows per bucket, of which this is number `at`."""
    total = int(sizes.sum())
    fall = np.random.default_rng([seed, 1]).multinomial(total, sizes / total, size=n_resamples)[:, at]
    rng, upto, out, a = np.random.default_rng([seed, 2, bucket]), np.cumsum(counts), np.zeros((n_resamples, x.shape[1])), 0
    per = max(1, BLOCK // max(1, int(fall.max(initial=1))))
    while a < n_resamples:
        k = fall[a : a + per]
        pick = rng.integers(0, upto[-1], int(k.sum()))
        pick = np.searchsorted(upto, pick, side="right") if upto[-1] > len(upto) else pick
        row = np.repeat(np.arange(len(k)), k)
        for j in range(x.shape[1]):
            out[a : a + per, j] = np.bincount(row, weights=x[pick, j], minlength=len(k))
        a += per
    return out


def resampled(df: DataFrame, by: list[str], values: list[str], n_resamples: int, seed: int = 0, per_task: int = PER_TASK) -> DataFrame:
    """by, _draw, _n and the means of the values in each resample with replacement; _draw 0 is the data as they are."""
    c = dealt(df, by, values, per_task)
    per = c.groupBy(*by, "_b").agg(F.sum("_c").alias("_k"))
    sizes = per.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_b", "_k"))).alias("_sizes"))
    each = same_keys(per.select(*by, "_b"), sizes, by).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col("_b").alias("_kb"), F.col("_sizes._b").alias("_bs"), F.col("_sizes._k").alias("_ks"))
    names = [f"_v{j}" for j in range(len(values))]

    def run(rows: pd.DataFrame, size: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(values, kind="stable")
        bucket, bs, ks = int(size["_kb"].iloc[0]), list(size["_bs"].iloc[0]), np.array(size["_ks"].iloc[0])
        x, n = rows[values].to_numpy(float), rows["_c"].to_numpy()
        sums = np.vstack([(x * n[:, None]).sum(0), draws(n, ks, x, bs.index(bucket), n_resamples, seed, bucket)])
        out = pd.DataFrame(sums, columns=names).assign(_draw=np.arange(len(sums)), _n=int(ks.sum()))
        for k in by:
            out[k] = pd.Series([rows[k].iloc[0]] * len(out), dtype=object)
        return out[[*by, "_draw", "_n", *names]]

    schema = f"{typed(df, by)}, _draw int, _n long, " + ", ".join(f"{n} double" for n in names)
    parts = c.groupBy(*by, "_b").cogroup(each.groupBy(*[f"_k{i}" for i in range(len(by))], "_kb")).applyInPandas(run, schema)
    return parts.groupBy(*by, "_draw").agg(F.max("_n").alias("_n"), *[(F.sum(n) / F.max("_n")).alias(v) for n, v in zip(names, values, strict=True)])


def interval(c: str, confidence: float = 0.95):
    """array(low, high) of c over resamples."""
    tail = (1 - confidence) / 2
    return F.percentile(F.when(F.col("_draw") > 0, F.col(c)), F.array(F.lit(tail), F.lit(1 - tail)))


def bootstrap_ci(df: DataFrame, by: list[str], value: str, n_resamples: int = 2000, confidence: float = 0.95, seed: int = 0, per_task: int = PER_TASK) -> DataFrame:
    """by, n_units, point, low, high, p_below_zero of the mean: percentile interval. Null values are dropped; a combination without values has 0 units and nulls."""
    m = resampled(df, by, [value], n_resamples, seed, per_task)
    got = m.groupBy(*by).agg(F.max("_n").alias("n_units"), F.max(F.when(F.col("_draw") == 0, F.col(value))).alias("point"), interval(value, confidence).alias("_i"), F.avg(F.when(F.col("_draw") > 0, (F.col(value) < 0).cast("double"))).alias("p_below_zero"))
    every = same_keys(df.select(*by).distinct(), got, by, "left")
    return every.select(*by, F.coalesce("n_units", F.lit(0)).alias("n_units"), "point", F.col("_i")[0].alias("low"), F.col("_i")[1].alias("high"), "p_below_zero")


def ratio_ci(df: DataFrame, by: list[str], numer: str, denom: str, n_resamples: int = 2000, seed: int = 0, per_task: int = PER_TASK) -> DataFrame:
    """by, point, low, high of the ratio of means, paired by row; resamples with a mean denominator within 1e-12 of 0 are skipped. Rows with a null are dropped."""
    m = resampled(df, by, [numer, denom], n_resamples, seed, per_task)
    m = m.withColumn("_r", F.when(F.abs(F.col(denom)) > 1e-12, F.col(numer) / F.col(denom)))
    got = m.groupBy(*by).agg(F.max(F.when(F.col("_draw") == 0, F.col("_r"))).alias("point"), interval("_r").alias("_i"))
    return got.select(*by, "point", F.col("_i")[0].alias("low"), F.col("_i")[1].alias("high"))


def signflip_p(df: DataFrame, by: list[str], value: str, n_flips: int = 10_000, slack: float = 1e-15, seed: int = 0, per_task: int = PER_TASK) -> DataFrame:
    """by, p_flip: two-sided sign-flip p-value with one added to both counts; NaN without values."""
    c = dealt(df, by, [value], per_task)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(value, kind="stable")
        x, n = rows[value].to_numpy(float), rows["_c"].to_numpy()
        rng, per, out = np.random.default_rng([seed, 3, int(rows["_b"].iloc[0])]), max(1, BLOCK // len(x)), [np.array([(x * n).sum()])]
        for a in range(0, n_flips, per):
            m = min(per, n_flips - a)
            signs = rng.integers(0, 2, size=(m, len(x))) * 2 - 1 if n.max() == 1 else rng.binomial(n, 0.5, size=(m, len(x))) * 2 - n
            out.append(signs @ x)
        s = np.concatenate(out)
        made = pd.DataFrame({"_draw": np.arange(len(s)), "_n": int(n.sum()), "_s": s})
        for k in by:
            made[k] = pd.Series([rows[k].iloc[0]] * len(made), dtype=object)
        return made[[*by, "_draw", "_n", "_s"]]

    parts = c.groupBy(*by, "_b").applyInPandas(run, f"{typed(df, by)}, _draw int, _n long, _s double")
    m = parts.groupBy(*by, "_draw").agg((F.abs(F.sum("_s")) / F.sum("_n")).alias("_m"))
    seen = F.max(F.when(F.col("_draw") == 0, F.col("_m"))).over(Window.partitionBy(*by))
    hits = F.count_if((F.col("_draw") > 0) & (F.col("_m") >= F.col("_seen") - slack))
    got = m.withColumn("_seen", seen).groupBy(*by).agg(((1 + hits) / (1 + n_flips)).alias("p_flip"))
    return same_keys(df.select(*by).distinct(), got, by, "left").select(*by, F.coalesce("p_flip", F.lit(float("nan"))).alias("p_flip"))


def hierarchical_ci(df: DataFrame, by: list[str], unit: str, seed_col: str, value: str, n_resamples: int = 2000, seed: int = 0, per_task: int = PER_TASK) -> DataFrame:
    """by, point, low, high, width_ratio, loso_range: users and seeds resampled together, against users alone; and the range of leave-one-seed-out points.

    A user is one row with a sum and a count per seed; the seeds (1000 at most) are read by the driver, the weights of a resample's seeds are a table of
    n_resamples rows."""
    seeds = sorted(r[0] for r in df.select(seed_col).distinct().limit(1001).collect())
    if len(seeds) > 1000:
        raise ValueError("more than 1000 seeds")
    per = df.groupBy(*by, unit, seed_col).agg(F.avg(value).alias("_x"))
    at = [F.when(F.col(seed_col) == s, F.col("_x")) for s in seeds]
    names = [f"_s{j}" for j in range(len(seeds))] + [f"_c{j}" for j in range(len(seeds))]
    wide = per.groupBy(*by, unit).agg(*[F.coalesce(F.sum(a), F.lit(0.0)).alias(f"_s{j}") for j, a in enumerate(at)], *[F.count(a).cast("double").alias(f"_c{j}") for j, a in enumerate(at)])
    m = resampled(wide, by, names, n_resamples, seed, per_task)
    rng = np.random.default_rng([seed, 4])
    weights = [[1] * len(seeds), *rng.multinomial(len(seeds), [1 / len(seeds)] * len(seeds), size=n_resamples).tolist()]
    w = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(weights)], "_draw int, _w array<int>")
    over = lambda js, weight: F.try_divide(sum((F.col(f"_s{j}") * weight(j) for j in js), F.lit(0.0)), sum((F.col(f"_c{j}") * weight(j) for j in js), F.lit(0.0)))
    every, one = range(len(seeds)), lambda j: F.lit(1.0)
    left_out = F.array(*[over([j for j in every if j != k], one) for k in every]) if len(seeds) > 1 else F.array(over(every, one))
    m = m.join(F.broadcast(w), "_draw").select(*by, "_draw", over(every, lambda j: F.col("_w")[j]).alias("_both"), over(every, one).alias("_alone"), left_out.alias("_loso"))
    first = lambda c: F.max(F.when(F.col("_draw") == 0, c))
    got = m.groupBy(*by).agg(first(F.col("_alone")).alias("point"), interval("_both").alias("_i"), interval("_alone").alias("_a"), first(F.array_max("_loso") - F.array_min("_loso")).alias("loso_range"))
    ratio = F.when(F.col("_a")[1] > F.col("_a")[0], (F.col("_i")[1] - F.col("_i")[0]) / (F.col("_a")[1] - F.col("_a")[0]))
    return got.select(*by, "point", F.col("_i")[0].alias("low"), F.col("_i")[1].alias("high"), ratio.alias("width_ratio"), "loso_range")


def holm(df: DataFrame, p: str, alpha: float = 0.05, within: list[str] | None = None) -> DataFrame:
    """Adds holm: rejected by the step-down rule. One row per test meets in the window."""
    part = Window.partitionBy(*(within or [F.lit(1)]))
    w = part.orderBy(p)
    ok = (F.col(p) <= F.lit(alpha) / (F.count(F.lit(1)).over(part) - F.row_number().over(w) + 1)).cast("int")
    return df.withColumn("_ok", ok).withColumn("holm", F.min("_ok").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_ok")


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, n, spearman: correlation of ranks, ties share their mean rank."""
    mean_rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2
    ranked = df.select(*by, mean_rank(x).alias("_rx"), mean_rank(y).alias("_ry"))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("spearman"))


def kendall(df: DataFrame, by: list[str], key: str, x: str, y: str) -> DataFrame:
    """by, tau_a, tau_b over pairs of rows of a group (selectors and simulators: a few dozen per group)."""
    a = df.select(*by, F.col(key).alias("_ka"), F.col(x).alias("_xa"), F.col(y).alias("_ya"))
    b = df.select(*by, F.col(key).alias("_kb"), F.col(x).alias("_xb"), F.col(y).alias("_yb"))
    pairs = a.join(b, by).filter("_ka < _kb").select(*by, F.signum(F.col("_xa") - F.col("_xb")).alias("_dx"), F.signum(F.col("_ya") - F.col("_yb")).alias("_dy"))
    s = pairs.groupBy(*by).agg(F.sum(F.col("_dx") * F.col("_dy")).alias("_s"), F.count(F.lit(1)).alias("_n"), F.sum(F.abs("_dx")).alias("_nx"), F.sum(F.abs("_dy")).alias("_ny"))
    degenerate = (F.col("_nx") == 0) | (F.col("_ny") == 0)
    return s.select(*by, (F.col("_s") / F.col("_n")).alias("tau_a"), F.when(degenerate, 0.0).otherwise(F.col("_s") / F.sqrt(F.col("_nx") * F.col("_ny"))).alias("tau_b"))


def two_afc(better: str, worse: str):
    """1 where better is smaller, 0 where larger, 0.5 for a tie."""
    return F.when(F.col(better) < F.col(worse), 1.0).when(F.col(better) > F.col(worse), 0.0).otherwise(0.5)


def detection_rate(df: DataFrame, by: list[str], high: str, point: str) -> DataFrame:
    """by, n, rate of replicates whose interval is below 0, mean, sd and quantiles of their points."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col(high) < 0, 1.0).otherwise(0.0)).alias("rate"),
        F.avg(point).alias("mean_point"),
        F.stddev_samp(point).alias("sd_point"),
        F.percentile(point, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q_point"),
    )


def dose_readout(df: DataFrame, by: list[str], alpha: str, value: str) -> DataFrame:
    """by, swing, monotone, swing_over_sd from values per dose and seed."""
    per = df.groupBy(*by, alpha).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_sd"))
    w = Window.partitionBy(*by).orderBy(alpha)
    per = per.withColumn("_step", F.col("_m") - F.lag("_m").over(w))
    return per.groupBy(*by).agg(
        (F.max_by("_m", alpha) - F.min_by("_m", alpha)).alias("swing"),
        F.bool_and(F.coalesce(F.col("_step") <= 1e-12, F.lit(True))).alias("monotone"),
        F.try_divide(F.max_by("_m", alpha) - F.min_by("_m", alpha), F.avg("_sd")).alias("swing_over_sd"),
    )
