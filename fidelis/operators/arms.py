"""Cells, donors, arms and paired contrasts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelis.operators.settle import ranged, settle


def seeded(user: str, seed: int) -> Column:
    """Order key of a user under a seed: the same in any engine with md5."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(user).cast("string")))


def donors(cells: DataFrame, user: str = "user_id", cell: str = "cell", seed: int = 0) -> DataFrame:
    """user, cell, donor: the next user of the cell in seeded order, the last one's is the first; alone in a cell: oneself.

    Users lie in ranges of (cell, seeded order); the last one of a range looks into the next range, so no task holds a cell. Edges have one row per range."""
    names = cells.columns
    r = ranged(cells.withColumn("_o", seeded(user, seed)), [cell, "_o", user])
    w = Window.partitionBy("_p").orderBy(cell, "_o", user)
    r = r.withColumn("_next", F.lead(F.struct(F.col(cell).alias("c"), F.col(user).alias("u"))).over(w))
    edges = r.groupBy("_p").agg(F.min(F.struct(F.col(cell).alias("c"), "_o", F.col(user).alias("u"))).alias("_f"))
    edges = edges.select("_p", F.lead("_f").over(Window.orderBy("_p")).alias("_edge"))
    firsts = r.groupBy(F.col(cell).alias("_c")).agg(F.min(F.struct("_o", F.col(user).alias("u"))).alias("_top"))
    j = r.join(F.broadcast(edges), "_p").join(firsts, F.col(cell) == F.col("_c"))
    after = F.coalesce("_next", F.struct(F.col("_edge.c").alias("c"), F.col("_edge.u").alias("u")))
    return j.withColumn("donor", F.when(after["c"] == F.col(cell), after["u"]).otherwise(F.col("_top.u"))).select(*names, "donor")


def matched(cells: DataFrame, user: str = "user_id") -> DataFrame:
    """cells without users who are alone in their cell: nobody is a look-alike of oneself, and such a user would pull contrasts to 0."""
    return cells.filter(F.col("donor") != F.col(user))


def restrict_donors(cells: DataFrame, eligible: DataFrame, user: str = "user_id", cell: str = "cell", seed: int = 0) -> DataFrame:
    """Donors among the users that remain, in the same rotation: equal to following each donor past those that were dropped."""
    return donors(cells.join(eligible.select(user).distinct(), user, "left_semi"), user, cell, seed)


def remap(df: DataFrame, mapping: DataFrame, user: str, donor: str = "donor") -> DataFrame:
    """Rows of df with donor: the mapped user, or the user itself."""
    return df.join(mapping.select(user, donor), user, "left").withColumn(donor, F.coalesce(donor, user))


def user_counts(rows: DataFrame, label: str, labels: list, user: str = "user_id", more: list[Column] | None = None) -> DataFrame:
    """user, c (training rows per label), h (held-out rows per label), and more aggregates: one row per user from one pass, settled, for all arms read it.

    Labels outside the closed list count in neither."""
    count = lambda x, where: F.count_if((F.col(label) == x) & where)
    c = [count(x, F.col("t") < F.col("k")) for x in labels]
    h = [count(x, F.col("t") >= F.col("k")) for x in labels]
    return settle(rows.groupBy(user).agg(F.array(*c).alias("c"), F.array(*h).alias("h"), *(more or [])))


def arm_scores(counts: DataFrame, cells: DataFrame, labels: list, user: str = "user_id") -> DataFrame:
    """user, n, A0 to A4: mean held-out surprise of a user's labels under each arm.

    counts: from user_counts. cells: user, cell, donor; users without another one as donor are left out. All arms follow from one row per user:
    rates of all and of a cell are sums of those rows."""
    m = len(labels)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    rates = lambda c: F.transform(c, lambda x: (x + 1) / (total(c) + m))
    sums = F.array(*[F.sum(F.col("c")[i]) for i in range(m)])
    pop = counts.agg(sums.alias("_s")).select(rates(F.col("_s")).alias("_a1"))
    with_cell = counts.join(cells.select(user, "cell", "donor"), user)
    group = with_cell.groupBy("cell").agg(sums.alias("_s")).select(F.col("cell").alias("_g"), rates(F.col("_s")).alias("_a2"))
    other = counts.select(F.col(user).alias("_d"), rates(F.col("c")).alias("_a3"))
    j = matched(with_cell, user).filter(total(F.col("h")) > 0).join(group, F.col("cell") == F.col("_g")).join(other, F.col("donor") == F.col("_d")).crossJoin(F.broadcast(pop))  # one row
    j = j.withColumn("_a4", rates(F.col("c"))).withColumn("n", total(F.col("h")))
    surprise = lambda p: F.aggregate(F.zip_with("h", p, lambda h, q: -h * F.log(q)), F.lit(0.0), lambda s, x: s + x) / F.col("n")
    return j.select(user, "n", F.lit(-math.log(1 / m)).alias("A0"), *[surprise(f"_a{i}").alias(f"A{i}") for i in range(1, 5)])


def mean_surprise(h: str, rates: str) -> Column:
    """Mean surprise of label counts h under log rates."""
    return F.aggregate(F.zip_with(h, rates, lambda n, q: -n * q), F.lit(0.0), lambda s, x: s + x) / F.aggregate(h, F.lit(0).cast("long"), lambda s, x: s + x)


def log_rates(c: str, m: int) -> Column:
    size = F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x) + m
    return F.transform(c, lambda x: F.log((x + 1) / size))


def hardest_donors(counts: DataFrame, cells: DataFrame, m: int, user: str = "user_id", per_block: int = 512, per_part: int = 100_000) -> DataFrame:
    """user, own, hardest: mean surprise of a user's held-out labels under the own training rates and under those of the other user of the cell that fit best
    (null: no other). Users without held-out labels are left out.

    Users with equal counts give equal rates, so different counts of a cell are compared, not users. They lie in blocks along a curve through all rates, and a block's
    largest rate of each label bounds how well any of it can fit: a user is compared with the block of the best bound, then with those whose bound is better
    than what was found. The driver holds a bound per block."""
    both = counts.join(cells.select(user, "cell"), user).select(user, "cell", "c", "h")
    size = F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x) + m
    bits = max(1, min(8, 62 // m))
    at = lambda i: F.floor((F.col("c")[i] + 1) / size * (2**bits - 1)).cast("long")
    curve = sum((F.shiftleft(F.shiftright(at(i), b).bitwiseAND(F.lit(1)), b * m + i) for b in range(bits) for i in range(m)), F.lit(0).cast("long"))
    classes = ranged(both.groupBy("cell", "c").agg(F.count(F.lit(1)).alias("_users")).withColumn("_z", curve), ["cell", "_z", "c"])
    place = F.row_number().over(Window.partitionBy("_p", "cell").orderBy("_z", "c")) - 1
    classes = settle(classes.withColumn("_i", place).select("cell", "c", "_users", log_rates("c", m).alias("_l"), F.concat_ws("/", "_p", "cell", F.floor(F.col("_i") / per_block)).alias("_block"), "_i"))
    boxes = classes.groupBy("cell", "_block").agg(*[F.max(F.col("_l")[i]).alias(f"_m{i}") for i in range(m)]).orderBy("cell", "_block").toPandas()
    bounds = {cell: (g["_block"].to_numpy(), g[[f"_m{i}" for i in range(m)]].to_numpy(float)) for cell, g in boxes.groupby("cell")}
    # a class of one user is nobody else's: that user is not compared with it
    users = settle(both.filter("exists(h, x -> x > 0)").join(classes.withColumnRenamed("cell", "_cell").withColumnRenamed("c", "_c"), (F.col("cell") == F.col("_cell")) & (F.col("c") == F.col("_c"))).select(user, "cell", "h", "_l", F.when(F.col("_users") == 1, F.concat_ws("#", "_block", "_i")).otherwise("").alias("_not")))
    asked = settle(users.select("cell", "h", "_not").distinct())
    parts = max(1, -(-asked.count() // per_part))

    @F.pandas_udf("array<string>")
    def blocks(cell: pd.Series, h: pd.Series, best: pd.Series, done: pd.Series) -> pd.Series:
        out: list = [None] * len(cell)
        for c in cell.unique():
            rows = np.flatnonzero((cell == c).to_numpy())
            names, most = bounds[c]
            x = np.stack(h.iloc[rows].to_numpy()).astype(float)
            can = (x / x.sum(1)[:, None]) @ most.T
            found = best.iloc[rows].to_numpy(float)
            for r, row, f in zip(rows, can, found, strict=True):
                if np.isneginf(f):
                    out[r] = [names[row.argmax()]]
                else:
                    out[r] = [n for n in names[row >= (f if np.isfinite(f) else -np.inf) - 1e-9] if n != done.iloc[r]]
        return pd.Series(out)

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("cell", "h", "_not", "_best", "_s")})
        h, rates = np.stack(x["h"].to_numpy()).astype(float), np.stack(y["_l"].to_numpy()).astype(float)
        names, out, best = (y["_block"] + "#" + y["_i"].astype(str)).to_numpy(), [], []
        where = {n: i for i, n in enumerate(names)}
        skip = np.array([where.get(n, -1) for n in x["_not"]])
        for s in range(0, len(h), 4096):
            fit = h[s : s + 4096] @ rates.T / h[s : s + 4096].sum(1)[:, None]
            own = np.flatnonzero(skip[s : s + 4096] >= 0)
            fit[own, skip[s : s + 4096][own]] = -np.inf
            k = fit.argmax(1)
            out += [rates[i] for i in k]
            best += fit[np.arange(len(k)), k].tolist()
        return pd.DataFrame({"cell": x["cell"], "h": x["h"], "_not": x["_not"], "_best": out, "_s": best})

    kind = dict(both.dtypes)
    theirs = classes.select("_block", "_l", "_i", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))

    def met(rows: DataFrame) -> DataFrame:
        a = rows.withColumn("_block", F.explode("_blocks")).select("cell", "h", "_not", "_block", F.pmod(F.xxhash64("h", "_not"), F.lit(parts)).cast("int").alias("_part"))
        return a.groupBy("_block", "_part").cogroup(theirs.groupBy("_block", "_part")).applyInPandas(run, f"cell {kind['cell']}, h {kind['h']}, _not string, _best array<double>, _s double")

    first = asked.withColumn("_blocks", blocks("cell", "h", F.lit(float("-inf")), F.lit("")))
    # nothing found (the block holds oneself alone): every other block is tried
    one = settle(met(first).withColumn("_s", F.when(F.col("_s") > float("-inf"), F.col("_s"))))
    more = one.withColumn("_was", blocks("cell", "h", F.lit(float("-inf")), F.lit(""))[0])
    more = met(more.withColumn("_blocks", blocks("cell", "h", F.coalesce("_s", F.lit(float("inf"))), "_was")).select("cell", "h", "_not", "_blocks"))
    top = one.unionByName(more).filter(F.col("_s") > float("-inf")).groupBy(F.col("cell").alias("_cell"), F.col("h").alias("_h"), F.col("_not").alias("_own")).agg(F.max_by("_best", "_s").alias("_best"))
    j = users.join(top, (F.col("cell") == F.col("_cell")) & (F.col("h") == F.col("_h")) & (F.col("_not") == F.col("_own")), "left")
    return j.select(user, mean_surprise("h", "_l").alias("own"), mean_surprise("h", "_best").alias("hardest"))


# Contrasts and the arms they compare.
CONTRASTS = {"dpop": ("A1", "A0"), "dgroup": ("A2", "A1"), "ddistract": ("A3", "A2"), "dindiv": ("A4", "A3"), "total": ("A4", "A0")}


def contrasts(wide: DataFrame, user: str = "user_id") -> DataFrame:
    """user, contrast, delta: differences of arms, negative is good."""
    return wide.select(user, F.explode(F.array(*[F.struct(F.lit(k).alias("contrast"), (F.col(a) - F.col(b)).alias("delta")) for k, (a, b) in CONTRASTS.items()])).alias("_x")).select(user, "_x.*")


def contrast_summary(long: DataFrame) -> DataFrame:
    """contrast, n, mean, share of users favoured."""
    return long.groupBy("contrast").agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean_delta"), F.avg(F.when(F.col("delta") < 0, 1.0).otherwise(0.0)).alias("share_favourable"))


def hold_last_means(rows: DataFrame, by: list[str], t: str, k: str, x: str, last_t: DataFrame) -> DataFrame:
    """by, t, mean: mean of x over rows with t < k at each t, gaps and later steps hold the last mean. last_t: by, last."""
    means = rows.filter(F.col(t) < F.col(k)).groupBy(*by, F.col(t).alias("t")).agg(F.avg(x).alias("_m"))
    grid = last_t.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("t"))
    w = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(means, [*by, "t"], "left").select(*by, "t", F.last("_m", ignorenulls=True).over(w).alias("mean"))


def clamped(rows: DataFrame, series: DataFrame, on: str, t: str = "t") -> DataFrame:
    """rows (on, t, ...) with value: the series' value at least(t, its last t). series: on, s_t, value."""
    ends = series.groupBy(on).agg(F.max("s_t").alias("_end"))
    return rows.join(ends, on, "left").withColumn("s_t", F.least(F.col(t), F.col("_end"))).join(series, [on, "s_t"], "left").drop("_end")
