"""Closed-form simulators and iterative fits. Every pass over rows is a Spark aggregate; only parameters reach the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.functions.scalars import lognormal_nll
from fidelis.operators.arms import matched
from fidelis.operators.settle import settle


def lognormal_fit(rows: DataFrame, by: list[str], x: str, least_sigma: float = 0.05) -> DataFrame:
    """by, mu, sigma (population) of ln(max(x, 1e-3))."""
    v = F.log(F.greatest(F.col(x), F.lit(1e-3)))
    return rows.filter(F.col(x).isNotNull()).groupBy(*by).agg(F.avg(v).alias("mu"), F.greatest(F.stddev_pop(v), F.lit(least_sigma)).alias("sigma"))


def lognormal_marginal(rows: DataFrame, cells: DataFrame, x: str, user: str = "user_id") -> DataFrame:
    """user, n, own, other: mean held-out surprise under the user's and the donor's fit of rows with t < k. Users without another one as donor are left out."""
    cells = matched(cells, user)
    fit = lognormal_fit(rows.filter("t < k"), [user], x)
    held = rows.filter((F.col("t") >= F.col("k")) & F.col(x).isNotNull()).join(cells.select(user, "donor"), user)
    j = held.join(fit, user).join(fit.select(F.col(user).alias("donor"), F.col("mu").alias("mu_d"), F.col("sigma").alias("sigma_d")), "donor")
    return j.groupBy(user).agg(F.count(F.lit(1)).alias("n"), F.avg(lognormal_nll(x, "mu", "sigma")).alias("own"), F.avg(lognormal_nll(x, "mu_d", "sigma_d")).alias("other"))


def bernoulli_marginal(rows: DataFrame, cells: DataFrame, y: str, user: str = "user_id") -> DataFrame:
    """user, n, own, other: Laplace rates (c + 1) / (n + 2) of rows with t < k. Users without another one as donor are left out."""
    cells = matched(cells, user)
    p = rows.filter("t < k").groupBy(user).agg(((F.sum(y) + 1) / (F.count(y) + 2)).alias("p"))
    held = rows.filter("t >= k").groupBy(user).agg(F.sum(y).alias("_c"), F.count(y).alias("n")).join(cells.select(user, "donor"), user)
    j = held.join(p, user).join(p.select(F.col(user).alias("donor"), F.col("p").alias("p_d")), "donor")
    nll = lambda q: -(F.col("_c") * F.log(q) + (F.col("n") - F.col("_c")) * F.log(1 - F.col(q))) / F.col("n")
    return j.select(user, "n", nll("p").alias("own"), nll("p_d").alias("other"))


def legal_marginal(train: DataFrame, held: DataFrame, key: str = "action", legal: str = "legal_actions", add: float = 0.5, user: str = "user_id") -> DataFrame:
    """user, t, nll: -ln((c + add) / sum over legal actions of (c + add)); an action that is not legal counts as the first legal one."""
    counts = train.groupBy(F.col(key).alias("_a")).agg(F.count(F.lit(1)).alias("_c"))
    seen = F.when(F.array_contains(legal, F.col(key)), F.col(key)).otherwise(F.element_at(legal, 1))
    each = held.select(user, "t", seen.alias("_seen"), F.explode(legal).alias("_a")).join(counts, "_a", "left").withColumn("_w", F.coalesce("_c", F.lit(0)) + add)
    return each.groupBy(user, "t").agg((-F.log(F.max(F.when(F.col("_a") == F.col("_seen"), F.col("_w"))) / F.sum("_w"))).alias("nll"))


def fit_logistic(rows: DataFrame, features: list[str], y: str, ridge: float = 1e-6, most: int = 100, tol: float = 1e-10) -> np.ndarray:
    """Coefficients (constant first) by iteratively reweighted least squares. A step is one aggregate of the Gram matrix and gradient: (p + 1)(p + 2) sums."""
    names = [f"_x{i}" for i in range(len(features) + 1)]
    data = rows.select(F.lit(1.0).alias("_x0"), *[F.col(c).cast("double").alias(f"_x{i + 1}") for i, c in enumerate(features)], F.col(y).cast("double").alias("_y"))
    data = settle(data)  # every step reads it
    b = np.zeros(len(names))
    for _ in range(most):
        z = sum((F.col(n) * float(v) for n, v in zip(names[1:], b[1:], strict=True)), F.lit(float(b[0])))
        p = 1 / (1 + F.exp(-z))
        d = data.withColumn("_p", p).withColumn("_w", F.col("_p") * (1 - F.col("_p")))
        sums = [F.sum(F.col("_w") * F.col(names[i]) * F.col(names[j])) for i in range(len(names)) for j in range(i, len(names))] + [F.sum(F.col(n) * (F.col("_y") - F.col("_p"))) for n in names]
        got = np.array(d.agg(*sums).first(), float)
        h, at = np.zeros((len(names), len(names))), 0
        for i in range(len(names)):
            for j in range(i, len(names)):
                h[i, j] = h[j, i] = got[at]
                at += 1
        step = np.linalg.solve(h + ridge * np.eye(len(names)), got[at:] - ridge * b)
        b = b + step
        if np.abs(step).max() < tol:
            break
    return b


def fit_irt(rows: DataFrame, user: str, item: str, y: str, l2: float = 1e-4, rounds: int = 12) -> tuple[DataFrame, DataFrame]:
    """Abilities (user, theta) and difficulties (item, b) of a one-parameter model: alternating Newton steps.

    Each half step is a join and one aggregate per side on counts per (user, item); parameters stay distributed."""
    counts = rows.groupBy(F.col(user).alias("_u"), F.col(item).alias("_i")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(y)).alias("_c"))
    counts = settle(counts)
    theta = counts.select("_u").distinct().withColumn("theta", F.lit(0.0))
    b = counts.select("_i").distinct().withColumn("b", F.lit(0.0))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(F.col("b") - F.col("theta")))
        j = counts.join(theta, "_u").join(b, "_i").withColumn("_p", p)
        grad, curve = F.sum(F.col("_c") - F.col("_n") * F.col("_p")), F.sum(F.col("_n") * F.col("_p") * (1 - F.col("_p")))
        theta = settle(j.groupBy("_u").agg((F.first("theta") + (grad - l2 * F.first("theta")) / (curve + l2)).alias("theta")))
        j = counts.join(theta, "_u").join(b, "_i").withColumn("_p", p)
        b = settle(j.groupBy("_i").agg((F.first("b") - (grad + l2 * F.first("b")) / (curve + l2)).alias("b")))
    return theta.withColumnRenamed("_u", user), b.withColumnRenamed("_i", item)
