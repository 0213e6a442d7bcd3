"""Column functions: time controls, clocks, buckets, likelihoods, distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the estimated game length in seconds, and the edges of time buckets.
SPEED_CLASSES = ((30, "ultrabullet"), (180, "bullet"), (480, "blitz"), (1500, "rapid"))
CHESS_EDGES, SHOPPING_EDGES = (1.0, 3.0, 8.0, 20.0), (1.5, 5.0, 20.0, 60.0)
NEUTRAL_ELO = 1500.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def try_double(c: str | Column) -> Column:
    return col(c).try_cast("double")


def safe_int(c: str | Column) -> Column:
    """Null for null, empty, "?" and anything that is no integer."""
    return F.nullif(F.trim(col(c)), F.lit("?")).try_cast("int")


def time_control(c: str | Column) -> Column:
    """struct(base, inc) in seconds of "180+2"; nulls where it does not parse, inc 0 where it is missing."""
    parts = F.split(col(c), r"\+")
    base, inc = try_double(F.get(parts, F.lit(0))), try_double(F.get(parts, F.lit(1)))
    ok = base.isNotNull() & ((F.size(parts) == 1) | inc.isNotNull())
    return F.struct(F.when(ok, base).alias("base"), F.when(ok, F.when(F.size(parts) == 1, 0.0).otherwise(inc)).alias("inc"))


def speed_class(c: str | Column) -> Column:
    tc = time_control(c)
    estimate = tc["base"] + 40 * tc["inc"]
    out = F.when(tc["base"].isNull(), "correspondence")
    for edge, name in SPEED_CLASSES:
        out = out.when(estimate < edge, name)
    return out.otherwise("classical")


def utc_seconds(day: str | Column, time: str | Column) -> Column:
    """Epoch seconds of "yyyy.MM.dd" and "HH:mm:ss" (session time zone UTC); null where they do not parse."""
    return F.unix_timestamp(F.try_to_timestamp(F.concat_ws(" ", col(day), col(time)), F.lit("yyyy.MM.dd HH:mm:ss"))).cast("double")


def phase(fullmove: str | Column) -> Column:
    return F.when(col(fullmove) <= 10, "opening").when(col(fullmove) <= 30, "middlegame").otherwise("endgame")


def bucket(x: str | Column, edges: tuple[float, ...]) -> Column:
    """Index of the first edge above x: intervals are closed on the left."""
    out = None
    for i, e in enumerate(edges):
        out = F.when(col(x) < e, i) if out is None else out.when(col(x) < e, i)
    return F.when(col(x).isNotNull(), out.otherwise(len(edges)))


def bucket_label(x: str | Column, edges: tuple[float, ...]) -> Column:
    names = [f"under {edges[0]:g}s", *(f"{a:g} to {b:g}s" for a, b in zip(edges, edges[1:], strict=False)), f"over {edges[-1]:g}s"]
    return F.element_at(F.array(*[F.lit(n) for n in names]), bucket(x, edges) + 1)


def square_index(sq: str | Column) -> Column:
    """a1 is 0, h8 is 63, by the first two characters; anything else 0."""
    s = col(sq)
    return F.when(s.rlike("^[a-h][1-8]"), (F.ascii(F.substring(s, 2, 1)) - 49) * 8 + F.ascii(s) - 97).otherwise(0)


def lognormal_nll(seconds: str | Column, mu: str | Column, sigma: str | Column) -> Column:
    t = F.when(col(seconds) <= 0, 1e-3).otherwise(col(seconds))
    z = (F.log(t) - col(mu)) / col(sigma)
    return 0.5 * z * z + F.log(col(sigma)) + F.lit(0.5 * math.log(2 * math.pi)) + F.log(t)


def zero_inflated_nll(seconds: str | Column, pi: str | Column, mu: str | Column, sigma: str | Column, least: float = 0.5) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), col(pi)))
    return F.when(col(seconds) < least, -F.log(p)).otherwise(-F.log(1 - p) + lognormal_nll(seconds, mu, sigma))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution by a rational approximation (absolute error below 7.5e-8): Spark SQL has no erf."""
    # Published coefficients of the approximation.
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def lognormal_bucket_probs(mu: str | Column, sigma: str | Column, edges: tuple[float, ...]) -> Column:
    """Probability of each time bucket, clamped at 0."""
    cdf = [F.lit(0.0), *(normal_cdf((F.lit(math.log(e)) - col(mu)) / col(sigma)) for e in edges), F.lit(1.0)]
    return F.array(*[F.greatest(F.lit(0.0), b - a) for a, b in zip(cdf, cdf[1:], strict=False)])


def bernoulli_nll(y: str | Column, p: str | Column, eps: float = 1e-9) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), col(p)))
    return -(col(y) * F.log(q) + (1 - col(y)) * F.log(1 - q))


def logit_nll(y: str | Column, z: str | Column) -> Column:
    return F.log1p(F.exp(-F.abs(col(z)))) + F.greatest(col(z), F.lit(0.0)) - col(y) * col(z)


def softmax(a: str | Column) -> Column:
    shifted = F.transform(col(a), lambda x: F.exp(x - F.array_max(col(a))))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda s, v: s + v))


def option_nll(logp: str | Column, label: str | Column, lengths: str | Column) -> Column:
    """Mean per token of the labelled option."""
    return -F.element_at(col(logp), col(label) + 1) / F.element_at(col(lengths), col(label) + 1)


def letter_nll(logprobs: str | Column, letter: str | Column, letters: list[str], floor: float = -15.0) -> Column:
    """NLL of a letter from map<string,double> of upper-case tokens: absent letters have the floor, renormalised over the letters."""
    x = F.array(*[F.coalesce(F.element_at(col(logprobs), F.lit(v)), F.lit(floor)) for v in letters])
    top = F.array_max(x)
    total = top + F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top)))
    return total - F.coalesce(F.element_at(col(logprobs), col(letter)), F.lit(floor))


def map_prob(dist: str | Column, key: str | Column, floor: float = 1e-9) -> Column:
    """Probability of a key in map<string,double>, renormalised where the sum is off by over 1e-6."""
    total = F.aggregate(F.map_values(col(dist)), F.lit(0.0), lambda s, v: s + v)
    p = F.coalesce(F.element_at(col(dist), col(key)), F.lit(0.0))
    return F.greatest(F.lit(floor), F.when(F.abs(total - 1) > 1e-6, p / total).otherwise(p))


def map_top(dist: str | Column, k: int) -> Column:
    """The k entries of largest value; equal values by key."""
    ordered = F.array_sort(F.map_entries(col(dist)), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).otherwise(1))
    return F.slice(ordered, 1, k)


def duration(spent: str | Column) -> Column:
    """Seconds of a game from its plies' times: unknown ones count as 0, no plies are 0."""
    return F.coalesce(F.aggregate(col(spent), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))), F.lit(0.0))


def in_trouble(remaining: str | Column, least: float = 10.0) -> Column:
    """Whether at most `least` seconds are left; an unknown clock is no trouble."""
    return F.coalesce(col(remaining) <= least, F.lit(False))


def scramble(clocks: str | Column, least: float = 10.0) -> Column:
    """Whether any of a side's clocks before its plies is in trouble."""
    return F.coalesce(F.exists(col(clocks), lambda x: in_trouble(x, least)), F.lit(False))
