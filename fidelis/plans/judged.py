"""Queries of verdicts: known signals, leakage, harder look-alikes, what is left beyond a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.operators import arms, crossfit, panel, verdicts
from fidelis.plans.screens import scored
from fidelis.plans.trial import ARMS, CROSS, LABELS, NEAREST_SQL, cells, hardest, matched_cells, nearest_imposter, r6, scalar, split_rows, table


def modes(rows: DataFrame) -> DataFrame:
    """user_id, guess: the most frequent training label, ties by name."""
    n = rows.filter("t < k").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("guess"))


def guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out events answered with a most frequent label: nobody's (A0), the donor's (A3), one's own (A4). An event of less than half a unit is not answered."""
    rows = split_rows(spark, sf_dir)
    m = modes(rows)
    every = rows.filter("t < k").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("_a0"))
    pairs = arms.matched(cells(rows)).select("user_id", "donor")
    held = rows.filter("t >= k").select("user_id", "t", "event_type", "value").join(pairs, "user_id").join(m, "user_id", "left")
    held = held.join(m.select(F.col("user_id").alias("donor"), F.col("guess").alias("_a3")), "donor", "left").crossJoin(F.broadcast(every))  # one row
    answers = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.when(F.col("value") >= 0.5, g).alias("predicted")) for a, g in (("A0", F.col("_a0")), ("A3", F.col("_a3")), ("A4", F.col("guess")))]))
    return held.select("user_id", "t", F.col("event_type").alias("correct_answer"), answers.alias("_x")).select("user_id", "t", "correct_answer", "_x.*")


def leakage_screen(spark, sf_dir):
    """Gates of the items that a guess without information gets wrong."""
    g = verdicts.screen_gates(guessed(spark, sf_dir).filter("arm = 'A0'"), "user_id")
    return g.select("n_items", r6("valid_rate", "valid_rate"), "n_survivors", "n_persons", "go")


def known_signal(spark, sf_dir):
    """Accuracy of one's own most frequent label against the donor's, on the items that survive the screen."""
    rows = guessed(spark, sf_dir)
    kept = verdicts.survivors(rows.filter("arm = 'A0'"), "user_id").select("user_id", "t")
    k = verdicts.known_signal(rows.join(kept, ["user_id", "t"], "left_semi"), "user_id", intervals=False)
    return k.select("n_persons", *[r6(c, c) for c in ("effect", "valid_a3", "valid_a4", "accuracy_a3", "accuracy_a4")])


def pair_losses(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """user_id, donor, nll of a user's held-out labels under the donor's training rates, for given pairs."""
    total = F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x)
    rates = counts.select(F.col("user_id").alias("donor"), F.transform("c", lambda x: -F.log((x + 1) / (total + len(LABELS)))).alias("_l"))
    j = pairs.join(counts.select("user_id", "h"), "user_id").filter("exists(h, x -> x > 0)").join(rates, "donor")
    return j.select("user_id", "donor", (F.aggregate(F.zip_with("h", "_l", lambda h, q: h * q), F.lit(0.0), lambda s, x: s + x) / F.aggregate("h", F.lit(0).cast("long"), lambda s, x: s + x)).alias("nll"))


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, matcher, value: one's own loss less that under the donor of the rotation, the nearest other user and the hardest one of the cell."""
    rows = split_rows(spark, sf_dir)
    counts = arms.user_counts(rows, "event_type", LABELS, more=[scalar()])
    matched = arms.matched(matched_cells(counts)).select("user_id", "donor")
    own = pair_losses(counts, matched.select("user_id", F.col("user_id").alias("donor"))).select("user_id", F.col("nll").alias("_own"))
    registered = pair_losses(counts, matched).select("user_id", F.lit("registered").alias("matcher"), "nll")
    near = pair_losses(counts, nearest_imposter(spark, sf_dir).select("user_id", "donor")).select("user_id", F.lit("nearest").alias("matcher"), "nll")
    hard = hardest(counts).filter("hardest is not null").select("user_id", F.lit("hardest").alias("matcher"), F.col("hardest").alias("nll"))
    return registered.unionByName(near).unionByName(hard).join(own, "user_id").select("user_id", "matcher", (F.col("_own") - F.col("nll")).alias("value"))


def matcher_differences(spark, sf_dir):
    return differences(spark, sf_dir).select("user_id", "matcher", F.round("value", 5).alias("value"))


def matcher_verdict(spark, sf_dir):
    """How many of three matchers' look-alikes one's own information beats, by intervals over users."""
    return verdicts.matcher_hierarchy(differences(spark, sf_dir).withColumn("combo", F.lit("events")), "combo", "matcher", "value")


def content_distances(spark, sf_dir):
    """Turns as generated samples: of every user turn the eight nearest vectors by number as samples of two arms, and how far they are from the turn's own vector."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    asked = e.select(F.col("vec_id").alias("row"), F.col("label").alias("sim"), "v", F.explode(F.sequence(F.lit(1), F.lit(16))).alias("i")).select("row", "sim", F.col("v").alias("_t"), F.when(F.col("i") % 2 == 0, "A4").otherwise("A3").alias("arm"), (F.col("row") + F.col("i")).alias("vec_id"))
    j = asked.join(e.select("vec_id", F.col("v").alias("_s")), "vec_id")
    sims = j.select("sim", "row", "arm", (dot(F.col("_t"), F.col("_s")) / F.sqrt(dot(F.col("_t"), F.col("_t")) * dot(F.col("_s"), F.col("_s")))).alias("similarity"))
    whole = sims.groupBy("sim", "row").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 16").select("sim", "row")
    c = verdicts.content_rows(sims.join(whole, ["sim", "row"], "left_semi"), ["sim", "row"], "arm", "similarity")
    r = verdicts.content_readout(c, user="row", intervals=False)
    return r.select("sim", "contrast", "n_units", F.round("point", 5).alias("point"))


def segment_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers: sim (market segment), user_id (nation), the price as the selector's value and the priority, 1 to 5, as the outcome."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("user_id"), F.col("c_mktsegment").alias("sim"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", (F.col("o_totalprice") / 1000).alias("price"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"))
    return o.join(c, "c_custkey")


def selector_crossfit(spark, sf_dir):
    """Segments ordered by price on one half of the nations, judged by priority on the other, and back."""
    rows = segment_orders(spark, sf_dir)
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("user_id"), F.col("n_regionkey").alias("stratum"))
    folds = panel.folds(nations, "stratum", "user_id").select("user_id", "fold")
    mean = lambda c: rows.groupBy("sim", "user_id").agg(F.avg(c).alias("value"))
    r = crossfit.crossfit(mean("price"), mean("priority"), folds)
    return r.select("direction", "n", r6("tau_a", "tau_a"), r6("tau_b", "tau_b"), "pick", F.col("pick_rank").cast("long").alias("pick_rank"))


def odd_even_agreement(spark, sf_dir):
    """Rank correlation over customers of prices on one half of their orders with priorities on the other."""
    rows = segment_orders(spark, sf_dir).withColumn("user_id", F.col("c_custkey"))
    r = crossfit.odd_even(crossfit.halves(rows, "user_id", ["o_orderkey"]), "sim", "user_id", "price", "priority")
    return r.select("sim", "direction", "n", r6("spearman", "spearman"))


def form_labels(spark, sf_dir):
    """Probabilities that two simulators give the event that came true, under the donor's and one's own rates."""
    p = scored(spark, sf_dir).groupBy("sim", "user_id", "t").agg(*[F.exp(-F.max(F.when(F.col("arm") == a, F.col("nll")))).alias(n) for a, n in (("A3", "p3"), ("A4", "p4"))])
    p = p.withColumns({c: F.round(c, 9) for c in ("p3", "p4")})  # equal rates are ties, whatever way they were computed
    r = crossfit.form_readout(p, "sim", "user_id", "p3", "p4", intervals=False)
    return r.select("sim", "contrast", "n_units", r6("point", "point"))


QUERIES = {f.__name__: f for f in (selector_crossfit, odd_even_agreement, form_labels, leakage_screen, known_signal, matcher_differences, matcher_verdict, content_distances)}

GUESS = (
    ARMS
    + """,
mo AS (SELECT user_id, arg_min(event_type, (-n, event_type)) AS guess FROM (SELECT user_id, event_type, count(*) AS n FROM r WHERE t < k GROUP BY 1, 2) AS x GROUP BY 1),
al AS (SELECT arg_min(event_type, (-n, event_type)) AS guess FROM (SELECT event_type, count(*) AS n FROM r WHERE t < k GROUP BY 1) AS x),
gs AS (SELECT r.user_id, r.t, r.event_type AS correct, CASE WHEN value >= 0.5 THEN al.guess END AS g0, CASE WHEN value >= 0.5 THEN d.guess END AS g3, CASE WHEN value >= 0.5 THEN o.guess END AS g4
       FROM r JOIN c USING (user_id) CROSS JOIN al LEFT JOIN mo AS o ON o.user_id = r.user_id LEFT JOIN mo AS d ON d.user_id = c.donor WHERE r.t >= r.k AND c.donor <> r.user_id)"""
)
#: The nearest other user, as CTEs after those of the arms: fa, fp, f, zs, zf, pr, and nr.
_NEAR = NEAREST_SQL[NEAREST_SQL.index("fa AS (") :]
NEAREST_CTE = _NEAR[: _NEAR.rindex("SELECT user_id, donor, round")].rstrip() + ", nr AS (" + _NEAR[_NEAR.rindex("SELECT user_id, donor, round") :] + ")"
SEGMENTS = "o AS (SELECT c_mktsegment AS sim, c_nationkey AS nation, c_custkey, o_orderkey, o_totalprice / 1000 AS price, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority FROM orders JOIN customer ON o_custkey = c_custkey)"
ORACLE_SQL = {
    "selector_crossfit": f"""WITH {SEGMENTS}, f AS (SELECT n_nationkey AS nation, CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY md5('0|' || n_nationkey), n_nationkey) % 2 = 1 THEN 'A' ELSE 'B' END AS fold FROM nation),
m AS (SELECT sim, nation, fold, avg(price) AS x, avg(priority) AS y FROM o JOIN f USING (nation) GROUP BY 1, 2, 3),
d AS (SELECT unnest(['A', 'B']) AS s, unnest(['B', 'A']) AS g),
v AS (SELECT d.s || ' to ' || d.g AS direction, sim, avg(CASE WHEN fold = d.s THEN x END) AS x, avg(CASE WHEN fold = d.g THEN y END) AS y FROM m CROSS JOIN d GROUP BY 1, 2),
p AS (SELECT a.direction, sign(a.x - b.x) AS dx, sign(a.y - b.y) AS dy FROM v AS a JOIN v AS b ON a.direction = b.direction AND a.sim < b.sim),
t AS (SELECT direction, sum(dx * dy) / count(*) AS tau_a, sum(dx * dy) / sqrt(sum(abs(dx)) * sum(abs(dy))) AS tau_b FROM p GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY y, sim) AS rk, row_number() OVER (PARTITION BY direction ORDER BY x, sim) AS first, count(*) OVER (PARTITION BY direction) AS n FROM v)
SELECT t.direction, k.n, round(tau_a, 6) AS tau_a, round(tau_b, 6) AS tau_b, k.sim AS pick, k.rk AS pick_rank FROM t JOIN k ON k.direction = t.direction AND k.first = 1""",
    "odd_even_agreement": f"""WITH {SEGMENTS}, h AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) % 2 = 1 AS odd FROM o),
u AS (SELECT sim, c_custkey, avg(price) FILTER (WHERE odd) AS so, avg(price) FILTER (WHERE NOT odd) AS se, avg(priority) FILTER (WHERE odd) AS oo, avg(priority) FILTER (WHERE NOT odd) AS oe FROM h GROUP BY 1, 2),
w AS (SELECT sim, unnest(['odd to even', 'even to odd']) AS direction, unnest([so, se]) AS x, unnest([oe, oo]) AS y FROM u), z AS (SELECT * FROM w WHERE x IS NOT NULL AND y IS NOT NULL),
r AS (SELECT sim, direction, rank() OVER (PARTITION BY sim, direction ORDER BY x) + (count(*) OVER (PARTITION BY sim, direction, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY sim, direction ORDER BY y) + (count(*) OVER (PARTITION BY sim, direction, y) - 1) / 2 AS ry FROM z)
SELECT sim, direction, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(rx, ry), 6) END AS spearman FROM r GROUP BY 1, 2""",
    "form_labels": f"""WITH {ARMS}, h AS (SELECT r.user_id, r.t, r.event_type, c.donor FROM r JOIN c USING (user_id) WHERE t >= k AND c.donor <> r.user_id),
n AS (SELECT user_id, event_type, count(*) AS c FROM r WHERE t < k GROUP BY 1, 2), o AS (SELECT user_id, sum(c) AS n FROM n GROUP BY 1),
sv AS (SELECT h.user_id, z.sim, round((coalesce(a.c, 0) + z.a) / (oa.n + 5 * z.a), 9) AS p4, round((coalesce(b.c, 0) + z.a) / (ob.n + 5 * z.a), 9) AS p3
      FROM h CROSS JOIN (SELECT unnest(['laplace', 'half']) AS sim, unnest([1.0::DOUBLE, 0.5::DOUBLE]) AS a) AS z JOIN o AS oa USING (user_id) JOIN o AS ob ON ob.user_id = h.donor
      LEFT JOIN n AS a ON a.user_id = h.user_id AND a.event_type = h.event_type LEFT JOIN n AS b ON b.user_id = h.donor AND b.event_type = h.event_type),
p AS (SELECT sim, user_id, avg(ln(p3) - ln(p4)) AS delta, avg(CASE WHEN p4 < p3 THEN 1.0 WHEN p4 > p3 THEN 0.0 ELSE 0.5 END) AS afc FROM sv GROUP BY 1, 2),
x AS (SELECT sim, unnest(['delta', 'afc']) AS contrast, unnest([delta, afc]) AS v FROM p) SELECT sim, contrast, count(v) AS n_units, round(avg(v), 6) AS point FROM x GROUP BY 1, 2""",
    "leakage_screen": f"WITH {GUESS}, u AS (SELECT user_id, count(*) AS n, count(g0) AS v, count_if(g0 <> correct) AS w FROM gs GROUP BY 1) SELECT sum(n)::BIGINT AS n_items, round(sum(v) / sum(n), 6) AS valid_rate, sum(w)::BIGINT AS n_survivors, count_if(w >= 3)::BIGINT AS n_persons, sum(v) / sum(n) >= 0.95 AND sum(w) >= 80 AND count_if(w >= 3) >= 15 AS go FROM u",
    "known_signal": f"WITH {GUESS}, u AS (SELECT user_id, count(*) AS n, count(g3) AS v3, count(g4) AS v4, avg(CASE WHEN g3 = correct THEN 1.0 WHEN g3 IS NOT NULL THEN 0.0 END) AS a3, avg(CASE WHEN g4 = correct THEN 1.0 WHEN g4 IS NOT NULL THEN 0.0 END) AS a4 FROM gs WHERE g0 <> correct GROUP BY 1) SELECT count(a4 - a3) AS n_persons, round(avg(a4 - a3), 6) AS effect, round(sum(v3) / sum(n), 6) AS valid_a3, round(sum(v4) / sum(n), 6) AS valid_a4, round(avg(a3), 6) AS accuracy_a3, round(avg(a4), 6) AS accuracy_a4 FROM u",
    "matcher_differences": f"""WITH {CROSS}, {NEAREST_CTE},
ow AS (SELECT user_id, nll FROM xm WHERE donor = user_id),
df AS (SELECT xm.user_id, 'registered' AS matcher, xm.nll FROM xm JOIN c USING (user_id) WHERE xm.donor = c.donor AND c.donor <> xm.user_id
       UNION ALL SELECT xm.user_id, 'nearest', xm.nll FROM xm JOIN nr USING (user_id, donor)
       UNION ALL SELECT user_id, 'hardest', min(nll) FROM xm WHERE donor <> user_id GROUP BY user_id)
SELECT df.user_id, matcher, round(ow.nll - df.nll, 5) AS value FROM df JOIN ow USING (user_id) WHERE df.user_id IN (SELECT user_id FROM c WHERE donor <> user_id)""",
    "content_distances": "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.label AS sim, a.vec_id AS r, i % 2 = 0 AS own, 1 - list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS d FROM e AS a CROSS JOIN (SELECT unnest(range(1, 17)) AS i) AS n JOIN e AS b ON b.vec_id = a.vec_id + i), g AS (SELECT sim, r, avg(d) FILTER (WHERE own) - avg(d) FILTER (WHERE NOT own) AS delta, CASE WHEN avg(d) FILTER (WHERE own) < avg(d) FILTER (WHERE NOT own) THEN 1.0 WHEN avg(d) FILTER (WHERE own) > avg(d) FILTER (WHERE NOT own) THEN 0.0 ELSE 0.5 END AS afc, min(d) FILTER (WHERE own) - min(d) FILTER (WHERE NOT own) AS best FROM s GROUP BY 1, 2 HAVING count(*) = 16), x AS (SELECT sim, unnest(['delta', 'afc', 'best']) AS contrast, unnest([delta, afc, best]) AS v FROM g) SELECT sim, contrast, count(v) AS n_units, round(avg(v), 5) AS point FROM x GROUP BY 1, 2",
}
