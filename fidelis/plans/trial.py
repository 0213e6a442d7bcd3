"""Queries on events, orders and line items: sessions, splits, cells, donors, arms, contrasts, inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fidelis.functions.scalars import CHESS_EDGES, bucket, bucket_label, lognormal_bucket_probs, lognormal_nll, logit_nll, softmax
from fidelis.operators import arms, features, folds, inference, ladder, metrics, sessions, simulators
from fidelis.operators.settle import settle, written

GAP = 21_600.0
CROSS_BLOCK = 20_000
LABELS = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with t, start in seconds, session and session_pos. All windows share one exchange by user."""
    e = table(spark, sf_dir, "events").withColumn("start", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return sessions.with_sessions(sessions.decisions(e, "user_id", ["ts", "event_id"]), "user_id", "start", GAP)


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.with_split(events(spark, sf_dir), "user_id")


def scalar() -> Column:
    return F.percentile(F.when(F.col("t") < F.col("k"), F.col("value")), F.lit(0.5)).alias("scalar")


def matched_cells(users: DataFrame) -> DataFrame:
    """user, scalar, cell, donor: tertiles of the training median of value."""
    return arms.donors(sessions.with_tertile(users.select("user_id", "scalar"), ["scalar", "user_id"], "cell"))


def cells(rows: DataFrame) -> DataFrame:
    return matched_cells(rows.groupBy("user_id").agg(scalar()))


BASE = f"""
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, epoch_us(ts) / 1e6 AS start FROM events),
g AS (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY user_id ORDER BY start, t) >= {GAP} THEN 1 ELSE 0 END AS fresh FROM e),
s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY start, t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g),
d AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY start, t) - 1 AS session_pos FROM s)"""
SPLIT = (
    BASE
    + """,
z AS (SELECT user_id, count(*) AS n, max(session) + 1 AS s FROM d GROUP BY user_id),
b AS (SELECT user_id, session, min(t) AS first FROM d GROUP BY user_id, session),
k AS (SELECT z.user_id, z.n, CAST(CASE WHEN n < 2 THEN n WHEN s < 2 THEN greatest(1, least(n - 1, round_even(0.7::DOUBLE * n, 0))) ELSE greatest(1, least(n - 1, b.first)) END AS BIGINT) AS k
      FROM z LEFT JOIN b ON b.user_id = z.user_id AND b.session = greatest(1, least(s - 1, round_even(0.7::DOUBLE * s, 0)))),
r AS (SELECT d.*, k.n, k.k FROM d JOIN k USING (user_id))"""
)
CELLS = (
    SPLIT
    + """,
m AS (SELECT user_id, quantile_cont(value, 0.5) AS scalar FROM r WHERE t < k GROUP BY user_id),
c0 AS (SELECT *, CAST(least(2, (row_number() OVER (ORDER BY scalar, user_id) - 1) * 3 // count(*) OVER ()) AS BIGINT) AS cell FROM m),
c AS (SELECT *, coalesce(lead(user_id) OVER w, first_value(user_id) OVER w) AS donor FROM c0 WINDOW w AS (PARTITION BY cell ORDER BY md5('0|' || user_id), user_id))"""
)
ARMS = (
    CELLS
    + """,
l AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS label),
tr AS (SELECT r.*, c.cell FROM r JOIN c USING (user_id) WHERE t < k),
a1 AS (SELECT l.label, (count(tr.user_id) + 1) / ((SELECT count(*) FROM tr) + 5.0) AS p FROM l LEFT JOIN tr ON tr.event_type = l.label GROUP BY l.label),
n2 AS (SELECT cell, count(*) AS n FROM tr GROUP BY cell),
a2 AS (SELECT n2.cell, l.label, (count(tr.user_id) + 1) / (any_value(n2.n) + 5.0) AS p FROM n2 CROSS JOIN l LEFT JOIN tr ON tr.cell = n2.cell AND tr.event_type = l.label GROUP BY n2.cell, l.label),
n4 AS (SELECT user_id, count(*) AS n FROM tr GROUP BY user_id),
a4 AS (SELECT n4.user_id, l.label, (count(tr.t) + 1) / (any_value(n4.n) + 5.0) AS p FROM n4 CROSS JOIN l LEFT JOIN tr ON tr.user_id = n4.user_id AND tr.event_type = l.label GROUP BY n4.user_id, l.label),
w AS (SELECT r.user_id, count(*) AS n, avg(-ln(0.2)) AS A0, avg(-ln(a1.p)) AS A1, avg(-ln(a2.p)) AS A2, avg(-ln(a3.p)) AS A3, avg(-ln(a4.p)) AS A4
      FROM r JOIN c USING (user_id) JOIN a1 ON a1.label = event_type JOIN a2 ON a2.cell = c.cell AND a2.label = event_type
      JOIN a4 AS a3 ON a3.user_id = c.donor AND a3.label = event_type JOIN a4 ON a4.user_id = r.user_id AND a4.label = event_type
      WHERE t >= k GROUP BY r.user_id)"""
)


def sessions_events(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "user_id", "t", "session", "session_pos")


def player_stats_events(spark, sf_dir):
    s = sessions.player_stats(events(spark, sf_dir), "user_id", "start")
    return s.filter("n_games >= 50 and n_sessions >= 3").select("user_id", "n_games", "n_sessions", r6("span_days", "span_days"))


def split_session_edge(spark, sf_dir):
    return sessions.session_split(events(spark, sf_dir), "user_id")


def split_first_seen(spark, sf_dir):
    return sessions.first_seen_split(events(spark, sf_dir), "user_id", "session")


def cells_tertile(spark, sf_dir):
    return cells(split_rows(spark, sf_dir)).select("user_id", r6("scalar", "scalar"), "cell")


def donor_map(spark, sf_dir):
    return cells(split_rows(spark, sf_dir)).select("user_id", "cell", "donor")


def donor_restricted(spark, sf_dir):
    """Donors among users who buy in their held-out rows."""
    rows = split_rows(spark, sf_dir)
    return arms.restrict_donors(cells(rows).select("user_id", "cell"), rows.filter("t >= k and event_type = 'purchase'").select("user_id").distinct())


def history_features(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("won", F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False))
    f = features.history_features(e, "user_id", ["t"], "won", "session_pos")
    return f.select("event_id", r6("post_loss", "post_loss"), r6("fatigue", "fatigue"), r6("momentum", "momentum"))


def answers(spark, sf_dir) -> DataFrame:
    """Items of orders as answers of a customer, in order, with skill, t and k; responses without the skill's difficulty."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    rows = li.select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", (F.col("l_returnflag") != "R").cast("int").alias("y")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = sessions.decisions(rows.withColumnRenamed("o_custkey", "user_id"), "user_id", ["o_orderdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "y"])
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    return rows.withColumn("k", F.bround(n * 0.7, 0).cast("long")).withColumn("skill", F.pmod("l_suppkey", F.lit(10)))


def with_difficulty(rows: DataFrame) -> DataFrame:
    hard = rows.filter("t < k").groupBy("skill").agg((1 - F.avg("y")).alias("difficulty"))
    return rows.join(F.broadcast(hard), "skill", "left").withColumn("difficulty", F.coalesce("difficulty", F.lit(0.5)))  # ten skills


def responses(spark, sf_dir) -> DataFrame:
    return with_difficulty(answers(spark, sf_dir))


RESPONSES = """
q0 AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS y, o_custkey AS user_id, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
q1 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o_orderdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, y) - 1 AS t, CAST(round_even(count(*) OVER (PARTITION BY user_id) * 0.7::DOUBLE, 0) AS BIGINT) AS k, l_suppkey % 10 AS skill FROM q0),
q2 AS (SELECT skill, 1 - avg(y) AS difficulty FROM q1 WHERE t < k GROUP BY skill),
q AS (SELECT q1.*, coalesce(q2.difficulty, 0.5) AS difficulty FROM q1 LEFT JOIN q2 USING (skill))"""


def item_difficulty(spark, sf_dir):
    return responses(spark, sf_dir).groupBy("skill").agg(F.count(F.lit(1)).alias("n"), r6(F.max("difficulty"), "difficulty"))


def memory_row(spark, sf_dir):
    rows = features.memory_row(responses(spark, sf_dir).select("l_orderkey", "l_linenumber", "user_id", "t", "y", "difficulty"), "user_id", ["t"], "y", "difficulty")
    return rows.select("l_orderkey", "l_linenumber", "t", *[r6(c, c) for c in rows.columns if c.startswith("f_")])


def _two(x: str, sign: str = "") -> str:
    """x with two decimals in SQL, rounded half to even after nine."""
    return f"printf('%{sign}.2f', (round_even(round({x}, 9) * 100, 0) / 100)::DOUBLE)"


def _answers(a: str) -> str:
    return (
        f"'Student state (' || CASE WHEN {a}.h < 0.5 THEN 'no answers yet' ELSE 'answers so far' END || '): overall accuracy ' || {_two(a + '.m')} || ', recent accuracy ' || {_two(a + '.r')} || ', last answer ' || "
        f"CASE WHEN {a}.l > 0.5 THEN 'correct' ELSE 'incorrect' END || ', streak ' || {_two(a + '.s', '+')} || ', skill-adjusted trend ' || {_two(a + '.e', '+')} || '.'"
    )


MEMORY_SQL = f"""WITH RECURSIVE {RESPONSES},
x AS (SELECT *, y - (1 - difficulty) AS res FROM q),
st AS (
  SELECT user_id, t, 0.5::DOUBLE AS ew, 0.0::DOUBLE AS rw, 0 AS streak, y, res FROM x WHERE t = 0
  UNION ALL
  SELECT x.user_id, x.t, CASE WHEN st.t = 0 THEN st.y::DOUBLE ELSE 0.9 * st.ew + 0.1 * st.y END, CASE WHEN st.t = 0 THEN st.res ELSE 0.9 * st.rw + 0.1 * st.res END,
         CASE WHEN st.y = 1 THEN CASE WHEN st.streak < 0 THEN CASE WHEN st.streak = -1 THEN 0 ELSE 1 END ELSE st.streak + 1 END ELSE CASE WHEN st.streak > 0 THEN -1 ELSE st.streak - 1 END END, x.y, x.res
  FROM st JOIN x ON x.user_id = st.user_id AND x.t = st.t + 1)
SELECT x.l_orderkey, x.l_linenumber, x.t, round(ln(1 + x.t) / 6, 6) AS f_volume, round(coalesce(avg(x.y) OVER p, 0.5), 6) AS f_mean, round(st.ew, 6) AS f_ewma,
  round(coalesce(avg(x.y) OVER p10, 0.5), 6) AS f_last10, round(coalesce(lag(x.y) OVER o, 0)::DOUBLE, 6) AS f_lag, round(tanh(st.streak / 5.0), 6) AS f_streak,
  round(coalesce(avg(x.res) OVER p, 0), 6) AS f_res_mean, round(st.rw, 6) AS f_res_ewma, round(coalesce(lag(x.res) OVER o, 0), 6) AS f_res_lag, CASE WHEN x.t > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f_has_history
FROM x JOIN st ON st.user_id = x.user_id AND st.t = x.t
WINDOW o AS (PARTITION BY x.user_id ORDER BY x.t), p AS (PARTITION BY x.user_id ORDER BY x.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p10 AS (PARTITION BY x.user_id ORDER BY x.t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""


def running_median_row(spark, sf_dir):
    rows = features.running_row(events(spark, sf_dir), "user_id", ["t"], "value", 2.0)
    return rows.select("event_id", *[r6(c, c) for c in ("r_median", "r_last5", "r_last", "r_quick")])


def dwell_buckets(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("dwell", sessions.dwell("start", ["user_id", "session"], ["t"]))
    return e.select("event_id", r6("dwell", "dwell"), F.coalesce(bucket(F.col("dwell") / 3600, CHESS_EDGES).cast("int"), F.lit(-1)).alias("bucket"), F.coalesce(F.when(F.col("dwell").isNotNull(), bucket_label(F.col("dwell") / 3600, CHESS_EDGES)), F.lit("none")).alias("label"))


def ema_state(spark, sf_dir):
    e = features.history_features(events(spark, sf_dir).withColumn("won", F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False)), "user_id", ["t"], "won", "session_pos")
    return folds.affine_fold(e, "user_id", "t", {"z": "post_loss"}).select("event_id", r6("z", "z"))


def state_notes(spark, sf_dir):
    """The state after each event in words: pressure of a two-hour clock per session, losses, length of the session, streaks."""
    e = events(spark, sf_dir).withColumn("won", F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False))
    e = features.history_features(e, "user_id", ["t"], "won", "session_pos")
    opened = F.first("start").over(Window.partitionBy("user_id", "session").orderBy("t"))
    e = e.withColumn("left", 7200 - (F.col("start") - opened)).withColumn("time_pressure", features.time_pressure("left"))
    dims = ["time_pressure", "post_loss", "fatigue", "momentum"]
    z = folds.affine_fold(e, "user_id", "t", {f"z_{d}": d for d in dims})
    return z.select("event_id", *[r6(f"z_{d}", f"z_{d}") for d in dims], folds.state_note({d: f"z_{d}" for d in dims}).alias("note"))


def source_states(spark, sf_dir):
    """Documents of a source in order as one history: the moving average of their length in pages of 2000 characters, two at most, after each."""
    d = table(spark, sf_dir, "documents").filter("source is not null").select("doc_id", "source", F.least(F.lit(2.0), F.col("n_chars") / 2000).alias("pages"))
    z = folds.affine_fold(folds.places(d, "source", ["doc_id"]), "source", "t", {"z": "pages"})
    return z.select("doc_id", "t", r6("z", "z"))


def live_window_rate(spark, sf_dir):
    return features.live_window_rate(responses(spark, sf_dir), "user_id", ["t"], "y").select("l_orderkey", "l_linenumber", r6("live_p", "live_p"))


def wide(spark, sf_dir) -> DataFrame:
    c = arms.user_counts(split_rows(spark, sf_dir), "event_type", LABELS, more=[scalar()])
    return arms.arm_scores(c, matched_cells(c), LABELS)


def arms_marginal(spark, sf_dir):
    return wide(spark, sf_dir).select("user_id", "n", *[r6(f"A{i}", f"a{i}") for i in range(5)])


def trial_contrasts(spark, sf_dir):
    s = arms.contrast_summary(arms.contrasts(wide(spark, sf_dir)))
    return s.select("contrast", "n", r6("mean_delta", "mean_delta"), r6("share_favourable", "share_favourable"))


def telescoping_identity(spark, sf_dir):
    c = arms.contrasts(wide(spark, sf_dir))
    per = c.groupBy("user_id").agg(F.abs(F.sum(F.when(F.col("contrast") == "total", -F.col("delta")).otherwise(F.col("delta")))).alias("err"))
    return per.agg(F.count(F.lit(1)).alias("n"), (F.max("err") < 1e-12).alias("holds"))


CONTRAST_SQL = ARMS + """,
x AS (SELECT user_id, unnest(['dpop', 'dgroup', 'ddistract', 'dindiv', 'total']) AS contrast, unnest([A1 - A0, A2 - A1, A3 - A2, A4 - A3, A4 - A0]) AS delta FROM w)"""


def dwelt(spark, sf_dir) -> DataFrame:
    return split_rows(spark, sf_dir).withColumn("dwell", sessions.dwell("start", ["user_id"], ["t"]))


def lognormal_marginal(spark, sf_dir):
    rows = dwelt(spark, sf_dir)
    m = simulators.lognormal_marginal(rows, cells(rows), "dwell")
    return m.select("user_id", "n", F.round("own", 5).alias("own"), F.round("other", 5).alias("other"))


def bernoulli_marginal(spark, sf_dir):
    rows = split_rows(spark, sf_dir).withColumn("y", (F.col("event_type") == "click").cast("int"))
    m = simulators.bernoulli_marginal(rows, cells(rows), "y")
    return m.select("user_id", "n", r6("own", "own"), r6("other", "other"))


def timing_buckets(spark, sf_dir):
    fit = simulators.lognormal_fit(dwelt(spark, sf_dir).filter("t < k").withColumn("hours", F.col("dwell") / 3600), ["user_id"], "hours")
    p = fit.withColumn("p", lognormal_bucket_probs("mu", "sigma", CHESS_EDGES)).select("user_id", F.posexplode("p").alias("bucket", "p"))
    return p.select("user_id", "bucket", F.round("p", 4).alias("p"))


def gain_by_segment_rollup(spark, sf_dir):
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    g = j.rollup("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), r6(F.median("o_totalprice"), "median_price"), r6(F.min("o_totalprice"), "min_price"), r6(F.max("o_totalprice"), "max_price"), F.grouping_id().cast("int").alias("level"))
    return g.select(F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), "n", "n_f", "median_price", "min_price", "max_price", "level")


def per_label_p(spark, sf_dir) -> DataFrame:
    """A p-value per event type from a normal score of the mean value against the overall mean."""
    e = table(spark, sf_dir, "events")
    a = e.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = e.groupBy("event_type").agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n")).crossJoin(a)
    return z.select("event_type", F.exp(-0.5 * F.pow((F.col("v") - F.col("m")) / F.col("s") * F.sqrt("n"), 2)).alias("p"))


def holm(spark, sf_dir):
    return inference.holm(per_label_p(spark, sf_dir), "p", alpha=0.9).select("event_type", r6("p", "p"), "holm")


def nation_scores(spark, sf_dir) -> DataFrame:
    """Two scores per nation: mean balance of its customers and of its suppliers, in whole hundreds (so that ties occur)."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.floor(F.avg("c_acctbal") / 100).alias("x"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.floor(F.avg("s_acctbal") / 100).alias("y"))
    return c.join(s, "nation").withColumn("all", F.lit(1))


NATION = """n AS (SELECT a.nation, x, y FROM (SELECT c_nationkey AS nation, floor(avg(c_acctbal) / 100) AS x FROM customer GROUP BY 1) AS a JOIN (SELECT s_nationkey AS nation, floor(avg(s_acctbal) / 100) AS y FROM supplier GROUP BY 1) AS b ON a.nation = b.nation)"""


def kendall(spark, sf_dir):
    return inference.kendall(nation_scores(spark, sf_dir), ["all"], "nation", "x", "y").select(r6("tau_a", "tau_a"), r6("tau_b", "tau_b"))


def spearman(spark, sf_dir):
    return inference.spearman(nation_scores(spark, sf_dir), ["all"], "x", "y").select("n", r6("spearman", "spearman"))


def two_afc(spark, sf_dir):
    w = wide(spark, sf_dir)
    return w.agg(F.count(F.lit(1)).alias("n"), r6(F.avg(inference.two_afc("A4", "A3")), "afc"), r6(F.exp(F.avg("A3") - F.avg("A4")), "perplexity_ratio"))


def tvd_js_accuracy(spark, sf_dir):
    """Order priorities of each segment's later orders against the rates of all earlier ones."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).withColumn("late", F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp"))
    real = metrics.label_profiles(o.filter("late"), ["c_mktsegment"], "o_orderpriority")
    model = metrics.label_profiles(o.filter("not late"), [], "o_orderpriority").withColumnRenamed("p", "q")
    both = real.join(F.broadcast(model), "o_orderpriority")  # five labels
    d = metrics.distribution_distances(both, ["c_mktsegment"], "p", "q")
    top = both.groupBy("c_mktsegment").agg(F.max_by("p", F.struct("q", "o_orderpriority")).alias("acc"))
    return d.join(top, "c_mktsegment").select(F.col("c_mktsegment").alias("segment"), r6("tvd", "tvd"), r6("js", "js"), r6("acc", "accuracy"))


def user_features(spark, sf_dir) -> DataFrame:
    """ln n, mean and sd of ln value, entropy and largest share of event types, from training rows."""
    tr = split_rows(spark, sf_dir).filter("t < k")
    a = tr.groupBy("user_id").agg(F.log(F.count(F.lit(1))).alias("ln_n"), F.avg(F.log1p("value")).alias("m"), F.stddev_pop(F.log1p("value")).alias("s"))
    p = metrics.label_profiles(tr, ["user_id"], "event_type").groupBy("user_id").agg((-F.sum(F.col("p") * F.log("p"))).alias("h"), F.max("p").alias("top"))
    return a.join(p, "user_id")


def behaviour_entropy(spark, sf_dir):
    return user_features(spark, sf_dir).select("user_id", *[r6(c, c) for c in ("ln_n", "m", "s", "h", "top")])


FEATS = CELLS + """,
fa AS (SELECT user_id, ln(count(*)) AS ln_n, avg(ln(1 + value)) AS m, stddev_pop(ln(1 + value)) AS s FROM r WHERE t < k GROUP BY user_id),
fp AS (SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM r WHERE t < k GROUP BY user_id, event_type),
f AS (SELECT fa.*, fb.h, fb.top FROM fa JOIN (SELECT user_id, -sum(p * ln(p)) AS h, max(p) AS top FROM fp GROUP BY user_id) AS fb USING (user_id))"""


def nearest_imposter(spark, sf_dir):
    """The nearest other user of the cell in z-scored features."""
    f = settle(user_features(spark, sf_dir))  # one row a user, read by the statistics and by both sides
    names = ["ln_n", "m", "s", "h", "top"]
    stats = f.agg(*[F.avg(c).alias(f"{c}_m") for c in names], *[F.stddev_pop(c).alias(f"{c}_s") for c in names])
    z = f.crossJoin(stats).select("user_id", F.array(*[(F.col(c) - F.col(f"{c}_m")) / F.when(F.col(f"{c}_s") < 1e-12, 1.0).otherwise(F.col(f"{c}_s")) for c in names]).alias("v"))
    z = z.join(cells(split_rows(spark, sf_dir)).select("user_id", "cell"), "user_id")
    z = settle(z)
    near = metrics.nearest(z, z, "user_id", "v", k=1, cell="cell")
    return near.select("user_id", F.col("neighbour").alias("donor"), F.round("distance", 5).alias("distance"))


NEAREST_SQL = f"""WITH {FEATS},
zs AS (SELECT avg(ln_n) a1, stddev_pop(ln_n) b1, avg(m) a2, stddev_pop(m) b2, avg(s) a3, stddev_pop(s) b3, avg(h) a4, stddev_pop(h) b4, avg(top) a5, stddev_pop(top) b5 FROM f),
zf AS (SELECT f.user_id, c.cell, (ln_n - a1) / b1 AS z1, (m - a2) / b2 AS z2, (s - a3) / b3 AS z3, (h - a4) / b4 AS z4, (top - a5) / b5 AS z5 FROM f CROSS JOIN zs JOIN c USING (user_id)),
pr AS (SELECT x.user_id, y.user_id AS donor, sqrt(power(x.z1 - y.z1, 2) + power(x.z2 - y.z2, 2) + power(x.z3 - y.z3, 2) + power(x.z4 - y.z4, 2) + power(x.z5 - y.z5, 2)) AS distance FROM zf x JOIN zf y ON x.cell = y.cell AND x.user_id <> y.user_id)
SELECT user_id, donor, round(distance, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY distance, donor) AS rn FROM pr) AS t WHERE rn = 1"""


def cross_scores(spark, sf_dir) -> DataFrame:
    """user, cell, donor, nll: held-out surprise of a user's labels under the rates of every user of the cell. One row of counts a user; both sides of a cell
    are cut into blocks that grow in number with the users, so that no task holds a cell. A row is copied to every block of the other side, so blocks are
    large: what is shuffled grows with users times blocks, and a block of rows of a hundred bytes fits into a task."""
    counts = arms.user_counts(split_rows(spark, sf_dir), "event_type", LABELS, more=[scalar()])
    both = counts.join(matched_cells(counts).select("user_id", "cell"), "user_id")
    n = -(-counts.count() // CROSS_BLOCK)
    block, every = F.pmod(F.xxhash64("user_id"), F.lit(n)).cast("int"), F.sequence(F.lit(0), F.lit(n - 1))
    held = both.filter("exists(h, x -> x > 0)").select("user_id", "cell", "h", block.alias("_x")).withColumn("_y", F.explode(every))
    own = both.select(F.col("user_id").alias("donor"), "cell", arms.log_rates("c", len(LABELS)).alias("_l"), block.alias("_y")).withColumn("_x", F.explode(every))
    return held.join(own, ["cell", "_x", "_y"]).select("user_id", "cell", "donor", arms.mean_surprise("h", "_l").alias("nll"))


CROSS = ARMS + """,
xm AS (SELECT r.user_id, c.cell, d2.user_id AS donor, avg(-ln(a4.p)) AS nll FROM r JOIN c USING (user_id) JOIN c AS d2 ON d2.cell = c.cell JOIN a4 ON a4.user_id = d2.user_id AND a4.label = r.event_type WHERE r.t >= r.k GROUP BY r.user_id, c.cell, d2.user_id)"""


def cross_matrix(spark, sf_dir):
    return cross_scores(spark, sf_dir).select("user_id", "donor", r6("nll", "nll"))


def hardest(counts: DataFrame) -> DataFrame:
    return arms.hardest_donors(counts, matched_cells(counts), len(LABELS))


def hardest_donor(spark, sf_dir):
    x = hardest(arms.user_counts(split_rows(spark, sf_dir), "event_type", LABELS, more=[scalar()]))
    return x.select("user_id", r6("own", "own"), r6("hardest", "hardest"))


def mean_trajectory_hold_last(spark, sf_dir):
    rows = split_rows(spark, sf_dir).join(cells(split_rows(spark, sf_dir)).select("user_id", "cell"), "user_id")
    last = rows.groupBy("cell").agg(F.max("t").alias("last"))
    m = arms.hold_last_means(rows, ["cell"], "t", "k", "value", last)
    return m.select("cell", "t", r6("mean", "mean"))


def clamped_donor_series(spark, sf_dir):
    """The donor's training value at the user's step, or the donor's last one."""
    rows = split_rows(spark, sf_dir)
    c = cells(rows).select("user_id", "donor")
    series = rows.filter("t < k").select(F.col("user_id").alias("donor"), F.col("t").alias("s_t"), F.col("value").alias("donor_value"))
    return arms.clamped(rows.join(c, "user_id").select("event_id", "donor", "t"), series, "donor").select("event_id", r6("donor_value", "donor_value"))


def length_edges(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile("value", F.array(*[F.lit(q) for q in (0.2, 0.4, 0.6, 0.8)])).alias("q"))
    return e.select("event_type", *[r6(F.col("q")[i], f"q{i + 1}") for i in range(4)])


def odd_even_split(spark, sf_dir):
    e = split_rows(spark, sf_dir).filter("t >= k")
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("t")) - 1
    return e.withColumn("half", F.when(at % 2 == 0, "odd").otherwise("even")).groupBy("half").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "mean_value"))


def option_softmax(spark, sf_dir):
    """Softmax over a supplier's three numbers, as rows."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", softmax(F.array(F.col("s_acctbal") / 1000, F.col("s_nationkey") / 10.0, F.lit(0.5))).alias("p"))
    return s.select("s_suppkey", *[r6(F.col("p")[i], f"p{i}") for i in range(3)])


def logit_losses(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("y", (F.col("event_type") == "click").cast("int"))
    return e.groupBy("event_type").agg(r6(F.avg(logit_nll("y", (F.col("value") - 50) / 25)), "logit_nll"), r6(F.avg(lognormal_nll(F.col("value") + 1, F.lit(3.0), F.lit(1.1))), "lognormal_nll"))


def bootstrap_ci(spark, sf_dir):
    return inference.bootstrap_ci(arms.contrasts(wide(spark, sf_dir)), ["contrast"], "delta")


def signflip(spark, sf_dir):
    return inference.signflip_p(arms.contrasts(wide(spark, sf_dir)), ["contrast"], "delta")


def think_rows(spark, sf_dir):
    """What is known of a user's pauses before each event: seconds as hundredths of an hour, under pressure in the last hour of a two-hour clock per session."""
    e = events(spark, sf_dir)
    opened = F.first("start").over(Window.partitionBy("user_id", "session").orderBy("t"))
    e = e.withColumn("spent", sessions.dwell("start", ["user_id", "session"], ["t"]) / 36).withColumn("left", (7200 - (F.col("start") - opened)) / 60)
    r = features.think_row(e.select("event_id", "user_id", "t", "spent", "left"), "user_id", ["t"], "spent", "left")
    return r.select("event_id", *[r6(c, c) for c in ("m_has_history", "m_elo", "m_median", "m_last5", "m_last", "m_fast", "m_pressure")])


MEMORY = ["f_volume", "f_mean", "f_ewma", "f_last10", "f_lag", "f_streak", "f_res_mean", "f_res_ewma", "f_res_lag", "f_has_history"]
NEUTRAL_MEMORY = [0.0, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
#: Weights of a plain model of kept items: a constant, the item's difficulty, the overall rate, the recent rate and the run.
PLAIN = [1.0, -1.0, 1.5, 0.5, 0.25]


def memory_answers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Items of orders as answers (user_id, t, k, y, difficulty), a few bytes a row, and cells: tertiles of a customer's median price in training."""
    rows = written(answers(spark, sf_dir).select("user_id", "t", "k", "y", "skill", F.col("l_extendedprice").alias("value")))
    return with_difficulty(rows).select("user_id", "t", "k", "y", "difficulty"), written(cells(rows))


def remembered(rows: DataFrame, keys: list[str]) -> DataFrame:
    return features.memory_row(rows, keys, ["t"], "y", "difficulty")


def memory_records(spark, sf_dir):
    """Items of orders as records for a model: the question, four cards and the label. Texts as one digest, the own card as it is."""
    r = ladder.answer_records(*memory_answers(spark, sf_dir), MEMORY, NEUTRAL_MEMORY, make=remembered)
    return r.select("user_id", "t", "part", "label", "self_card", F.md5(F.concat_ws("|", "base", "frozen_card", "group_card", "placebo_card")).alias("texts"))


def memory_drift(spark, sf_dir):
    """A plain model of given weights under the six arms: mean held-out surprise of each customer, and what stops with a frozen memory."""
    x = ladder.Served(*memory_answers(spark, sf_dir), MEMORY, NEUTRAL_MEMORY, ["difficulty", "y"], make=remembered).rows(train=False)
    z = ladder.score(["difficulty", "f_mean", "f_last10", "f_streak"], F.array(*[F.lit(w) for w in PLAIN]))
    w = ladder.per_arm(x.withColumn("nll", ladder.surprise(z, "y")), ["user_id"])
    return w.select("user_id", *[r6(a, a.lower()) for a in (*ladder.ARMS, "drift")])


def memory_ladder(spark, sf_dir):
    """The same under fitted models: means over customers by grade."""
    x = ladder.Served(*memory_answers(spark, sf_dir), MEMORY, NEUTRAL_MEMORY, ["difficulty", "y"], make=remembered, keep_as=written)
    w = ladder.graded(x.rows, MEMORY, ["difficulty"], "y", ridge=1e-4)
    return w.groupBy("grade").agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(a.lower()) for a in (*ladder.ARMS, "drift")])


def irls(spark, sf_dir):
    """Coefficients of a pooled logistic model of returned items on the memory row."""
    rows = features.memory_row(responses(spark, sf_dir).select("user_id", "t", "k", "y", "difficulty"), "user_id", ["t"], "y", "difficulty")
    names = ["f_mean", "f_ewma", "f_lag", "f_streak", "difficulty"]
    b = simulators.fit_logistic(rows.filter("t < k"), names, "y", ridge=1e-4)
    return spark.createDataFrame([(n, float(v)) for n, v in zip(["constant", *names], b, strict=True)], "term string, coefficient double")


QUERIES = {f.__name__: f for f in (
    trial_contrasts, sessions_events, player_stats_events, split_session_edge, split_first_seen, cells_tertile, donor_map, donor_restricted, history_features, item_difficulty, memory_row, running_median_row,
    dwell_buckets, ema_state, state_notes, source_states, live_window_rate, arms_marginal, telescoping_identity, lognormal_marginal, bernoulli_marginal, timing_buckets, gain_by_segment_rollup, holm, kendall, spearman, two_afc, tvd_js_accuracy,
    behaviour_entropy, nearest_imposter, cross_matrix, hardest_donor, mean_trajectory_hold_last, clamped_donor_series, length_edges, odd_even_split, option_softmax, logit_losses, bootstrap_ci, signflip, irls, memory_drift, memory_ladder, think_rows, memory_records,
)}

HIST = """h AS (SELECT *, CASE WHEN event_type = 'error' THEN t END AS lost, CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'error' THEN 0 END AS won FROM d),
hf AS (SELECT event_id, user_id, t, coalesce(greatest(0, 1 - (t - 1 - max(lost) OVER p) / 3.0), 0) AS post_loss, least(1, session_pos / 20.0) AS fatigue, coalesce((avg(won) OVER p5 - 0.5) * 2, 0) AS momentum FROM h
       WINDOW p AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p5 AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"""
# Published coefficients of the rational approximation of the normal distribution.
PHI = "CASE WHEN {z} >= 0 THEN 1 - {t} ELSE {t} END"
TAIL = "exp(-{z} * {z} / 2) / sqrt(2 * pi()) * ({k} * (0.319381530 + {k} * (-0.356563782 + {k} * (1.781477937 + {k} * (-1.821255978 + {k} * 1.330274429)))))"


def phi(z: str) -> str:
    return PHI.format(z=z, t=TAIL.format(z=z, k=f"(1 / (1 + 0.2316419 * abs({z})))"))


TIMING_SQL = f"""WITH {SPLIT},
x AS (SELECT *, (start - lag(start) OVER (PARTITION BY user_id ORDER BY t)) / 3600 AS hours FROM r),
ft AS (SELECT user_id, avg(ln(greatest(hours, 1e-3))) AS mu, greatest(stddev_pop(ln(greatest(hours, 1e-3))), 0.05) AS sigma FROM x WHERE t < k AND hours IS NOT NULL GROUP BY user_id),
zs AS (SELECT user_id, (ln(1::DOUBLE) - mu) / sigma AS z1, (ln(3::DOUBLE) - mu) / sigma AS z2, (ln(8::DOUBLE) - mu) / sigma AS z3, (ln(20::DOUBLE) - mu) / sigma AS z4 FROM ft),
cd AS (SELECT user_id, {phi("z1")} AS c1, {phi("z2")} AS c2, {phi("z3")} AS c3, {phi("z4")} AS c4 FROM zs),
ps AS (SELECT user_id, unnest([0, 1, 2, 3, 4]) AS bucket, unnest([greatest(0, c1), greatest(0, c2 - c1), greatest(0, c3 - c2), greatest(0, c4 - c3), greatest(0, 1 - c4)]) AS p FROM cd)
SELECT user_id, bucket, round(p, 4) AS p FROM ps"""
ORACLE_SQL = {
    "timing_buckets": TIMING_SQL,
    "donor_restricted": f"WITH {CELLS}, el AS (SELECT c.user_id, c.cell FROM c WHERE user_id IN (SELECT user_id FROM r WHERE t >= k AND event_type = 'purchase')) SELECT user_id, cell, coalesce(lead(user_id) OVER w, first_value(user_id) OVER w) AS donor FROM el WINDOW w AS (PARTITION BY cell ORDER BY md5('0|' || user_id), user_id)",
    "sessions_events": f"WITH {BASE} SELECT event_id, user_id, t, session, session_pos FROM d",
    "player_stats_events": f"WITH {BASE} SELECT user_id, count(*) AS n_games, count(DISTINCT session) AS n_sessions, round(CASE WHEN count(start) >= 2 THEN (max(start) - min(start)) / 86400 ELSE 0 END, 6) AS span_days FROM d GROUP BY user_id HAVING count(*) >= 50 AND count(DISTINCT session) >= 3",
    "split_session_edge": f"WITH {SPLIT} SELECT user_id, n, k FROM k",
    "split_first_seen": f"WITH {BASE}, z AS (SELECT user_id, session, count(*) AS rows_, row_number() OVER (PARTITION BY user_id ORDER BY min(t)) AS rk, count(*) OVER (PARTITION BY user_id) AS s FROM d GROUP BY user_id, session) SELECT user_id, CAST(sum(rows_) AS BIGINT) AS n, CAST(CASE WHEN max(s) < 2 THEN round_even(0.7::DOUBLE * sum(rows_), 0) ELSE sum(CASE WHEN rk <= greatest(1, round_even(0.7::DOUBLE * s, 0)) THEN rows_ ELSE 0 END) END AS BIGINT) AS k FROM z GROUP BY user_id",
    "cells_tertile": f"WITH {CELLS} SELECT user_id, round(scalar, 6) AS scalar, cell FROM c",
    "donor_map": f"WITH {CELLS} SELECT user_id, cell, donor FROM c",
    "history_features": f"WITH {BASE}, {HIST} SELECT event_id, round(post_loss, 6) AS post_loss, round(fatigue::DOUBLE, 6) AS fatigue, round(momentum, 6) AS momentum FROM hf",
    "item_difficulty": f"WITH {RESPONSES} SELECT skill, count(*) AS n, round(max(difficulty), 6) AS difficulty FROM q GROUP BY skill",
    "memory_row": MEMORY_SQL,
    "memory_records": MEMORY_SQL[: MEMORY_SQL.index("SELECT x.l_orderkey")].rstrip() + f""",
mm AS (SELECT x.user_id, x.t, x.k, x.y, x.difficulty, x.l_extendedprice AS value, coalesce(avg(x.y) OVER p, 0.5) AS m, coalesce(avg(x.y) OVER p10, 0.5) AS r, coalesce(lag(x.y) OVER o, 0)::DOUBLE AS l, tanh(st.streak / 5.0) AS s, st.rw AS e, CASE WHEN x.t > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS h
  FROM x JOIN st ON st.user_id = x.user_id AND st.t = x.t
  WINDOW p AS (PARTITION BY x.user_id ORDER BY x.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p10 AS (PARTITION BY x.user_id ORDER BY x.t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY x.user_id ORDER BY x.t)),
me AS (SELECT user_id, quantile_cont(value, 0.5) AS scalar FROM mm WHERE t < k GROUP BY user_id),
ce AS (SELECT *, CAST(least(2, (row_number() OVER (ORDER BY scalar, user_id) - 1) * 3 // count(*) OVER ()) AS BIGINT) AS cell FROM me),
ba AS (SELECT mm.*, ce.cell FROM mm JOIN ce USING (user_id)),
a1 AS (SELECT t, avg(m) AS m, avg(r) AS r, avg(l) AS l, avg(s) AS s, avg(e) AS e, avg(h) AS h FROM ba WHERE t < k GROUP BY t),
a2 AS (SELECT cell, t, avg(m) AS m, avg(r) AS r, avg(l) AS l, avg(s) AS s, avg(e) AS e, avg(h) AS h FROM ba WHERE t < k GROUP BY cell, t),
hc AS (SELECT cell, max(k) AS h FROM ba GROUP BY cell), en AS (SELECT user_id, least(max(k), max(t)) AS t FROM ba GROUP BY user_id)
SELECT b.user_id, b.t, CASE WHEN b.t < b.k THEN 'train' ELSE 'eval' END AS part, CASE WHEN b.y > 0.5 THEN 'correct' ELSE 'incorrect' END AS label, {_answers("b")} AS self_card,
  md5(concat_ws('|', 'Predict whether this student answers the next question correctly.' || chr(10) || 'Question difficulty: ' || {_two("b.difficulty")} || ' (0 = easiest, 1 = hardest). Attempt ' || (b.t + 1) || '.', {_answers("f")}, {_answers("g")}, {_answers("a")})) AS texts
FROM ba AS b JOIN hc ON hc.cell = b.cell JOIN en ON en.user_id = b.user_id JOIN ba AS f ON f.user_id = b.user_id AND f.t = en.t JOIN a1 AS a ON a.t = least(b.t, (SELECT max(k) FROM ba) - 1) JOIN a2 AS g ON g.cell = b.cell AND g.t = least(b.t, hc.h - 1)""",
    "memory_drift": MEMORY_SQL[: MEMORY_SQL.index("SELECT x.l_orderkey")].rstrip() + """,
mm AS (SELECT x.user_id, x.t, x.k, x.y, x.difficulty, x.l_extendedprice AS value, coalesce(avg(x.y) OVER p, 0.5) AS m, coalesce(avg(x.y) OVER p10, 0.5) AS r, tanh(st.streak / 5.0) AS s FROM x JOIN st ON st.user_id = x.user_id AND st.t = x.t
  WINDOW p AS (PARTITION BY x.user_id ORDER BY x.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p10 AS (PARTITION BY x.user_id ORDER BY x.t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
me AS (SELECT user_id, quantile_cont(value, 0.5) AS scalar FROM mm WHERE t < k GROUP BY user_id),
ce AS (SELECT *, CAST(least(2, (row_number() OVER (ORDER BY scalar, user_id) - 1) * 3 // count(*) OVER ()) AS BIGINT) AS cell FROM me),
dn AS (SELECT *, coalesce(lead(user_id) OVER w, first_value(user_id) OVER w) AS donor FROM ce WINDOW w AS (PARTITION BY cell ORDER BY md5('0|' || user_id), user_id)),
ba AS (SELECT mm.*, dn.cell, dn.donor FROM mm JOIN dn USING (user_id)),
a1 AS (SELECT t, avg(m) AS m, avg(r) AS r, avg(s) AS s FROM ba WHERE t < k GROUP BY t),
a2 AS (SELECT cell, t, avg(m) AS m, avg(r) AS r, avg(s) AS s FROM ba WHERE t < k GROUP BY cell, t),
hc AS (SELECT cell, max(k) AS h FROM ba GROUP BY cell), ks AS (SELECT user_id, max(k) AS k FROM ba GROUP BY user_id),
sv AS (SELECT b.user_id, b.difficulty AS d, b.y, unnest(['a0', 'a1', 'a2', 'a3', 'a4', 'a4frozen']) AS arm, unnest([0.5, coalesce(p1.m, 0.5), coalesce(p2.m, 0.5), coalesce(p3.m, 0.5), b.m, coalesce(p4.m, 0.5)]) AS m,
         unnest([0.5, coalesce(p1.r, 0.5), coalesce(p2.r, 0.5), coalesce(p3.r, 0.5), b.r, coalesce(p4.r, 0.5)]) AS r, unnest([0, coalesce(p1.s, 0), coalesce(p2.s, 0), coalesce(p3.s, 0), b.s, coalesce(p4.s, 0)]) AS s
       FROM ba AS b JOIN hc ON hc.cell = b.cell JOIN ks ON ks.user_id = b.donor LEFT JOIN a1 AS p1 ON p1.t = least(b.t, (SELECT max(k) FROM ba) - 1) LEFT JOIN a2 AS p2 ON p2.cell = b.cell AND p2.t = least(b.t, hc.h - 1)
       LEFT JOIN ba AS p3 ON p3.user_id = b.donor AND p3.t = least(b.t, ks.k - 1) AND p3.t < p3.k LEFT JOIN ba AS p4 ON p4.user_id = b.user_id AND p4.t = least(b.t, b.k - 1) AND p4.t < p4.k
       WHERE b.t >= b.k AND b.donor <> b.user_id),
zz AS (SELECT user_id, arm, y, 1 - d + 1.5::DOUBLE * m + 0.5::DOUBLE * r + 0.25::DOUBLE * s AS z FROM sv),
nl AS (SELECT user_id, arm, avg(ln(1 + exp(-abs(z))) + greatest(z, 0) - y * z) AS v FROM zz GROUP BY 1, 2)
SELECT user_id, round(any_value(v) FILTER (WHERE arm = 'a0'), 6) AS a0, round(any_value(v) FILTER (WHERE arm = 'a1'), 6) AS a1, round(any_value(v) FILTER (WHERE arm = 'a2'), 6) AS a2, round(any_value(v) FILTER (WHERE arm = 'a3'), 6) AS a3,
  round(any_value(v) FILTER (WHERE arm = 'a4'), 6) AS a4, round(any_value(v) FILTER (WHERE arm = 'a4frozen'), 6) AS a4frozen, round(any_value(v) FILTER (WHERE arm = 'a4frozen') - any_value(v) FILTER (WHERE arm = 'a4'), 6) AS drift FROM nl GROUP BY user_id""",
    "running_median_row": f"WITH {BASE} SELECT event_id, round(quantile_cont(value, 0.5) OVER p, 6) AS r_median, round(avg(value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS r_last5, round(lag(value) OVER (PARTITION BY user_id ORDER BY t), 6) AS r_last, round(avg(CASE WHEN value < 2 THEN 1.0 ELSE 0.0 END) OVER p, 6) AS r_quick FROM d WINDOW p AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "dwell_buckets": f"WITH {BASE}, x AS (SELECT event_id, start - lag(start) OVER (PARTITION BY user_id, session ORDER BY t) AS dwell FROM d) SELECT event_id, round(dwell, 6) AS dwell, CAST(CASE WHEN dwell IS NULL THEN -1 WHEN dwell / 3600 < 1 THEN 0 WHEN dwell / 3600 < 3 THEN 1 WHEN dwell / 3600 < 8 THEN 2 WHEN dwell / 3600 < 20 THEN 3 ELSE 4 END AS INT) AS bucket, CASE WHEN dwell IS NULL THEN 'none' WHEN dwell / 3600 < 1 THEN 'under 1s' WHEN dwell / 3600 < 3 THEN '1 to 3s' WHEN dwell / 3600 < 8 THEN '3 to 8s' WHEN dwell / 3600 < 20 THEN '8 to 20s' ELSE 'over 20s' END AS label FROM x",
    "ema_state": f"WITH RECURSIVE {BASE}, {HIST}, z AS (SELECT event_id, user_id, t, 0.4 * post_loss AS z FROM hf WHERE t = 0 UNION ALL SELECT hf.event_id, hf.user_id, hf.t, 0.6 * z.z + 0.4 * hf.post_loss FROM z JOIN hf ON hf.user_id = z.user_id AND hf.t = z.t + 1) SELECT event_id, round(z, 6) AS z FROM z",
    "state_notes": f"""WITH RECURSIVE {BASE}, {HIST}, o AS (SELECT event_id, greatest(0, least(1, 1 - (7200 - (start - min(start) OVER (PARTITION BY user_id, session))) / 30)) AS pressure FROM d),
x AS (SELECT hf.*, o.pressure FROM hf JOIN o USING (event_id)),
z AS (SELECT event_id, user_id, t, 0.4 * pressure AS a, 0.4 * post_loss AS b, 0.4 * fatigue AS c, 0.4 * momentum AS m FROM x WHERE t = 0
      UNION ALL SELECT x.event_id, x.user_id, x.t, 0.6 * z.a + 0.4 * x.pressure, 0.6 * z.b + 0.4 * x.post_loss, 0.6 * z.c + 0.4 * x.fatigue, 0.6 * z.m + 0.4 * x.momentum FROM z JOIN x ON x.user_id = z.user_id AND x.t = z.t + 1),
p AS (SELECT *, list_filter([CASE WHEN round(a, 9) > 0.5 THEN 'under time pressure (rushing, more errors likely)' END, CASE WHEN round(b, 9) > 0.5 THEN 'just lost (may be tilted / over-aggressive)' END, CASE WHEN round(c, 9) > 0.5 THEN 'deep into the session (fatigued, slower decline)' END,
      CASE WHEN round(m, 9) > 0.4 THEN 'on a winning streak (confident)' WHEN round(m, 9) < -0.4 THEN 'on a losing streak (shaken)' END], lambda s: s IS NOT NULL) AS said FROM z)
SELECT event_id, round(a, 6) AS z_time_pressure, round(b, 6) AS z_post_loss, round(c, 6) AS z_fatigue, round(m, 6) AS z_momentum, 'Current player state: ' || CASE WHEN len(said) = 0 THEN 'composed, near baseline form' ELSE array_to_string(said, '; ') END || '.' AS note FROM p""",
    "think_rows": f"""WITH {BASE}, x AS (SELECT event_id, user_id, t, coalesce((start - lag(start) OVER (PARTITION BY user_id, session ORDER BY t)) / 36, 0) AS x, (7200 - (start - min(start) OVER (PARTITION BY user_id, session))) / 60 AS rest FROM d),
m AS (SELECT *, median(x) OVER p AS med, avg(x) OVER p5 AS l5, lag(x) OVER (PARTITION BY user_id ORDER BY t) AS l1, avg(CASE WHEN x < 2 THEN 1.0 ELSE 0.0 END) OVER p AS fast, avg(CASE WHEN rest < 60 THEN x END) OVER p AS press FROM x
      WINDOW p AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p5 AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT event_id, CASE WHEN t > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m_has_history, 1500.0::DOUBLE AS m_elo, round(coalesce(med, 0), 6) AS m_median, round(coalesce(l5, 0), 6) AS m_last5, round(coalesce(l1, 0), 6) AS m_last, round(coalesce(fast, 0), 6) AS m_fast, round(coalesce(press, med, 0), 6) AS m_pressure FROM m""",
    "source_states": "WITH RECURSIVE d AS (SELECT doc_id, source, least(2, n_chars / 2000) AS x, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS t FROM documents WHERE source IS NOT NULL), z AS (SELECT doc_id, source, t, 0.4::DOUBLE * x AS z FROM d WHERE t = 0 UNION ALL SELECT d.doc_id, d.source, d.t, 0.6::DOUBLE * z.z + 0.4::DOUBLE * d.x FROM z JOIN d ON d.source = z.source AND d.t = z.t + 1) SELECT doc_id, t, round(z, 6) AS z FROM z",
    "live_window_rate": f"WITH {RESPONSES} SELECT l_orderkey, l_linenumber, round((coalesce(sum(y) OVER w, 0) + 1) / (count(y) OVER w + 2), 6) AS live_p FROM q WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)",
    "arms_marginal": f"WITH {ARMS} SELECT user_id, n, round(A0, 6) AS a0, round(A1, 6) AS a1, round(A2, 6) AS a2, round(A3, 6) AS a3, round(A4, 6) AS a4 FROM w",
    "trial_contrasts": f"WITH {CONTRAST_SQL} SELECT contrast, count(*) AS n, round(avg(delta), 6) AS mean_delta, round(avg(CASE WHEN delta < 0 THEN 1.0 ELSE 0.0 END), 6) AS share_favourable FROM x GROUP BY contrast",
    "telescoping_identity": f"WITH {ARMS} SELECT count(*) AS n, max(abs((A1 - A0) + (A2 - A1) + (A3 - A2) + (A4 - A3) - (A4 - A0))) < 1e-12 AS holds FROM w",
    "lognormal_marginal": f"WITH {CELLS}, x AS (SELECT *, start - lag(start) OVER (PARTITION BY user_id ORDER BY t) AS dwell FROM r), ft AS (SELECT user_id, avg(ln(greatest(dwell, 1e-3))) AS mu, greatest(stddev_pop(ln(greatest(dwell, 1e-3))), 0.05) AS sigma FROM x WHERE t < k AND dwell IS NOT NULL GROUP BY user_id), hl AS (SELECT x.user_id, c.donor, CASE WHEN dwell <= 0 THEN 1e-3 ELSE dwell END AS s FROM x JOIN c USING (user_id) WHERE t >= k AND dwell IS NOT NULL AND c.donor <> x.user_id) SELECT hl.user_id, count(*) AS n, round(avg(0.5 * power((ln(s) - f.mu) / f.sigma, 2) + ln(f.sigma) + 0.5 * ln(2 * pi()) + ln(s)), 5) AS own, round(avg(0.5 * power((ln(s) - g.mu) / g.sigma, 2) + ln(g.sigma) + 0.5 * ln(2 * pi()) + ln(s)), 5) AS other FROM hl JOIN ft AS f ON f.user_id = hl.user_id JOIN ft AS g ON g.user_id = hl.donor GROUP BY hl.user_id",
    "bernoulli_marginal": f"WITH {CELLS}, y AS (SELECT *, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS y FROM r), p AS (SELECT user_id, (sum(y) + 1.0) / (count(*) + 2) AS p FROM y WHERE t < k GROUP BY user_id) SELECT y.user_id, count(*) AS n, round(avg(-(y * ln(a.p) + (1 - y) * ln(1 - a.p))), 6) AS own, round(avg(-(y * ln(b.p) + (1 - y) * ln(1 - b.p))), 6) AS other FROM y JOIN c USING (user_id) JOIN p AS a ON a.user_id = y.user_id JOIN p AS b ON b.user_id = c.donor WHERE t >= k AND c.donor <> y.user_id GROUP BY y.user_id",
    "gain_by_segment_rollup": "SELECT coalesce(c_mktsegment, 'all') AS segment, count(*) AS n, count_if(o_orderstatus = 'F')::BIGINT AS n_f, round(median(o_totalprice), 6) AS median_price, round(min(o_totalprice), 6) AS min_price, round(max(o_totalprice), 6) AS max_price, CAST(grouping(c_mktsegment) AS INT) AS level FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment)",
    "holm": "WITH a AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events), z AS (SELECT event_type, exp(-0.5 * power((avg(value) - any_value(m)) / any_value(s) * sqrt(count(*)), 2)) AS p FROM events CROSS JOIN a GROUP BY event_type), o AS (SELECT *, CASE WHEN p <= 0.9 / (count(*) OVER () - row_number() OVER (ORDER BY p) + 1) THEN 1 ELSE 0 END AS ok FROM z) SELECT event_type, round(p, 6) AS p, min(ok) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) = 1 AS holm FROM o",
    "kendall": f"WITH {NATION}, p AS (SELECT sign(a.x - b.x) AS dx, sign(a.y - b.y) AS dy FROM n a JOIN n b ON a.nation < b.nation) SELECT round(sum(dx * dy) / count(*), 6) AS tau_a, round(CASE WHEN sum(abs(dx)) = 0 OR sum(abs(dy)) = 0 THEN 0 ELSE sum(dx * dy) / sqrt(sum(abs(dx)) * sum(abs(dy))) END, 6) AS tau_b FROM p",
    "spearman": f"WITH {NATION}, k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM n) SELECT count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM k",
    "two_afc": f"WITH {ARMS} SELECT count(*) AS n, round(avg(CASE WHEN A4 < A3 THEN 1.0 WHEN A4 > A3 THEN 0.0 ELSE 0.5 END), 6) AS afc, round(exp(avg(A3) - avg(A4)), 6) AS perplexity_ratio FROM w",
    "tvd_js_accuracy": "WITH o AS (SELECT c_mktsegment, o_orderpriority, o_orderdate >= TIMESTAMP '1997-01-01' AS late FROM orders JOIN customer ON o_custkey = c_custkey), m AS (SELECT o_orderpriority, count(*) / sum(count(*)) OVER () AS q FROM o WHERE NOT late GROUP BY 1), p AS (SELECT c_mktsegment, o_orderpriority, count(*) / sum(count(*)) OVER (PARTITION BY c_mktsegment) AS p FROM o WHERE late GROUP BY 1, 2), b AS (SELECT * FROM p JOIN m USING (o_orderpriority)) SELECT c_mktsegment AS segment, round(sum(abs(p - q)) / 2, 6) AS tvd, round(0.5 * sum(p * ln(p / ((p + q) / 2))) + 0.5 * sum(q * ln(q / ((p + q) / 2))), 6) AS js, round(arg_max(p, (q, o_orderpriority)), 6) AS accuracy FROM b GROUP BY 1",
    "behaviour_entropy": f"WITH {FEATS} SELECT user_id, round(ln_n, 6) AS ln_n, round(m, 6) AS m, round(s, 6) AS s, round(h, 6) AS h, round(top, 6) AS top FROM f",
    "nearest_imposter": NEAREST_SQL,
    "cross_matrix": f"WITH {CROSS} SELECT user_id, donor, round(nll, 6) AS nll FROM xm",
    "hardest_donor": f"WITH {CROSS} SELECT user_id, round(max(CASE WHEN donor = user_id THEN nll END), 6) AS own, round(min(CASE WHEN donor <> user_id THEN nll END), 6) AS hardest FROM xm GROUP BY user_id",
    "mean_trajectory_hold_last": f"WITH {CELLS}, x AS (SELECT r.*, c.cell FROM r JOIN c USING (user_id)), mt AS (SELECT cell, t, avg(value) AS m FROM x WHERE t < k GROUP BY cell, t), gd AS (SELECT cell, unnest(range(0, max(t) + 1)) AS t FROM x GROUP BY cell) SELECT gd.cell, gd.t, round(last_value(m IGNORE NULLS) OVER (PARTITION BY gd.cell ORDER BY gd.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS mean FROM gd LEFT JOIN mt ON mt.cell = gd.cell AND mt.t = gd.t",
    "clamped_donor_series": f"WITH {CELLS} SELECT r.event_id, round(s.value, 6) AS donor_value FROM r JOIN c USING (user_id) JOIN k AS dk ON dk.user_id = c.donor JOIN r AS s ON s.user_id = c.donor AND s.t = least(r.t, dk.k - 1)",
    "length_edges": "SELECT event_type, round(quantile_cont(value, 0.2), 6) AS q1, round(quantile_cont(value, 0.4), 6) AS q2, round(quantile_cont(value, 0.6), 6) AS q3, round(quantile_cont(value, 0.8), 6) AS q4 FROM events GROUP BY event_type",
    "odd_even_split": f"WITH {SPLIT}, x AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY t) - 1) % 2 AS o FROM r WHERE t >= k) SELECT CASE WHEN o = 0 THEN 'odd' ELSE 'even' END AS half, count(*) AS n, round(avg(value), 6) AS mean_value FROM x GROUP BY 1",
    "option_softmax": "WITH s AS (SELECT s_suppkey, exp(s_acctbal / 1000) AS a, exp(s_nationkey / 10.0) AS b, exp(0.5) AS c FROM supplier) SELECT s_suppkey, round(a / (a + b + c), 6) AS p0, round(b / (a + b + c), 6) AS p1, round(c / (a + b + c), 6) AS p2 FROM s",
    "logit_losses": "WITH e AS (SELECT event_type, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS y, (value - 50) / 25 AS z, value + 1 AS v FROM events) SELECT event_type, round(avg(ln(1 + exp(-abs(z))) + greatest(z, 0) - y * z), 6) AS logit_nll, round(avg(0.5 * power((ln(v) - 3) / 1.1, 2) + ln(1.1) + 0.5 * ln(2 * pi()) + ln(v)), 6) AS lognormal_nll FROM e GROUP BY event_type",
}
