"""Queries on cohorts, reused arms, samples, records of decisions, clocks and readouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidelis.functions import text as tx
from fidelis.functions.scalars import bernoulli_nll, duration, in_trouble, option_nll, scramble, softmax, zero_inflated_nll
from fidelis.operators import arms, cohorts, inference, metrics, readouts, sessions, simulators
from fidelis.plans.trial import ARMS, BASE, CELLS, SPLIT, cells, events, r6, responses, split_rows, table, wide


def yearly(spark, sf_dir) -> DataFrame:
    """Customers with an order in each of three years, as cohorts."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    return cohorts.united([(str(y), o.filter(F.col("y") == y).select("o_custkey")) for y in (1995, 1996, 1997)])


def cohort_dedup(spark, sf_dir):
    """Customers of each cohort, and those that no cohort before it has."""
    return cohorts.dropped(yearly(spark, sf_dir), "o_custkey")


def cohort_rows(spark, sf_dir):
    """Orders of the cohort in which a customer comes first."""
    return cohorts.earliest_cohort(yearly(spark, sf_dir), "o_custkey").groupBy("cohort").agg(F.count(F.lit(1)).alias("orders"))


def reused_no_info(spark, sf_dir):
    """Mean order values as scores: the arm A0 of finished orders serves all configurations."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("config"), F.when(F.col("o_orderpriority") < "2", "A0").when(F.col("o_orderpriority") < "4", "A3").otherwise("A4").alias("arm"), "o_totalprice")
    s = o.groupBy("user_id", "config", "arm").agg(F.avg("o_totalprice").alias("v"))
    r = cohorts.reused_arm(s, ["user_id"], "config", "F", "A0", ["A0", "A3", "A4"], "v")
    return r.select("user_id", "config", *[r6(c, c.lower()) for c in ("A0", "A3", "A4")])


def few_shot(spark, sf_dir):
    """Four training events of each user in seeded order."""
    return cohorts.few_shot(split_rows(spark, sf_dir).filter("t < k").select("user_id", "event_id"), "user_id", "event_id").select("user_id", "event_id", "shot")


def ordinal_labels(spark, sf_dir):
    """Places of order priorities in their closed list."""
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return table(spark, sf_dir, "orders").groupBy(cohorts.label_order("o_orderpriority", names).alias("place")).agg(F.count(F.lit(1)).alias("n"))


def top_pick(spark, sf_dir):
    """Of each market segment the nation with the least mean balance, and its rank by mean order value."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("v"))
    m = c.join(o, "c_custkey").groupBy("c_mktsegment", "c_nationkey").agg(F.avg("c_acctbal").alias("s"), F.avg("v").alias("g"))
    return cohorts.top_pick(m, ["c_mktsegment"], "c_nationkey", "s", "g")


def shortest_slice(spark, sf_dir):
    """The shortest document of each language and source, of the 140 pairs for which it is shortest."""
    d = table(spark, sf_dir, "documents").withColumn("user", F.concat_ws("/", "lang", "source"))
    return cohorts.shortest_items(d, "user", "n_chars", "doc_id")


def cap_shift(spark, sf_dir):
    """Mean order value per customer with and without a cap, less the customer's balance: what the cap shifts in each segment."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg(F.least("o_totalprice", F.lit(4000.0))).alias("cut"), F.avg("o_totalprice").alias("whole"))
    d = c.join(o, "c_custkey").select("c_mktsegment", (F.col("cut") - F.col("c_acctbal")).alias("old"), (F.col("whole") - F.col("c_acctbal")).alias("new"))
    return cohorts.paired_shift(d, ["c_mktsegment"], "old", "new").select("c_mktsegment", "n", *[F.round(x, 4).alias(x) for x in ("old", "new", "shift")], "turned")


def pooled_stream(spark, sf_dir):
    rows = split_rows(spark, sf_dir)
    j = rows.join(cells(rows).select("user_id", "cell"), "user_id")
    return cohorts.pooled_stream(j, "cell", "user_id", "t", "k", "value").select("cell", "t", "user_id", r6("value", "value"))


def decision_records(spark, sf_dir):
    rows = split_rows(spark, sf_dir)
    return cohorts.records(rows, cells(rows), "value", "event_type")


def remapped_events(spark, sf_dir):
    """Rows and sum of values per mapped user; users who buy in their held-out rows keep their own name."""
    rows = split_rows(spark, sf_dir)
    m = cells(rows).join(rows.filter("t >= k and event_type = 'purchase'").select("user_id").distinct(), "user_id", "left_anti")
    return arms.remap(rows.select("user_id", "value"), m, "user_id").groupBy("donor").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


def session_clocks(spark, sf_dir):
    """Sessions as games: their length in hours, and whether a clock of two hours comes to its last ten minutes. Times are hours, the first is unknown."""
    e = events(spark, sf_dir).withColumn("dwell", sessions.dwell("start", ["user_id", "session"], ["t"]) / 60)
    spent = F.sum(F.coalesce("dwell", F.lit(0.0))).over(Window.partitionBy("user_id", "session").orderBy("t").rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("left", F.lit(120.0) - F.coalesce(spent, F.lit(0.0)))
    g = e.groupBy("user_id", "session").agg(F.sort_array(F.collect_list(F.struct("t", "dwell", "left"))).alias("plies"), F.count_if(in_trouble("left")).alias("troubled"))
    return g.select("user_id", "session", r6(duration("plies.dwell"), "minutes"), "troubled", scramble("plies.left").alias("scramble"))


def option_scores(spark, sf_dir):
    """Three options a supplier with log-probabilities and token counts: accuracy and loss per token, by nation."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", softmax(F.array(F.col("s_acctbal") / 1000, F.col("s_nationkey") / 10.0, F.lit(0.5))).alias("p"))
    s = s.select("s_nationkey", F.transform("p", lambda x: F.log(x)).alias("logp"), (F.col("s_suppkey") % 3).cast("int").alias("label"), F.array(F.lit(1), F.lit(2), F.lit(4)).alias("tokens"))
    nll = s.groupBy("s_nationkey").agg(r6(F.avg(option_nll("logp", "label", "tokens")), "nll"))
    return metrics.accuracy(s, ["s_nationkey"], "logp", "label").join(nll, "s_nationkey").select("s_nationkey", "n", r6("accuracy", "accuracy"), "nll")


def timing_losses(spark, sf_dir):
    """Zero-inflated log-normal loss of values, and clipped Bernoulli loss of large ones, per event type."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(r6(F.avg(zero_inflated_nll(F.col("value") / 10, F.lit(0.1), F.lit(1.0), F.lit(0.9))), "zero_inflated"), r6(F.avg(bernoulli_nll((F.col("value") > 50).cast("int"), F.col("value") / 100)), "bernoulli"))


def dose_ladder(spark, sf_dir):
    """Years as doses, order status as seed: swing and direction of mean order values per priority."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.year("o_orderdate").alias("dose"), (F.col("o_totalprice") / 1000).alias("v"))
    return inference.dose_readout(o, ["o_orderpriority"], "dose", "v").select("o_orderpriority", r6("swing", "swing"), "monotone", r6("swing_over_sd", "swing_over_sd"))


def detection_rates(spark, sf_dir):
    """Suppliers as replicates of their nation: how often the interval of the mean discount less 5 % is below 0."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg((F.avg("l_discount") - 0.05).alias("point"), (F.avg("l_discount") - 0.05 + 1.96 * F.stddev_samp("l_discount") / F.sqrt(F.count(F.lit(1)))).alias("high"))
    r = inference.detection_rate(li.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey"), ["s_nationkey"], "high", "point")
    return r.select("s_nationkey", "n", r6("rate", "rate"), r6("mean_point", "mean_point"), r6("sd_point", "sd_point"), *[r6(F.col("q_point")[i], f"q{i}") for i in range(3)])


def marginal_residual(spark, sf_dir):
    """Gain of the label arms beyond the gain of click rates alone."""
    rows = split_rows(spark, sf_dir).withColumn("y", (F.col("event_type") == "click").cast("int"))
    m = simulators.bernoulli_marginal(rows, cells(rows), "y")
    r = readouts.marginal_residual(wide(spark, sf_dir).select("user_id", F.col("A3").alias("a3"), F.col("A4").alias("a4f")), m, "user_id")
    return r.select("n", r6("model", "model"), r6("marginal", "marginal"), r6("residual", "residual"))


def legal_marginal(spark, sf_dir):
    """Loss of held-out event types under training shares among a session's types; errors are no legal choice."""
    rows = split_rows(spark, sf_dir)
    legal = rows.filter("t >= k").groupBy("user_id", "session").agg(F.sort_array(F.array_union(F.array(F.lit("view")), F.filter(F.collect_set("event_type"), lambda x: x != "error"))).alias("legal_actions"))
    held = rows.filter("t >= k").join(legal, ["user_id", "session"])
    return simulators.legal_marginal(rows.filter("t < k"), held, key="event_type").select("user_id", "t", r6("nll", "nll"))


def value_distances(spark, sf_dir):
    """Distances between the values of the first and the later events, per event type."""
    e = split_rows(spark, sf_dir).withColumn("side", (F.col("t") >= F.col("k")).cast("int"))
    w = metrics.wasserstein_1d(e, ["event_type"], "side", "value")
    h = metrics.histogram_distances(e, ["event_type"], "side", "value")
    return w.join(h, "event_type").select("event_type", r6("w1", "w1"), r6("js_bits", "js_bits"), r6("kl_laplace", "kl_laplace"))


def irt_difficulties(spark, sf_dir):
    """One-parameter difficulties of skills from customers' responses."""
    return simulators.fit_irt(responses(spark, sf_dir).filter("t < k"), "user_id", "skill", "y")[1]


def ratio_gain(spark, sf_dir):
    """Share of the whole gain that a user's own information brings, with an interval."""
    w = wide(spark, sf_dir).select(F.lit("own").alias("contrast"), (F.col("A4") - F.col("A3")).alias("a"), (F.col("A4") - F.col("A0")).alias("b"))
    return inference.ratio_ci(w, ["contrast"], "a", "b")


def hierarchical_gain(spark, sf_dir):
    """Mean order values of customers per status (as seeds), both resampled."""
    o = table(spark, sf_dir, "orders").select(F.lit("all").alias("combo"), "o_custkey", "o_orderstatus", (F.col("o_totalprice") / 1000).alias("v"))
    return inference.hierarchical_ci(o, ["combo"], "o_custkey", "o_orderstatus", "v")


def document_heads(spark, sf_dir):
    """Heads, tails, slugs and last lines of whole documents."""
    d = table(spark, sf_dir, "documents")
    last = tx.final_episode("text", "\n")
    return d.select("doc_id", F.md5(F.concat(tx.head_text("text", 600), tx.tail_text("text", 1200))).alias("ends"), F.md5(tx.slug("text")).alias("slug"), F.md5(last["before"]).alias("before"), F.coalesce(F.md5(last["last"]), F.lit("none")).alias("last"))


QUERIES = {f.__name__: f for f in (
    cohort_dedup, cohort_rows, reused_no_info, few_shot, ordinal_labels, top_pick, shortest_slice, cap_shift, pooled_stream, decision_records, remapped_events, session_clocks, option_scores, timing_losses, dose_ladder,
    detection_rates, marginal_residual, legal_marginal, value_distances, irt_difficulties, ratio_gain, hierarchical_gain, document_heads,
)}

COHORTS = "u AS (SELECT o_custkey, year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) IN (1995, 1996, 1997)), f AS (SELECT o_custkey, min(y) AS first FROM u GROUP BY 1)"
CARD = "CASE WHEN {n} > 0 THEN printf('events %d; mean %.2f', {n}, round_even({m} * 100, 0) / 100) ELSE 'no history' END"
GRID = ", ".join(str((i + 0.5) / 200) for i in range(200))
ORACLE_SQL = {
    "cohort_dedup": f"WITH {COHORTS} SELECT CAST(y AS VARCHAR) AS cohort, count(DISTINCT o_custkey) AS users, count(DISTINCT CASE WHEN y = first THEN o_custkey END) AS kept FROM u JOIN f USING (o_custkey) GROUP BY y",
    "cohort_rows": f"WITH {COHORTS} SELECT CAST(y AS VARCHAR) AS cohort, count(*) AS orders FROM u JOIN f USING (o_custkey) WHERE y = first GROUP BY y",
    "reused_no_info": "WITH s AS (SELECT o_custkey AS user_id, o_orderstatus AS config, CASE WHEN o_orderpriority < '2' THEN 'A0' WHEN o_orderpriority < '4' THEN 'A3' ELSE 'A4' END AS arm, avg(o_totalprice) AS v FROM orders GROUP BY ALL), w AS (SELECT user_id, config, max(CASE WHEN arm = 'A3' THEN v END) AS a3, max(CASE WHEN arm = 'A4' THEN v END) AS a4 FROM s WHERE arm <> 'A0' GROUP BY 1, 2) SELECT w.user_id, w.config, round(s.v, 6) AS a0, round(a3, 6) AS a3, round(a4, 6) AS a4 FROM w JOIN s ON s.user_id = w.user_id AND s.config = 'F' AND s.arm = 'A0'",
    "few_shot": f"WITH {SPLIT}, x AS (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY md5('7|' || event_id), event_id) AS INT) AS shot FROM r WHERE t < k) SELECT * FROM x WHERE shot <= 4",
    "ordinal_labels": "SELECT CAST(left(o_orderpriority, 1) AS BIGINT) - 1 AS place, count(*) AS n FROM orders GROUP BY 1",
    "top_pick": "WITH v AS (SELECT o_custkey, avg(o_totalprice) AS v FROM orders GROUP BY 1), m AS (SELECT c_mktsegment, c_nationkey, avg(c_acctbal) AS s, avg(v) AS g FROM customer JOIN v ON o_custkey = c_custkey GROUP BY 1, 2), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY g DESC, c_nationkey) AS INT) AS rank, row_number() OVER (PARTITION BY c_mktsegment ORDER BY s, c_nationkey) AS nth FROM m) SELECT c_mktsegment, c_nationkey AS pick, rank FROM k WHERE nth = 1",
    "shortest_slice": "WITH d AS (SELECT concat_ws('/', lang, source) AS \"user\", doc_id, n_chars, row_number() OVER (PARTITION BY concat_ws('/', lang, source) ORDER BY n_chars, doc_id) AS rn FROM documents WHERE n_chars > 0 AND n_chars <= 300000) SELECT \"user\", doc_id, n_chars FROM d WHERE rn = 1 ORDER BY n_chars, doc_id LIMIT 140",
    "cap_shift": "WITH o AS (SELECT o_custkey, avg(least(o_totalprice, 4000.0)) AS cut, avg(o_totalprice) AS whole FROM orders GROUP BY 1), d AS (SELECT c_mktsegment, cut - c_acctbal AS old, whole - c_acctbal AS new FROM customer JOIN o ON o_custkey = c_custkey) SELECT c_mktsegment, count(*) AS n, round(avg(old), 4) AS old, round(avg(new), 4) AS new, round(avg(new - old), 4) AS shift, sign(avg(old)) <> sign(avg(new)) AS turned FROM d GROUP BY 1",
    "pooled_stream": f"WITH {CELLS}, x AS (SELECT c.cell, r.t, r.user_id, r.value, row_number() OVER (PARTITION BY c.cell, r.t ORDER BY md5('0|' || r.t || '|' || r.user_id), r.user_id) AS rn FROM r JOIN c USING (user_id) WHERE t < k) SELECT cell, t, user_id, round(value, 6) AS value FROM x WHERE rn = 1",
    "decision_records": f"""WITH {CELLS},
st AS (SELECT user_id, t, k, event_type, value, count(value) OVER w AS n, CAST(sum(CAST(value AS DECIMAL(20, 4))) OVER w AS DOUBLE) / count(value) OVER w AS m, count(CASE WHEN t < k THEN value END) OVER w AS fn, CAST(sum(CASE WHEN t < k THEN CAST(value AS DECIMAL(20, 4)) END) OVER w AS DOUBLE) / count(CASE WHEN t < k THEN value END) OVER w AS fm FROM r WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT st.*, c.cell, c.donor FROM st JOIN c USING (user_id) WHERE c.donor <> st.user_id),
gr AS (SELECT cell, count(value) AS gn, CAST(sum(CAST(value AS DECIMAL(20, 4))) AS DOUBLE) / count(value) AS gm FROM j WHERE t < k GROUP BY cell)
SELECT j.user_id, j.t, CASE WHEN j.t < j.k THEN 'train' ELSE 'eval' END AS part, j.event_type, {CARD.format(n='j.n', m='j.m')} AS self_card, {CARD.format(n='j.fn', m='j.fm')} AS frozen_card, {CARD.format(n='gn', m='gm')} AS group_card, {CARD.format(n='d.fn', m='d.fm')} AS placebo_card
FROM j JOIN gr ON gr.cell = j.cell JOIN k AS dk ON dk.user_id = j.donor JOIN st AS d ON d.user_id = j.donor AND d.t = least(j.t, dk.k - 1)""",
    "remapped_events": f"WITH {CELLS}, own AS (SELECT DISTINCT user_id FROM r WHERE t >= k AND event_type = 'purchase'), mp AS (SELECT user_id, donor FROM c WHERE user_id NOT IN (SELECT user_id FROM own)) SELECT coalesce(mp.donor, r.user_id) AS donor, count(*) AS n, round(sum(value), 3) AS total FROM r LEFT JOIN mp USING (user_id) GROUP BY 1",
    "session_clocks": f"WITH {BASE}, x AS (SELECT user_id, session, t, (start - lag(start) OVER (PARTITION BY user_id, session ORDER BY t)) / 60 AS dwell FROM d), y AS (SELECT *, 120 - coalesce(sum(coalesce(dwell, 0)) OVER (PARTITION BY user_id, session ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM x) SELECT user_id, session, round(sum(coalesce(dwell, 0)), 6) AS minutes, CAST(count_if(rest <= 10) AS BIGINT) AS troubled, bool_or(rest <= 10) AS scramble FROM y GROUP BY 1, 2",
    "option_scores": "WITH s AS (SELECT s_nationkey, s_suppkey % 3 AS l, s_acctbal / 1000 AS a, s_nationkey / 10.0::DOUBLE AS b, 0.5::DOUBLE AS c FROM supplier), z AS (SELECT *, ln(exp(a) + exp(b) + exp(c)) AS z FROM s) SELECT s_nationkey, count(*) AS n, round(avg(CASE WHEN l = CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE l WHEN 0 THEN z - a WHEN 1 THEN (z - b) / 2 ELSE (z - c) / 4 END), 6) AS nll FROM z GROUP BY 1",
    "timing_losses": "WITH e AS (SELECT event_type, value / 10 AS s, CASE WHEN value > 50 THEN 1 ELSE 0 END AS y, greatest(1e-9, least(1 - 1e-9, value / 100)) AS p FROM events) SELECT event_type, round(avg(CASE WHEN s < 0.5 THEN -ln(0.1) ELSE -ln(0.9) + 0.5 * power((ln(CASE WHEN s <= 0 THEN 1e-3 ELSE s END) - 1) / 0.9, 2) + ln(0.9) + 0.5 * ln(2 * pi()) + ln(CASE WHEN s <= 0 THEN 1e-3 ELSE s END) END), 6) AS zero_inflated, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS bernoulli FROM e GROUP BY 1",
    "dose_ladder": "WITH p AS (SELECT o_orderpriority, year(o_orderdate) AS dose, avg(o_totalprice / 1000) AS m, stddev_samp(o_totalprice / 1000) AS sd FROM orders GROUP BY 1, 2), s AS (SELECT *, m - lag(m) OVER (PARTITION BY o_orderpriority ORDER BY dose) AS step FROM p) SELECT o_orderpriority, round(arg_max(m, dose) - arg_min(m, dose), 6) AS swing, bool_and(coalesce(step <= 1e-12, true)) AS monotone, round((arg_max(m, dose) - arg_min(m, dose)) / avg(sd), 6) AS swing_over_sd FROM s GROUP BY 1",
    "detection_rates": "WITH l AS (SELECT l_suppkey, avg(l_discount) - 0.05 AS point, avg(l_discount) - 0.05 + 1.96 * stddev_samp(l_discount) / sqrt(count(*)) AS high FROM lineitem GROUP BY 1) SELECT s_nationkey, count(*) AS n, round(avg(CASE WHEN high < 0 THEN 1.0 ELSE 0.0 END), 6) AS rate, round(avg(point), 6) AS mean_point, round(stddev_samp(point), 6) AS sd_point, round(quantile_cont(point, 0.025), 6) AS q0, round(quantile_cont(point, 0.5), 6) AS q1, round(quantile_cont(point, 0.975), 6) AS q2 FROM l JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1",
    "marginal_residual": f"WITH {ARMS}, y AS (SELECT *, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS y FROM r), p AS (SELECT user_id, (sum(y) + 1.0) / (count(*) + 2) AS p FROM y WHERE t < k GROUP BY user_id), bm AS (SELECT y.user_id, avg(-(y * ln(a.p) + (1 - y) * ln(1 - a.p))) AS own, avg(-(y * ln(b.p) + (1 - y) * ln(1 - b.p))) AS other FROM y JOIN c USING (user_id) JOIN p AS a ON a.user_id = y.user_id JOIN p AS b ON b.user_id = c.donor WHERE t >= k AND c.donor <> y.user_id GROUP BY y.user_id) SELECT count(*) AS n, round(avg(A4 - A3), 6) AS model, round(avg(own - other), 6) AS marginal, round(avg((A4 - A3) - (own - other)), 6) AS residual FROM w JOIN bm USING (user_id)",
    "legal_marginal": f"WITH {SPLIT}, cn AS (SELECT event_type, count(*) AS c FROM r WHERE t < k GROUP BY 1), lg AS (SELECT user_id, session, list_sort(list_distinct(list_append(list(event_type) FILTER (WHERE event_type <> 'error'), 'view'))) AS legal FROM r WHERE t >= k GROUP BY 1, 2), h AS (SELECT r.user_id, r.t, CASE WHEN list_contains(legal, event_type) THEN event_type ELSE legal[1] END AS seen, unnest(legal) AS a FROM r JOIN lg USING (user_id, session) WHERE t >= k) SELECT user_id, t, round(-ln(max(CASE WHEN a = seen THEN coalesce(c, 0) + 0.5 END) / sum(coalesce(c, 0) + 0.5)), 6) AS nll FROM h LEFT JOIN cn ON cn.event_type = h.a GROUP BY 1, 2",
    "value_distances": f"""WITH {SPLIT}, ev AS (SELECT event_type, value, CASE WHEN t >= k THEN 1 ELSE 0 END AS side FROM r),
qs AS (SELECT event_type, quantile_cont(value, [{GRID}]) FILTER (WHERE side = 0) AS a, quantile_cont(value, [{GRID}]) FILTER (WHERE side = 1) AS b FROM ev GROUP BY 1),
w AS (SELECT event_type, list_sum(list_transform(range(1, 201), lambda i: abs(a[i] - b[i]))) / 200 AS w1 FROM qs),
ed AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM ev GROUP BY 1),
bn AS (SELECT event_type, least(11, floor((value - lo) / (hi - lo) * 12)) AS bin, count_if(side = 0) AS c0, count_if(side = 1) AS c1 FROM ev JOIN ed USING (event_type) GROUP BY 1, 2),
pr AS (SELECT event_type, c0 / sum(c0) OVER v AS p, c1 / sum(c1) OVER v AS q, (c0 + 1 / 12.0::DOUBLE) / (sum(c0) OVER v + 1) AS p1, (c1 + 1 / 12.0::DOUBLE) / (sum(c1) OVER v + 1) AS q1 FROM bn WINDOW v AS (PARTITION BY event_type)),
dv AS (SELECT event_type, sum(0.5 * CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + 0.5 * CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / ln(2) AS js_bits, sum(p1 * ln(p1 / q1)) AS kl_laplace FROM pr GROUP BY 1)
SELECT event_type, round(w1, 6) AS w1, round(js_bits, 6) AS js_bits, round(kl_laplace, 6) AS kl_laplace FROM w JOIN dv USING (event_type)""",
    "document_heads": r"SELECT doc_id, md5((CASE WHEN length(text) > 600 THEN left(text, 600) || '…' ELSE text END) || (CASE WHEN length(text) > 1200 THEN '…' || right(text, 1200) ELSE text END)) AS ends, md5(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, md5(CASE WHEN contains(text, chr(10)) THEN left(text, length(text) - length(list_last(string_split(text, chr(10)))) - 1) ELSE text END) AS before, coalesce(md5(CASE WHEN contains(text, chr(10)) THEN chr(10) || list_last(string_split(text, chr(10))) END), 'none') AS last FROM documents",
}
