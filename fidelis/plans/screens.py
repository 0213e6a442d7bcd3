"""Queries that choose a metric and check tables against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fidelis.operators import arms, contracts, panel, screen
from fidelis.plans.trial import ARMS, LABELS, cells, r6, split_rows, table

SCREEN = {"line": ("own_line", "donor_line"), "card": ("own_card", "donor_card")}


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a person: the first half of their turns makes the card, later ones are records; donors have as many turns (four and more are one class)."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    mine = Window.partitionBy("conv_id")
    c = c.withColumn("i", F.row_number().over(mine.orderBy("turn"))).withColumn("n", F.count(F.lit(1)).over(mine)).filter("n >= 2")
    cells = c.filter("i = 1").select("conv_id", F.least("n", F.lit(4)).alias("cell"))
    donors = arms.matched(arms.donors(cells, "conv_id"), "conv_id")
    return screen.screen_rows(c.filter("2 * i <= n + 1"), c.filter("2 * i > n + 1"), donors, "conv_id", ["turn"], "text", ["turn"], screen.word_terms("_text"))


def card_line_maxima(spark, sf_dir):
    """Of each later turn the largest cosine with a line of the own card and of a look-alike's, and the cosines with the whole cards."""
    r = screened(spark, sf_dir)
    return r.select("conv_id", "turn", *[F.round(c, 5).alias(c) for m in SCREEN.values() for c in m])


def metric_screen(spark, sf_dir):
    """Which of both metrics tells people from their look-alikes, by intervals over people."""
    return screen.choose_metric(screened(spark, sf_dir), "conv_id", SCREEN)


def source_digests(spark, sf_dir):
    """One digest of the documents of each source, whole and in order."""
    return contracts.row_digests(table(spark, sf_dir, "documents"), "source", ["doc_id"], ["doc_id", "lang", "text"])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out events under three arms by two simulators, which differ in how much they smooth a user's rates: sim, user_id, t, arm, nll."""
    rows = split_rows(spark, sf_dir)
    counts = arms.user_counts(rows, "event_type", LABELS)
    pairs = arms.matched(cells(rows))
    m = len(LABELS)
    total = F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x)
    place = F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("event_type")).cast("int")
    held = rows.filter("t >= k").select("user_id", "t", place.alias("place")).join(pairs.select("user_id", "donor"), "user_id")
    out = None
    for sim, a in (("laplace", 1.0), ("half", 0.5)):
        rates = counts.select("user_id", F.transform("c", lambda x: -F.log((x + a) / (total + a * m))).alias("s"))  # noqa: B023
        j = held.join(rates, "user_id").join(rates.select(F.col("user_id").alias("donor"), F.col("s").alias("d")), "donor")
        each = F.explode(F.array(*[F.struct(F.lit(arm).alias("arm"), v.alias("nll")) for arm, v in (("A0", F.log(F.lit(float(m)))), ("A3", F.element_at("d", F.col("place"))), ("A4", F.element_at("s", F.col("place"))))]))
        part = j.select(F.lit(sim).alias("sim"), "user_id", "t", each.alias("_a")).select("sim", "user_id", "t", "_a.*")
        out = part if out is None else out.unionByName(part)
    return out


def trial_table(spark, sf_dir):
    """Both simulators on rows that must be the same: counts, digest, and gains of one's own information."""
    t = contracts.trial_table(scored(spark, sf_dir), "sim", "user_id", ["t"], "arm", "nll", "laplace", intervals=False)
    return t.select("sim", "n_users", "n_rows", "row_digest", r6("d_indiv", "d_indiv"), r6("d_total", "d_total"))


def user_volume(spark, sf_dir):
    """Users' first events of a kind and day as conversations: how many, on how many days, and whether that is enough."""
    e = table(spark, sf_dir, "events").withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    e = e.withColumn("hash", F.concat_ws("|", "user_id", "event_type", F.substring("at", 1, 10)))
    return panel.user_volume(e, "user_id", "hash", "at", 30, 20)


def label_coverage(spark, sf_dir):
    """Labels by source: every label must belong to a document, documents without a label are left out."""
    d, l = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    labelled = d.join(l.select("doc_id"), "doc_id", "left_semi")
    j = contracts.covering(contracts.unique(l, ["doc_id"]), labelled, ["doc_id"])
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"), F.sum("quality").alias("quality"))


QUERIES = {f.__name__: f for f in (card_line_maxima, metric_screen, source_digests, trial_table, label_coverage, user_volume)}


def _weights(name: str, docs: str) -> str:
    """Unit TF-IDF weights of the rows (key, text) of docs."""
    return rf"""{name}_c AS (SELECT key, term, count(*) AS c FROM (SELECT key, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM {docs}) AS t GROUP BY 1, 2),
{name}_i AS (SELECT term, ln((1 + (SELECT count(DISTINCT key) FROM {name}_c)) / (1 + count(*))) + 1 AS idf FROM {name}_c GROUP BY term),
{name}_n AS (SELECT key, sqrt(sum(((1 + ln(c)) * idf) ** 2)) AS norm FROM {name}_c JOIN {name}_i USING (term) GROUP BY key),
{name} AS (SELECT key, term, (1 + ln(c)) * idf / norm AS w FROM {name}_c JOIN {name}_i USING (term) JOIN {name}_n USING (key))"""


def _digest(rows: str, by: str, order: str, columns: list[str]) -> str:
    """The digests of rows, as in the operator: by, n_rows, digest."""
    named = ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)
    hashed = f"SELECT {by}, sha256(concat(row_number() OVER (PARTITION BY {by} ORDER BY {order}) - 1, '|', {named})) AS h FROM {rows}"
    parts = ", ".join(f"sum(CAST('0x' || substr(h, {15 * i + 1}, 15) AS BIGINT))" for i in range(4))
    return f"SELECT {by}, count(*) AS n_rows, sha256(concat_ws('|', count(*), {parts})) AS digest FROM ({hashed}) AS x GROUP BY {by}"


ORACLE_SQL = {
    "source_digests": _digest("documents", "source", "doc_id", ["doc_id", "lang", "text"]),
    "trial_table": f"""WITH {ARMS}, h AS (SELECT r.user_id, r.t, r.event_type, c.donor FROM r JOIN c USING (user_id) WHERE t >= k AND c.donor <> r.user_id),
n AS (SELECT user_id, event_type, count(*) AS c FROM r WHERE t < k GROUP BY 1, 2), o AS (SELECT user_id, sum(c) AS n FROM n GROUP BY 1),
sv AS (SELECT h.*, z.sim, -ln((coalesce(a.c, 0) + z.a) / (oa.n + 5 * z.a)) AS own, -ln((coalesce(b.c, 0) + z.a) / (ob.n + 5 * z.a)) AS other
      FROM h CROSS JOIN (SELECT unnest(['laplace', 'half']) AS sim, unnest([1.0::DOUBLE, 0.5::DOUBLE]) AS a) AS z JOIN o AS oa USING (user_id) JOIN o AS ob ON ob.user_id = h.donor
      LEFT JOIN n AS a ON a.user_id = h.user_id AND a.event_type = h.event_type LEFT JOIN n AS b ON b.user_id = h.donor AND b.event_type = h.event_type),
p AS (SELECT sim, user_id, avg(own) - avg(other) AS i, avg(own) - ln(5) AS a FROM sv GROUP BY 1, 2), gv AS ({_digest("sv", "sim", "user_id, t", ["user_id", "t"])})
SELECT p.sim, count(*) AS n_users, any_value(gv.n_rows) AS n_rows, any_value(gv.digest) AS row_digest, round(avg(i), 6) AS d_indiv, round(avg(a), 6) AS d_total FROM p JOIN gv USING (sim) GROUP BY p.sim""",
    "user_volume": "WITH f AS (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events GROUP BY 1, 2, 3) SELECT user_id, count(*) AS n, count(DISTINCT day) AS n_days, count(*) >= 30 AND count(DISTINCT day) >= 20 AS ok FROM f GROUP BY user_id",
    "label_coverage": "SELECT source, count(*) AS n, sum(toxic)::BIGINT AS toxic, sum(quality)::BIGINT AS quality FROM labels JOIN documents USING (doc_id) GROUP BY source",
    "card_line_maxima": rf"""
WITH u AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'user'),
d AS (SELECT conv_id, coalesce(lead(conv_id) OVER w, first_value(conv_id) OVER w) AS donor FROM u WHERE i = 1 AND n >= 2 WINDOW w AS (PARTITION BY least(n, 4) ORDER BY md5('0|' || conv_id), conv_id)),
l AS (SELECT conv_id, turn, regexp_replace(unnest(s), '^\s+|\s+$', '', 'g') AS line, generate_subscripts(s, 1) AS j FROM (SELECT conv_id, turn, string_split_regex(text, '\r\n|\r|\n') AS s FROM u WHERE n >= 2 AND 2 * i <= n + 1) AS x),
f AS (SELECT conv_id, line, min((turn, j)) AS p FROM l WHERE line <> '' GROUP BY 1, 2),
k AS (SELECT conv_id, line, row_number() OVER w AS nth, sum(len(string_split_regex(line, '\s+'))) OVER w AS run FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY p ROWS UNBOUNDED PRECEDING)),
card AS (SELECT conv_id, line, nth FROM k WHERE run <= 100),
r AS (SELECT u.conv_id, u.turn, u.text, d.donor FROM u JOIN d USING (conv_id) WHERE n >= 2 AND 2 * i > n + 1 AND d.donor <> u.conv_id AND conv_id IN (SELECT conv_id FROM card) AND donor IN (SELECT conv_id FROM card)),
ld AS (SELECT 'L|' || conv_id || '|' || nth AS key, line AS text FROM card UNION ALL SELECT 'R|' || conv_id || '|' || turn, text FROM r),
cd AS (SELECT 'L|' || conv_id AS key, string_agg(line, chr(10) ORDER BY nth) AS text FROM card GROUP BY conv_id UNION ALL SELECT 'R|' || conv_id || '|' || turn, text FROM r),
{_weights("lw", "ld")}, {_weights("cw", "cd")},
a AS (SELECT conv_id, turn, conv_id AS owner, 'own' AS side FROM r UNION ALL SELECT conv_id, turn, donor, 'donor' FROM r),
lm AS (SELECT conv_id, turn, side, max(c) AS c FROM (SELECT a.conv_id, a.turn, a.side, card.nth, sum(x.w * y.w) AS c FROM a JOIN card ON card.conv_id = a.owner JOIN lw AS x ON x.key = 'R|' || a.conv_id || '|' || a.turn JOIN lw AS y ON y.key = 'L|' || a.owner || '|' || card.nth AND y.term = x.term GROUP BY 1, 2, 3, 4) AS t GROUP BY 1, 2, 3),
cm AS (SELECT a.conv_id, a.turn, a.side, sum(x.w * y.w) AS c FROM a JOIN cw AS x ON x.key = 'R|' || a.conv_id || '|' || a.turn JOIN cw AS y ON y.key = 'L|' || a.owner AND y.term = x.term GROUP BY 1, 2, 3)
SELECT r.conv_id, r.turn, round(coalesce(lo.c, 0), 5) AS own_line, round(coalesce(ld_.c, 0), 5) AS donor_line, round(coalesce(co.c, 0), 5) AS own_card, round(coalesce(cd_.c, 0), 5) AS donor_card FROM r
LEFT JOIN lm AS lo ON lo.conv_id = r.conv_id AND lo.turn = r.turn AND lo.side = 'own' LEFT JOIN lm AS ld_ ON ld_.conv_id = r.conv_id AND ld_.turn = r.turn AND ld_.side = 'donor'
LEFT JOIN cm AS co ON co.conv_id = r.conv_id AND co.turn = r.turn AND co.side = 'own' LEFT JOIN cm AS cd_ ON cd_.conv_id = r.conv_id AND cd_.turn = r.turn AND cd_.side = 'donor'""",
}
