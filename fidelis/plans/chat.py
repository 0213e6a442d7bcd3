"""Queries on documents, pages, conversations and embeddings: text features, panel building, geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fidelis.functions import text as tx
from fidelis.functions.scalars import phase, safe_int, speed_class, square_index, time_control
from fidelis.operators import coverage, metrics, panel, readouts, sessions, shopping
from fidelis.plans.trial import r6, table


def norm_text_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each source and normalised text, and how many there are. Digests are grouped, texts are not shuffled."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(tx.norm_text("text"), 256).alias("norm"))
    return d.groupBy("source", "norm").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def token_jaccard_pairs(spark, sf_dir):
    """Pairs of documents of a language with nearly equal token sets."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return panel.pair_jaccard(d, "doc_id", "text", 0.8, "lang").select("key_a", "key_b", r6("jaccard", "jaccard"))


def row_ok_panel(spark, sf_dir):
    """Eligible documents per source, with distinct length classes."""
    ok = table(spark, sf_dir, "documents").filter("lang = 'en' and n_chars >= 1").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels").filter("toxic = 0").select("doc_id"), "doc_id", "left_semi")
    return ok.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.floor(F.col("n_chars") / 1000)).alias("classes")).filter("n >= 3 and classes >= 2")


def stratified_users(spark, sf_dir):
    ok = row_ok_panel(spark, sf_dir)
    return panel.stratified(ok.withColumn("stratum", sessions.tertile(["n", "source"])), "stratum", "source", 7).select("source", "stratum", "n")


def fold_assignment(spark, sf_dir):
    ok = row_ok_panel(spark, sf_dir)
    return panel.folds(ok.withColumn("stratum", sessions.tertile(["n", "source"])), "stratum", "source").select("source", "stratum", "fold")


def collision_antijoin(spark, sf_dir):
    """Documents none of whose lines is a whole benchmark text. Line by line: an item that spans lines is not looked for."""
    items = table(spark, sf_dir, "benchmark").select(tx.norm_text("text").alias("norm")).distinct()
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", tx.norm_text("line").alias("norm"))
    hit = lines.join(items, "norm", "left_semi").select("doc_id").distinct()
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(hit, "doc_id", "left_anti")


def turn_collisions(spark, sf_dir):
    """User turns of later conversations that repeat no turn of an earlier one of the same class of ids."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") % 5).alias("user"), "conv_id", "turn", "text")
    return panel.collisions(c.filter("conv_id % 2 = 0"), c.filter("conv_id % 2 = 1"), "user", "conv_id", "text").select("conv_id", "turn")


def page_type(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("kind", tx.page_type("url"))
    return p.select("page_id", "kind")


def turn_features(spark, sf_dir):
    """Code, question, length and terminal flags of user turns."""
    c = table(spark, sf_dir, "conversations").filter("trim(text) <> ''")
    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    c = c.withColumn("terminal", F.col("turn") == last).filter("role = 'user'")
    words = F.size(F.filter(F.split("text", "[ \n]+"), lambda w: w != ""))
    return c.select("conv_id", "turn", tx.is_code("text").alias("code"), tx.has_question("text").alias("question"), words.cast("long").alias("n_words"), "terminal")


def first_n_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'user' and length(text) <= 400")
    return sessions.first_rows(c, ["conv_id"], ["turn"], 2).select("conv_id", "turn")


def prefix_budget(spark, sf_dir):
    """The newest turns of each conversation that fit 120 words together."""
    c = table(spark, sf_dir, "conversations").withColumn("n", F.size(F.split("text", " ")))
    return sessions.until_budget(c, ["conv_id"], [F.desc("turn")], "n", 120).select("conv_id", "turn")


def representative(spark, sf_dir):
    """The first two user turns of each conversation, joined and cut."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user' and trim(text) <> ''")
    two = sessions.first_rows(c, ["conv_id"], ["turn"], 2)
    return two.groupBy("conv_id").agg(F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n"), 1, 6000).alias("text")).select("conv_id", F.md5("text").alias("digest"), F.length("text").alias("n_chars"))


def char_wb_tfidf_cosine(spark, sf_dir):
    """Cosine of the character n-gram vectors of each conversation's first two user turns."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.translate("text", "\n", " ").alias("text"))
    two = sessions.first_rows(c, ["conv_id"], ["turn"], 2).withColumn("doc", F.col("conv_id") * 100 + F.col("turn"))
    w = metrics.tfidf(two.select("doc", F.explode(tx.char_wb_ngrams("text")).alias("gram")), "doc", "gram")
    pairs = two.groupBy("conv_id").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("a", "b")
    return metrics.sparse_cosine(w, w, pairs, "a", "b", "doc", "gram").select("a", "b", F.round("cosine", 5).alias("cosine"))


def embedding_knn(spark, sf_dir):
    """The three nearest vectors of the same label, exact."""
    e = table(spark, sf_dir, "embeddings")
    return metrics.nearest(e, e, "vec_id", "embedding", 3, cell="label").select("vec_id", "rank", "neighbour", F.round("distance", 4).alias("distance"))


def precision_recall(spark, sf_dir):
    """Support of even against odd vectors."""
    e = table(spark, sf_dir, "embeddings")
    return metrics.precision_recall(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1"), "vec_id", "embedding", 3).select(r6("precision", "precision"), r6("recall", "recall"))


def frechet(spark, sf_dir):
    """Distance of each label's vectors to all others': moments by Spark sums, a 64 x 64 eigenproblem each on the driver."""
    e = table(spark, sf_dir, "embeddings")
    per = metrics.moments(e, ["label"], "embedding", 64)
    whole = metrics.moments(e.withColumn("label", F.lit(-1)), ["label"], "embedding", 64)[(-1,)]
    return spark.createDataFrame([(int(k[0]), v[0], metrics.frechet(v, whole)) for k, v in sorted(per.items())], "label int, n long, distance double")


def pca_variance(spark, sf_dir):
    values, _ = metrics.pca(metrics.moments(table(spark, sf_dir, "embeddings").withColumn("all", F.lit(0)), ["all"], "embedding", 64)[(0,)][2])
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "component int, variance double")


def safe_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", tx.safe_id("u_", "c_custkey").alias("safe_id"), tx.row_key("c_custkey", "c_nationkey").alias("row_key"))


def speed_class_orders(spark, sf_dir):
    """Order totals read as time controls."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "-").when(F.col("o_orderkey") % 7 == 0, F.floor(F.col("o_totalprice") / 100).cast("string")).otherwise(F.concat(F.floor(F.col("o_totalprice") / 100).cast("string"), F.lit("+"), (F.col("o_orderkey") % 5).cast("string"))).alias("tc"))
    t = time_control("tc")
    return o.select("o_orderkey", t["base"].alias("base"), t["inc"].alias("inc"), speed_class("tc").alias("speed"), phase(F.col("o_orderkey") % 50).alias("phase"))


def answer_parse(spark, sf_dir):
    """Answers written from line items' flags, in several forms."""
    li = table(spark, sf_dir, "lineitem")
    letter = F.substring(F.lit("abcd"), (F.col("l_partkey") % 4 + 1).cast("int"), F.lit(1))
    said = F.when(F.col("l_orderkey") % 5 == 0, F.concat(F.lit("thus <final_answer>("), letter, F.lit(")"))).when(F.col("l_orderkey") % 5 == 1, F.concat(F.lit("The answer is "), letter)).when(F.col("l_orderkey") % 5 == 2, F.concat(F.lit("(a) or ("), letter, F.lit(")"))).when(F.col("l_orderkey") % 5 == 3, F.lit("the answer is correct")).otherwise(F.lit("none"))
    return li.withColumn("said", said).groupBy(F.coalesce(tx.parse_answer("said"), F.lit("null")).alias("answer")).agg(F.count(F.lit(1)).alias("n"))


def round_robin(spark, sf_dir):
    """Shortest English documents, one per source and round, sixty in all."""
    d = table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", "source", "n_chars")
    return panel.round_robin(d, "source", ["n_chars", "doc_id"], 60).select("doc_id", "source", F.col("round").cast("long").alias("round"))


def primary_clusters(spark, sf_dir):
    """Of each source, the languages that hold its chosen documents."""
    d = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("earliest"))
    return panel.choose_primary(d, "source", "size", "earliest", "lang", least=30).select("source", "lang", "size")


def job_matrix(spark, sf_dir):
    """Every nation, segment and seed: the cartesian expansion of three dimension lists of fixed size."""
    n = table(spark, sf_dir, "nation").select("n_name")
    s = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    return n.crossJoin(s).crossJoin(spark.range(3).select(F.col("id").alias("seed"))).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("jobs"))


def ingest_safe_ints(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "?").when(F.col("c_custkey") % 3 == 1, F.col("c_custkey").cast("string")).otherwise("x1").alias("raw"))
    return c.select("c_custkey", F.coalesce(safe_int("raw"), F.lit(-1)).alias("value"), square_index(F.concat(F.substring(F.lit("abcdefgh"), (F.col("c_custkey") % 8 + 1).cast("int"), F.lit(1)), (F.col("c_custkey") % 8 + 1).cast("string"))).cast("long").alias("square"))


def dose_mix(spark, sf_dir):
    """Share of fields taken from the target card at dose 0.5."""
    c = table(spark, sf_dir, "customer").select("c_custkey", tx.mix_card(F.lit("a; b; c; d"), F.lit("w; x; y; z"), 0.5, F.concat(F.lit("dose:"), F.col("c_custkey").cast("string"))).alias("card"))
    return c.groupBy("card").agg(F.count(F.lit(1)).alias("n"))


def greedy_dedup(spark, sf_dir):
    """Kept-first dedup of vectors of a label: their texts are the labels' ids in short classes."""
    e = table(spark, sf_dir, "embeddings").withColumn("text", F.concat(F.lit("item "), (F.col("vec_id") % 40).cast("string")))
    return panel.greedy_dedup(e, "label", ["vec_id"], "text", "embedding", cosine=0.9).select("vec_id", "label", "verdict")


def online_clusters(spark, sf_dir):
    return panel.online_clusters(table(spark, sf_dir, "embeddings"), "label", ["vec_id"], "embedding", 0.5).select("vec_id", "label", "cluster")


def card_fill(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.split("text", " ")).cast("long").alias("n"))
    return panel.budget_fill(c, "conv_id", ["turn"], "n", 100).filter("taken").select("conv_id", "turn", "n")


def assignment(spark, sf_dir):
    """Partners of suppliers within a region-like stratum: least total cost, never the same nation."""
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 5).alias("stratum"), "s_suppkey", "s_nationkey", (F.col("s_suppkey") % 2).alias("topic"), F.abs("s_acctbal").alias("size"))
    return panel.assign_min_cost(s, "stratum", "s_suppkey", "s_nationkey", "topic", "size")


def form_histogram(spark, sf_dir):
    """Smoothed shares of event types per user."""
    h = readouts.form_histogram(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["click", "error", "view"])
    return h.select("user_id", *[r6(f"p_{x}", f"p_{x}") for x in ("click", "error", "view")])


def empty_rates(spark, sf_dir):
    """Conversations as samples: short, long and closing turns per role."""
    c = table(spark, sf_dir, "conversations").select(F.col("role").alias("sim"), (F.col("turn") % 2).cast("string").alias("arm"), (F.length("text") < 40).alias("terminal"), F.least(F.size(F.split("text", " ")), F.lit(96)).alias("generated_tokens"))
    return readouts.empty_rates(c)


def selector_pairs(spark, sf_dir):
    """Segments as simulators: paired differences of mean order values per nation, judged by mean balances."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("user_id"), F.col("c_mktsegment").alias("sim"), "c_acctbal")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    users = o.join(c, "c_custkey").groupBy("sim", "user_id").agg(F.avg("o_totalprice").alias("delta"))
    return readouts.pair_readout(users, c.groupBy("sim").agg(F.avg("c_acctbal").alias("score")), n_resamples=2000)


def selector_verdict(spark, sf_dir):
    return readouts.classify(selector_pairs(spark, sf_dir))


def coverage_basket(spark, sf_dir):
    """Odd vectors of each label against even ones, in all their dimensions, with 200 resamples and 1000 draws of the radius."""
    e = table(spark, sf_dir, "embeddings").withColumn("side", (F.col("vec_id") % 2).cast("int"))
    return coverage.basket(e, "label", "side", "embedding")


def shopping_rows(spark, sf_dir):
    """Events as shopping actions on the pages: causal state before each."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 50).alias("slot"), "url").groupBy("slot").agg(F.min("url").alias("url"))
    a = e.withColumn("slot", F.col("event_id") % 50).join(F.broadcast(pages), "slot", "left")  # fifty slots
    a = a.select("event_id", "user_id", F.floor(F.col("ts") / 86400).alias("session_id"), "ts", F.when(F.col("event_type") == "click", "click").otherwise("input").alias("action_type"), F.when(F.col("event_type") == "view", "search").otherwise("product_link").alias("click_type"), F.coalesce("url", F.lit("")).alias("url"), F.lit("{}").alias("page_meta"))
    r = shopping.shopping_rows(a)
    return r.select("event_id", "t", r6("s_place", "s_place"), r6("s_clicks", "s_clicks"), r6("s_searches", "s_searches"), r6("s_pause", "s_pause"))


QUERIES = {f.__name__: f for f in (
    norm_text_dedup, token_jaccard_pairs, row_ok_panel, stratified_users, fold_assignment, collision_antijoin, turn_collisions, page_type, turn_features, first_n_turns, prefix_budget, representative, char_wb_tfidf_cosine,
    embedding_knn, precision_recall, frechet, pca_variance, safe_ids, speed_class_orders, answer_parse, round_robin, primary_clusters, job_matrix, ingest_safe_ints, dose_mix, greedy_dedup, online_clusters, card_fill, assignment,
    form_histogram, empty_rates, selector_pairs, selector_verdict, coverage_basket, shopping_rows,
)}

NORM = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
OK = "ok AS (SELECT source, count(*) AS n, count(DISTINCT floor(n_chars / 1000)) AS classes FROM documents WHERE lang = 'en' AND n_chars >= 1 AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) GROUP BY source HAVING count(*) >= 3 AND count(DISTINCT floor(n_chars / 1000)) >= 2), st AS (SELECT *, CAST(least(2, (row_number() OVER (ORDER BY n, source) - 1) * 3 // count(*) OVER ()) AS BIGINT) AS stratum FROM ok)"
ORACLE_SQL = {
    "norm_text_dedup": "SELECT source, sha256(" + NORM.format("text") + ") AS norm, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1, 2",
    "token_jaccard_pairs": r"WITH c AS (SELECT doc_id AS key, lang, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS t FROM documents), p AS (SELECT a.key AS key_a, b.key AS key_b, len(list_intersect(a.t, b.t)) AS i, len(a.t) + len(b.t) AS n FROM c a JOIN c b ON a.lang = b.lang AND a.key < b.key WHERE len(a.t) > 0 AND len(b.t) > 0 AND least(len(a.t), len(b.t)) >= 0.8 * greatest(len(a.t), len(b.t))) SELECT key_a, key_b, round(i / (n - i), 6) AS jaccard FROM p WHERE i >= 0.8 * (n - i)",
    "row_ok_panel": f"WITH {OK} SELECT source, n, classes FROM ok",
    "stratified_users": f"WITH {OK}, k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('0|' || source), source) AS rn, 2 + CASE WHEN dense_rank() OVER (ORDER BY stratum) <= 1 THEN 1 ELSE 0 END AS take FROM st) SELECT source, stratum, n FROM k WHERE rn <= take",
    "fold_assignment": f"WITH {OK} SELECT source, stratum, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY md5('0|' || source), source) % 2 = 1 THEN 'A' ELSE 'B' END AS fold FROM st",
    "collision_antijoin": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT DISTINCT " + NORM.format("text") + " AS norm FROM benchmark) SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l JOIN b ON b.norm = " + NORM.format("line") + ")",
    "turn_collisions": "WITH c AS (SELECT conv_id % 5 AS u, conv_id, turn, " + NORM.format("text") + " AS norm FROM conversations WHERE role = 'user'), h AS (SELECT DISTINCT x.u, x.conv_id FROM c x JOIN c y ON x.u = y.u AND x.norm = y.norm WHERE x.conv_id % 2 = 1 AND y.conv_id % 2 = 0) SELECT conv_id, turn FROM c WHERE conv_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM h WHERE h.u = c.u AND h.conv_id = c.conv_id)",
    "page_type": "SELECT page_id, CASE WHEN contains(url, '/s?') OR contains(url, 'field-keywords') OR contains(url, '/s/') THEN 'search results' WHEN contains(url, '/dp/') OR contains(url, '/gp/product') THEN 'product page' WHEN contains(url, 'cart') THEN 'cart' WHEN ends_with(rtrim(url, '/'), '.com') OR contains(url, '/ref=nav') THEN 'home' ELSE 'other page' END AS kind FROM pages",
    "turn_features": r"""WITH c AS (SELECT *, turn = max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS terminal FROM conversations WHERE trim(text) <> '')
SELECT conv_id, turn, contains(text, '```') OR len(list_filter(string_split_regex(text, '\r?\n'), lambda x: regexp_matches(x, '^\s*(def|import|from|class|for|while|if)\b') OR regexp_matches(x, '[{};]\s*$'))) >= 2 AS code, contains(text, '?') AS question, CAST(len(list_filter(string_split_regex(text, '[ \n]+'), lambda x: x <> '')) AS BIGINT) AS n_words, terminal FROM c WHERE role = 'user'""",
    "first_n_turns": "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'user' AND length(text) <= 400) AS t WHERE rn <= 2",
    "prefix_budget": "SELECT conv_id, turn FROM (SELECT *, sum(len(string_split(text, ' '))) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS run FROM conversations) AS t WHERE run <= 120",
    "representative": "WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'user' AND trim(text) <> ''), t AS (SELECT conv_id, substr(string_agg(text, chr(10) ORDER BY turn), 1, 6000) AS text FROM c WHERE rn <= 2 GROUP BY conv_id) SELECT conv_id, md5(text) AS digest, CAST(length(text) AS INT) AS n_chars FROM t",
    "char_wb_tfidf_cosine": r"""WITH c AS (SELECT conv_id, conv_id * 100 + turn AS doc, lower(replace(text, chr(10), ' ')) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'user'),
two AS (SELECT * FROM c WHERE rn <= 2), wd AS (SELECT doc, ' ' || w || ' ' AS w FROM (SELECT doc, unnest(string_split_regex(text, '\s+')) AS w FROM two) AS x WHERE w <> ''),
gr AS (SELECT doc, substr(w, i, n) AS gram FROM (SELECT doc, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM wd CROSS JOIN (SELECT unnest([3, 4, 5]) AS n) AS ns) AS y),
cn AS (SELECT doc, gram, count(*) AS c FROM gr GROUP BY doc, gram), nd AS (SELECT count(DISTINCT doc) AS n FROM cn), df AS (SELECT gram, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM cn CROSS JOIN nd GROUP BY gram),
w0 AS (SELECT doc, gram, (1 + ln(c)) * idf AS w FROM cn JOIN df USING (gram)), nm AS (SELECT doc, sqrt(sum(w * w)) AS nrm FROM w0 GROUP BY doc), w1 AS (SELECT doc, gram, w / nrm AS w FROM w0 JOIN nm USING (doc)),
pr AS (SELECT min(doc) AS a, max(doc) AS b FROM two GROUP BY conv_id HAVING min(doc) < max(doc)), dt AS (SELECT pr.a, pr.b, sum(x.w * y.w) AS d FROM pr JOIN w1 x ON x.doc = pr.a JOIN w1 y ON y.doc = pr.b AND y.gram = x.gram GROUP BY pr.a, pr.b)
SELECT pr.a, pr.b, round(coalesce(d, 0), 5) AS cosine FROM pr LEFT JOIN dt ON dt.a = pr.a AND dt.b = pr.b""",
    "embedding_knn": "WITH p AS (SELECT a.vec_id, b.vec_id AS neighbour, sqrt(list_sum(list_transform(range(1, 65), lambda i: power(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2)))) AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rn FROM p) SELECT vec_id, CAST(rn AS INT) AS rank, neighbour, round(distance, 4) AS distance FROM r WHERE rn <= 3",
    "precision_recall": "WITH p AS (SELECT a.vec_id AS x, b.vec_id AS y, sqrt(list_sum(list_transform(range(1, 65), lambda i: power(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2)))) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), rad AS (SELECT x, d AS r FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY d, y) AS rn FROM p WHERE x % 2 = y % 2) AS t WHERE rn = 3), cov AS (SELECT p.x, max(CASE WHEN p.d <= rad.r THEN 1 ELSE 0 END) AS inside FROM p JOIN rad ON rad.x = p.y WHERE p.x % 2 <> p.y % 2 GROUP BY p.x) SELECT round(avg(CASE WHEN x % 2 = 1 THEN inside END), 6) AS precision, round(avg(CASE WHEN x % 2 = 0 THEN inside END), 6) AS recall FROM cov",
    "safe_ids": "SELECT c_custkey, 'u_' || substr(sha256('e36:' || c_custkey), 1, 16) AS safe_id, c_custkey || '|' || c_nationkey AS row_key FROM customer",
    "speed_class_orders": "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE floor(o_totalprice / 100) END::DOUBLE AS base, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 5 END::DOUBLE AS inc FROM orders) SELECT o_orderkey, base, inc, CASE WHEN base IS NULL THEN 'correspondence' WHEN base + 40 * inc < 30 THEN 'ultrabullet' WHEN base + 40 * inc < 180 THEN 'bullet' WHEN base + 40 * inc < 480 THEN 'blitz' WHEN base + 40 * inc < 1500 THEN 'rapid' ELSE 'classical' END AS speed, CASE WHEN o_orderkey % 50 <= 10 THEN 'opening' WHEN o_orderkey % 50 <= 30 THEN 'middlegame' ELSE 'endgame' END AS phase FROM o",
    "answer_parse": "WITH l AS (SELECT l_orderkey % 5 AS m, substr('abcd', CAST(l_partkey % 4 + 1 AS INT), 1) AS x FROM lineitem) SELECT CASE WHEN m IN (0, 1) THEN '(' || x || ')' WHEN m = 2 AND x = 'a' THEN '(a)' WHEN m = 3 THEN '(c)' ELSE 'null' END AS answer, count(*) AS n FROM l GROUP BY 1",
    "round_robin": "WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS round FROM documents WHERE lang = 'en') SELECT doc_id, source, round FROM d ORDER BY round, source LIMIT 60",
    "primary_clusters": "WITH d AS (SELECT source, lang, count(*) AS size, min(doc_id) AS earliest FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS rk, coalesce(sum(size) OVER (PARTITION BY source ORDER BY size DESC, earliest, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM d WINDOW w AS (PARTITION BY source ORDER BY size DESC, earliest, lang)) SELECT source, lang, size FROM r WHERE had < 30 AND rk <= 2",
    "job_matrix": "SELECT c_mktsegment, count(*) AS jobs FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) AS s CROSS JOIN range(3) AS r GROUP BY 1",
    "ingest_safe_ints": "SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 1 THEN c_custkey ELSE -1 END AS INT) AS value, (c_custkey % 8) * 8 + c_custkey % 8 AS square FROM customer",
    "dose_mix": "WITH f AS (SELECT c_custkey, unnest([0, 1, 2, 3]) AS i, unnest(['a', 'b', 'c', 'd']) AS t, unnest(['w', 'x', 'y', 'z']) AS o FROM customer), u AS (SELECT c_custkey, i, CASE WHEN CAST('0x' || substr(md5('dose:' || c_custkey || ':' || i), 1, 13) AS BIGINT) / power(16, 13) < 0.5 THEN t ELSE o END AS x FROM f), c AS (SELECT c_custkey, string_agg(x, '; ' ORDER BY i) AS card FROM u GROUP BY 1) SELECT card, count(*) AS n FROM c GROUP BY 1",
    "form_histogram": "SELECT user_id, round((count_if(event_type = 'click') + 0.5) / (count(*) + 1.5), 6) AS p_click, round((count_if(event_type = 'error') + 0.5) / (count(*) + 1.5), 6) AS p_error, round((count_if(event_type = 'view') + 0.5) / (count(*) + 1.5), 6) AS p_view FROM events GROUP BY user_id",
    "empty_rates": "WITH c AS (SELECT role AS sim, CAST(turn % 2 AS VARCHAR) AS arm, length(text) < 40 AS terminal, least(len(string_split(text, ' ')), 96) AS g FROM conversations) SELECT sim, arm, count(*) AS n, count_if(terminal)::BIGINT AS n_terminal, count_if(g <= 1)::BIGINT AS n_empty, count_if(g = 96)::BIGINT AS n_cap FROM c GROUP BY sim, arm",
    "shopping_rows": """WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS ts, floor(epoch_us(ts) / 1e6 / 86400) AS sess, event_type = 'click' AS click, event_type = 'view' AS search FROM events),
x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sess, ts) - 1 AS t, row_number() OVER (PARTITION BY user_id, sess ORDER BY ts) - 1 AS place, ts - lag(ts) OVER (PARTITION BY user_id, sess ORDER BY ts) AS dwell FROM e),
k AS (SELECT user_id, t, dwell, row_number() OVER (PARTITION BY user_id ORDER BY t) AS n FROM x WHERE dwell IS NOT NULL),
kn AS (SELECT x.event_id, x.user_id, x.t, max(k.n) AS n FROM x LEFT JOIN k ON k.user_id = x.user_id AND k.t < x.t GROUP BY 1, 2, 3),
p AS (SELECT kn.event_id, avg(k.dwell) AS pause FROM kn JOIN k ON k.user_id = kn.user_id AND k.n <= kn.n AND k.n > kn.n - 5 GROUP BY 1)
SELECT x.event_id, t, round(least(1, place / 30.0)::DOUBLE, 6) AS s_place, round(coalesce(sum(CASE WHEN click THEN 1 ELSE 0 END) OVER w, 0) / greatest(t, 1), 6) AS s_clicks, round(coalesce(sum(CASE WHEN search THEN 1 ELSE 0 END) OVER w, 0) / greatest(t, 1), 6) AS s_searches, round(least(1, coalesce(pause, 0) / 60), 6) AS s_pause
FROM x LEFT JOIN p USING (event_id) WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "card_fill": """WITH RECURSIVE c AS (SELECT conv_id, turn, CAST(len(string_split(text, ' ')) AS BIGINT) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT conv_id, turn, n, i, n <= 100 AS taken, 100 - CASE WHEN n <= 100 THEN n ELSE 0 END AS rest FROM c WHERE i = 1
  UNION ALL SELECT c.conv_id, c.turn, c.n, c.i, f.rest >= 40 AND c.n <= f.rest, f.rest - CASE WHEN f.rest >= 40 AND c.n <= f.rest THEN c.n ELSE 0 END FROM f JOIN c ON c.conv_id = f.conv_id AND c.i = f.i + 1)
SELECT conv_id, turn, n FROM f WHERE taken""",
    "greedy_dedup": """WITH RECURSIVE e AS (SELECT vec_id, label, vec_id % 40 AS txt, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
u AS (SELECT *, sqrt(list_dot_product(v, v)) AS nrm FROM e),
p AS (SELECT a.vec_id, list(b.vec_id) FILTER (WHERE a.txt = b.txt) AS same, list(b.vec_id) FILTER (WHERE a.txt <> b.txt AND list_dot_product(a.v, b.v) / (a.nrm * b.nrm) >= 0.9 AND 1 / 3.0 >= 0.75) AS near
      FROM u AS a JOIN u AS b ON a.label = b.label AND b.i < a.i GROUP BY a.vec_id),
q AS (SELECT e.vec_id, e.label, e.i, coalesce(p.same, []) AS same, coalesce(p.near, []) AS near FROM e LEFT JOIN p USING (vec_id)),
w AS (SELECT vec_id, label, i, [vec_id] AS kept, 'kept' AS verdict FROM q WHERE i = 1
  UNION ALL SELECT q.vec_id, q.label, q.i, CASE WHEN list_has_any(w.kept, q.same) OR list_has_any(w.kept, q.near) THEN w.kept ELSE list_append(w.kept, q.vec_id) END, CASE WHEN list_has_any(w.kept, q.same) THEN 'exact' WHEN list_has_any(w.kept, q.near) THEN 'near' ELSE 'kept' END
  FROM w JOIN q ON q.label = w.label AND q.i = w.i + 1)
SELECT vec_id, label, verdict FROM w""",
    "online_clusters": """WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
w AS (SELECT vec_id, label, i, [v] AS sums, 0::BIGINT AS cluster FROM e WHERE i = 1
  UNION ALL SELECT vec_id, label, i, CASE WHEN best < 0.5 THEN list_append(sums, v) ELSE list_transform(sums, lambda s, k: CASE WHEN k = pos THEN list_transform(s, lambda x, d: x + v[d]) ELSE s END) END, CASE WHEN best < 0.5 THEN len(sums) ELSE pos - 1 END
  FROM (SELECT vec_id, label, i, sums, v, list_max(cs) AS best, list_position(cs, list_max(cs)) AS pos
        FROM (SELECT e.vec_id, e.label, e.i, w.sums, e.v, list_transform(w.sums, lambda s: list_dot_product(s, e.v) / sqrt(list_dot_product(s, s))) AS cs FROM w JOIN e ON e.label = w.label AND e.i = w.i + 1) AS a) AS b)
SELECT vec_id, label, cluster FROM w""",
}
