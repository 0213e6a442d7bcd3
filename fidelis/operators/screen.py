"""Screen of content metrics: does a person's own card tell more of what they say next than a look-alike's card?

A card is a bounded list of lines. Each record (something a person said) is compared with the lines of two cards, the person's own
and the donor's, through an inverted index: one posting list per (card, term), as long as the card has lines with that term. Terms
of records meet posting lists in an equi-join, so a record costs its terms times the lines that share one, and no two lines meet
that share none. A card that very many records ask for is a hot key of the larger side only; skew handling splits it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelis.functions.scalars import col
from fidelis.operators.inference import interval, resampled
from fidelis.operators.settle import same_keys, settle


def card_lines(turns: DataFrame, user: str, order: list[str], text: str, budget: int) -> DataFrame:
    """user, line, text: the lines of a person's turns in order, trimmed, without empty ones, while they have at most `budget` words together.

    A line that repeats an earlier one of the same person does not count again."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    rows = turns.select(user, F.struct(*order).alias("_at"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\r|\n")).alias("_i", "_line")).withColumn("_line", trim(F.col("_line"))).filter("_line != ''")
    first = rows.groupBy(user, "_line").agg(F.min(F.struct("_at", "_i")).alias("_p"))
    words = F.size(F.split("_line", r"\s+"))
    w = Window.partitionBy(user).orderBy("_p")
    run = first.withColumn("_run", F.sum(words).over(w)).withColumn("line", F.row_number().over(w) - 1)
    return run.filter(F.col("_run") <= budget).select(user, "line", F.col("_line").alias("text"))


def word_terms(c: str | Column) -> Column:
    """Words in lower case, with repetitions."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"[\p{L}\p{N}_]+"), 0)


def weights(docs: DataFrame, keys: list[str], terms: Column) -> DataFrame:
    """keys, term, w: (1 + ln c)(ln((1 + N) / (1 + df)) + 1), unit length per document; documents without a term have no row. A null key equals a null key.

    N counts documents with a term. Equal documents count as often as they occur."""
    c = docs.select(*keys, F.explode(terms).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("_c"))
    c = settle(c)
    n = c.select(*keys).distinct().count()
    idf = c.groupBy("term").agg((F.log((1 + F.lit(n)) / (1 + F.count(F.lit(1)))) + 1).alias("_idf"))
    w = c.join(idf, "term").withColumn("_w", (1 + F.log("_c")) * F.col("_idf"))
    norm = w.groupBy(*keys).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return same_keys(w, norm, keys).select(*keys, "term", (F.col("_w") / F.col("_norm")).alias("w"))


def line_maxima(records: DataFrame, lines: DataFrame, record: list[str], sides: dict[str, str]) -> DataFrame:
    """record and, for each side, the largest cosine of the record with a line of that side's card, 0 where none shares a term.

    records: record, one column per side with the card's owner, term, w (unit length); rows of records without terms may have a null term.
    lines: owner, line, term, w (unit length). sides: name of the result -> column of the owner. A null owner gives 0."""
    postings = lines.groupBy("owner", "term").agg(F.collect_list(F.struct("line", F.col("w").alias("lw"))).alias("_hits"))  # at most a card's lines
    every = F.explode(F.array(*[F.struct(F.lit(name).alias("side"), F.col(owner).alias("owner")) for name, owner in sides.items()]))
    asked = records.select(*record, "term", "w", every.alias("_s")).select(*record, "term", "w", "_s.*")
    dots = asked.join(postings, ["owner", "term"]).select(*record, "side", "w", F.explode("_hits").alias("_h")).groupBy(*record, "side", "_h.line").agg(F.sum(F.col("w") * F.col("_h.lw")).alias("_d"))
    best = dots.groupBy(*record).agg(*[F.max(F.when(F.col("side") == name, F.col("_d"))).alias(name) for name in sides])
    return records.select(*record).distinct().join(best, record, "left").select(*record, *[F.coalesce(name, F.lit(0.0)).alias(name) for name in sides])


def screen_rows(turns: DataFrame, records: DataFrame, donors: DataFrame, user: str, order: list[str], text: str, record: list[str], terms: Column, budget: int = 100) -> DataFrame:
    """user, record, own_line, donor_line (the nearest line of a card), own_card, donor_card (the card as one document).

    turns: what cards are made of; records: what was said later (user, record, text); donors: user, donor. People whose own or donor's
    card is empty are left out, and so are records of people without a donor. terms: array of terms of column `_text`.
    Line and card weights are fitted apart, each on its documents and the records."""
    cards = settle(card_lines(turns, user, order, text, budget))
    has = cards.select(user).distinct()
    pairs = donors.join(has, user, "left_semi").join(has.select(F.col(user).alias("donor")), "donor", "left_semi").select(user, "donor")
    said = settle(records.join(pairs, user).select(user, "donor", *record, F.coalesce(F.col(text), F.lit("")).alias("_text")))
    whole = cards.groupBy(user).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("_text"))  # at most the budget
    out = said.select(user, *record)
    none = [F.lit(None).cast(dict(said.dtypes)[r]).alias(r) for r in record]
    for name, docs in (("line", cards.select(user, "line", F.col("text").alias("_text"))), ("card", whole.select(user, F.lit(0).alias("line"), "_text"))):
        every = docs.select(F.lit(True).alias("_is_card"), user, "line", *none, "_text").unionByName(said.select(F.lit(False).alias("_is_card"), user, F.lit(None).cast("int").alias("line"), *record, "_text"))
        w = settle(weights(every, ["_is_card", user, "line", *record], terms))
        lines = w.filter("_is_card").select(F.col(user).alias("owner"), "line", "term", "w")
        asked = said.select(user, "donor", *record).join(w.filter("not _is_card").select(user, *record, "term", "w"), [user, *record], "left")
        out = out.join(line_maxima(asked, lines, [user, *record], {f"own_{name}": user, f"donor_{name}": "donor"}), [user, *record])
    return out


def choose_metric(rows: DataFrame, user: str, metrics: dict[str, tuple[str, str]], n_resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """metric, n_users, point, low, high, se, z, passes, chosen: own less donor, averaged per person, resampled over people.

    A metric passes if its interval lies above 0; of those that pass the largest point / se is chosen, ties by name. se is 0 where all resamples
    agree; z is then infinite for a positive point and 0 else. metrics: name -> (own column, donor column)."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(a) - F.col(b)).alias("d")) for m, (a, b) in metrics.items()]))
    people = rows.select(user, each.alias("_m")).select(user, "_m.*").groupBy("metric", user).agg(F.avg("d").alias("d"))
    draws = resampled(people, ["metric"], ["d"], n_resamples, seed)
    made = F.when(F.col("_draw") > 0, F.col("d"))
    got = draws.groupBy("metric").agg(F.max("_n").alias("n_users"), F.max(F.when(F.col("_draw") == 0, F.col("d"))).alias("point"), interval("d").alias("_i"), F.stddev_samp(made).alias("se"))
    z = F.when(F.col("se") > 0, F.col("point") / F.col("se")).when(F.col("point") > 0, F.lit(float("inf"))).otherwise(0.0)
    got = got.select("metric", "n_users", "point", F.col("_i")[0].alias("low"), F.col("_i")[1].alias("high"), "se", z.alias("z")).withColumn("passes", F.col("low") > 0)
    best = Window.orderBy(F.desc("passes"), F.desc("z"), "metric")  # a row per metric
    return got.withColumn("chosen", F.col("passes") & (F.row_number().over(best) == 1))
