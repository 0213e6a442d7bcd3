"""Corpus pipeline: toxicity, exact dedup, near-duplicate join, mixing to target weights, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents. A stage works on every row and whole text
that its predecessor kept:

1. toxicity: documents that score 0.3 or more go; learned from the labels of rows outside the held-out fold.
2. exact_dedup: of equal texts the row with the largest doc_id stays.
3. ngram_join: of connected documents (five-word shingles, Jaccard 0.8 or more) the one with the smallest doc_id stays.
4. mixing: each document appears as often as the mix takes it (0 to 3 times); sources come near their targets.
5. bpe: doc_id, copies (rows of the mix), source, n_tokens, ids (array of token ids), ids_sha256 of each text of the mix.

Nulls, empty and very long texts, repeated rows and empty tables: see the operators. The first four stages keep all columns
they were given, whatever their names and types; the last returns those listed above alone. Stages 1, 3 and 5 learn or
search, so SQL cannot express run(); tests/llm holds the stages against brute force on small tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.llm.bpe import encode_corpus
from fidelis.llm.common import WORD, id_keys, materialize, packed_row, table
from fidelis.llm.exact_dedup import keep_first_copies
from fidelis.llm.mixing import mix
from fidelis.llm.ngram_join import one_of_each
from fidelis.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs as often as the mix takes them; documents without words are not taken."""
    taken = mix(docs).filter("size > 0").groupBy(*id_keys(F.col("doc_id"), "_v"), *id_keys(F.col("source"), "_w"), F.col("size").alias("_vsize"))
    times = materialize(taken.agg((F.max("taken") / F.col("_vsize")).cast("int").alias("_times")).filter("_times > 0"), "mix-times")
    size = F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(packed_row(docs), *id_keys(docs["doc_id"], "_k"), *id_keys(docs["source"], "_s"), size.alias("_size"))
    on = (F.col("_k1") == F.col("_v1")) & (F.col("_k2") == F.col("_v2")) & (F.col("_s1") == F.col("_w1")) & (F.col("_s2") == F.col("_w2")) & (F.col("_size") == F.col("_vsize"))
    return rows.join(times, on).select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text of the mix is encoded once, with the number of its copies."""
    once = docs.groupBy("doc_id", "source", "text").agg(F.count(F.lit(1)).alias("copies"))
    keyed = once.withColumn("_row", F.struct("doc_id", "source", "copies"))
    ids = encode_corpus(keyed.select(F.to_json("_row").alias("row"), "text"), id_col="row", with_ids=True)
    kinds = dict(docs.dtypes)
    back = F.from_json("row", f"doc_id {kinds['doc_id']}, source {kinds['source']}, copies long")
    return ids.withColumn("_r", back).select("_r.doc_id", "_r.source", "_r.copies", "n_tokens", "ids", "ids_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("mixing", mixing),
    ("bpe", bpe),
]
#: Language models and similarity search stand in the way.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
