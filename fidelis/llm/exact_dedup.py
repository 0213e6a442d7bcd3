"""Exact dedup by skew-safe combining: local, salted and global merges that compare full content.

Digests find the candidates, the group keys hold the text itself, so two texts merge only when
they are identical. Every digest takes the same way: rows with one text are combined in the task that
read them (the partial half of the first aggregate), the winners of tasks meet by digest, salt and text, and
the winners of salts meet by digest and text. A group of copies of any size therefore reaches a
stage as at most one row per task, then as at most one row per salt.

Defined cases: a null text counts as the empty text; a null id is smaller than any id; of rows
that repeat both id and text exactly one is kept; an empty table gives an empty result; further
columns of the input are ignored by exact_dedup and kept by keep_first_copies, whatever their names and
types. Two texts with one SHA-256 digest stop the job with an error rather than merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidelis.llm.common import id_keys, materialize, packed_row, text_of


def winners(rows: DataFrame, salts: int) -> DataFrame:
    """_d, keep_id, group_size per digest. rows: _id, _d, _t."""
    # the task's number: a task emits one row per text, and the tasks of one text spread over the salts
    salt = F.pmod(F.spark_partition_id(), F.lit(salts))
    salted = rows.groupBy("_d", salt.alias("_salt"), "_t").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    merged = salted.groupBy("_d", "_t").agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    clash = F.raise_error(F.lit("two texts share a SHA-256 digest"))
    # the digest decides nothing: it only has to hold for one text
    return merged.groupBy("_d").agg(F.max("_keep").alias("keep_id"), F.sum("_n").alias("group_size"), F.when(F.count(F.lit(1)) > 1, clash).cast("long").alias("_clash")).select(
        "_d", "keep_id", F.coalesce(F.col("_clash"), F.col("group_size")).cast("long").alias("group_size")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 8) -> DataFrame:
    """A row per document: id, keep_id, group_size, kept, text_sha256. The largest id of equal texts is kept."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t")).withColumn("_d", F.unhex(F.sha2("_t", 256)))
    classes = materialize(winners(rows, salts), "dedup-classes")
    same = F.col("_id").eqNullSafe(F.col("keep_id"))
    # of rows that repeat id and text one is kept
    first = F.row_number().over(Window.partitionBy("_d", "_id").orderBy("_id")) == 1
    out = rows.select("_id", "_d").withColumn("_first", first).join(classes, "_d")
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", (same & F.col("_first")).alias("kept"), F.lower(F.hex("_d")).alias("text_sha256"))


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops, all columns as they were. Of rows that repeat id and text the one stays that is smallest as JSON."""
    rows = docs.select(packed_row(docs), *id_keys(docs[id_col], "_k"), F.sha2(text_of(docs[text_col]), 256).alias("_d"))
    verdict = exact_dedup(docs, id_col, text_col).groupBy(*id_keys(F.col(id_col), "_v"), F.col("text_sha256").alias("_vd")).agg(F.bool_or("kept").alias("_kept"), F.count(F.lit(1)).alias("_n"))
    kept = materialize(verdict.filter("_kept").select("_v1", "_v2", "_vd", "_n"), "dedup-kept")
    mine = rows.join(kept, (F.col("_k1") == F.col("_v1")) & (F.col("_k2") == F.col("_v2")) & (F.col("_d") == F.col("_vd")))
    order = Window.partitionBy("_k1", "_k2", "_d").orderBy(F.when(F.col("_n") > 1, F.to_json("_row")))
    return mine.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").select("_row.*")
