"""Mixing sources to target weights with hash-threshold histograms.

Every document has a 60-bit hash. Word counts are summed by source and leading hash bits; the
bucket in which a source's budget ends is found from the running sums; only that bucket is
summed again by the next bits, until it holds one hash. A document is then taken by comparing
its hash with its source's threshold: nothing is sorted and no source meets in one task.
Thresholds of smaller budgets are smaller, so mixes of growing budgets are nested.

Defined cases: null text has size 0; a null source is a source of its own, ordered last; null or
repeated ids share one hash and one fate; sources of size 0 have target 0; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidelis.llm.common import WORD, materialize

#: Hash bits, and bits resolved by one histogram.
BITS, STEP = 60, 12


def targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, ceiling: float) -> DataFrame:
    """A row per source: weight and target. sizes: source, source_size. Targets are weight shares of
    budget * all sizes, held at ceiling * size, the excess reshared by weight: min(ceiling * size,
    level * weight) with one level, found from running sums by ceiling * size / weight. One row per
    source meets here, never documents."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(ceiling))
    everything = Window.partitionBy(F.lit(1))
    ratio = Window.partitionBy(F.lit(1)).orderBy("_ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("weight", w)
        .withColumn("_cap", cap)
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(ratio), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ratio), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_weights"))
        # the first source that the level of the rest does not fill sets the level; later ones have lower levels
        .withColumn("_level", F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(everything))
    )
    return ranked.select("source", "source_size", "weight", F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("weight"))).alias("target"))


def hash60(column: str):
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.0, ceiling: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row per document: id, source, size, source_size, target, taken (words the mix takes; a document
    is taken floor(target / source_size) times, and once more below its source's threshold)."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    slim = materialize(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), size.alias("size"), hash60(id_col).alias("_h")), "mix")
    plan = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, ceiling)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = materialize(plan.withColumn("_times", F.least(times, F.lit(int(ceiling))).cast("long")).withColumn("_rest", F.floor(F.col("target") - F.col("_times") * F.col("source_size")).cast("long")), "mix-plan")

    # the threshold: all hashes below _low are in, _left words remain for the bucket that starts there
    cut = plan.select(F.col("source").alias("_s"), F.lit(0).cast("long").alias("_low"), F.col("_rest").alias("_left"))
    inside = slim
    for shift in range(BITS - STEP, -1, -STEP):
        bucket = F.shiftright("_h", shift)
        if shift < BITS - STEP:  # only what is in the boundary bucket goes on to the next level
            inside = inside.join(cut, F.col("source").eqNullSafe(F.col("_s"))).filter(F.shiftright("_h", shift + STEP) == F.shiftright("_low", shift + STEP))
            inside = materialize(inside.select("source", "size", "_h"), "mix-boundary")
        sums = inside.groupBy("source", bucket.alias("_b")).agg(F.sum("size").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy("source").orderBy("_b"))
        sums = sums.join(cut, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_upto", upto)
        # the first bucket whose running sum exceeds what is left
        over = sums.filter(F.col("_upto") > F.col("_left")).groupBy("_s").agg(F.min(F.struct("_b", (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_l"), "_n")).alias("_x"))
        cut = cut.join(over.withColumnRenamed("_s", "_s2"), F.col("_s").eqNullSafe(F.col("_s2")), "left")
        low, left, n = F.shiftleft(F.col("_x._b"), shift), F.col("_x._l"), F.col("_x._n")
        if shift:
            low = F.coalesce(low, F.col("_low"))
        else:  # one hash is left: it goes in if that comes nearer to the target
            low = F.when(F.col("_x").isNull(), F.lit((1 << BITS) - 1)).when(2 * left > n, low + 1).otherwise(low)
        cut = materialize(cut.select("_s", low.alias("_low"), F.coalesce(left, F.col("_left")).alias("_left")), "mix-cut")

    whole = plan.join(cut, F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), "source_size", "target", "_times", "_rest", "_low")
    more = ((F.col("_rest") > 0) & (F.col("_h") < F.col("_low"))).cast("long")
    return slim.join(whole, F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("_id").alias(id_col), "source", "size", "source_size", "target", (F.col("size") * (F.col("_times") + more)).alias("taken")
    )
