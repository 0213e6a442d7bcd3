"""Tables that several branches of one plan read: written once, read back, so that nothing below them runs twice."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without that setting a session on one machine gets a folder of its own; on a cluster this is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="fidelis-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """df through a checkpoint in the shared folder, which cuts lineage and survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Shuffle files go once the query that made them has ended: its result is written, so nothing reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df through Parquet in the shared folder: as settle, but small on disk, later reads take the columns that they need, and its size is known to the planner."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, order: list[Column | str], keep=settle) -> DataFrame:
    """df in ranges of this order with _p, the number of its range. Settled: ranges come from a sample and would differ when run again."""
    return keep(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on keys, of which null equals null; the keys come from a."""
    b = b.select(*[F.col(c).alias(f"_k_{c}") for c in keys], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return a.join(b, on, how).drop(*[f"_k_{c}" for c in keys])
