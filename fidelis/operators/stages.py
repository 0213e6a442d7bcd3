"""Restartable jobs: stages that remember what they have done and redo only what changed.

    <root>/<stage>/done/<batch>/     rows (_key, _digest): keys that are finished, with the digest of what they were made of
    <root>/<stage>/data/<batch>/     what these keys gave

A keyed stage makes the rows of each key from the input rows of that key. Its input's digest per key says whether a key is new,
changed, finished or gone. Pending keys are dealt into batches; a batch writes its data first and its keys after, and counts when the
keys' folder is complete (_SUCCESS, which Spark's committer writes last). So a run that is killed loses the batch that it was at,
the next one goes on with the keys that remain, and the result is the same. A whole stage has one key, and is made anew when any
input row changed. The version of a stage goes into the digests: a changed rule makes everything stale.

The driver lists batches; keys, digests and rows stay in tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Make = Callable[[DataFrame], DataFrame]


@dataclass
class Stage:
    """name; make (input rows of some keys -> output rows, with the key column kept); key (None: the input as a whole); version of the rule; batches per run."""

    name: str
    make: Make
    key: str | None = None
    version: str = "1"
    batches: int = 4
    made: list[str] = field(default_factory=list)  # batches that this run made


def input_digests(rows: DataFrame, key: Column, version: str) -> DataFrame:
    """_key, _digest of the rows of each key, in any order: count, two sums and an exclusive or of row hashes, and the version."""
    one = F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)])
    said = F.to_json(one, {"ignoreNullFields": "false"})
    h = rows.select(key.cast("string").alias("_key"), F.xxhash64(said).alias("_a"), F.xxhash64(F.lit("again"), said).alias("_b"))
    g = h.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("_a").cast("decimal(20,0)")).alias("_x"), F.sum(F.col("_b").cast("decimal(20,0)")).alias("_y"), F.bit_xor("_a").alias("_z"))
    return g.select(F.coalesce("_key", F.lit("")).alias("_key"), F.col("_key").isNull().alias("_null"), F.sha2(F.concat_ws("|", F.lit(version), *[F.col(c).cast("string") for c in ("_n", "_x", "_y", "_z")]), 256).alias("_digest"))


class Graph:
    """Runs stages one after another; each takes the result of the one before."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _complete(self, stage: Stage) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{stage.name}/done")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        marked = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(n for n in names if fs.exists(marked(f"{self.root}/{stage.name}/done/{n}/_SUCCESS")))

    def _done(self, stage: Stage) -> DataFrame:
        """_key, _null, _digest, _batch of finished keys."""
        names = self._complete(stage)
        schema = "_key string, _null boolean, _digest string"
        if not names:
            return self.spark.createDataFrame([], f"{schema}, _batch string")
        df = self.spark.read.schema(schema).parquet(*[f"{self.root}/{stage.name}/done/{n}" for n in names])
        return df.withColumn("_batch", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))

    def _keyed(self, rows: DataFrame, stage: Stage) -> tuple[DataFrame, Column]:
        return rows, (F.col(f"`{stage.key}`") if stage.key else F.lit("all"))

    def pending(self, rows: DataFrame, stage: Stage) -> DataFrame:
        """_key, _null, _digest of keys that are new or changed."""
        rows, key = self._keyed(rows, stage)
        now = input_digests(rows, key, f"{stage.name}/{stage.version}")
        return now.join(self._done(stage).select("_key", "_null", "_digest").distinct(), ["_key", "_null", "_digest"], "left_anti")

    def run(self, rows: DataFrame, stage: Stage) -> DataFrame:
        """The stage's rows for the keys of `rows`, of which only pending ones are made."""
        stage.made = []
        rows, key = self._keyed(rows, stage)
        todo = self.pending(rows, stage).withColumn("_at", F.pmod(F.xxhash64("_key", "_null"), F.lit(stage.batches)).cast("int"))
        todo = self._settled(todo, stage)
        with_key = rows.withColumn("_k1", F.coalesce(key.cast("string"), F.lit(""))).withColumn("_k2", key.isNull())
        for at in [r["_at"] for r in todo.select("_at").distinct().orderBy("_at").collect()]:
            mine = todo.filter(F.col("_at") == at)
            name = f"{stage.version}-{uuid.uuid4().hex}"
            part = with_key.join(mine.select(F.col("_key").alias("_k1"), F.col("_null").alias("_k2")), ["_k1", "_k2"], "left_semi").drop("_k1", "_k2")
            stage.make(part).write.parquet(f"{self.root}/{stage.name}/data/{name}")
            mine.select("_key", "_null", "_digest").write.parquet(f"{self.root}/{stage.name}/done/{name}")
            stage.made.append(name)
        return self.result(rows, stage)

    def _settled(self, todo: DataFrame, stage: Stage) -> DataFrame:
        """Pending keys written down: what the run has finished must not change what it still has to do."""
        path = f"{self.root}/{stage.name}/todo/{uuid.uuid4().hex}"
        todo.write.parquet(path)
        return self.spark.read.schema(todo.schema).parquet(path)

    def result(self, rows: DataFrame, stage: Stage) -> DataFrame:
        """Rows that finished keys gave for the input as it is now: one batch a key, the last by name where two runs made it."""
        rows, key = self._keyed(rows, stage)
        now = input_digests(rows, key, f"{stage.name}/{stage.version}")
        valid = self._done(stage).join(now, ["_key", "_null", "_digest"], "left_semi").groupBy("_key", "_null").agg(F.max("_batch").alias("_batch"))
        names = self._complete(stage)
        if not names:
            return stage.make(rows.filter(F.lit(False)))
        shape = self.spark.read.parquet(f"{self.root}/{stage.name}/data/{names[-1]}").schema
        data = self.spark.read.schema(shape).parquet(*[f"{self.root}/{stage.name}/data/{n}" for n in names])
        data = data.select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("_b"))
        out_key = F.col(f"`{stage.key}`").cast("string") if stage.key else F.lit("all")
        on = (data["_b"] == valid["_batch"]) & (F.coalesce(out_key, F.lit("")) == valid["_key"]) & (out_key.isNull() == valid["_null"])
        return data.join(valid, on, "left_semi").drop("_b")
