"""Writers beside Spark's own: small report tables and run records. What they collect has one row per combination or run."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def report_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One CSV file with a header, sorted."""
    df.orderBy(*order).coalesce(1).write.mode("error").option("header", True).csv(path)


def if_absent(df: DataFrame, path: str) -> None:
    """Write Parquet unless something is there."""
    df.write.mode("ignore").parquet(path)


def append_then_compact(fresh: DataFrame, path: str, keys: list[str], at: str, compacted: str) -> DataFrame:
    """Append records, then write the last one per key without errors to another folder, sorted."""
    from fidelis.sources.readers import last_records

    fresh.write.mode("append").json(path)
    every = fresh.sparkSession.read.schema(fresh.schema).json(path)
    last_records(every.filter("error is null"), keys, at).orderBy(*keys).write.mode("overwrite").json(compacted)
    return fresh.sparkSession.read.schema(fresh.schema).json(compacted)


def run_id(experiment: str, config: dict, now: datetime | None = None) -> str:
    """Time, experiment and a digest of the configuration."""
    now = now or datetime.now(timezone.utc)
    return f"{now:%Y%m%d-%H%M%S}-{now.microsecond // 1000:03d}__{experiment}__{hashlib.sha1(json.dumps(config, sort_keys=True).encode()).hexdigest()[:8]}"


def record_run(spark: SparkSession, root: str, experiment: str, config: dict, metrics: dict[str, float]) -> str:
    """A row of the runs table and one per metric; returns the run's id."""
    name = run_id(experiment, config)
    spark.createDataFrame([(name, experiment, json.dumps(config, sort_keys=True))], "run string, experiment string, config string").coalesce(1).write.mode("append").parquet(f"{root}/runs")
    spark.createDataFrame([(name, k, float(v)) for k, v in metrics.items()], "run string, metric string, value double").coalesce(1).write.mode("append").parquet(f"{root}/metrics")
    return name


def observed_counts(df: DataFrame, name: str, **conditions) -> tuple[DataFrame, object]:
    """df with an observation of its rows and of conditions, filled by the first action: counts for a manifest without another pass."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()]), seen


def write_samples(df: DataFrame, path: str, keys: list[str]) -> None:
    """Samples as lines of JSON, compressed; one line per key (row, arm, number of the sample): a repeated key is an error and nothing is written."""
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"repeated {', '.join(keys)}")
    df.write.mode("overwrite").option("compression", "gzip").json(path)
