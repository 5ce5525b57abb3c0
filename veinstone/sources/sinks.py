"""Sinks: partition overwrite, upsert, deletion by keys, pointer switch, metrics text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace just the partitions that df holds, in one write."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those of equal key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """df without the rows whose keys are given."""
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def switch_pointer(spark: SparkSession, path: str, changes: DataFrame, key: str = "file_node_id") -> DataFrame:
    """Make ``generation`` of changes the current one, the former current the previous. The table is written as a new
    version beside the old, and the version is what readers look for: a failure leaves the old one in place."""
    versions = sorted(int(p.split("=")[1]) for p in _children(spark, path) if p.startswith("version=") and _complete(spark, f"{path}/{p}"))
    old = spark.read.parquet(f"{path}/version={versions[-1]}") if versions else spark.createDataFrame([], f"{key} long, current string, previous string")
    both = old.join(changes.select(key, "generation"), key, "full")
    new = both.select(key, F.coalesce("generation", "current").alias("current"), F.when(F.col("generation").isNotNull() & (F.col("generation") != F.coalesce("current", F.lit(""))), F.col("current")).otherwise(F.col("previous")).alias("previous"))
    new.write.parquet(f"{path}/version={(versions[-1] if versions else 0) + 1}")
    return spark.read.parquet(f"{path}/version={(versions[-1] if versions else 0) + 1}")


def _children(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _complete(spark: SparkSession, path: str) -> bool:
    return "_SUCCESS" in _children(spark, path)


def metrics_text(df: DataFrame, name: str = "duration_seconds") -> str:
    """Quantiles, sum and count by type as metrics text. df: (event_type, p50, p95, p99, total, n), one row a type."""
    out = [f"# TYPE {name} summary"]
    for r in sorted(df.collect(), key=lambda r: r["event_type"]):
        out += [f'{name}{{type="{r["event_type"]}",quantile="{q}"}} {r[c]}' for q, c in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
        out += [f'{name}_sum{{type="{r["event_type"]}"}} {r["total"]}', f'{name}_count{{type="{r["event_type"]}"}} {r["n"]}']
    return "\n".join(out) + "\n"
