"""Versioned tables on shared storage, and checks before rows enter them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_version(df: DataFrame, path: str, repository_id: str, commit_sha: str) -> None:
    """One version of a repository's rows; written again, it replaces only itself."""
    rows = df.withColumns({"repository_id": F.lit(repository_id), "commit_sha": F.lit(commit_sha)})
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("repository_id", "commit_sha").parquet(path)


def read_version(spark: SparkSession, path: str, repository_id: str, commit_sha: str) -> DataFrame:
    """The rows of one version: only its partition is read. A version that isn't there is an error."""
    df = spark.read.parquet(path).where((F.col("repository_id") == repository_id) & (F.col("commit_sha") == commit_sha))
    if df.isEmpty():
        raise KeyError(f"{repository_id}@{commit_sha}")
    return df


def mark(spark: SparkSession, path: str, repository_id: str, commit_sha: str, status: str) -> None:
    """Appends to the log of versions: building, ready or failed. Readers follow the last ready one."""
    if status not in ("building", "ready", "failed"):
        raise ValueError(status)
    spark.createDataFrame([(repository_id, commit_sha, status)], "repository_id string, commit_sha string, status string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def active_version(spark: SparkSession, path: str) -> DataFrame:
    """(repository_id, commit_sha): the latest version of each repository whose last mark is ready."""
    log = spark.read.parquet(path)
    last = log.groupBy("repository_id", "commit_sha").agg(F.max(F.struct("at", "status")).alias("r"))
    return last.where("r.status = 'ready'").groupBy("repository_id").agg(F.max(F.struct("r.at", "commit_sha")).alias("r")).select("repository_id", "r.commit_sha")


def conflicts(df: DataFrame, key: str) -> DataFrame:
    """(key, n_forms): keys whose rows differ; equal repeats are none."""
    return df.groupBy(key).agg(F.count_distinct(F.struct(*[c for c in df.columns if c != key])).alias("n_forms")).where("n_forms > 1")


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, n): how many rows break each SQL condition; null counts as broken."""
    n = df.agg(*[F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(r) for r, c in rules.items()])
    return n.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules])).alias("v")).select("v.*")
