"""Ranking quality, its breakdowns and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_query(ranked: DataFrame, judged: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, precision, recall, hit_rate, reciprocal_rank, ndcg) at k for every judged query.

    ranked: (query_id, chunk_id, rank); judged: (query_id, chunk_id, grade), a grade above 0 is relevant. Precision
    divides by k, recall by the relevant; the reciprocal rank looks at the whole list; gains are linear. Nothing
    relevant or nothing found gives 0. k below 1 is an error.
    """
    if k < 1:
        raise ValueError("k must be positive")
    grades = judged.groupBy("query_id", "chunk_id").agg(F.max("grade").alias("grade"))
    found = ranked.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "chunk_id")
    rows = grades.withColumn("ideal_rank", F.row_number().over(w)).join(found, ["query_id", "chunk_id"], "left")
    relevant, near = F.col("grade") > 0, F.col("rank") <= k
    n, hits = F.count_if(relevant), F.count_if(relevant & near)
    ideal = F.sum(F.when(F.col("ideal_rank") <= k, F.col("grade") / F.log2(F.col("ideal_rank") + 1)))
    gain = F.coalesce(F.sum(F.when(near, F.col("grade") / F.log2(F.col("rank") + 1))), F.lit(0.0))
    return rows.groupBy("query_id").agg(
        F.round(hits / k, 6).alias("precision"),
        F.round(F.when(n > 0, hits / n).otherwise(0.0), 6).alias("recall"),
        F.when(hits > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        F.round(F.coalesce(1 / F.min(F.when(relevant, F.col("rank"))), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.when(ideal > 0, gain / ideal).otherwise(0.0), 6).alias("ndcg"),
    )


def breakdown(metrics: DataFrame, sets: list[list[str]], measures: list[str]) -> DataFrame:
    """Macro averages over several groupings in one pass; columns outside a grouping are null."""
    every = sorted({c for s in sets for c in s})
    return metrics.groupingSets([[F.col(c) for c in s] for s in sets], *every).agg(F.count("*").alias("n_queries"), *[F.round(F.avg(m), 6).alias(m) for m in measures])


def deltas(by_system: DataFrame, base: str, measure: str) -> DataFrame:
    """(system, value, absolute, relative_percent) against the base system; 0 where the base is 0."""
    b = by_system.where(F.col("system") == base).select(F.col(measure).alias("_b"))
    diff = F.col(measure) - F.col("_b")
    return by_system.join(F.broadcast(b)).select(  # the base is one row
        "system", F.col(measure).alias("value"), F.round(diff, 6).alias("absolute"), F.round(F.when(F.col("_b") != 0, 100 * diff / F.col("_b")).otherwise(0.0), 4).alias("relative_percent")
    )


def percentiles(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation by group, and the number of values; nulls don't count."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), *[F.round(F.percentile(F.col(value), F.lit(p)), 6).alias(name) for name, p in points.items()])


def contribution(branches: DataFrame) -> DataFrame:
    """(bm25, vector, graph, n): how many results each combination of branches found."""
    flags = branches.groupBy("query_id", "chunk_id").agg(*[F.max(F.col("source") == s).alias(s) for s in ("bm25", "vector", "graph")])
    return flags.groupBy("bm25", "vector", "graph").agg(F.count("*").alias("n"))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)
