"""One ranking from several differently-scaled scores: a weighted Borda count.

A score counts only by the rank it gives a chunk within its query: competition ranks with ties averaged, missing scores
at the mid-rank of the places below all present ones. Scales and distributions cancel out.

Queries of up to ``hot_rows`` chunks are ranked by windows that share one shuffle. A larger one never sorts in a single
task: its chunks are range-partitioned, ranked within the partitions and shifted by the counts of those before.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.keys import norm_id
from lodestone.session import cut_lineage

HOT_ROWS = 500_000
WEIGHTS = {"bm25_score": 1.0, "vector_score": 1.0, "graph_score": 1.0}


def finite(c: Column | str) -> Column:
    """The score, null where it isn't finite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def positions(df: DataFrame, key: str, order: list[Column], into: str) -> DataFrame:
    """df with the 1-based place of each row within its key, without a task that holds a key.

    order must be total. The range partitions are written once, so that places and counts are of the same cut.
    """
    cols = [c for c in df.columns]
    cut = cut_lineage(df.repartitionByRange(F.col(key), *order).withColumn("_part", F.spark_partition_id()))
    counts = cut.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    shift = counts.select(
        F.col(key).alias("_k"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift")
    )
    within = cut.withColumn("_at", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)))
    return within.join(shift, (F.col(key) == F.col("_k")) & (F.col("_part") == F.col("_p"))).select(*cols, (F.col("_at") + F.col("_shift")).alias(into))


def _ranks_by_window(rows: DataFrame, scores: list[str]) -> DataFrame:
    q = Window.partitionBy("query_id")
    out = rows.withColumn("n", F.count("*").over(q))
    for s in scores:
        w = q.orderBy(F.col(s).desc_nulls_last())
        tied = F.count("*").over(Window.partitionBy("query_id", s))
        out = out.withColumn(f"{s}_rank", F.rank().over(w) + (tied - 1) / 2)
    return out


def _ranks_by_range(rows: DataFrame, scores: list[str]) -> DataFrame:
    out = rows.join(rows.groupBy("query_id").agg(F.count("*").alias("n")), "query_id")
    for s in scores:
        at = positions(out, "query_id", [F.col(s).desc_nulls_last(), F.col("chunk_id")], "_place")
        ties = at.groupBy(F.col("query_id").alias("_q"), F.col(s).alias("_s")).agg(F.avg("_place").alias(f"{s}_rank"))
        out = at.join(ties, (F.col("query_id") == F.col("_q")) & F.col(s).eqNullSafe(F.col("_s"))).drop("_place", "_q", "_s")
    return out


def borda(results: DataFrame, weights: Mapping[str, float] = WEIGHTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(query_id, chunk_id, the scores, their ranks, fused_score, fused_rank): one row per query and chunk.

    A rank is the average of the places that chunks of the same score share, 1 for the greatest; null and non-finite
    scores are missing and share the places below all others. fused_score: weighted points, n - rank for n chunks,
    as a share of the most there is; 1 where a query has one chunk. fused_rank: by fused_score, ties by chunk_id.
    Of rows redelivered for a query and chunk the latest holds. Rows without either id are left out; an empty table
    gives no rows. The table's own rank and fused_score are not looked at.
    """
    scores = list(weights)
    rows = (
        results.select(norm_id("query_id").alias("query_id"), norm_id("chunk_id").alias("chunk_id"), "retrieved_at", *[finite(F.col(s).cast("double")).alias(s) for s in scores])
        .where("query_id is not null and chunk_id is not null")
        .groupBy("query_id", "chunk_id")
        .agg(F.max(F.struct("retrieved_at", *scores)).alias("r"))
        .select("query_id", "chunk_id", *[f"r.{s}" for s in scores])
    )
    most = sum(weights.values())
    points = sum((F.col("n") - F.col(f"{s}_rank")) * F.lit(float(w)) for s, w in weights.items())
    fused = F.when(F.col("n") == 1, 1.0).otherwise(points / ((F.col("n") - 1) * most))
    best = [F.col("fused_score").desc(), F.col("chunk_id")]
    out = ["query_id", "chunk_id", *scores, *[f"{s}_rank" for s in scores], "fused_score", "fused_rank"]

    hot = rows.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("query_id")
    hot = cut_lineage(hot)
    if not hot.limit(1).count():
        cold, warm = rows, None
    else:
        cold, warm = rows.join(hot, "query_id", "left_anti"), rows.join(hot, "query_id", "left_semi")
    done = _ranks_by_window(cold, scores).withColumn("fused_score", fused).withColumn("fused_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best)).cast("bigint")).select(*out)
    if warm is None:
        return done
    large = positions(_ranks_by_range(warm, scores).withColumn("fused_score", fused), "query_id", best, "fused_rank")
    return done.unionByName(large.select(*out))


def sound_first(ranked: DataFrame, scores: list[str] | None = None) -> DataFrame:
    """(query_id, chunk_id) of borda() that lead in every score alone, and so in any sound ranking."""
    scores = scores or list(WEIGHTS)
    keep = F.col("fused_rank") == 1
    for s in scores:
        keep = keep & F.col(s).isNotNull() & (F.col(f"{s}_rank") == 1)
    return ranked.where(keep).select("query_id", "chunk_id")


def ndcg(ranked: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg) of borda() for the judged queries: linear gain, unjudged chunks 0; 0 where nothing is relevant."""
    grades = judgments.select(norm_id("query_id").alias("query_id"), norm_id("chunk_id").alias("chunk_id"), "grade").groupBy("query_id", "chunk_id").agg(F.max("grade").alias("grade"))
    ideal = (
        grades.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "chunk_id")))
        .where(F.col("at") <= k)
        .groupBy("query_id")
        .agg(F.sum(F.col("grade") / F.log2(F.col("at") + 1)).alias("ideal"))
    )
    got = ranked.where(F.col("fused_rank") <= k).join(grades, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.sum(F.col("grade") / F.log2(F.col("fused_rank") + 1)).alias("got"))
    return ideal.join(got, "query_id", "left").select("query_id", F.round(F.coalesce(F.when(F.col("ideal") > 0, F.col("got") / F.col("ideal")), F.lit(0.0)), 6).alias("ndcg"))
