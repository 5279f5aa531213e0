"""Rank fusion and reranking of branch results, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
#: The reranker's weights.
RERANK_WEIGHTS = {"exact_symbol": 0.35, "qualified_symbol": 0.20, "token_overlap": 0.25, "source_agreement": 0.10, "rrf_prior": 0.10}
SOURCES = ("bm25", "vector", "graph")


def fuse(branches: DataFrame, k: int | None = 10, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, chunk_id, source, rank, score).

    One row per query and chunk: fused_score, its rank, sources in the order bm25, vector, graph, and rank and score by
    source. One aggregation takes the place of outer joins. A branch's repeated chunk counts by its best rank. Null
    ranks are no result. Ties go by chunk_id. k=None gives the whole list.
    """
    best = branches.where("rank is not null").groupBy("query_id", "chunk_id", "source").agg(F.min(F.struct("rank", "score")).alias("r"))
    at = {s: F.col("source") == s for s in SOURCES}
    out = best.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1 / (F.lit(rrf_k) + F.col("r.rank"))), 9).alias("fused_score"),
        *[F.max(F.when(at[s], F.col("r.rank"))).alias(f"{s}_rank") for s in SOURCES],
        *[F.max(F.when(at[s], F.col("r.score"))).alias(f"{s}_score") for s in SOURCES],
    )
    present = F.filter(F.array(*[F.when(F.col(f"{s}_rank").isNotNull(), F.lit(s)) for s in SOURCES]), lambda s: s.isNotNull())
    w = Window.partitionBy("query_id").orderBy(F.col("fused_score").desc(), "chunk_id")
    ranked = out.withColumn("sources", present).withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def rerank(fused: DataFrame, pool: int = 50, k: int = 10, weights: dict[str, float] = RERANK_WEIGHTS) -> DataFrame:
    """Deterministic features over the best ``pool`` rows of each query.

    fused: (query_id, chunk_id, rank, fused_score, sources, symbol_name, qualified_name, file_path, target, query_tokens).
    Unknown or negative weights are an error.
    """
    if set(weights) - set(RERANK_WEIGHTS) or any(w < 0 for w in weights.values()):
        raise ValueError("unknown or negative weight")
    w = RERANK_WEIGHTS | weights
    rows = fused.where(F.col("rank") <= pool)
    top = F.max("fused_score").over(Window.partitionBy("query_id"))

    def lower(c: str) -> Column:
        return F.lower(F.coalesce(F.col(c), F.lit("")))

    none = F.array().cast("array<string>")
    tokens = F.array_distinct(
        F.filter(
            F.concat(
                F.array(lower("symbol_name")), F.coalesce(F.split(lower("qualified_name"), r"\."), none), F.coalesce(F.split(F.translate(lower("file_path"), "/.", "  "), " "), none)
            ),
            lambda t: t != "",
        )
    )
    asked = F.array_distinct(F.col("query_tokens"))
    target = F.lower(F.col("target"))
    features = {
        "exact_symbol": F.when((target != "") & (lower("symbol_name") == target), 1.0).otherwise(0.0),
        "qualified_symbol": F.when((target != "") & lower("qualified_name").contains(target), 1.0).otherwise(0.0),
        "token_overlap": F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tokens)) / F.size(asked)).otherwise(0.0),
        "source_agreement": F.least(F.size("sources") / 3, F.lit(1.0)),
        "rrf_prior": F.least(F.greatest(F.col("fused_score") / F.when(top > 0, top).otherwise(1.0), F.lit(0.0)), F.lit(1.0)),
    }
    score = F.round(sum(F.lit(w[n]) * f for n, f in features.items()), 6)
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "chunk_id")
    out = rows.select("query_id", "chunk_id", score.alias("rerank_score")).withColumn("rerank_rank", F.row_number().over(order))
    return out.where(F.col("rerank_rank") <= k)
