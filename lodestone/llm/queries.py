"""Queries of this subpackage over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import borda as b
from lodestone.llm import docpairs, leakage, mixture, packing, spans, syntax
from lodestone.llm.oracle import SQL  # noqa: F401  (read by the entry module)
from lodestone.session import cut_lineage, table


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "packed_items"), table(spark, d, "budget_configs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("size > capacity").select("query_id", "candidate_id").distinct()


def p2_contexts(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(_packed(spark, d))


def p2_invariants(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_invariants(_packed(spark, d))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return b.borda(table(spark, d, "retrieval_results"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return b.sound_first(_ranked(spark, d))


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("query_id", "chunk_id", "bm25_score_rank", "vector_score_rank", "graph_score_rank", F.round("fused_score", 9).alias("fused_score"), F.col("fused_rank").cast("bigint").alias("fused_rank"))


def p3_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return b.ndcg(_ranked(spark, d), table(spark, d, "judgments"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented_functions(table(spark, d, "source_files")).select("file_id", "qualified_name").distinct()


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented_functions(table(spark, d, "source_files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.broken_files(table(spark, d, "source_files")).where("broken").select("file_id")


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.broken_rates(syntax.broken_files(table(spark, d, "source_files")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_near(spark, d).where("least_edits = 0").select("doc_id", "item_id")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _planned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixture.planned(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _planned(spark, d)[1].where("short").select("source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(*_planned(spark, d))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    counts, plan = _planned(spark, d)
    return mixture.mix_report(mixture.mix(counts, plan), plan)


def p9_tempered(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    counts = cut_lineage(mixture.token_counts(table(spark, d, "documents")))
    plan = mixture.tempered_plan(counts, targets)
    return mixture.mix_report(mixture.mix(counts, plan), plan)


def p9_char_plan(spark: SparkSession, d: str) -> DataFrame:
    """The plan with code points in place of tokens, which SQL can count."""
    counts = mixture.char_counts(table(spark, d, "documents"))
    return mixture.source_plan(counts, table(spark, d, "mix_targets")).select("source", "documents", "tokens", "target_share", F.col("max_repeats").cast("bigint").alias("max_repeats"), "budget", "short")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.document_pairs(*spans.shared_spans(table(spark, d, "documents")))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_shares(*spans.shared_spans(table(spark, d, "documents")))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_contexts, p2_report, p2_invariants, p3_found, p3_ranking, p3_ndcg, p4_found, p4_pairs, p6_found, p6_rates, p8_found, p8_near, p9_found, p9_mix, p9_report, p9_tempered, p9_char_plan, p10_found, p10_shares)
}
