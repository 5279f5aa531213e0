"""Whether an answer's claims are borne out by the contexts they cite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import claims

#: Weights, thresholds and the least length of a word.
VALID, SYMBOL, LEXICAL, SUPPORTED, PARTIAL, LEAST = 0.2, 0.4, 0.8, 0.8, 0.5, 3


def _words(c):
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^A-Za-z0-9_]+"), lambda w: F.length(w) >= LEAST))


def verify(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """(answer_id, claim, n_citations, n_valid, score, status): one row per claim.

    answers: (answer_id, text); contexts: (answer_id, context_id, symbol_name, code). A claim cites as [CTX:id]. A
    valid citation scores 0.2, 0.4 more if the claim names the context's symbol, and 0.8 times the share of its words
    that the code has, at most 1; the mean is over all citations, those to unknown or blank ids scoring 0.
    SUPPORTED from 0.8, PARTIALLY_SUPPORTED from 0.5, else UNSUPPORTED; UNCITED without citations. Null answers have
    no claims.
    """
    rows = answers.select("answer_id", F.posexplode(claims("text")).alias("claim", "said"))
    cited = rows.withColumn("cited", F.explode_outer(F.regexp_extract_all("said", F.lit(r"\[CTX:(.*?)\]"), 1)))
    one = contexts.groupBy("answer_id", F.col("context_id").alias("cited")).agg(F.min(F.struct("symbol_name", "code")).alias("ctx"))
    j = cited.withColumn("is_citation", F.col("cited").isNotNull()).withColumn("cited", F.trim("cited")).join(one, ["answer_id", "cited"], "left")
    said, valid = _words("said"), F.col("ctx").isNotNull()
    symbol = F.lower(F.coalesce("ctx.symbol_name", F.lit("")))
    share = F.when(F.size(said) > 0, F.size(F.array_intersect(said, _words(F.coalesce("ctx.code", F.lit(""))))) / F.size(said)).otherwise(0.0)
    score = F.when(valid, F.least(F.lit(1.0), F.lit(VALID) + F.when((symbol != "") & F.lower("said").contains(symbol), SYMBOL).otherwise(0.0) + LEXICAL * share)).otherwise(0.0)
    per = j.withColumn("s", score).groupBy("answer_id", "claim").agg(F.count_if("is_citation").alias("n_citations"), F.count_if(valid).alias("n_valid"), F.round(F.sum(F.when(F.col("is_citation"), F.col("s"))), 9).alias("total"))
    mean = F.round(F.when(F.col("n_citations") > 0, F.col("total") / F.col("n_citations")).otherwise(0.0), 6)
    status = F.when(F.col("n_citations") == 0, "UNCITED").when(mean >= SUPPORTED, "SUPPORTED").when(mean >= PARTIAL, "PARTIALLY_SUPPORTED").otherwise("UNSUPPORTED")
    return per.select("answer_id", "claim", "n_citations", "n_valid", mean.alias("score"), status.alias("status"))


def summary(verified: DataFrame) -> DataFrame:
    """Counts, coverage and an overall status by answer."""
    n = F.count("*")
    a = verified.groupBy("answer_id").agg(
        n.alias("n_claims"), *[F.count_if(F.col("status") == s.upper()).alias(s) for s in ("supported", "partially_supported", "unsupported", "uncited")],
        F.sum("n_citations").alias("n_citations"), F.sum("n_valid").alias("n_valid"), F.round(F.avg("score"), 6).alias("mean_score"),
    )
    overall = F.when(F.col("supported") == F.col("n_claims"), "SUPPORTED").when(F.col("supported") + F.col("partially_supported") > 0, "PARTIALLY_SUPPORTED").otherwise("UNSUPPORTED")
    return a.withColumns({"citation_coverage": F.round((F.col("n_claims") - F.col("uncited")) / F.col("n_claims"), 6), "grounding_coverage": F.round(F.col("supported") / F.col("n_claims"), 6), "overall": overall})
