"""Changes of symbols between two times, and what an index must redo for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.keys import norm_id, norm_name


def alive(entities: DataFrame, at: str) -> DataFrame:
    """(repository_id, qualified_name, symbol_id, body, place): what lives at a time, one row a name, the smallest id.

    A life runs from the earliest indexed_at until before deleted_at.
    """
    t = F.lit(at).cast("timestamp_ntz")
    rows = entities.groupBy(norm_id("entity_id").alias("symbol_id")).agg(
        F.min(F.col("indexed_at").cast("timestamp_ntz")).alias("since"), F.max(F.coalesce(F.col("deleted_at").cast("timestamp_ntz"), F.lit("9999-01-01").cast("timestamp_ntz"))).alias("until"),
        F.min(F.struct(norm_id("repository_id").alias("repository_id"), norm_name("qualified_name").alias("qualified_name"), F.concat_ws("|", "kind", "name", "doc_comment").alias("body"), F.concat_ws("-", "start_line", "end_line").alias("place"))).alias("r"),
    )
    live = rows.where((F.col("since") <= t) & (t < F.col("until"))).select("symbol_id", "r.*").where("qualified_name is not null and symbol_id is not null")
    return live.groupBy("repository_id", "qualified_name").agg(F.min(F.struct("symbol_id", "body", "place")).alias("r")).select("repository_id", "qualified_name", "r.*")


def symbol_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repository_id, qualified_name, change_type, old_id, new_id): ADDED, DELETED, MODIFIED or IDENTITY_ONLY.

    Of alive() at two times. MODIFIED: the body differs; IDENTITY_ONLY: only the id or place does. What stays as it
    was gives no row.
    """
    a, b = before.alias("a"), after.alias("b")
    j = a.join(b, (F.col("a.repository_id") == F.col("b.repository_id")) & (F.col("a.qualified_name") == F.col("b.qualified_name")), "full_outer")
    same = F.col("a.symbol_id").eqNullSafe(F.col("b.symbol_id")) & F.col("a.place").eqNullSafe(F.col("b.place"))
    kind: Column = F.when(F.col("a.symbol_id").isNull(), "ADDED").when(F.col("b.symbol_id").isNull(), "DELETED").when(~F.col("a.body").eqNullSafe(F.col("b.body")), "MODIFIED").when(~same, "IDENTITY_ONLY")
    return j.select(
        F.coalesce("a.repository_id", "b.repository_id").alias("repository_id"), F.coalesce("a.qualified_name", "b.qualified_name").alias("qualified_name"), kind.alias("change_type"),
        F.col("a.symbol_id").alias("old_id"), F.col("b.symbol_id").alias("new_id"),
    ).where("change_type is not null")


def reindex_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chunk_id, action): KEEP, REMOVE, EMBED or REUSE for the chunks of two versions (chunk_id, chunk_type, text).

    A new chunk whose text and type a removed or kept old chunk has takes over its embedding; texts meet by digest.
    """
    o = old.select("chunk_id", "chunk_type", F.sha2("text", 256).alias("digest"))
    n = new.select("chunk_id", "chunk_type", F.sha2("text", 256).alias("digest"))
    kept = n.join(o, ["chunk_id", "chunk_type", "digest"], "left_semi")
    removed = o.join(n, ["chunk_id", "chunk_type", "digest"], "left_anti")
    fresh = n.join(o, ["chunk_id", "chunk_type", "digest"], "left_anti")
    have = o.where("digest is not null").select("chunk_type", "digest").distinct().withColumn("has", F.lit(True))
    return (
        kept.select("chunk_id", F.lit("KEEP").alias("action"))
        .unionByName(removed.select("chunk_id", F.lit("REMOVE").alias("action")))
        .unionByName(fresh.join(have, ["chunk_type", "digest"], "left").select("chunk_id", F.when(F.col("has"), "REUSE").otherwise("EMBED").alias("action")))
    )


def next_version(base: DataFrame, removed: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """The rows of a version less those removed, with those added: an added key takes the place of an old one."""
    return base.join(removed.select(key), key, "left_anti").join(added.select(key), key, "left_anti").select(base.columns).unionByName(added.select(base.columns))


def audit_log(derived: DataFrame, logged: DataFrame) -> DataFrame:
    """(repository_id, n_derived, n_logged, n_agreed, precision, recall) of logged against derived changes.

    Both: (repository_id, snapshot_no, path, change_type), repeats counting once.
    """
    key = ["repository_id", "snapshot_no", "path", "change_type"]
    both = derived.select(key).distinct().withColumn("d", F.lit(1)).join(logged.select(key).distinct().withColumn("l", F.lit(1)), key, "full_outer")
    n = both.groupBy("repository_id").agg(F.count("d").alias("n_derived"), F.count("l").alias("n_logged"), F.count_if(F.col("d").isNotNull() & F.col("l").isNotNull()).alias("n_agreed"))
    return n.withColumns({m: F.round(F.when(F.col(c) > 0, F.col("n_agreed") / F.col(c)).otherwise(0.0), 6) for m, c in (("precision", "n_logged"), ("recall", "n_derived"))})
