"""References to records that do not exist, at the time of the reference.

Skew-aware split: references are pre-aggregated per key and time, so a hot key comes down to its distinct times before
anything is shuffled on it; keys that still hold more than ``heavy`` of them are checked against their few targets by a
broadcast, if these are proven small, and the rest by a shuffled anti-join. Both counts are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.keys import norm_id, norm_name

HEAVY = 50_000
BROADCAST_ROWS = 200_000


def lifetimes(entities: DataFrame, key: list[Column], born: str, gone: str) -> DataFrame:
    """(k1.., since, until): when at least one entity of a key lives; until is null where it still does.

    Overlapping lives are merged, so a key has as many rows as there are gaps in its life, not as entities.
    """
    names = [f"k{i}" for i in range(len(key))]
    per = (
        entities.select(*[c.alias(n) for c, n in zip(key, names)], norm_id("entity_id").alias("id"), F.col(born).alias("born"), F.col(gone).alias("gone"))
        .where(" and ".join(f"{n} is not null" for n in [*names, "id"]))
        .groupBy(*names, "id")
        .agg(F.min("born").alias("since"), F.max(F.when(F.col("gone").isNull(), F.lit("9999-01-01").cast("timestamp_ntz")).otherwise(F.col("gone").cast("timestamp_ntz"))).alias("until"))
        .select(*names, F.col("since").cast("timestamp_ntz").alias("since"), "until")
        .where("since is not null and since < until")
        .groupBy(*names, "since")
        .agg(F.max("until").alias("until"))
    )
    w = Window.partitionBy(*names).orderBy("since")
    return (
        per.withColumn("reach", F.max("until").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("part", F.sum((F.col("reach").isNull() | (F.col("since") > F.col("reach"))).cast("int")).over(w))
        .groupBy(*names, "part")
        .agg(F.min("since").alias("since"), F.max("until").alias("until"))
        .drop("part")
    )


def missing(probes: DataFrame, lives: DataFrame, names: list[str], heavy: int = HEAVY, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of probes (names.., at, distinct) at whose time no life of their key runs."""
    hot = probes.groupBy(*names).agg(F.count("*").alias("n")).where(F.col("n") > heavy).select(*names)
    hot_lives = lives.join(hot, names, "left_semi")

    def gone(p: DataFrame, t: DataFrame) -> DataFrame:
        t = t.select(*[F.col(n).alias(f"t_{n}") for n in names], "since", "until")
        on = [F.col(n) == F.col(f"t_{n}") for n in names] + [F.col("since") <= F.col("at"), F.col("at") < F.col("until")]
        return p.join(t, on, "left_anti")

    if not hot.limit(1).count():
        return gone(probes, lives)
    if hot_lives.limit(broadcast_rows + 1).count() <= broadcast_rows:
        hot_lives = F.broadcast(hot_lives)
    return gone(probes.join(hot, names, "left_anti"), lives).unionByName(gone(probes.join(hot, names, "left_semi"), hot_lives))


def orphan_references(refs: DataFrame, entities: DataFrame, heavy: int = HEAVY, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(reference_id, repository_id, ref_kind, month, via): resolved references without a living target.

    A reference points by target_symbol_id, or, where that is null or blank, by its repository_id and
    target_qualified_name; it is an orphan if no such entity lives at its indexed_at. An entity lives from its earliest
    indexed_at until before its deleted_at (the latest, null: for ever). Statuses other than resolved are left out.
    Ids compare trimmed and in lower case, names trimmed; blank is null. A reference with neither id nor name, or
    without a time, has no living target. Repeated references count once. Without entities all are orphans.
    """
    asked = refs.where(F.lower(F.trim("status")) == "resolved").select(
        norm_id("reference_id").alias("reference_id"),
        norm_id("repository_id").alias("repository_id"),
        F.lower(F.trim("ref_kind")).alias("ref_kind"),
        norm_id("target_symbol_id").alias("k_id"),
        norm_name("target_qualified_name").alias("k_name"),
        F.col("indexed_at").cast("timestamp_ntz").alias("at"),
    )
    by_id = asked.where("k_id is not null")
    by_name = asked.where("k_id is null")
    id_probes = by_id.where("at is not null").select(F.col("k_id").alias("k0"), "at").distinct()
    name_probes = by_name.where("at is not null and repository_id is not null and k_name is not null").select(F.col("repository_id").alias("k0"), F.col("k_name").alias("k1"), "at").distinct()
    gone_id = missing(id_probes, lifetimes(entities, [norm_id("entity_id")], "indexed_at", "deleted_at"), ["k0"], heavy, broadcast_rows)
    gone_name = missing(name_probes, lifetimes(entities, [norm_id("repository_id"), norm_name("qualified_name")], "indexed_at", "deleted_at"), ["k0", "k1"], heavy, broadcast_rows)
    a = by_id.join(gone_id.withColumnRenamed("k0", "k_id"), ["k_id", "at"], "left_semi").withColumn("via", F.lit("id"))
    b = by_name.join(gone_name.withColumnsRenamed({"k0": "repository_id", "k1": "k_name"}), ["repository_id", "k_name", "at"], "left_semi").withColumn("via", F.lit("name"))
    c = asked.where("at is null or (k_id is null and (repository_id is null or k_name is null))").withColumn("via", F.lit("none"))
    every = a.unionByName(b).unionByName(c)
    return (
        every.where("reference_id is not null")
        .groupBy("reference_id")
        .agg(F.min(F.struct("repository_id", "ref_kind", F.date_format("at", "yyyy-MM").alias("month"), "via")).alias("r"))
        .select("reference_id", "r.*")
    )


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """(repository_id, ref_kind, month, n_orphans) of orphan_references()."""
    return orphans.groupBy("repository_id", "ref_kind", "month").agg(F.count("*").alias("n_orphans"))
