"""What changed between full snapshots.

Every key is windowed by snapshot index: the lagged hash reveals changes, a gap in the index a removal and a later
addition. A key's window holds one row a snapshot, as repeats are aggregated away before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.keys import norm_hash, norm_id, norm_path


def snapshot_changes(listings: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(repository_id, snapshot_no, path, change_type, old_hash, new_hash) between consecutive listings.

    deliveries says which listings exist; rows of others are left out, and a delivered listing without rows is empty.
    ADDED, DELETED or MODIFIED carry the number of the later listing; the first listing of a repository changes
    nothing. Paths compare with / and without leading ./, hashes by their lower-case hex digits; a null hash differs
    from every hash but not from null. Repeated rows of a listing count once; where their hashes differ the greatest
    holds, nulls last. Rows with a null repository, number or path are no cases; empty tables give no rows.
    """
    w = Window.partitionBy("repository_id").orderBy("snapshot_no")
    known = (
        deliveries.select(norm_id("repository_id").alias("repository_id"), "snapshot_no")
        .where("repository_id is not null and snapshot_no is not null")
        .distinct()
        .select("*", F.lag("snapshot_no").over(w).alias("before_no"), F.lead("snapshot_no").over(w).alias("after_no"))
    )
    rows = (
        listings.select(norm_id("repository_id").alias("repository_id"), "snapshot_no", norm_path("path").alias("path"), norm_hash("content_hash").alias("hash"))
        .where("repository_id is not null and snapshot_no is not null and path is not null")
        .groupBy("repository_id", "path", "snapshot_no")
        .agg(F.max("hash").alias("hash"))
        .join(known, ["repository_id", "snapshot_no"])
    )
    k = Window.partitionBy("repository_id", "path").orderBy("snapshot_no")
    seen = rows.select(
        "*",
        F.lag("snapshot_no").over(k).eqNullSafe(F.col("before_no")).alias("was_there"),
        F.lead("snapshot_no").over(k).eqNullSafe(F.col("after_no")).alias("stays"),
        F.lag("hash").over(k).alias("old"),
    )
    arrived = F.when(F.col("before_no").isNull(), None).when(~F.col("was_there"), "ADDED").when(~F.col("old").eqNullSafe(F.col("hash")), "MODIFIED")
    left = F.when(F.col("after_no").isNotNull() & ~F.col("stays"), "DELETED")
    event = F.array(
        F.struct(F.col("snapshot_no").alias("no"), arrived.alias("change_type"), F.when(F.col("was_there"), F.col("old")).alias("old_hash"), F.col("hash").alias("new_hash")),
        F.struct(F.col("after_no").alias("no"), left.alias("change_type"), F.col("hash").alias("old_hash"), F.lit(None).cast("string").alias("new_hash")),
    )
    return (
        seen.select("repository_id", "path", F.explode(F.filter(event, lambda e: e["change_type"].isNotNull())).alias("e"))
        .select("repository_id", F.col("e.no").alias("snapshot_no"), "path", F.col("e.change_type").alias("change_type"), F.col("e.old_hash").alias("old_hash"), F.col("e.new_hash").alias("new_hash"))
    )
