"""Queries of the general data problems, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.keys import norm_name
from lodestone.operators.hierarchy import all_descendants, cycles, descendants, hierarchy
from lodestone.operators.orphans import orphan_counts, orphan_references
from lodestone.operators.snapshots import snapshot_changes
from lodestone.session import table


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "ir_entities"), "entity_id", "parent_id", "name")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return cycles(table(spark, d, "ir_entities"), "entity_id", "parent_id").select(F.col("node_id").alias("entity_id"), "cycle_id")


def _named(spark: SparkSession, d: str, n_descendants: Column) -> DataFrame:
    e = table(spark, d, "ir_entities")
    names = (
        e.select(F.nullif(F.lower(F.trim("entity_id")), F.lit("")).alias("node_id"), norm_name("qualified_name").alias("qualified_name"))
        .groupBy("node_id")
        .agg(F.min("qualified_name").alias("qualified_name"))
    )
    p = _placed(spark, d).join(names, "node_id", "left")
    return p.select(
        F.col("node_id").alias("entity_id"), "root_id", "depth", "path", F.concat_ws("/", "path_ids").alias("id_path"), "cycle_id", "status",
        n_descendants.alias("n_descendants"),
        (F.col("path") == F.col("qualified_name")).alias("path_is_qualified_name"),
    )


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """n_descendants is null on and below circles, as in its SQL; p1_hierarchy_all has it for every row."""
    return _named(spark, d, F.when(F.col("root_id").isNotNull(), F.col("n_descendants")))


def p1_hierarchy_all(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d, F.col("n_descendants"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Pairs below roots only, as in its SQL; p1_descendants_all has every pair."""
    return descendants(_placed(spark, d))


def p1_descendants_all(spark: SparkSession, d: str) -> DataFrame:
    return all_descendants(_placed(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(table(spark, d, "code_refs"), table(spark, d, "ir_entities")).select("reference_id")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(orphan_references(table(spark, d, "code_refs"), table(spark, d, "ir_entities")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "file_snapshots"), table(spark, d, "snapshot_deliveries")).select("repository_id", "snapshot_no", "path", "change_type")


def p7_changed_files(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "file_snapshots"), table(spark, d, "snapshot_deliveries"))


_LINKS = """
WITH RECURSIVE e AS (
  SELECT nullif(lower(trim(entity_id)), '') AS id, min(nullif(lower(trim(parent_id)), '')) AS raw_parent, min(trim(name)) AS name,
         min(nullif(trim(qualified_name), '')) AS qualified_name
  FROM ir_entities WHERE nullif(lower(trim(entity_id)), '') IS NOT NULL GROUP BY 1),
n AS (SELECT e.*, p.id AS parent FROM e LEFT JOIN (SELECT id FROM e) p ON e.raw_parent = p.id),
up AS (
  SELECT id, parent AS cur, id AS low, 1 AS steps FROM n WHERE parent IS NOT NULL
  UNION ALL
  SELECT u.id, n.parent, least(u.low, u.cur), u.steps + 1 FROM up u JOIN n ON n.id = u.cur
  WHERE u.cur <> u.id AND n.parent IS NOT NULL AND u.steps < 500),
cyc AS (SELECT id AS entity_id, low AS cycle_id FROM up WHERE cur = id),
down AS (
  SELECT id, id AS root_id, 0 AS depth, coalesce(name, '') AS path, id AS id_path, raw_parent IS NOT NULL AS dangling FROM n WHERE parent IS NULL
  UNION ALL
  SELECT n.id, d.root_id, d.depth + 1, d.path || '.' || coalesce(n.name, ''), d.id_path || '/' || n.id, false FROM down d JOIN n ON n.parent = d.id),
pairs AS (
  SELECT a AS ancestor_id, id AS descendant_id, CAST(depth - (i - 1) AS INTEGER) AS distance
  FROM (SELECT id, depth, unnest(string_split(id_path, '/')) AS a, unnest(range(1, depth + 2)) AS i FROM down) WHERE a <> id)
"""

_ORPHANS = """
WITH ent AS (
  SELECT nullif(lower(trim(entity_id)), '') AS id, nullif(lower(trim(repository_id)), '') AS repo, nullif(trim(qualified_name), '') AS qn,
         min(indexed_at) AS since, CASE WHEN count(*) > count(deleted_at) THEN NULL ELSE max(deleted_at) END AS until
  FROM ir_entities GROUP BY 1, 2, 3),
ref AS (
  SELECT DISTINCT nullif(lower(trim(reference_id)), '') AS reference_id, nullif(lower(trim(repository_id)), '') AS repo, lower(trim(ref_kind)) AS ref_kind,
         nullif(lower(trim(target_symbol_id)), '') AS tid, nullif(trim(target_qualified_name), '') AS tqn, indexed_at AS t
  FROM code_refs WHERE lower(trim(status)) = 'resolved'),
orphan AS (
  SELECT * FROM ref WHERE NOT CASE WHEN tid IS NOT NULL
    THEN EXISTS (SELECT 1 FROM ent WHERE ent.id = ref.tid AND ent.since <= ref.t AND (ent.until IS NULL OR ent.until > ref.t))
    ELSE EXISTS (SELECT 1 FROM ent WHERE ent.repo = ref.repo AND ent.qn = ref.tqn AND ent.since <= ref.t AND (ent.until IS NULL OR ent.until > ref.t)) END)
"""

_CHANGES = """
WITH d AS (
  SELECT *, lead(snapshot_no) OVER (PARTITION BY repository_id ORDER BY snapshot_no) AS nxt
  FROM (SELECT DISTINCT lower(trim(repository_id)) AS repository_id, snapshot_no FROM snapshot_deliveries)),
s AS (
  SELECT lower(trim(repository_id)) AS repository_id, snapshot_no, regexp_replace(replace(trim(path), chr(92), '/'), '^(\\./+)+', '') AS path,
         max(regexp_replace(lower(trim(content_hash)), '^[a-z0-9_-]+[:=]\\s*', '')) AS hash
  FROM file_snapshots GROUP BY 1, 2, 3),
a AS (SELECT s.*, d.nxt FROM s JOIN d USING (repository_id, snapshot_no) WHERE d.nxt IS NOT NULL),
b AS (SELECT s.*, d.snapshot_no AS prev FROM s JOIN d ON d.repository_id = s.repository_id AND d.nxt = s.snapshot_no),
c AS (
  SELECT coalesce(a.repository_id, b.repository_id) AS repository_id, coalesce(a.nxt, b.snapshot_no) AS snapshot_no, coalesce(a.path, b.path) AS path,
         CASE WHEN a.path IS NULL THEN 'ADDED' WHEN b.path IS NULL THEN 'DELETED' WHEN a.hash IS DISTINCT FROM b.hash THEN 'MODIFIED' END AS change_type,
         a.hash AS old_hash, b.hash AS new_hash
  FROM a FULL JOIN b ON a.repository_id = b.repository_id AND a.path = b.path AND a.nxt = b.snapshot_no)
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_hierarchy_all, p1_descendants, p1_descendants_all, p5_found, p5_report, p7_found, p7_changed_files)}

SQL = {
    "p1_found": _LINKS + "SELECT entity_id, cycle_id FROM cyc",
    "p1_hierarchy": _LINKS
    + """, below AS (SELECT ancestor_id AS id, count(*) AS c FROM pairs GROUP BY 1)
SELECT n.id AS entity_id, d.root_id, CAST(d.depth AS INTEGER) AS depth, d.path, coalesce(d.id_path, '') AS id_path, c.cycle_id,
  CASE WHEN d.dangling THEN 'dangling' WHEN d.id IS NOT NULL THEN 'rooted' WHEN c.entity_id IS NOT NULL THEN 'cycle' ELSE 'into_cycle' END AS status,
  CASE WHEN d.id IS NOT NULL THEN coalesce(below.c, 0) END AS n_descendants, d.path = n.qualified_name AS path_is_qualified_name
FROM n LEFT JOIN down d ON d.id = n.id LEFT JOIN cyc c ON c.entity_id = n.id LEFT JOIN below ON below.id = n.id""",
    "p1_descendants": _LINKS + "SELECT * FROM pairs",
    "p5_found": _ORPHANS + "SELECT DISTINCT reference_id FROM orphan",
    "p5_report": _ORPHANS + "SELECT repo AS repository_id, ref_kind, strftime(t, '%Y-%m') AS month, count(DISTINCT reference_id) AS n_orphans FROM orphan GROUP BY 1, 2, 3",
    "p7_found": _CHANGES + "SELECT repository_id, snapshot_no, path, change_type FROM c WHERE change_type IS NOT NULL",
    "p7_changed_files": _CHANGES + "SELECT * FROM c WHERE change_type IS NOT NULL",
}
