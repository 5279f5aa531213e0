"""Queries on the code graph: neighbours, traversals, impact, integrity and reference resolution.

Searches start from every entity whose id, read as a hexadecimal number, is divisible by 100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.keys import norm_id
from lodestone.operators import graph, records, resolve
from lodestone.session import cut_lineage, table


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.entity_nodes(table(spark, d, "ir_entities"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.reference_edges(table(spark, d, "code_refs"))


def _sound(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(graph.sound_edges(_edges(spark, d), _nodes(spark, d)))


def _is_root() -> Column:
    return F.conv("node_id", 16, 10).cast("decimal(20,0)") % 100 == 0


def _roots(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).where(_is_root()).select("node_id")


def graph_kinds(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d).groupBy("kind").agg(F.count("*").alias("n")).withColumn("table", F.lit("nodes"))
    e = _edges(spark, d).groupBy("kind").agg(F.count("*").alias("n")).withColumn("table", F.lit("edges"))
    return n.unionByName(e)


def graph_dangling(spark: SparkSession, d: str) -> DataFrame:
    return graph.dangling_edges(_edges(spark, d), _nodes(spark, d))


def graph_containment(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return graph.sound_edges(graph.containment_edges(n), n).select("source_id", "target_id")


def graph_callers(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_sound(spark, d), "in", ["calls"])


def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_sound(spark, d), "both")


def graph_traverse(spark: SparkSession, d: str) -> DataFrame:
    return graph.traverse(_sound(spark, d), _roots(spark, d), "out", None, 3)


def graph_dependents(spark: SparkSession, d: str) -> DataFrame:
    return graph.traverse(_sound(spark, d), _roots(spark, d), "in", graph.DEPENDENCY_KINDS, None)


def graph_impact(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact(_sound(spark, d), _roots(spark, d), 3).withColumn("kinds", F.concat_ws("+", "kinds"))


def graph_invalidated(spark: SparkSession, d: str) -> DataFrame:
    return graph.invalidated(graph.traverse(_sound(spark, d), _roots(spark, d), "in", graph.DEPENDENCY_KINDS, 3).withColumnRenamed("depth", "min_depth"))


def graph_subgraph(spark: SparkSession, d: str) -> DataFrame:
    e = _sound(spark, d)
    return graph.induced(e, graph.traverse(e, _roots(spark, d), "out", None, 2))


def graph_without_roots(spark: SparkSession, d: str) -> DataFrame:
    return graph.without_nodes(_edges(spark, d), _roots(spark, d))


def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    """Every root's name, looked for in all names and qualified names, letter case ignored."""
    n = _nodes(spark, d)
    asked = n.join(_roots(spark, d), "node_id", "left_semi").select(F.col("node_id").alias("query_id"), F.col("name").alias("text"))
    return graph.symbol_search(n, asked)


def graph_classified(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    e = graph.classified(_sound(spark, d), n)
    return e.join(n.select(F.col("node_id").alias("target_id"), F.col("kind").alias("target_kind")), "target_id").groupBy("kind", "target_kind").agg(F.count("*").alias("n"))


def file_symbols(spark: SparkSession, d: str) -> DataFrame:
    return records.file_symbols(_nodes(spark, d)).select("file_id", F.concat_ws("|", "symbols").alias("symbols"), F.size("symbols").cast("bigint").alias("n"))


def nodes_in_order(spark: SparkSession, d: str) -> DataFrame:
    return records.in_order(_nodes(spark, d), ["repository_id"]).select("repository_id", "node_id", "place")


def repositories_listed(spark: SparkSession, d: str) -> DataFrame:
    return records.listed(table(spark, d, "repositories").withColumn("repository_id", norm_id("repository_id")), "created_at", "repository_id").select("repository_id", "name", "status", "place")


def references_resolved(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve(table(spark, d, "code_refs"), _nodes(spark, d))


def imports_resolved(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_imports(table(spark, d, "code_refs"), _nodes(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        graph_kinds, graph_dangling, graph_containment, graph_callers, graph_neighbours, graph_traverse, graph_dependents, graph_impact, graph_invalidated, graph_subgraph,
        graph_without_roots, graph_classified, file_symbols, nodes_in_order, repositories_listed, symbol_search, references_resolved, imports_resolved,
    )
}

_GRAPH = """
WITH RECURSIVE n AS (
  SELECT id AS node_id, min({'kind': kind, 'name': name, 'qualified_name': qn, 'file_id': file_id, 'repository_id': repo, 'parent_id': pid, 'language': lang}) AS r
  FROM (SELECT nullif(lower(trim(entity_id)), '') AS id, lower(trim(kind)) AS kind, nullif(trim(name), '') AS name, nullif(trim(qualified_name), '') AS qn, nullif(lower(trim(file_id)), '') AS file_id,
          nullif(lower(trim(repository_id)), '') AS repo, nullif(lower(trim(parent_id)), '') AS pid, lower(trim(language)) AS lang FROM ir_entities)
  WHERE id IS NOT NULL GROUP BY 1),
nodes AS (SELECT node_id, r.kind AS kind, r.name AS name, r.qualified_name AS qualified_name, r.file_id AS file_id, r.repository_id AS repository_id, r.parent_id AS parent_id, r.language AS language FROM n),
edges AS (
  SELECT DISTINCT lower(trim(reference_id)) AS edge_id, lower(trim(source_symbol_id)) AS source_id, lower(trim(target_symbol_id)) AS target_id,
    CASE lower(trim(ref_kind)) WHEN 'call' THEN 'calls' WHEN 'import' THEN 'imports' WHEN 'type_usage' THEN 'typed_as' WHEN 'variable_usage' THEN 'uses' WHEN 'field_access' THEN 'field_access'
      WHEN 'instantiation' THEN 'uses' WHEN 'extends' THEN 'extends' WHEN 'implements' THEN 'implements' WHEN 'override' THEN 'overrides' ELSE 'references' END AS kind
  FROM code_refs WHERE lower(trim(status)) = 'resolved' AND nullif(trim(source_symbol_id), '') IS NOT NULL AND nullif(trim(target_symbol_id), '') IS NOT NULL),
sound AS (SELECT * FROM edges WHERE source_id IN (SELECT node_id FROM nodes) AND target_id IN (SELECT node_id FROM nodes)),
roots AS (SELECT node_id FROM nodes WHERE ('0x' || node_id)::UBIGINT % 100 = 0),
dep AS (SELECT source_id, target_id, list_sort(list(DISTINCT kind)) AS k FROM sound WHERE kind NOT IN ('overrides', 'declares') GROUP BY 1, 2)
"""


def _walk(step: str, depth: str, name: str = "walk") -> str:
    return f""", {name} AS (
  SELECT node_id AS root_id, node_id, 0 AS depth FROM roots
  UNION
  SELECT w.root_id, s.t, w.depth + 1 FROM {name} w JOIN ({step}) s ON s.f = w.node_id WHERE w.depth < {depth})"""


_PATHS = """, paths AS (
  SELECT node_id AS root_id, node_id, 0 AS depth, [node_id] AS path, []::VARCHAR[] AS kinds FROM roots
  UNION ALL
  SELECT p.root_id, d.source_id, p.depth + 1, list_append(p.path, d.source_id), list_concat(p.kinds, d.k) FROM paths p JOIN dep d ON d.target_id = p.node_id
  WHERE p.depth < 3 AND NOT list_contains(p.path, d.source_id)),
imp AS (SELECT root_id, node_id, min(depth) AS min_depth, count(*) AS n_paths, array_to_string(list_sort(list_distinct(flatten(list(kinds)))), '+') AS kinds, round(1.0::DOUBLE / min(depth), 6) AS impact_score
  FROM paths WHERE depth > 0 GROUP BY 1, 2)"""

_OUT = "SELECT DISTINCT source_id AS f, target_id AS t FROM sound"

_RESOLVE = (
    _GRAPH
    + """, sym AS (SELECT x.node_id AS symbol_id, x.repository_id, x.file_id, x.kind, x.name, x.qualified_name, p.name AS owner FROM nodes x LEFT JOIN nodes p ON p.node_id = x.parent_id
  WHERE x.kind IN ('class', 'interface', 'function', 'method', 'variable')),
lang AS (SELECT file_id, min(language) AS language FROM nodes WHERE file_id IS NOT NULL GROUP BY 1),
al AS (SELECT lower(trim(source_file_id)) AS file_id, list_last(string_split(trim(target_qualified_name), '.')) AS alias, arg_max(trim(target_qualified_name), lower(trim(reference_id))) AS expanded
  FROM code_refs WHERE lower(trim(ref_kind)) = 'import' AND nullif(trim(target_qualified_name), '') IS NOT NULL GROUP BY 1, 2),
ref AS (SELECT DISTINCT lower(trim(reference_id)) AS reference_id, lower(trim(repository_id)) AS repo, lower(trim(source_file_id)) AS file_id, lower(trim(ref_kind)) AS kind, trim(target_qualified_name) AS target,
    nullif(lower(trim(target_symbol_id)), '') AS preset, string_split(trim(target_qualified_name), '.') AS parts FROM code_refs WHERE lower(trim(ref_kind)) <> 'import' AND nullif(trim(target_qualified_name), '') IS NOT NULL),
r AS (SELECT ref.*, parts[-1] AS simple, CASE WHEN len(parts) > 1 THEN parts[-2] END AS type_name, language,
    CASE kind WHEN 'extends' THEN 'class' WHEN 'implements' THEN 'interface' WHEN 'call' THEN 'method' WHEN 'type_usage' THEN 'class' END AS hint,
    al.expanded || CASE WHEN len(parts) > 1 THEN '.' || array_to_string(parts[2:], '.') ELSE '' END AS expanded
  FROM ref LEFT JOIN lang ON lang.file_id = ref.file_id LEFT JOIN al ON al.file_id = ref.file_id AND al.alias = parts[1]),
hit AS (
  SELECT reference_id, 1 AS o, symbol_id FROM r JOIN sym s ON s.repository_id = repo AND s.symbol_id = preset
  UNION SELECT reference_id, 3, symbol_id FROM r JOIN sym s ON s.repository_id = repo AND s.qualified_name = target
  UNION SELECT reference_id, 4, symbol_id FROM r JOIN sym s ON s.repository_id = repo AND s.qualified_name = expanded
  UNION SELECT reference_id, 5, symbol_id FROM r JOIN sym s ON s.repository_id = repo AND s.owner = type_name AND s.name = simple AND s.kind IN ('method', 'function')
  UNION SELECT reference_id, 6, symbol_id FROM r JOIN sym s ON s.file_id = r.file_id AND s.name = simple AND (hint IS NULL OR s.kind = hint)
  UNION SELECT reference_id, 7, symbol_id FROM r JOIN sym s ON s.repository_id = repo AND s.name = simple AND (hint IS NULL OR s.kind = hint)
  UNION SELECT reference_id, 8, symbol_id FROM r JOIN sym s ON s.repository_id = repo AND ends_with(lower(s.qualified_name), lower(simple)) AND (hint IS NULL OR s.kind = hint)
  UNION SELECT reference_id, 2, NULL FROM r WHERE BUILTIN),
best AS (SELECT reference_id, min(o) AS o FROM hit GROUP BY 1),
res AS (SELECT r.reference_id, best.o, count(hit.symbol_id) AS n, min(hit.symbol_id) AS symbol_id FROM r LEFT JOIN best USING (reference_id) LEFT JOIN hit ON hit.reference_id = r.reference_id AND hit.o = best.o GROUP BY 1, 2)
SELECT reference_id, CASE o WHEN 1 THEN 'preset' WHEN 2 THEN 'builtin' WHEN 3 THEN 'exact' WHEN 4 THEN 'alias' WHEN 5 THEN 'method' WHEN 6 THEN 'file' WHEN 7 THEN 'repository' WHEN 8 THEN 'suffix' ELSE 'none' END AS step,
  CASE WHEN o = 2 THEN 'BUILTIN' WHEN o IS NULL THEN 'UNRESOLVED' WHEN n = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status, CASE WHEN n = 1 THEN symbol_id END AS symbol_id, n AS n_candidates,
  (CASE WHEN n <> 1 THEN 0 WHEN o IN (1, 3) THEN 1.0 WHEN o = 4 THEN 0.9 WHEN o = 5 THEN 0.85 WHEN o = 6 THEN 0.75 WHEN o = 7 THEN 0.6 ELSE 0.5 END)::DOUBLE AS confidence FROM res"""
).replace("BUILTIN)", " OR ".join(f"(language = '{lang}' AND (target IN ({n}) OR simple IN ({n})))" for lang, n in ((k, ", ".join(f"'{x}'" for x in v)) for k, v in resolve.BUILTINS.items())) + ")", 1)

SQL = {
    "graph_kinds": _GRAPH + "SELECT kind, count(*) AS n, 'nodes' AS \"table\" FROM nodes GROUP BY 1 UNION ALL SELECT kind, count(*), 'edges' FROM edges GROUP BY 1",
    "graph_dangling": _GRAPH
    + """SELECT edge_id, CASE WHEN NOT s AND NOT t THEN 'both' WHEN NOT s THEN 'source' ELSE 'target' END AS missing
FROM (SELECT edge_id, source_id IN (SELECT node_id FROM nodes) AS s, target_id IN (SELECT node_id FROM nodes) AS t FROM edges) WHERE NOT (s AND t)""",
    "graph_containment": _GRAPH + "SELECT a.parent_id AS source_id, a.node_id AS target_id FROM nodes a JOIN nodes b ON a.parent_id = b.node_id",
    "graph_callers": _GRAPH + "SELECT target_id AS node_id, source_id AS neighbour_id, count(*) AS n_edges FROM sound WHERE kind = 'calls' GROUP BY 1, 2",
    "graph_neighbours": _GRAPH
    + "SELECT node_id, neighbour_id, count(*) AS n_edges FROM (SELECT target_id AS node_id, source_id AS neighbour_id FROM sound UNION ALL SELECT source_id, target_id FROM sound) GROUP BY 1, 2",
    "graph_traverse": _GRAPH + _walk(_OUT, "3") + "SELECT root_id, node_id, min(depth) AS depth FROM walk WHERE node_id <> root_id GROUP BY 1, 2",
    "graph_dependents": _GRAPH + _walk("SELECT target_id AS f, source_id AS t FROM dep", "12") + "SELECT root_id, node_id, min(depth) AS depth FROM walk WHERE node_id <> root_id GROUP BY 1, 2",
    "graph_impact": _GRAPH + _PATHS + "SELECT * FROM imp",
    "graph_invalidated": _GRAPH + _PATHS + "SELECT node_id, min(min_depth) AS min_depth, count(DISTINCT root_id) AS n_roots FROM imp WHERE node_id NOT IN (SELECT root_id FROM imp) GROUP BY 1",
    "graph_subgraph": _GRAPH
    + _walk(_OUT, "2")
    + """, ins AS (SELECT DISTINCT root_id, node_id FROM walk WHERE root_id IN (SELECT root_id FROM walk WHERE depth > 0 AND node_id <> root_id))
SELECT DISTINCT a.root_id, e.edge_id FROM sound e JOIN ins a ON a.node_id = e.source_id JOIN ins b ON b.node_id = e.target_id AND b.root_id = a.root_id""",
    "graph_without_roots": _GRAPH + "SELECT edge_id, source_id, target_id, kind FROM edges WHERE source_id NOT IN (SELECT node_id FROM roots) AND target_id NOT IN (SELECT node_id FROM roots)",
    "symbol_search": _GRAPH
    + """, qn AS (SELECT node_id AS query_id, lower(trim(name)) AS q FROM nodes JOIN roots USING (node_id) WHERE trim(name) <> '')
SELECT query_id, node_id, kind FROM nodes JOIN qn ON contains(lower(name), q) OR contains(lower(qualified_name), q)""",
    "graph_classified": _GRAPH
    + """, k AS (SELECT CASE WHEN s.kind = 'calls' AND n.kind IN ('class', 'interface') THEN 'uses' ELSE s.kind END AS kind, n.kind AS target_kind FROM sound s JOIN nodes n ON n.node_id = s.target_id)
SELECT kind, target_kind, count(*) AS n FROM k GROUP BY 1, 2""",
    "file_symbols": _GRAPH + "SELECT file_id, array_to_string(list_sort(list(DISTINCT qualified_name)), '|') AS symbols, count(DISTINCT qualified_name) AS n FROM nodes WHERE file_id IS NOT NULL AND qualified_name IS NOT NULL GROUP BY 1",
    "nodes_in_order": _GRAPH + "SELECT repository_id, node_id, CAST(row_number() OVER (PARTITION BY repository_id ORDER BY kind NULLS FIRST, qualified_name NULLS FIRST, node_id) AS INTEGER) AS place FROM nodes",
    "repositories_listed": """SELECT lower(trim(repository_id)) AS repository_id, name, status, CAST(row_number() OVER (ORDER BY created_at DESC, lower(trim(repository_id))) AS INTEGER) AS place FROM repositories""",

    "references_resolved": _RESOLVE,
    "imports_resolved": _GRAPH
    + """, ref AS (SELECT DISTINCT lower(trim(reference_id)) AS reference_id, lower(trim(repository_id)) AS repo, regexp_replace(trim(target_qualified_name), '\\.\\*$', '') AS target
  FROM code_refs WHERE lower(trim(ref_kind)) = 'import' AND nullif(trim(target_qualified_name), '') IS NOT NULL),
ex AS (SELECT repository_id AS repo, qualified_name AS target, min(node_id) AS symbol_id FROM nodes WHERE qualified_name IS NOT NULL GROUP BY 1, 2),
mem AS (SELECT repository_id AS repo, regexp_extract(qualified_name, '^(.*)\\.[^.]+$', 1) AS target, count(*) AS n_members FROM nodes WHERE qualified_name IS NOT NULL GROUP BY 1, 2),
fst AS (SELECT DISTINCT repository_id AS repo, split_part(qualified_name, '.', 1) AS f FROM nodes WHERE qualified_name IS NOT NULL)
SELECT reference_id, CASE WHEN symbol_id IS NOT NULL THEN 'RESOLVED' WHEN n_members IS NOT NULL THEN 'WILDCARD' WHEN fst.f IS NULL THEN 'EXTERNAL' ELSE 'UNRESOLVED' END AS status, symbol_id, coalesce(n_members, 0) AS n_members
FROM ref LEFT JOIN ex USING (repo, target) LEFT JOIN mem USING (repo, target) LEFT JOIN fst ON fst.repo = ref.repo AND fst.f = split_part(ref.target, '.', 1)""",
}
