"""A property graph as two tables, and traversals as frontier joins.

nodes: (node_id, kind, name, qualified_name, file_id, repository_id); edges: (edge_id, source_id, target_id, kind).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.keys import norm_id, norm_name
from lodestone.functions.text import type_names
from lodestone.session import cut_lineage

#: The kinds of edges that carry dependencies, and those that only say where something stands.
DEPENDENCY_KINDS = ("imports", "uses", "calls", "references", "extends", "implements", "typed_as", "reads", "writes", "field_access")
STRUCTURE_KINDS = ("contains", "declares", "exports")
#: The edge kind of each kind of reference.
KIND_OF_REFERENCE = {
    "call": "calls", "import": "imports", "type_usage": "typed_as", "variable_usage": "uses", "field_access": "field_access", "instantiation": "uses",
    "extends": "extends", "implements": "implements", "override": "overrides",
}


def entity_nodes(entities: DataFrame) -> DataFrame:
    """One node per entity id; of repeated rows the first in order of all columns holds."""
    cols = {"kind": F.lower(F.trim("kind")), "name": norm_name("name"), "qualified_name": norm_name("qualified_name"), "file_id": norm_id("file_id"), "repository_id": norm_id("repository_id"), "parent_id": norm_id("parent_id"), "language": F.lower(F.trim("language"))}
    rows = entities.select(norm_id("entity_id").alias("node_id"), F.struct(*[c.alias(n) for n, c in cols.items()]).alias("r")).where("node_id is not null")
    return rows.groupBy("node_id").agg(F.min("r").alias("r")).select("node_id", "r.*")


def reference_edges(refs: DataFrame) -> DataFrame:
    """One edge per resolved reference that names both ends; kind by KIND_OF_REFERENCE, references for others."""
    kinds = F.create_map(*[F.lit(x) for p in KIND_OF_REFERENCE.items() for x in p])
    return (
        refs.where(F.lower(F.trim("status")) == "resolved")
        .select(
            norm_id("reference_id").alias("edge_id"), norm_id("source_symbol_id").alias("source_id"), norm_id("target_symbol_id").alias("target_id"),
            F.coalesce(kinds[F.lower(F.trim("ref_kind"))], F.lit("references")).alias("kind"),
        )
        .where("edge_id is not null and source_id is not null and target_id is not null")
        .groupBy("edge_id").agg(F.min(F.struct("source_id", "target_id", "kind")).alias("r"))
        .select("edge_id", "r.*")
    )


def classified(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges, in which a call of a class or interface, which makes an object, is a use."""
    kinds = nodes.select(F.col("node_id").alias("target_id"), F.col("kind").alias("target_kind"))
    kind = F.when((F.col("kind") == "calls") & F.col("target_kind").isin("class", "interface"), "uses").otherwise(F.col("kind"))
    return edges.join(kinds, "target_id", "left").withColumn("kind", kind).select(edges.columns)


TYPE_CONFIDENCE = 0.9


def type_edges(typed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, source_id, target_id, kind, confidence): uses edges from what has a type to the types that are nodes.

    typed: (source_id, repository_id, type_text). Of the nodes of the repository with a part's qualified name, else its
    name, the smallest id holds; a type that names its own source gives no edge. Null and blank types name nothing.
    """
    parts = typed.select("source_id", "repository_id", F.explode(type_names("type_text")).alias("t")).distinct()
    types = nodes.where(F.col("kind").isin("class", "interface"))
    keys = F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("qualified_name").alias("t")), F.struct(F.lit(1).alias("way"), F.col("name").alias("t")))).alias("k")
    named = types.select("node_id", "repository_id", keys).select("node_id", "repository_id", "k.*").where("t is not null").groupBy("repository_id", "t", "way").agg(F.min("node_id").alias("node_id"))
    hit = parts.join(named, ["repository_id", "t"]).groupBy("source_id", "t").agg(F.min(F.struct("way", "node_id")).alias("m")).select("source_id", F.col("m.node_id").alias("target_id")).where("source_id <> target_id").distinct()
    return hit.select(F.concat_ws(":", "source_id", F.lit("type"), "target_id").alias("edge_id"), "source_id", "target_id", F.lit("uses").alias("kind"), F.lit(TYPE_CONFIDENCE).alias("confidence"))


def ordered_paths(paths: DataFrame) -> DataFrame:
    """paths of simple_paths() with their place under each root: by depth, target and the way itself."""
    w = Window.partitionBy("root_id").orderBy("depth", "node_id", "path")
    return paths.withColumn("place", F.row_number().over(w))


def require_nodes(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """roots (node_id); an error that names up to ten of them that are no nodes."""
    lost = [r["node_id"] for r in roots.join(nodes.select("node_id"), "node_id", "left_anti").orderBy("node_id").limit(10).collect()]
    if lost:
        raise KeyError(f"no such nodes: {', '.join(map(str, lost))}")
    return roots


def containment_edges(nodes: DataFrame) -> DataFrame:
    """declares edges from a parent to each of its children."""
    return nodes.where("parent_id is not null").select(F.concat_ws(">", "parent_id", "node_id").alias("edge_id"), F.col("parent_id").alias("source_id"), F.col("node_id").alias("target_id"), F.lit("declares").alias("kind"))


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, missing): edges with an end that is no node: source, target or both."""
    known = nodes.select(F.col("node_id").alias("k"), F.lit(True).alias("known"))
    s = edges.join(known, edges["source_id"] == F.col("k"), "left").select("edge_id", "target_id", F.col("known").alias("has_source"))
    t = s.join(known, F.col("target_id") == F.col("k"), "left").select("edge_id", "has_source", F.col("known").alias("has_target"))
    return t.where("has_source is null or has_target is null").select(
        "edge_id", F.when(F.col("has_source").isNull() & F.col("has_target").isNull(), "both").when(F.col("has_source").isNull(), "source").otherwise("target").alias("missing")
    )


def sound_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes."""
    n = nodes.select("node_id")
    return edges.join(n.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(n.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi").select(edges.columns)


def _steps(edges: DataFrame, direction: str, kinds: Sequence[str] | None) -> DataFrame:
    """(at, to, kind) in the direction of travel: out, in or both."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"unknown direction {direction}")
    e = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    out = e.select(F.col("source_id").alias("at"), F.col("target_id").alias("to"), "kind")
    back = e.select(F.col("target_id").alias("at"), F.col("source_id").alias("to"), "kind")
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


def neighbours(edges: DataFrame, direction: str = "out", kinds: Sequence[str] | None = None) -> DataFrame:
    """(node_id, neighbour_id, n_edges): distinct neighbours."""
    return _steps(edges, direction, kinds).groupBy(F.col("at").alias("node_id"), F.col("to").alias("neighbour_id")).agg(F.count("*").alias("n_edges"))


def traverse(edges: DataFrame, roots: DataFrame, direction: str = "out", kinds: Sequence[str] | None = None, max_depth: int | None = 1) -> DataFrame:
    """(root_id, node_id, depth): what each root reaches, at its least depth; the root itself is left out.

    Breadth first for all roots at once: the frontier joins the distinct steps, and what was seen is taken off. Each
    level is written once, so its lineage stays short. max_depth None goes on until nothing new is found. Circles end
    where they began. Roots without edges reach nothing.
    """
    steps = cut_lineage(_steps(edges, direction, kinds).select("at", "to").distinct())
    seen = cut_lineage(roots.select(F.col("node_id").alias("root_id"), "node_id").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = frontier.join(steps, frontier["node_id"] == steps["at"]).select("root_id", F.col("to").alias("node_id")).distinct()
        frontier = cut_lineage(reached.join(seen.select("root_id", "node_id"), ["root_id", "node_id"], "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def simple_paths(edges: DataFrame, roots: DataFrame, direction: str = "in", kinds: Sequence[str] | None = DEPENDENCY_KINDS, max_depth: int = 3) -> DataFrame:
    """(root_id, node_id, depth, path, kinds): every path without a repeated node, up to max_depth edges.

    Parallel edges are one step with all their kinds. The number of paths grows with the power of the depth.
    """
    steps = _steps(edges, direction, kinds).groupBy("at", "to").agg(F.array_sort(F.collect_set("kind")).alias("k"))
    at = roots.select(F.col("node_id").alias("root_id"), "node_id", F.array("node_id").alias("path"), F.array().cast("array<string>").alias("kinds")).distinct()
    out = None
    for depth in range(1, max_depth + 1):
        at = at.join(steps, F.col("node_id") == F.col("at")).where(~F.array_contains("path", F.col("to"))).select(
            "root_id", F.col("to").alias("node_id"), F.concat("path", F.array("to")).alias("path"), F.array_sort(F.array_union("kinds", "k")).alias("kinds")
        )
        at = cut_lineage(at)
        level = at.withColumn("depth", F.lit(depth))
        out = level if out is None else out.unionByName(level)
    return out if out is not None else at.withColumn("depth", F.lit(0)).where(F.lit(False))


def impact(edges: DataFrame, roots: DataFrame, max_depth: int = 3, kinds: Sequence[str] = DEPENDENCY_KINDS) -> DataFrame:
    """(root_id, node_id, min_depth, n_paths, kinds, impact_score): what depends on each root, by its simple paths."""
    p = simple_paths(edges, roots, "in", kinds, max_depth)
    return p.groupBy("root_id", "node_id").agg(
        F.min("depth").alias("min_depth"), F.count("*").alias("n_paths"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"), F.round(1 / F.min("depth"), 6).alias("impact_score")
    )


def invalidated(impacted: DataFrame) -> DataFrame:
    """(node_id, min_depth, n_roots): over all changed roots, without the roots themselves. impacted: (root_id, node_id, min_depth)."""
    roots = impacted.select(F.col("root_id").alias("node_id")).distinct()
    return impacted.groupBy("node_id").agg(F.min("min_depth").alias("min_depth"), F.count_distinct("root_id").alias("n_roots")).join(roots, "node_id", "left_anti")


def induced(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(root_id, edge_id): the edges with both ends among a root and what it reaches."""
    inside = reached.select("root_id", "node_id").unionByName(reached.select("root_id", F.col("root_id").alias("node_id"))).distinct()
    a = edges.select("edge_id", "source_id", "target_id").join(inside.withColumnRenamed("node_id", "source_id"), "source_id")
    return a.join(inside.withColumnRenamed("node_id", "target_id"), ["root_id", "target_id"], "left_semi").select("root_id", "edge_id").distinct()


GRAM = 3
SEARCH_BROADCAST = 200_000


def symbol_search(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, node_id, kind): nodes whose name or qualified name holds the query's text, letter case ignored.

    queries: (query_id, text). A text is looked up by one of its trigrams, the first; a node by all that its names hold,
    so no query meets every node; texts of fewer signs by themselves as whole grams. Null and blank texts find nothing.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))

    def grams(c: Column, n: int) -> Column:
        return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    asked = queries.select("query_id", F.lower(F.trim("text")).alias("q")).where("q <> ''").withColumn("gram", F.substring("q", 1, GRAM))
    if asked.limit(SEARCH_BROADCAST + 1).count() <= SEARCH_BROADCAST:
        asked = F.broadcast(asked)
    each = F.array_distinct(F.concat(*[grams(F.col(c), n) for c in ("a", "b") for n in range(1, GRAM + 1)]))
    held = nodes.select("node_id", "kind", low("name").alias("a"), low("qualified_name").alias("b")).select("*", F.explode(each).alias("gram"))
    return held.join(asked, "gram").where("contains(a, q) or contains(b, q)").select("query_id", "node_id", "kind").distinct()


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges left after nodes are removed."""
    g = gone.select("node_id")
    return edges.join(g.withColumnRenamed("node_id", "source_id"), "source_id", "left_anti").join(g.withColumnRenamed("node_id", "target_id"), "target_id", "left_anti").select(edges.columns)
