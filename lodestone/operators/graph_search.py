"""Answers from the code graph: targets of questions, ranked neighbours, and the context around search results.

Everything is for many questions at once: names become keys that join, traversals are those of ``graph`` for all targets
together, and limits are ranks within a question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import DEPENDENCY_KINDS, STRUCTURE_KINDS, _steps, traverse
from lodestone.session import cut_lineage

IMPACT_DEPTH = 5
#: Scores of the target itself, of what one relation reaches, and of other neighbours.
SELF_SCORE, RELATED_SCORE, NEAR_SCORE = 1.0, 0.9, 0.8
USAGE_KINDS = ("uses", "references", "field_access", "reads", "writes", "typed_as")
#: For each strategy the (direction, edge kinds, relation) that are followed.
STRATEGIES = {
    "CALLERS": (("in", ("calls",), "CALLERS"),),
    "CALLEES": (("out", ("calls",), "CALLS"),),
    "DEPENDENTS": (("in", DEPENDENCY_KINDS, "DEPENDENTS"),),
    "DEPENDENCIES": (("out", DEPENDENCY_KINDS, "DEPENDENCIES"),),
    "IMPLEMENTS": (("in", ("implements",), "IMPLEMENTS"), ("out", ("implements",), "IMPLEMENTS")),
    "EXTENDS": (("in", ("extends",), "EXTENDS"), ("out", ("extends",), "EXTENDS")),
    "IMPORTS": (("out", ("imports",), "IMPORTS"), ("in", ("imports",), "IMPORTS")),
    "USES": (("in", USAGE_KINDS, "USES"), ("out", USAGE_KINDS, "USES")),
    "ARCHITECTURE": (("both", STRUCTURE_KINDS + DEPENDENCY_KINDS, "DEPENDENCIES"),),
    "NEIGHBOURS": (("out", DEPENDENCY_KINDS, "DEPENDENCIES"), ("in", DEPENDENCY_KINDS, "DEPENDENTS")),
}
#: Chunk types of node kinds; all others are file contexts.
CHUNK_TYPES = {"class": "class_context", "interface": "interface_context", "function": "function", "method": "method"}
MAX_TARGETS_BROADCAST = 200_000


def chunk_type(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in CHUNK_TYPES.items() for x in p])[F.lower(kind)], F.lit("file_context"))


def resolve_targets(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, node_id): every node that a target names by id, qualified name, name or the end of its qualified name.

    asked: (query_id, target). Names compare with letter case. A node has one key for each dot or colon in its name, so
    the join is on equal keys. Null and blank targets name nothing.
    """
    ends = F.regexp_extract_all(F.col("qualified_name"), F.lit("(?s)(?<=[.:])(?=(.*))"), 1)  # what follows each dot or colon
    keys = F.array_distinct(F.filter(F.concat(F.array("node_id", "qualified_name", "name"), F.coalesce(ends, F.array().cast("array<string>"))), lambda k: k.isNotNull() & (k != "")))
    named = nodes.select("node_id", F.explode(keys).alias("target"))
    want = asked.select("query_id", F.trim("target").alias("target")).where("target <> ''").distinct()
    if want.limit(MAX_TARGETS_BROADCAST + 1).count() <= MAX_TARGETS_BROADCAST:
        want = F.broadcast(want)
    return named.join(want, "target").select("query_id", "node_id").distinct()


def anchors(results: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, node_id, chunk_id): the nodes that search results stand for.

    results: (query_id, chunk_id, symbol_id, qualified_name, symbol_name). The first that hits: symbol_id, chunk_id as a
    node's id, the qualified name, the name, both without letter case; of several nodes the smallest id. A node that
    several results stand for has the smallest chunk_id.
    """
    low = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    r = results.select("query_id", "chunk_id", F.posexplode(F.array(low("symbol_id"), low("chunk_id"), low("qualified_name"), low("symbol_name"))).alias("way", "key")).where("key is not null")
    keys = F.explode(F.array(*[F.struct(F.lit(w).alias("way"), F.nullif(F.lower(F.trim(F.col(c))), F.lit("")).alias("key")) for w, c in enumerate(("node_id", "node_id", "qualified_name", "name"))])).alias("k")
    n = nodes.select("node_id", keys).select("k.*", "node_id").where("key is not null").groupBy("way", "key").agg(F.min("node_id").alias("node_id"))
    hit = r.join(n, ["way", "key"]).groupBy("query_id", "chunk_id").agg(F.min(F.struct("way", "node_id")).alias("m"))
    return hit.groupBy("query_id", F.col("m.node_id").alias("node_id")).agg(F.min("chunk_id").alias("chunk_id"))


def graph_search(asked: DataFrame, nodes: DataFrame, edges: DataFrame, k: int | None = 10, where: Column | None = None) -> DataFrame:
    """(query_id, node_id, score, depth, relation, direction, rank): what the graph says to each question.

    asked: (query_id, target, relation, direction), one row a target; relation and direction are those of
    questions.understand(): IMPACT, DEPENDENT, DEPENDENCY, IDENTIFIER or an edge kind; null is no graph question. edges:
    both ends must be nodes. IMPACT follows dependencies inbound to depth 5, each step costing a tenth; IDENTIFIER gives
    the target and its neighbours; others the neighbours by the relation. A node reached in several ways keeps the best
    score, the first relation by name at equal ones. Ranked by score, depth, name and id. where filters nodes. k None
    gives all.
    """
    if k is not None and k < 1:
        raise ValueError("k must be positive")
    want = asked.where("relation is not null").select("query_id", "target", "relation", "direction").distinct()
    at = cut_lineage(resolve_targets(want, nodes).join(want.select("query_id", "relation", "direction").distinct(), "query_id"))
    steps = _steps(edges, "out", None).withColumn("way", F.lit("outbound")).unionByName(_steps(edges, "in", None).withColumn("way", F.lit("inbound")))
    follows = (
        F.when(F.col("relation") == "IDENTIFIER", F.lit(True))
        .when(F.col("relation").isin("DEPENDENT", "DEPENDENCY"), F.col("kind").isin(*DEPENDENCY_KINDS) & (F.col("way") == F.col("direction")))
        .otherwise((F.col("kind") == F.col("relation")) & (F.col("way") == F.col("direction")))
    )
    bare = F.col("relation") == "IDENTIFIER"
    near = at.where("relation <> 'IMPACT'").join(steps, at["node_id"] == steps["at"]).where(follows).select(
        "query_id", F.col("to").alias("node_id"), F.when(bare, NEAR_SCORE).otherwise(RELATED_SCORE).alias("score"), F.lit(1).alias("depth"),
        F.when(bare, "NEIGHBOR").otherwise(F.upper("relation")).alias("relation"), F.col("way").alias("direction"),
    )
    own = at.where(bare).select("query_id", "node_id", F.lit(SELF_SCORE).alias("score"), F.lit(0).alias("depth"), F.lit("EXACT_TARGET").alias("relation"), F.lit("self").alias("direction"))
    hit = at.where("relation = 'IMPACT'")
    reached = traverse(edges, hit.select("node_id"), "in", DEPENDENCY_KINDS, IMPACT_DEPTH)
    far = hit.select("query_id", F.col("node_id").alias("root_id")).join(reached, "root_id").select(
        "query_id", "node_id", F.greatest(F.lit(0.1), F.round(1 - F.col("depth") * 0.1, 6)).alias("score"), "depth", F.lit("IMPACT").alias("relation"), F.lit("inbound").alias("direction")
    )
    every = own.unionByName(near).unionByName(far)
    best = every.groupBy("query_id", "node_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "depth", "relation", "direction")).alias("m"))
    kept = nodes if where is None else nodes.where(where)
    named = best.join(kept.select("node_id", F.coalesce("name", F.lit("")).alias("name")), "node_id").select("query_id", "node_id", (-F.col("m.s")).alias("score"), "m.depth", "m.relation", "m.direction", "name")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "depth", "name", "node_id")
    out = named.withColumn("rank", F.row_number().over(w)).drop("name")
    return out if k is None else out.where(F.col("rank") <= k)


def expand(
    starts: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 2, per_node: int = 10, max_candidates: int = 50, same_file: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(candidates, summary): the context around each query's anchors, by its strategy.

    starts: (query_id, node_id, chunk_id, strategy, scope), strategies of STRATEGIES or IMPACT; NONE and others give no rows.
    candidates: (query_id, node_id, anchor_id, relation, depth, path, source, chunk_id, place): a node once a query, by
    the shallowest way, then by the anchor's id, relation and way; never an anchor's own loop. Each node passes on at most
    per_node edges of each spec, in the order of kind, neighbour and edge id. With scope FILE and same_file false only
    neighbours in the node's file count. Of a query the first max_candidates stay, by depth, relation, kind, qualified
    name and id; summary: (query_id, n_anchors, n_found, max_depth, truncated). source tells whether a search result
    stands for the node, too.
    """
    if min(max_depth, 0) < 0 or per_node < 1 or max_candidates < 1:
        raise ValueError("limits must be positive")
    specs = [(s, direction, list(kinds), rel, n) for s, rows in (STRATEGIES | {"IMPACT": (("in", DEPENDENCY_KINDS, "IMPACT"),)}).items() for n, (direction, kinds, rel) in enumerate(rows)]
    plan = F.broadcast(starts.sparkSession.createDataFrame(specs, "strategy string, spec_way string, spec_kinds array<string>, relation string, spec int"))  # some 20 rows
    starts = cut_lineage(starts.select("query_id", "node_id", "chunk_id", F.upper("strategy").alias("strategy"), F.coalesce("scope", F.lit("")).alias("scope")).distinct())
    e = edges.select("edge_id", "source_id", "target_id", "kind")
    both = e.select("edge_id", F.col("source_id").alias("at"), F.col("target_id").alias("to"), "kind", F.lit("out").alias("way")).unionByName(
        e.select("edge_id", F.col("target_id").alias("at"), F.col("source_id").alias("to"), "kind", F.lit("in").alias("way"))
    )
    files = nodes.select("node_id", "file_id")
    both = both.where("at <> to").join(files.select(F.col("node_id").alias("at"), F.col("file_id").alias("at_file")), "at").join(files.select(F.col("node_id").alias("to"), F.col("file_id").alias("to_file")), "to")
    # Which edges a node passes on depends on the spec alone, so the limit is taken once for all queries.
    ways = both.join(plan, (F.col("spec_way") == "both") | (F.col("spec_way") == F.col("way"))).where("array_contains(spec_kinds, kind)")
    w = Window.partitionBy("at", "strategy", "spec").orderBy("kind", "to", "edge_id")
    ways = cut_lineage(ways.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_node).select("at", "strategy", "to", "relation", "spec", "n", "at_file", "to_file"))
    frontier = starts.select("query_id", "strategy", "scope", F.col("node_id").alias("at"), F.col("node_id").alias("anchor_id"), F.array("node_id").alias("path"))
    seen = None
    for depth in range(1, max_depth + 1):
        near = frontier.join(ways, ["at", "strategy"])
        if not same_file:
            near = near.where((F.col("scope") != "FILE") | F.col("at_file").isNull() | F.col("to_file").isNull() | (F.col("at_file") == F.col("to_file")))
        first = near.groupBy("query_id", F.col("to").alias("node_id")).agg(F.min(F.struct("anchor_id", "relation", "path", "spec", "n", "strategy", "scope")).alias("m"))
        if seen is not None:
            first = first.join(seen.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
        level = cut_lineage(first.select("query_id", "node_id", "m.anchor_id", "m.relation", F.lit(depth).alias("depth"), F.concat("m.path", F.array("node_id")).alias("path"), "m.strategy", "m.scope"))
        seen = level if seen is None else seen.unionByName(level)
        frontier = level.select("query_id", "strategy", "scope", F.col("node_id").alias("at"), "anchor_id", "path")
        if not level.limit(1).count():
            break
    if seen is None:
        seen = starts.where(F.lit(False)).select("query_id", "node_id", F.col("node_id").alias("anchor_id"), F.col("scope").alias("relation"), F.lit(0).alias("depth"), F.array("node_id").alias("path"))
    own = starts.select("query_id", "node_id", "chunk_id").distinct()
    named = seen.join(nodes.select("node_id", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("qualified_name", F.lit("")).alias("q")), "node_id").join(own, ["query_id", "node_id"], "left")
    place = Window.partitionBy("query_id").orderBy("depth", "relation", "kind", "q", "node_id")
    ranked = cut_lineage(named.withColumn("place", F.row_number().over(place)))
    counts = ranked.groupBy("query_id").agg(F.count("*").alias("n_found"), F.max("depth").alias("max_depth"))
    summary = own.groupBy("query_id").agg(F.count_distinct("node_id").alias("n_anchors")).join(counts, "query_id", "left").select(
        "query_id", "n_anchors", F.coalesce("n_found", F.lit(0)).alias("n_found"), F.coalesce("max_depth", F.lit(0)).alias("max_depth"), (F.coalesce("n_found", F.lit(0)) > max_candidates).alias("truncated")
    )
    source = F.when(F.col("chunk_id").isNotNull(), "RETRIEVAL+GRAPH_EXPANSION").otherwise("GRAPH_EXPANSION")
    return ranked.where(F.col("place") <= max_candidates).select("query_id", "node_id", "anchor_id", "relation", "depth", "path", source.alias("source"), "chunk_id", "place"), summary
