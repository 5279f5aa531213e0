"""Listings, merges and checks on records of any kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_symbols(nodes: DataFrame) -> DataFrame:
    """(file_id, symbols): the sorted distinct qualified names of each file; files without any are left out."""
    named = nodes.where("file_id is not null and qualified_name is not null")
    return named.groupBy("file_id").agg(F.array_sort(F.collect_set("qualified_name")).alias("symbols"))


def in_order(nodes: DataFrame, within: Sequence[str]) -> DataFrame:
    """nodes with their place by kind, qualified name and id within each group of the columns within; nulls come first."""
    w = Window.partitionBy(*within).orderBy("kind", "qualified_name", "node_id")
    return nodes.withColumn("place", F.row_number().over(w))


def listed(rows: DataFrame, by: str, key: str) -> DataFrame:
    """rows of a small table with their place, the latest by first, ties by key."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.col(by).desc(), key)))


def first_rows(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Of the rows with one key the first in order, as of chunks of one entity, type and index. A null key is a key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def merged_maps(rows: DataFrame, key: Sequence[str], order: Column, values: str) -> DataFrame:
    """(key, values): the maps of each key united; of entries with one name the first in order holds. Null maps are empty."""
    each = rows.select(*key, order.alias("_o"), F.explode(values).alias("_k", "_v"))
    first = each.groupBy(*key, "_k").agg(F.min_by("_v", "_o").alias("_v"))
    return rows.select(*key).distinct().join(
        first.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(values)), list(key), "left"
    ).withColumn(values, F.coalesce(F.col(values), F.create_map().cast(rows.schema[values].dataType)))


def require_one(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows; an error where a column holds more than one value, as results of several repositories or queries would. Nulls count as none."""
    n = rows.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    mixed = [c for c in columns if n[c] > 1]
    if mixed:
        raise ValueError(f"more than one value in {', '.join(mixed)}")
    return rows


def require_unique(rows: DataFrame, key: str) -> DataFrame:
    """rows; an error that names up to ten keys that come more than once."""
    twice = [r[key] for r in rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").orderBy(key).limit(10).collect()]
    if twice:
        raise ValueError(f"{key} comes more than once: {', '.join(map(str, twice))}")
    return rows


def counters(results: DataFrame, ok: Column) -> DataFrame:
    """(total, succeeded, failed), one row; what is neither true nor false failed."""
    good = F.coalesce(ok, F.lit(False))
    return results.agg(F.count("*").alias("total"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"))


def graph_to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id, json): each node and edge as one JSON text, nulls kept, so that graph_from_json() gives the same rows."""
    keep = {"ignoreNullFields": "false"}
    n = nodes.select(F.lit("node").alias("part"), F.col("node_id").alias("id"), F.to_json(F.struct(*nodes.columns), keep).alias("json"))
    return n.unionByName(edges.select(F.lit("edge").alias("part"), F.col("edge_id").alias("id"), F.to_json(F.struct(*edges.columns), keep).alias("json")))


def graph_from_json(rows: DataFrame, node_schema: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graph_to_json(). A text that is no JSON object of the schema is an error."""

    def read(part: str, schema: str) -> DataFrame:
        return rows.where(F.col("part") == part).select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")

    return read("node", node_schema), read("edge", edge_schema)


def index_record(chunks: DataFrame, columns: dict[str, str]) -> DataFrame:
    """chunks under the column names of an index, columns: {name here: name there}; missing columns are null."""
    return chunks.select(*[(F.col(a) if a in chunks.columns else F.lit(None).cast("string")).alias(b) for a, b in columns.items()])


def chunk_of(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(node_id, chunk_id, file_path, symbol_name, qualified_name, from_chunk): each node's chunk, else the node's own attributes.

    chunks: (chunk_id, entity_id, file_path, symbol_name, qualified_name); of several chunks of an entity the smallest id.
    """
    one = chunks.groupBy(F.col("entity_id").alias("node_id")).agg(F.min(F.struct("chunk_id", "file_path", "symbol_name", "qualified_name")).alias("c"))
    return nodes.join(one, "node_id", "left").select(
        "node_id", F.coalesce("c.chunk_id", "node_id").alias("chunk_id"), F.coalesce("c.file_path", "file_id", F.lit("unknown/file")).alias("file_path"),
        F.coalesce("c.symbol_name", "name").alias("symbol_name"), F.coalesce(F.col("c.qualified_name"), nodes["qualified_name"]).alias("qualified_name"), F.col("c.chunk_id").isNotNull().alias("from_chunk"),
    )
