"""Source files and entities to chunks of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.keys import norm_id, norm_path
from lodestone.functions.text import uuid5

#: Our own namespace for chunk ids.
NAMESPACE = "6f1c7a52-3b0e-5d3a-9a53-0d4b1f2c8e77"
MAX_LINES = 150
FILE_LINES = 150


def kept_files(files: DataFrame) -> DataFrame:
    """(file_id, repository_id, path, language, content, lines): the latest row of each file whose text was kept."""
    rows = files.where("content is not null").select(
        norm_id("file_id").alias("file_id"), F.struct("indexed_at", norm_id("repository_id").alias("repository_id"), norm_path("path").alias("path"), F.lower(F.trim("language")).alias("language"), "content").alias("r")
    )
    one = rows.where("file_id is not null").groupBy("file_id").agg(F.max("r").alias("r")).select("file_id", "r.repository_id", "r.path", "r.language", "r.content")
    text = F.regexp_replace("content", r"\r\n?", "\n")
    return one.withColumn("lines", F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n")))


def file_chunks(files: DataFrame, most: int = FILE_LINES) -> DataFrame:
    """(chunk_id, file_id, start_line, end_line, content): one chunk a file, its first ``most`` lines where it is longer."""
    f = kept_files(files)
    n = F.least(F.size("lines"), F.lit(most))
    return f.select(uuid5(NAMESPACE, F.concat_ws("|", F.lit("file"), "repository_id", "path")).alias("chunk_id"), "file_id", F.lit(1).alias("start_line"), n.alias("end_line"), F.array_join(F.slice("lines", 1, most), "\n").alias("content"))


def signatures(nodes: DataFrame, refs: DataFrame, is_async: DataFrame | None = None) -> DataFrame:
    """(node_id, signature, n_methods) of classes, interfaces, functions and methods, made from what the graph knows.

    refs: references of kind extends and implements by source_symbol_id; is_async: (node_id, is_async).
    """
    kind = F.lower(F.trim("ref_kind"))
    up = refs.where(kind.isin("extends", "implements")).select(norm_id("source_symbol_id").alias("node_id"), kind.alias("k"), F.nullif(F.trim("target_qualified_name"), F.lit("")).alias("t"))
    up = up.where("node_id is not null and t is not null").groupBy("node_id").agg(*[F.array_join(F.array_sort(F.collect_set(F.when(F.col("k") == k, F.col("t")))), ", ").alias(k) for k in ("extends", "implements")])
    methods = nodes.where("kind = 'method' and parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n_methods"))
    n = nodes.where(F.col("kind").isin("class", "interface", "function", "method")).join(up, "node_id", "left").join(methods, "node_id", "left")
    n = n.withColumn("is_async", F.lit(False)) if is_async is None else n.join(is_async.select("node_id", "is_async"), "node_id", "left")
    name = F.coalesce("name", F.lit(""))
    bases = F.concat(*[F.when(F.coalesce(F.col(k), F.lit("")) != "", F.concat(F.lit(f" {k} "), F.col(k))).otherwise("") for k in ("extends", "implements")])
    made = F.when(F.col("kind").isin("class", "interface"), F.concat("kind", F.lit(" "), name, bases)).otherwise(F.concat(F.when(F.coalesce("is_async", F.lit(False)), "async ").otherwise(""), F.lit("def "), name, F.lit("()")))
    return n.select("node_id", made.alias("signature"), F.coalesce("n_methods", F.lit(0)).alias("n_methods"))


def entity_chunks(files: DataFrame, nodes: DataFrame, spans: DataFrame, signed: DataFrame, most: int = MAX_LINES) -> DataFrame:
    """(chunk_id, parent_chunk_id, entity_id, chunk_type, sub_index, n_sub, start_line, end_line, signature, content).

    Every class, interface, function and method. One of up to ``most`` lines is one chunk; a longer one gives a header,
    its first line, as piece 0 and sub-chunks of ``most`` lines with the header as parent. spans: (node_id, start_line,
    end_line); lines beyond the text are left out. An entity without text (its file's wasn't kept, its lines are unknown
    or lie beyond it) has its signature, of signatures(), with a stand-in for the body.
    """
    f = kept_files(files).select("file_id", "path", "lines")
    e = nodes.where(F.col("kind").isin("class", "interface", "function", "method")).join(spans, "node_id", "left").join(signed, "node_id", "left").join(f, "file_id", "left")
    known = F.coalesce(F.col("lines").isNotNull() & (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")), F.lit(False))
    text = F.when(known, F.slice("lines", F.when(known, F.col("start_line")).otherwise(1), F.when(known, F.col("end_line") - F.col("start_line") + 1).otherwise(0))).otherwise(F.array().cast("array<string>"))
    sign = F.coalesce("signature", F.col("kind"))
    stand_in = F.when(F.col("kind").isin("class", "interface"), F.array(F.concat(sign, F.lit(" {")), F.concat(F.lit("  // Methods: "), F.coalesce("n_methods", F.lit(0)).cast("string")), F.lit("}"))).otherwise(F.array(sign, F.lit("    ...")))
    e = e.withColumn("text", text).withColumn("has", F.size("text") > 0).withColumn("body", F.when(F.col("has"), F.col("text")).otherwise(stand_in)).withColumn("n", F.size("body"))
    e = e.withColumn("n_sub", F.when(F.col("has") & (F.col("n") > most), F.ceil(F.col("n") / most).cast("int")).otherwise(0))
    p = e.withColumn("sub_index", F.explode(F.sequence(F.lit(0), F.col("n_sub"))))
    first = F.when(F.col("sub_index") > 0, (F.col("sub_index") - 1) * most).otherwise(0)
    size = F.when(F.col("n_sub") == 0, F.col("n")).when(F.col("sub_index") == 0, 1).otherwise(F.least(F.lit(most), F.col("n") - first))

    def key(k):
        return uuid5(NAMESPACE, F.concat_ws("|", F.lit("entity"), "node_id", k.cast("string")))

    return p.select(
        key(F.col("sub_index")).alias("chunk_id"), F.when(F.col("sub_index") > 0, key(F.lit(0))).alias("parent_chunk_id"), F.col("node_id").alias("entity_id"),
        F.when(F.col("sub_index") > 0, "sub_chunk").otherwise(F.col("kind")).alias("chunk_type"), "sub_index", "n_sub",
        (F.col("start_line") + first).alias("start_line"), F.when(F.col("has"), F.col("start_line") + first + size - 1).otherwise(F.col("end_line")).alias("end_line"), sign.alias("signature"),
        F.array_join(F.slice("body", first + 1, size), "\n").alias("content"),
    )


def chunk_order(chunks: DataFrame, by: str) -> DataFrame:
    """chunks with their place within a column by: files first, then by line, type and index."""
    w = Window.partitionBy(by).orderBy(F.col("chunk_type") != "file", "start_line", "chunk_type", "sub_index", "chunk_id")
    return chunks.withColumn("place", F.row_number().over(w))
