"""BM25 over field-weighted code tokens, for many queries in one job.

An index is one row a chunk with its weighted tokens and length; it can be stored, extended, thinned and cloned as a
table (``upsert``, ``remove``, ``clone``). A search reads it once, packs the postings of the asked tokens (``bm25``) and
keeps the best of every query where these are; only k rows a query and partition are shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import code_tokens
from lodestone.operators import bm25
from lodestone.session import cut_lineage, spread

IDF_FLOOR = 1e-6
BROADCAST_TERMS = 3_000_000
BROADCAST_IDS = 1_000_000
#: How often a field counts. A doc comment counts once.
FIELD_WEIGHTS = {"name": 10, "qualified_name": 5, "path": 3, "signature": 3, "doc_comment": 1, "content": 1}


@dataclass(frozen=True)
class LexicalIndex:
    """rows: (chunk_id, scope, length, terms array<struct<token, w>>, extra columns), one a chunk.

    scope holds what has corpus statistics of its own, as a repository's version; it is null where there is one corpus.
    """

    rows: DataFrame

    @property
    def lengths(self) -> DataFrame:
        return self.rows.drop("terms")

    @property
    def totals(self) -> DataFrame:
        """(scope, n, avgdl): a corpus without tokens has the average 1."""
        return self.lengths.groupBy("scope").agg(F.count("*").alias("n"), F.coalesce(F.nullif(F.avg("length"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))

    def postings(self, tokens: DataFrame | None = None, where: Column | None = None) -> DataFrame:
        """(chunk_id, scope, token, tf, length, kept), of the given tokens (one column, small enough to be broadcast) or of all; kept: whether where holds."""
        kept = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        each = self.rows.select("chunk_id", "scope", "length", kept.alias("kept"), F.explode("terms").alias("t")).select("chunk_id", "scope", "length", "kept", "t.*")
        if tokens is not None:
            each = each.join(tokens, "token", "left_semi")
        parts = int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return each.groupBy("chunk_id", "scope", "token").agg(F.sum("w").alias("tf"), F.max("length").alias("length"), F.max("kept").alias("kept")).repartition(parts, "chunk_id")

    @property
    def frequencies(self) -> DataFrame:
        """(scope, token, df)."""
        return self.postings().groupBy("scope", "token").agg(F.count("*").alias("df"))


def index_rows(chunks: DataFrame, chunk_id: str, fields: Mapping[str, Column], keep: tuple[str, ...] = (), scope: Column | None = None, scan: bool = True) -> DataFrame:
    """The rows of an index. fields: column expressions by field name of FIELD_WEIGHTS.

    Null fields have no tokens; a chunk without tokens counts in the corpus with length 0. keep: columns for filters. scan: chunks
    are a scan, which is dealt out if it has few splits; what comes from joins isn't, as counting its splits runs them.
    """

    def weighed(c: Column, w: int) -> Column:
        return F.transform(code_tokens(c), lambda t: F.struct(t.alias("token"), F.lit(w).alias("w")))

    terms = F.concat(*[weighed(c, FIELD_WEIGHTS[f]) for f, c in fields.items()])
    rows = (spread(chunks) if scan else chunks).select(F.col(chunk_id).alias("chunk_id"), (F.lit(None).cast("string") if scope is None else scope).alias("scope"), *keep, terms.alias("terms"))
    return rows.withColumn("length", F.aggregate("terms", F.lit(0), lambda a, t: a + t["w"]))


def lazy_index(chunks: DataFrame, chunk_id: str, fields: Mapping[str, Column], keep: tuple[str, ...] = (), scope: Column | None = None, scan: bool = True) -> LexicalIndex:
    """index_rows() that aren't written, for a single search, which reads them once."""
    return LexicalIndex(index_rows(chunks, chunk_id, fields, keep, scope, scan))


def build_index(chunks: DataFrame, chunk_id: str, fields: Mapping[str, Column], keep: tuple[str, ...] = (), scope: Column | None = None) -> LexicalIndex:
    """index_rows(), written once. Chunk ids must be unique within a scope; upsert() makes them so."""
    return LexicalIndex(cut_lineage(index_rows(chunks, chunk_id, fields, keep, scope)))


def _hinted(ids: DataFrame) -> DataFrame:
    """Few ids are broadcast, so that chunks stay where they are."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Index rows with new ones added (like all upkeep, also of chunks with scopes that are yet to be tokenised); a chunk that is there already is replaced, and all statistics with it."""
    ids = new.select("chunk_id", F.coalesce("scope", F.lit("")).alias("s"))
    kept = old.withColumn("s", F.coalesce("scope", F.lit(""))).join(_hinted(ids), ["chunk_id", "s"], "left_anti").select(old.columns)
    return kept.unionByName(new)


def remove(rows: DataFrame, gone: DataFrame, scope: str | None = None) -> DataFrame:
    """Index rows without the chunks of gone (chunk_id), in one scope or in all."""
    hit = rows if scope is None else rows.where(F.col("scope") == scope)
    left = hit.join(_hinted(gone.select("chunk_id")), "chunk_id", "left_anti").select(rows.columns)
    return left if scope is None else left.unionByName(rows.where(F.col("scope").isNull() | (F.col("scope") != scope)))


def clear(rows: DataFrame, scope: str | None = None) -> DataFrame:
    """Index rows without those of a scope, or none at all."""
    return rows.where(F.lit(False)) if scope is None else rows.where(F.col("scope").isNull() | (F.col("scope") != scope))


def clone(rows: DataFrame, scope: str, to: str) -> DataFrame:
    """Index rows with those of a scope once more under another, which they replace."""
    return clear(rows, to).unionByName(rows.where(F.col("scope") == scope).withColumn("scope", F.lit(to)))


def search(index: LexicalIndex, queries: DataFrame, k: int = 10, where: Column | None = None, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks of every query.

    queries: (query_id, text), and scope where the index has scopes: each query then meets its own, whose statistics
    count. A repeated query token counts each time. where filters chunks after the corpus statistics. Scores are rounded
    to 6 places before ranking, ties go by chunk_id; scores that aren't above 0 and finite are left out. k below 1 is an
    error. Queries with more than broadcast_terms terms in all come in blocks, each of which reads the index once.
    """
    if k < 1:
        raise ValueError("k must be positive")
    scope = F.coalesce("scope", F.lit("")) if "scope" in queries.columns else F.lit("")
    asked = queries.select("query_id", scope.alias("s"), F.explode(code_tokens("text")).alias("token")).groupBy("query_id", "s", "token").agg(F.count("*").alias("qtf"))
    blocks = -(-asked.count() // max(1, broadcast_terms))
    out = None
    for i in range(blocks):
        got = _search(index, asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), k, where)
        if got is None:
            continue
        got = cut_lineage(got) if blocks > 1 else got
        out = got if out is None else out.unionByName(got)
    if out is None:
        ids = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {index.rows.schema['chunk_id'].dataType.simpleString()}"
        return index.rows.sparkSession.createDataFrame([], f"{ids}, score double, rank int")
    return out


def _search(index: LexicalIndex, asked: DataFrame, k: int, where: Column | None) -> DataFrame | None:
    """search() of queries whose terms the driver and every task can hold."""
    sc = asked.sparkSession.sparkContext
    held = asked.toArrow()
    if not held.num_rows:
        return None
    ids, tokens, scopes = (pa.concat_arrays(held[c].chunks).dictionary_encode() for c in ("query_id", "token", "s"))
    query = pc.fill_null(ids.indices, len(ids.dictionary)).to_numpy().astype(np.int32)
    names = pa.concat_arrays([ids.dictionary, pa.nulls(1, ids.dictionary.type)])
    pairs, pair = np.unique(scopes.indices.to_numpy().astype(np.int64) * len(tokens.dictionary) + tokens.indices.to_numpy(), return_inverse=True)
    order = np.argsort(pair, kind="stable")
    start = np.searchsorted(pair[order], np.arange(len(pairs) + 1))
    scope_of = pairs // len(tokens.dictionary)
    words = bm25.Vocabulary(tokens.dictionary.to_pylist(), scopes.dictionary.to_pylist(), pairs)

    kept = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    of = F.coalesce("scope", F.lit(""))
    if len(words.scopes) <= 100:  # what isn't asked needn't be tokenised
        rows = index.rows.where(of.isin(words.scopes))
    else:
        rows = index.rows
    rows = rows.select("chunk_id", of.alias("s"), "length", kept.alias("kept"), "terms")
    packed = cut_lineage(rows.mapInArrow(bm25.pack(sc.broadcast(words)), bm25.PACKED))

    n, total, df = np.zeros(len(words.scopes), np.int64), np.zeros(len(words.scopes), np.int64), np.zeros(len(pairs), np.int64)
    counts = packed.where("block is null")
    for r in counts.select(F.explode(F.arrays_zip("scope", "n", "total")).alias("x")).select("x.*").groupBy("scope").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        n[r.scope], total[r.scope] = r.n, r.total
    each = counts.select(F.explode(F.arrays_zip("pair", "df")).alias("x")).select("x.*").groupBy("pair").agg(F.sum("df").alias("df")).toArrow()
    df[each["pair"].to_numpy()] = each["df"].to_numpy()
    avgdl = np.where(total > 0, total / np.maximum(n, 1), 1.0)
    idf = np.maximum(np.log((n[scope_of] - df + 0.5) / (df + 0.5) + 1), IDF_FLOOR)
    weight = held["qtf"].to_numpy()[order] * idf[pair[order]]
    about = sc.broadcast(bm25.Asked(start, query[order], weight, df, n, avgdl, scope_of, names))
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, chunk_id {index.rows.schema['chunk_id'].dataType.simpleString()}, score double"
    return top(packed.where("block is not null").select("block").mapInArrow(bm25.find(about, k), schema), k)


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k greatest scores of every query with their rank, ties by chunk_id."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")
