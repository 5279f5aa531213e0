"""Exact nearest neighbours by cosine, many queries against all rows.

Queries are a stated set and come in blocks of a bounded number, each broadcast; every partition multiplies its vectors
with the block and keeps its own k best of each query, so only k rows a query and partition are shuffled. Of several
blocks each is done with before the next is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.lexical import top
from lodestone.session import cut_lineage, spread

BLOCK = 2048
#: Queries and vectors multiplied at once, pairs multiplied exactly at once, and results held until they are cut to the k best.
QUERIES, ROWS, EXACT, HELD = 256, 2048, 50_000, 1_000_000


def _units(v: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(x, dtype=np.float64) for x in v])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _reached(q: np.ndarray, x: np.ndarray, tops: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of unit vectors: of each row of q the k best of x that reach the k best so far in tops, which are brought up to date.

    All are multiplied in single precision, whose error is bounded; what may be among the best is then multiplied exactly.
    """
    k, least = tops.shape[1], tops[:, -1].copy()
    near = q.astype(np.float32) @ x.T.astype(np.float32)
    off = (q.shape[1] + 8) * 2.0**-23
    new = np.flatnonzero(np.isneginf(least))
    if len(new) and near.shape[1] > k:
        least[new] = np.partition(near[new], -k, axis=1)[:, -k] - off
    row, col = np.divmod(np.flatnonzero(near >= (least - 2e-6 - off).astype(np.float32)[:, None]), near.shape[1])  # scores are rounded to 6 places
    score = np.concatenate([np.einsum("ij,ij->i", q[row[lo : lo + EXACT]], x[col[lo : lo + EXACT]]) for lo in range(0, len(row), EXACT)] or [np.zeros(0)])
    score = np.clip(np.round(score, 6), -1.0, 1.0) + 0.0
    ok = score >= tops[row, -1]
    row, col, score = row[ok], col[ok], score[ok]
    order = np.lexsort((place[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    ok = nth < k
    row, col, score, nth = row[ok], col[ok], score[ok], nth[ok]
    who, at = np.unique(row, return_inverse=True)
    fresh = np.full((len(who), k), -np.inf)
    fresh[at, nth] = score
    tops[who] = np.sort(np.concatenate([tops[who], fresh], axis=1), axis=1)[:, : -k - 1 : -1]
    return row, col, score


def _cut(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], tops: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One part (query, chunk_id, score) with the k best of every query, ties by chunk_id."""
    query, chunk, score = (np.concatenate([p[i] for p in parts]) for i in range(3))
    ok = score >= tops[query, -1]
    query, chunk, score = query[ok], chunk[ok], score[ok]
    order = np.lexsort((np.argsort(np.argsort(chunk, kind="stable"), kind="stable"), -score, query))
    query, chunk, score = query[order], chunk[order], score[order]
    ok = np.arange(len(query)) - np.searchsorted(query, query) < tops.shape[1]
    return [(query[ok], chunk[ok], score[ok])]


def _best(block, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = block.value
        tops, whole = np.full((len(ids), k), -np.inf), np.isfinite(q).all()
        parts, held, limit = [], 0, HELD
        for b in batches:
            if not len(b):
                continue
            x = _units(b["vector"])
            if x.shape[1] != q.shape[1]:
                raise ValueError("vectors differ in dimension")
            chunk = b["chunk_id"].to_numpy()
            place = np.argsort(np.argsort(chunk, kind="stable"), kind="stable")  # the order of ids, whatever their type
            if whole and np.isfinite(x).all():
                for at in range(0, len(x), ROWS):
                    for lo in range(0, len(ids), QUERIES):
                        row, col, part = _reached(q[lo : lo + QUERIES], x[at : at + ROWS], tops[lo : lo + QUERIES], place[at : at + ROWS])
                        if len(row):
                            parts.append((row + lo, chunk[at + col], part))
                            held += len(row)
                    if held > limit:
                        parts = _cut(parts, tops)
                        held = len(parts[0][0])
                        limit = max(HELD, 2 * held)
                continue
            for lo in range(0, len(ids), QUERIES):  # values that don't compare are sorted with all others
                part = np.clip(np.round(q[lo : lo + QUERIES] @ x.T, 6), -1.0, 1.0) + 0.0
                col = np.lexsort((np.broadcast_to(place, part.shape), -part), axis=1)[:, :k]
                row, part, col = np.repeat(np.arange(len(part)), col.shape[1]), np.take_along_axis(part, col, 1).ravel(), col.ravel()
                yield pd.DataFrame({"query_id": ids[lo : lo + QUERIES][row], "chunk_id": chunk[col], "score": part})
        if parts:
            query, chunk, score = _cut(parts, tops)[0]
            for lo in range(0, len(query), 50_000):
                yield pd.DataFrame({"query_id": ids[query[lo : lo + 50_000]], "chunk_id": chunk[lo : lo + 50_000], "score": score[lo : lo + 50_000]})

    return run


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, chunk_id, score, rank) from (chunk_id, vector) and (query_id, vector); ids are bigints or strings.

    score: cosine rounded to 6 places, 0 where a norm is 0, negative ones stay. Ties go by chunk_id. Null vectors are
    left out, other dimensions are an error, and so is k below 1. Empty tables give no rows.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = vectors.sparkSession
    ids = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}"
    vectors = spread(vectors)
    asked = queries.where("vector is not null and query_id is not null").select("query_id", "vector")
    blocks = max(1, -(-asked.count() // block))
    out = None
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toPandas()
        if not len(rows):
            continue
        held = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), _units(rows["vector"])))
        got = top(vectors.where("vector is not null").select("chunk_id", "vector").mapInPandas(_best(held, k), f"{ids}, score double"), k)
        if blocks > 1:  # the driver and the executors hold one block at a time
            got = cut_lineage(got)
            held.destroy()
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], f"{ids}, score double, rank int")
