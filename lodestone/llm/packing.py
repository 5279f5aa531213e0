"""Filling fixed-capacity containers with items.

Space-filling-curve order: an item's hashed features are projected on three dimensions, the point becomes a Hilbert key,
rows are range-sorted by query and key, and neighbours along the curve are packed together: best fit decreasing within
a window of neighbours, whose emptiest contexts stay open for the next window. A query that spans several range
partitions, as one with a third of all rows would, is packed in each; the contexts left open at the cuts are then
packed into each other as if they were items.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.keys import norm_id
from lodestone.session import cut_lineage

WINDOW = 4096
OPEN = 64
MAX_CONFIGS = 100_000
DIMS, BITS = 3, 10
SCHEMA = (
    "query_id string, candidate_id string, config_id int, size bigint, capacity bigint, final_score double, "
    "piece string, tokens bigint, context string, contexts bigint, open boolean"
)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each row of points, integers below 2**bits, on the Hilbert curve (transposed form of Skilling)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projected(hashes: list[np.ndarray]) -> np.ndarray:
    """Three coordinates of BITS bits from the hashes of each item's features."""
    lengths = np.array([0 if h is None else len(h) for h in hashes])
    flat = np.concatenate([np.asarray(h, dtype=np.int64) for h in hashes if h is not None and len(h)] or [np.zeros(0, np.int64)]).view(np.uint64)
    owner = np.repeat(np.arange(len(hashes)), lengths)
    out = np.zeros((len(hashes), DIMS), dtype=np.int64)
    for d, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
        sign = ((flat * np.uint64(odd)) >> np.uint64(63)).astype(np.float64) * 2 - 1
        total = np.bincount(owner, weights=sign, minlength=len(hashes))
        out[:, d] = np.clip((1 << BITS) / (1 + np.exp(-1.7 * total / np.sqrt(np.maximum(lengths, 1)))), 0, (1 << BITS) - 1)
    return out


def _curve_keys(hashes: pd.Series) -> pd.Series:
    return pd.Series(hilbert(_projected(list(hashes))))


def features(*cols: str) -> Column:
    """Hashes of the words and path prefixes of the columns."""
    words = F.concat(*[F.coalesce(F.split(F.lower(F.col(c).cast("string")), r"[^a-z0-9]+"), F.array()) for c in cols])
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


class Bins:
    """Best fit: each item goes into the fullest context that holds it."""

    def __init__(self, capacity: int, name: str):
        self.capacity, self.name, self.n = capacity, name, 0
        self.room: list[tuple[int, int]] = []  # (room left, context), sorted

    def put(self, size: int) -> int:
        k = bisect_left(self.room, (size, -1))
        if k < len(self.room):
            left, b = self.room.pop(k)
        else:
            left, b = self.capacity, self.n
            self.n += 1
        insort(self.room, (left - size, b))
        return b

    def close(self, keep: int) -> None:
        """Only the emptiest stay open."""
        self.room = self.room[-keep:] if keep else []


def _packed(window: int, keep: int):
    cols = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        at, bins, held, first, out = None, None, [], True, []

        def flush() -> None:
            held.sort(key=lambda r: (-r[-1], r[1]))
            for *row, kind, tokens in held:
                b = bins.put(tokens)
                out.append((*row, kind, tokens, f"{bins.name}{b}", 1, False))
            held.clear()
            bins.close(keep)

        def done(last: bool) -> None:
            nonlocal first
            if bins is not None:
                flush()
                if first or last:  # the query may go on in another partition: its open contexts, at most keep, are told
                    out.extend((at, None, None, None, bins.capacity, None, "open", bins.capacity - left, f"{bins.name}{b}", 0, True) for left, b in bins.room)
                first = False

        for b in batches:
            for q, c, cfg, size, cap, score in zip(b["query_id"], b["candidate_id"], b["config_id"], b["size"], b["capacity"], b["final_score"]):
                if q != at:
                    done(False)
                    at, bins = q, Bins(0 if pd.isna(cap) else int(cap), f"{part}-")
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=cols)
                    out.clear()
                cfg = None if pd.isna(cfg) else int(cfg)
                row = (q, c, cfg, None if pd.isna(size) else int(size), None if pd.isna(cap) else int(cap), None if pd.isna(score) else float(score))
                size, cap = row[3], row[4]
                if size is None or cap is None or size < 0 or (size > cap and not cap):
                    out.append((*row, "unplaced", size, None, 0, False))
                    continue
                if size > cap:
                    whole, size = divmod(size, cap)
                    out.append((*row, "full", whole * cap, f"{part}-{c}-full", whole, False))
                    if not size:
                        continue
                    held.append((*row, "rest", size))
                else:
                    held.append((*row, "whole", size))
                if len(held) >= window:
                    flush()
        done(True)
        if out:
            yield pd.DataFrame(out, columns=cols)

    return run


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """Open contexts of one query, at most OPEN a partition that it spans, packed into each other."""
    pdf = pdf.sort_values(["tokens", "context"], ascending=[False, True])
    bins = Bins(int(pdf["capacity"].iloc[0]), "")
    to = [bins.put(int(t)) for t in pdf["tokens"]]
    names: dict[int, str] = {}
    for b, c in zip(to, pdf["context"]):
        names.setdefault(b, c)
    return pd.DataFrame({"query_id": pdf["query_id"], "context": pdf["context"], "into": [names[b] for b in to]})


def pack(items: DataFrame, configs: DataFrame, window: int = WINDOW, keep_open: int = OPEN) -> DataFrame:
    """One row per piece of an item: (query_id, candidate_id, config_id, size, capacity, final_score, piece, tokens, context, contexts).

    size: token_count, or code_tokens + header_tokens where that is null. capacity: max_context_tokens less the four
    reserves (null: 0), at least 0. piece: whole; where the size exceeds the capacity full, which fills that many
    contexts of its own, and rest, packed like an item; unplaced where size or capacity is unknown, the size is
    negative or the capacity is 0. Every context belongs to one query, named by context; contexts counts those a row
    fills alone (0 unplaced). Items of size 0 fit anywhere.

    Of rows redelivered for a query and candidate the latest holds. Rows without either id are no items. An empty
    table gives no rows.
    """
    reserves = ("reserved_system_tokens", "reserved_query_tokens", "reserved_output_tokens", "safety_margin_tokens")
    room = configs.groupBy("config_id").agg(F.max(F.greatest(F.lit(0), F.col("max_context_tokens") - sum(F.coalesce(F.col(r), F.lit(0)) for r in reserves))).cast("bigint").alias("capacity"))
    # Cut, as range partitioning reads its input twice.
    rows = cut_lineage(
        items.select(
            norm_id("query_id").alias("query_id"), norm_id("candidate_id").alias("candidate_id"), F.col("packed_at"), F.col("config_id").cast("int").alias("config_id"),
            F.coalesce(F.col("token_count"), F.col("code_tokens") + F.col("header_tokens")).cast("bigint").alias("size"),
            "final_score", features("file_path", "qualified_name", "symbol_name", "node_kind").alias("hashes"),
        )
        .where("query_id is not null and candidate_id is not null")
        .groupBy("query_id", "candidate_id")
        .agg(F.max(F.struct("packed_at", "config_id", "size", "final_score", "hashes")).alias("r"))
        .select("query_id", "candidate_id", "r.config_id", "r.size", "r.final_score", F.pandas_udf(_curve_keys, "bigint")("r.hashes").alias("key"))
        .join(F.broadcast(room) if configs.limit(MAX_CONFIGS + 1).count() <= MAX_CONFIGS else room, "config_id", "left")
    )
    packed = cut_lineage(
        rows.repartitionByRange("query_id", "key", "candidate_id")
        .sortWithinPartitions("query_id", "key", "candidate_id")
        .select("query_id", "candidate_id", "config_id", "size", "capacity", "final_score")
        .mapInPandas(_packed(window, keep_open), SCHEMA)
    )
    moves = packed.where("open").select("query_id", "context", "tokens", "capacity").groupBy("query_id").applyInPandas(_merged, "query_id string, context string, into string")
    return packed.where("not open").join(moves, ["query_id", "context"], "left").select(
        "query_id", "candidate_id", "config_id", "size", "capacity", "final_score", "piece", "tokens", F.coalesce("into", "context").alias("context"), "contexts"
    )


def packing_report(packed: DataFrame) -> DataFrame:
    """(query_id, capacity, n_items, n_contexts, tokens, unused_share) of pack(), unplaced pieces left out."""
    by = packed.where("context is not null").groupBy("query_id", "context").agg(
        F.max("capacity").alias("capacity"), F.max("contexts").alias("contexts"), F.sum("tokens").alias("tokens"), F.count_if(F.col("piece") != "rest").alias("n_items")
    )
    return by.groupBy("query_id").agg(
        F.max("capacity").alias("capacity"), F.sum("n_items").alias("n_items"), F.sum("contexts").alias("n_contexts"), F.sum("tokens").alias("tokens"),
        F.round(1 - F.sum("tokens") / F.nullif(F.sum(F.col("contexts") * F.col("capacity")), F.lit(0)), 6).alias("unused_share"),
    )


def packing_invariants(packed: DataFrame) -> DataFrame:
    """(query_id, n_items, n_unplaced, tokens, placed, n_over) of pack(): every item once, whole, and no context above its capacity."""
    items = packed.groupBy("query_id", "candidate_id").agg(F.max("size").alias("size"), F.max((F.col("piece") == "unplaced").cast("int")).alias("unplaced"), F.sum(F.when(F.col("piece") != "unplaced", F.col("tokens"))).alias("placed"))
    by = items.groupBy("query_id").agg(F.count("*").alias("n_items"), F.sum("unplaced").alias("n_unplaced"), F.sum("size").alias("tokens"), F.sum("placed").alias("placed"))
    fill = packed.where("context is not null").groupBy("query_id", "context").agg((F.sum("tokens") > F.max("capacity") * F.max("contexts")).cast("int").alias("over"))
    over = fill.groupBy("query_id").agg(F.sum("over").alias("n_over"))
    return by.join(over, "query_id", "left").withColumn("n_over", F.coalesce("n_over", F.lit(0)))
