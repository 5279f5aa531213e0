"""Long exact spans shared between records.

A text's tokens are its character q-grams, hashed. Of the Cartesian tree over the hashes, each node (a q-gram that is
smaller than all others from one side of it to the other) is a *compact window*: all subsequences of t q-grams inside of
it that hold the node share its hash as their minimum. Their starts form one interval, so the tree's nodes that are wide
enough are read off as the runs of equal places in the sliding minimum, in linear time for any text.

1. Under each of ``HASHES`` hash functions every start lies in one window. *Interval join* within a text: where the
   windows of all functions overlap, the starts share the whole signature, that is all minima and their distances.
   Two texts with a common substring of t + q - 1 characters have a run of starts with the same signature each.
2. *Interval join* between texts: runs with one signature, laid over each other at their first minimum. Runs of equal
   extent and text are one class, so a passage copied into a million records is one row from here on; where classes of
   one signature differ in extent (at a copy's ends), they meet start by start.
3. *Verification*: each member's characters are compared with those of its class, and those of a class with the
   smallest one that it meets; rows for that are in proportion to the runs, never to pairs.

Texts are taken once per class of exact copies. Links stay in the form of groups (with their members), since a
group of n records stands for n * (n - 1) / 2 pairs; ``document_pairs`` writes them out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut_lineage, spread

SPAN = 300
Q = 100
HASHES = 3
_B = 0x5851F42D4C957F2D  # odd, so it has an inverse
_B_INV = pow(_B, -1, 2**64)
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: Rows of ids or signatures up to which they are broadcast (8 bytes each); above, the join shuffles.
BROADCAST_IDS = 1_000_000
#: Places are kept in the low bits of a hash while minima are taken, so longer texts go in pieces that overlap.
PLACE_BITS = 20


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p) if n else p


class Roller:
    """Hashes of substrings of one text, modulo 2**64."""

    def __init__(self):
        self.up, self.down = _powers(_B, 0), _powers(_B_INV, 0)

    def read(self, codes: np.ndarray) -> None:
        n = len(codes)
        if len(self.up) < n:
            self.up, self.down = _powers(_B, 2 * n), _powers(_B_INV, 2 * n)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(7)) * self.down[:n], out=self.sums[1:])

    def at(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each [begin, end) of the text read last."""
        return mixed((self.sums[end] - self.sums[begin]) * self.up[begin])

    def __call__(self, codes: np.ndarray, length: int) -> np.ndarray:
        """Those of all substrings of one length."""
        if len(codes) < length:
            return np.zeros(0, dtype=np.uint64)
        self.read(codes)
        begin = np.arange(len(codes) - length + 1)
        return self.at(begin, begin + length)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_ODD[3])
    return h ^ (h >> np.uint64(32))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def sliding_min(h: np.ndarray, t: int) -> np.ndarray:
    """The minimum of every t neighbours, from prefix and suffix minima of blocks."""
    n = len(h)
    if n < t:
        return h[:0]
    pad = -n % t
    x = np.concatenate([h, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, t)
    prefix = np.minimum.accumulate(x, 1).ravel()
    suffix = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - t + 1], prefix[t - 1 : n])


def compact_windows(h: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last) of every compact window of at least t hashes, in order.

    first .. last are the starts of the sequences of t hashes that lie in the window and hold its minimum, which stands
    at place: the first one, where equal hashes repeat. Each start belongs to one window.
    """
    bits = np.uint64(2**PLACE_BITS - 1)
    parts = []
    for lo in range(0, max(1, len(h) - t + 1), 2**PLACE_BITS - t):
        x = h[lo : lo + 2**PLACE_BITS - 1]
        low = sliding_min((x & ~bits) | np.arange(len(x), dtype=np.uint64), t)
        if len(low):
            begin = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
            end = np.concatenate([begin[1:], [len(low)]]) - 1
            parts.append((low[begin] & ~bits, (low[begin] & bits).astype(np.int64) + lo, begin + lo, end + lo))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return h[:0], none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts))


def signed_runs(h: np.ndarray, t: int, hashes: int = HASHES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, place, first, last): the interval join of the compact windows under all hash functions.

    place is that of the first function's minimum; the signature holds all minima and the others' distances from it.
    """
    views = [compact_windows(mixed(h * np.uint64(_ODD[k % 4] + 2 * (k // 4))), t) for k in range(hashes)]
    first = np.unique(np.concatenate([v[2] for v in views]))
    last = np.concatenate([first[1:] - 1, [len(h) - t]]) if len(first) else first
    sign, place = np.zeros(len(first), dtype=np.uint64), None
    for v in views:
        on = np.searchsorted(v[2], first, "right") - 1
        place = v[1][on] if place is None else place
        sign = mixed(sign * np.uint64(_ODD[0]) + v[0][on]) + (v[1][on] - place).astype(np.uint64) * np.uint64(_ODD[1])
    return mixed(sign), place if place is not None else first, first, last


def _runs(span: int, q: int, hashes: int):
    """(doc_id, sign, run, first, last, low) of every run; run names its extent and text."""
    t = span - q + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll = Roller()
        for b in batches:
            parts = []
            for d, text in zip(b["doc_id"], b["text"]):
                sign, place, first, last = signed_runs(roll(codes(text), q), t, hashes)
                name = roll.at(first, last + span) * np.uint64(_ODD[1]) + sign + (first - place).view(np.uint64) * np.uint64(_ODD[2]) + (last - place).view(np.uint64)
                parts.append((np.full(len(sign), d, dtype=np.int64), sign.view(np.int64), mixed(name).view(np.int64), *(x.astype(np.int32) for x in (first, last, first - place))))
            if parts:
                yield pd.DataFrame(dict(zip(("doc_id", "sign", "run", "first", "last", "low"), (np.concatenate(x) for x in zip(*parts)))))

    return run


def _starts(span: int):
    """(sign, run, key, at): each start of the runs of a text, at places from its first; key names what begins there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll = Roller()
        for b in batches:
            for text, runs in zip(b["text"], b["runs"]):
                roll.read(codes(text))
                name = np.array([r["run"] for r in runs], dtype=np.int64)
                sign = np.array([r["sign"] for r in runs], dtype=np.int64).view(np.uint64)
                first, last, low = (np.array([r[k] for r in runs], dtype=np.int64) for k in ("first", "last", "low"))
                n = last - first + 1
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                begin = np.repeat(first, n) + at
                key = roll.at(begin, begin + span) * np.uint64(_ODD[2]) + np.repeat(sign, n) + (np.repeat(low, n) + at).view(np.uint64) * np.uint64(_ODD[0])
                yield pd.DataFrame({"sign": np.repeat(sign.view(np.int64), n), "run": np.repeat(name, n), "key": mixed(key).view(np.int64), "at": at})

    return run


def _same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id) of the links whose characters differ."""
    for b in batches:
        bad = [
            i
            for x, y, links in zip(b["x"], b["y"], b["links"])
            for i, p, r, n in ((k["id"], k["p"], k["r"], k["n"]) for k in links)
            if x[p : p + n] != y[r : r + n]
        ]
        yield pd.DataFrame({"id": np.array(bad, dtype=np.int64)})


def _differing(links: DataFrame, texts: DataFrame) -> DataFrame:
    """(id) of links (id, a, p, b, r, n) where n characters of a's text from p aren't those of b's from r."""
    by = links.groupBy("a", "b").agg(F.collect_list(F.struct("id", "p", "r", "n")).alias("links"))  # bounded by the runs of one text
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    return by.join(left, "a").join(right, "b").select("x", "y", "links").mapInPandas(_same, "id bigint")


def _few(ids: DataFrame, most: int) -> DataFrame:
    """ids, to be broadcast if they are few."""
    ids = cut_lineage(ids)
    return F.broadcast(ids) if ids.count() <= most else ids


def copy_classes(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, class_id, n_chars): texts of at least span characters; class_id is the smallest doc_id of its exact copies."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2("text", 256).alias("digest"), F.length("text").alias("n_chars"))
    rows = rows.where((F.col("n_chars") >= span) & F.col("doc_id").isNotNull())
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    return rows.join(first, "digest").select("doc_id", "class_id", "n_chars").distinct()


def shared_spans(documents: DataFrame, span: int = SPAN, q: int = Q, hashes: int = HASHES, broadcast_ids: int = BROADCAST_IDS) -> tuple[DataFrame, DataFrame]:
    """(classes, groups): copy_classes(), and (sign, span_id, class_id, begin, end): the members of every shared span.

    A group, named by sign and span_id, is a text of at least span characters that stands in more than one class of exact copies, its members the
    places [begin, end) where it does. Two classes share a span if and only if they have a group in common. Compared
    exactly, code point by code point, without any folding. Null texts and texts of fewer than span characters have no
    span; a doc_id that comes again with the same text counts once. Empty tables give no rows.

    Runs are told apart by 128 bits (signature and name) before their characters are compared; a run whose characters
    then differ from its class's is left out.
    """
    classes = cut_lineage(copy_classes(documents, span))
    firsts = _few(classes.where("doc_id = class_id").select("doc_id"), broadcast_ids)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.length("text") >= span)
    runs = spread(texts).mapInPandas(_runs(span, q, hashes), "doc_id bigint, sign bigint, run bigint, first int, last int, low int")
    runs = cut_lineage(runs.join(firsts, "doc_id", "left_semi"))
    # Signatures of one document alone share nothing.
    often = runs.groupBy("sign").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("sign")
    often = _few(often, broadcast_ids)
    shared = cut_lineage(runs.join(often, "sign", "left_semi").distinct().withColumn("id", F.monotonically_increasing_id()))
    classed = shared.groupBy("sign", "run").agg(
        F.min(F.struct("doc_id", "first", "last", "low")).alias("m"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")
    )
    heads = cut_lineage(classed.select("sign", "run", "m.*", "least", "most"))
    alone = F.col("kinds") == 1
    kinds = heads.groupBy("sign").agg(F.count("*").alias("kinds"))
    known = heads.join(kinds, "sign")
    # Members against the head of their class.
    one = texts.join(shared.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    held = shared.join(heads.select("sign", "run", F.col("doc_id").alias("b"), F.col("first").alias("r")), ["sign", "run"]).where("doc_id != b or first != r")
    links = held.select("id", F.col("doc_id").alias("a"), F.col("first").alias("p"), "b", "r", (F.col("last") - F.col("first") + span).alias("n"))
    # Starts of the heads, where classes of one signature differ.
    asked = known.where(~alone).groupBy("doc_id").agg(F.collect_list(F.struct("run", "sign", "first", "last", "low")).alias("runs"))
    starts = cut_lineage(asked.join(one, "doc_id").select("text", "runs").mapInPandas(_starts(span), "sign bigint, run bigint, key bigint, at bigint"))
    met = starts.join(heads.select("run", "sign", "doc_id", "first", "least", "most"), ["sign", "run"])
    meets = met.groupBy("key", "sign").agg(F.min(F.struct("doc_id", "first", "at", "run")).alias("m"), F.min("least").alias("least"), F.max("most").alias("most"), F.bit_xor(F.xxhash64("run")).alias("who"), F.count("*").alias("n"))
    meets = cut_lineage(meets.where("least < most").select("key", "sign", "who", "n", F.col("m.run").alias("head"), F.col("m.doc_id").alias("b"), (F.col("m.first") + F.col("m.at")).alias("r")))
    pairs = starts.join(meets, ["sign", "key"]).join(heads.select("run", "sign", F.col("doc_id").alias("a"), "first"), ["sign", "run"])
    # Neighbouring starts that meet the same classes make one stretch.
    step = Window.partitionBy("run", "who", "n", "b", F.col("r") - F.col("at")).orderBy("at")
    stretch = cut_lineage(
        pairs.withColumn("part", F.col("at") - F.row_number().over(step))
        .groupBy("run", "sign", "a", "first", "who", "n", "b", (F.col("r") - F.col("at")).alias("shift"), "part")
        .agg(F.min("at").alias("lo"), (F.max("at") + span).alias("hi"), F.min_by("key", "at").alias("key"))
        .withColumn("id", -1 - F.monotonically_increasing_id())
    )
    more = stretch.select("id", "a", (F.col("first") + F.col("lo")).alias("p"), "b", (F.col("shift") + F.col("lo")).alias("r"), (F.col("hi") - F.col("lo")).alias("n")).where("a != b or p != r")
    bad = cut_lineage(_differing(links.unionByName(more), one))
    if bad.limit(1).count():
        shared, stretch = shared.join(bad, "id", "left_anti"), stretch.join(bad, "id", "left_anti")
    whole = known.where(alone & (F.col("least") < F.col("most"))).select("run", "sign", F.col("run").alias("span_id"), F.lit(0).alias("lo"), (F.col("last") - F.col("first") + span).alias("hi"))
    # A stretch is named by its first start, so classes that meet along it share the name.
    parts = stretch.select("run", "sign", F.col("key").alias("span_id"), "lo", "hi")
    groups = shared.join(whole.unionByName(parts), ["sign", "run"]).select(
        "sign", "span_id", F.col("doc_id").alias("class_id"), (F.col("first") + F.col("lo")).alias("begin"), (F.col("first") + F.col("hi")).alias("end")
    )
    return classes, cut_lineage(groups)


def document_pairs(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: groups and copies, written out for every two documents.

    Of groups with the same members one is written out.
    """
    members = groups.select("sign", "span_id", F.col("class_id").alias("c")).distinct()
    sets = members.groupBy("sign", "span_id").agg(F.bit_xor(F.xxhash64("c")).alias("who"), F.count("*").alias("n"), F.min("c").alias("least"), F.max("c").alias("most")).where("n > 1")
    once = sets.groupBy("who", "n", "least", "most").agg(F.min(F.struct("sign", "span_id")).alias("s")).select("s.*")
    kept = cut_lineage(members.join(once, ["sign", "span_id"], "left_semi"))
    links = kept.select("sign", "span_id", F.col("c").alias("a")).join(kept.select("sign", "span_id", F.col("c").alias("b")), ["sign", "span_id"]).where("a < b").select("a", "b").distinct()
    m = classes.select("class_id", "doc_id")
    across = (
        links.join(m.select(F.col("class_id").alias("a"), F.col("doc_id").alias("x")), "a")
        .join(m.select(F.col("class_id").alias("b"), F.col("doc_id").alias("y")), "b")
        .select("x", "y")
    )
    within = m.select("class_id", F.col("doc_id").alias("x")).join(m.select("class_id", F.col("doc_id").alias("y")), "class_id").where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def shared_shares(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_chars, n_copies, shared_chars, shared_share): how much of each document is elsewhere.

    A document with exact copies is shared whole. Its links are the groups of its class_id.
    """
    each = groups.groupBy("class_id", "begin").agg(F.max("end").alias("end"))
    w = Window.partitionBy("class_id").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(w), F.lit(0))
    covered = each.withColumn("reach", reach).groupBy("class_id").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("begin", "reach"))).alias("chars"))
    size = classes.groupBy("class_id").agg(F.count("*").alias("n_copies"))
    chars = F.when(F.col("n_copies") > 1, F.col("n_chars")).otherwise(F.coalesce("chars", F.lit(0))).cast("bigint")
    return (
        classes.join(size, "class_id").join(covered, "class_id", "left")
        .select("doc_id", "class_id", F.col("n_chars").cast("bigint").alias("n_chars"), "n_copies", chars.alias("shared_chars"))
        .withColumn("shared_share", F.round(F.col("shared_chars") / F.col("n_chars"), 6))
    )
