"""Mixing sources to target weights.

Temperature mixing: a source's natural share p of the tokens is raised to an exponent. With one exponent for all, p ** x
normalised, it is bisected to a target entropy or to the limits that max_repeats sets (``temperature_weights``). Ten
given shares can't be met by one exponent, so with targets t each source goes from its natural share towards its target,
p ** (1 - x) * t ** x, on an exponent of its own, bisected to the largest that its repetition limit allows
(``target_weights``): a source with x = 1 holds its target, one with x < 1 must fall short.

The weights become token budgets, which are realised as block permutations: each pass over a source is a random
permutation of its documents, cut into blocks of about ``block_tokens``; the last pass ends where the budget does.
position spreads the blocks of every source evenly, so rows sorted by it hold the weights in every stretch. All cuts
come from token sums per slice of a permutation, so no task ever orders a whole source.
"""

from __future__ import annotations

import base64
import math
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut_lineage, spread

VOCABULARY = os.environ.get("LODESTONE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the public split pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICES = 4096
BLOCK_TOKENS = 1_000_000
PIECE = 100_000
_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    """The byte-level tokenizer of a vocabulary file, once a worker."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


_CUT = re.compile(r"(?<=[^\W_])(?=\s)")


def _count(text: str | None, enc) -> int:
    """Tokens of a text; long ones piece by piece, cut only where a letter or digit ends before a blank, which no token spans."""
    if not text:
        return 0
    n, i = 0, 0
    while len(text) - i > PIECE and (m := _CUT.search(text, i + PIECE)):
        n += len(enc.encode_ordinary(text[i : m.start()]))
        i = m.start()
    return n + len(enc.encode_ordinary(text[i:]))


def _counted(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": [_count(t, enc) for t in b["text"]]})

    return run


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens): source trimmed and in lower case; a null or empty text has 0 tokens."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.nullif(F.lower(F.trim("source")), F.lit("")).alias("source"), "text").where("doc_id is not null")
    return spread(rows).mapInPandas(_counted(vocabulary), "doc_id bigint, source string, tokens bigint").groupBy("doc_id").agg(F.max(F.struct("source", "tokens")).alias("r")).select("doc_id", "r.*")


def char_counts(documents: DataFrame) -> DataFrame:
    """token_counts() with code points as the size."""
    source = F.nullif(F.lower(F.trim("source")), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.struct(source.alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("tokens")).alias("r"))
    return rows.where("doc_id is not null").groupBy("doc_id").agg(F.max("r").alias("r")).select("doc_id", "r.*")


def _bisect(f, low: float, high: float, rounds: int = 200) -> float:
    """Where the increasing f crosses 0 between low and high."""
    for _ in range(rounds):
        mid = (low + high) / 2
        if f(mid) < 0:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def temperature_weights(shares: dict[str, float], entropy: float | None = None, limits: dict[str, float] | None = None) -> tuple[dict[str, float], float]:
    """(weights, exponent): shares ** exponent, normalised, with the entropy (nats) wanted or none above its limit.

    The exponent lies between 0 (all equal) and 1 (natural shares). An entropy beyond both ends takes the nearer end;
    limits (the greatest weight a source can bear) take the smallest exponent that keeps them, 1 if none does.
    """
    live = {k: v for k, v in shares.items() if v > 0}

    def at(x: float) -> dict[str, float]:
        w = {k: v**x for k, v in live.items()}
        total = sum(w.values())
        return {k: v / total for k, v in w.items()}

    def h(x: float) -> float:
        return -sum(v * math.log(v) for v in at(x).values() if v > 0)

    if not live:
        return {}, 1.0
    if entropy is not None:
        x = 0.0 if entropy >= h(0.0) else 1.0 if entropy <= h(1.0) else _bisect(lambda x: entropy - h(x), 0.0, 1.0)
    elif limits is not None:
        over = lambda x: max((v - limits.get(k, 1.0) for k, v in at(x).items()), default=0.0)
        x = 0.0 if over(0.0) <= 0 else 1.0 if over(1.0) > 0 else _bisect(lambda x: -over(x) - 1e-15, 0.0, 1.0)
    else:
        x = 1.0
    return at(x), x


def target_weights(shares: dict[str, float], targets: dict[str, float], limits: dict[str, float], redistribute: bool = False) -> dict[str, tuple[float, float | None]]:
    """{source: (weight, exponent)}: share ** (1 - x) * target ** x with the largest x up to 1 that keeps the limit.

    limits: the greatest weight that a source can bear, its share times max_repeats. A source without tokens or repeats
    has weight 0 and no exponent. redistribute: what short sources lack goes to those below their limits, in proportion.
    """
    out: dict[str, tuple[float, float | None]] = {}
    for s, t in targets.items():
        p, most = shares.get(s, 0.0), limits.get(s, 0.0)
        if p <= 0 or most <= 0 or t <= 0:
            out[s] = (0.0, 1.0 if t <= 0 else None)
            continue
        at = lambda x: p ** (1 - x) * t**x
        # Where the target is above its limit the weight grows with x from the share, which any repetition allows.
        x = 1.0 if t <= most else _bisect(lambda x: at(x) - most, 0.0, 1.0)
        out[s] = (at(x) if x == 1 else min(at(x), most), x)
    while redistribute:
        lack = 1 - sum(w for w, _ in out.values())
        free = {s: w for s, (w, _) in out.items() if 0 < w < limits[s] * (1 - 1e-12)}
        if lack <= 1e-12 or not free:
            break
        for s, w in free.items():
            out[s] = (min(limits[s], w * (1 + lack / sum(free.values()))), out[s][1])
    return out


def source_plan(counts: DataFrame, targets: DataFrame, redistribute: bool = False) -> DataFrame:
    """(source, documents, tokens, target_share, max_repeats, budget, weight, exponent, short): one row a source of targets.

    counts: of token_counts(). The size of the mix is the tokens of all documents whose source is in targets. short:
    the exponent stops before the target, as the source's tokens times max_repeats are fewer than its share of the size.
    Repeated rows of targets count once, the greatest share holding; null shares and repeats count as 0; null sources
    are left out. The plan has one row a row of targets, so it is worked out on the driver.
    """
    spark = counts.sparkSession
    goal = targets.select(F.nullif(F.lower(F.trim("source")), F.lit("")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("repeats"))
    goal = goal.where("source is not null").groupBy("source").agg(F.max(F.struct("share", "repeats")).alias("r")).select("source", "r.share", "r.repeats")
    have = counts.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    rows = goal.join(have, "source", "left").select("source", "share", "repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens")).collect()
    size = sum(r["tokens"] for r in rows)
    kind = "source string, documents bigint, tokens bigint, target_share double, max_repeats int, budget bigint, weight double, exponent double, short boolean"
    most = {r["source"]: r["tokens"] * max(0, r["repeats"]) for r in rows}
    # A target that is met to the token isn't missed by the rounding of its limit.
    limits = {r["source"]: max(most[r["source"]] / size, r["share"] if most[r["source"]] >= r["share"] * size else 0.0) for r in rows} if size else {}
    w = target_weights({r["source"]: r["tokens"] / size for r in rows} if size else {}, {r["source"]: r["share"] for r in rows}, limits, redistribute)
    out = []
    for r in rows:
        weight, x = w[r["source"]]
        short = bool(size) and (x is None or x < 1)
        budget = most[r["source"]] if short else min(round(weight * size), most[r["source"]])
        out.append((r["source"], r["documents"], r["tokens"], float(r["share"]), r["repeats"], int(budget), float(weight), x, short))
    return spark.createDataFrame(sorted(out, key=lambda r: r[0]), kind)


def tempered_plan(counts: DataFrame, targets: DataFrame, entropy: float | None = None) -> DataFrame:
    """source_plan() without targets: temperature_weights() with one exponent, for an entropy in nats or, none given, the flattest mix that keeps every max_repeats."""
    spark = counts.sparkSession
    base = source_plan(counts, targets)
    rows = base.collect()  # one row a row of targets
    size = sum(r["tokens"] for r in rows)
    shares = {r["source"]: r["tokens"] / size for r in rows if size}
    w, x = temperature_weights(shares, entropy, None if entropy is not None else {r["source"]: shares.get(r["source"], 0.0) * max(0, r["max_repeats"]) for r in rows})
    out = [
        (r["source"], r["documents"], r["tokens"], r["target_share"], r["max_repeats"], min(round(w.get(r["source"], 0.0) * size), r["tokens"] * max(0, r["max_repeats"])), w.get(r["source"], 0.0), x,
         w.get(r["source"], 0.0) * size > r["tokens"] * max(0, r["max_repeats"]) + 1)
        for r in rows
    ]
    return spark.createDataFrame(out, base.schema)


def mix(counts: DataFrame, plan: DataFrame, seed: int = 7, slices: int = SLICES, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, source, tokens, pass, block, position): one row each time that a document is in the mix.

    Each pass is a permutation of the source of its own, cut into blocks of about block_tokens by its slices; the last
    one ends with the document that just stays within the budget. So no document comes more than max_repeats times, and
    a source falls short of its budget by less than the document at the cut. position, from 0 to 1, is the place of the
    document's slice in its source's budget. Ties of the permutation's key go by doc_id.
    """
    quota = plan.where("tokens > 0 and budget > 0").select("source", F.col("tokens").alias("size"), "budget")
    keyed = (
        counts.join(F.broadcast(quota), "source")  # one row a source of the plan
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.expr("cast((budget - 1) div size as int)"))))
        .withColumn("room", F.least("size", F.col("budget") - F.col("pass") * F.col("size")))
        .withColumn("key", F.xxhash64(F.lit(seed), "pass", "doc_id"))
        .withColumn("slice", F.pmod(F.shiftrightunsigned("key", 33), F.lit(slices)))
    )
    sums = keyed.groupBy("source", "pass", "slice").agg(F.sum("tokens").alias("t"))
    w = Window.partitionBy("source", "pass").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    rows = keyed.join(sums.select("source", "pass", "slice", "t", F.coalesce(F.sum("t").over(w), F.lit(0)).alias("before")), ["source", "pass", "slice"])
    inside = rows.where(F.col("before") + F.col("t") <= F.col("room"))
    cut = rows.where((F.col("before") <= F.col("room")) & (F.col("before") + F.col("t") > F.col("room")))
    k = Window.partitionBy("source", "pass", "slice").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("upto", F.col("before") + F.sum("tokens").over(k)).where("upto <= room").drop("upto")
    offset = F.col("pass") * F.col("size") + F.col("before")
    return inside.unionByName(cut).select(
        "doc_id", "source", "tokens", "pass", F.floor(offset / block_tokens).alias("block"), F.round(offset / F.col("budget"), 9).alias("position")
    )


def mix_report(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with what the mix holds: tokens_in, share_of_size (of the tokens of all sources), actual_share (of the mix)."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens_in"), (F.max("pass") + 1).alias("most_repeats"))
    every = Window.partitionBy(F.lit(1))
    return (
        plan.join(got, "source", "left")
        .withColumns({"tokens_in": F.coalesce("tokens_in", F.lit(0)), "most_repeats": F.coalesce("most_repeats", F.lit(0))})
        .withColumn("share_of_size", F.round(F.col("tokens_in") / F.nullif(F.sum("tokens").over(every), F.lit(0)), 6))
        .withColumn("actual_share", F.round(F.col("tokens_in") / F.nullif(F.sum("tokens_in").over(every), F.lit(0)), 6))
    )


def planned(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(counts, plan) with the counts written once."""
    counts = cut_lineage(token_counts(documents, vocabulary))
    return counts, source_plan(counts, targets)
