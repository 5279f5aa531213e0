"""Evaluation texts leaking into training text.

An item is looked for by its passages: all its runs of ``words`` words, or the whole item where it is shorter, so the
windows of a document are as long as the items' passages. The CGK random walk embeds a window so that edit distance
becomes Hamming distance: a random bit of the word under the pointer says whether the pointer moves on, so two windows
meet again soon after an inserted, deleted or replaced word. Each repetition samples places of a walk and hashes the
words that stood there; windows within a few edits collide in some repetition with high probability, equal windows in
every one. A collision is verified word by word: the edit distance between the passage and the nearest of the document's
windows of size - k .. size + k words that begin there.

Documents are read once, where they lie. The items' keys, and their pairs of neighbouring words, become bit fields of a
bounded size, which alone are broadcast; windows with too many pairs that no passage has are never embedded, and what a document shuffles are the few windows with a key in it, and not even those while the items' keys are few enough
to be broadcast as a whole. Items never reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut_lineage, spread

WORDS = 13
MAX_EDITS = 1
#: Walks, samples of each walk, and places a sample keeps of a window of WORDS words, all for one edit.
WALKS, SAMPLES, PLACES = 8, 4, 10
#: Rows of item keys up to which they are broadcast (about 150 bytes each); above, the join shuffles.
BROADCAST_KEYS = 400_000
#: The bit field has 16 bits a key, up to 2**MAX_BITS in all (32 MB); a fuller field lets more windows through, no fewer.
MAX_BITS = 28
STEP = 200_000
_WORD = re.compile(r"[a-z0-9]+")
_ODD = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_ODD[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_ODD[1])
    return x ^ (x >> np.uint64(31))


class Walks:
    """The repetitions for windows of one size: random bits for each walk, and the places each sample keeps."""

    def __init__(self, size: int, walks: int, samples: int, sample: int, seed: int):
        rng = np.random.default_rng((seed, size))
        self.size = size
        # After j steps a pointer has passed about j / 2 words; later places mostly lie behind the window.
        reach = max(1, 5 * size // 3)
        odd = lambda n: rng.integers(1, 2**63, n, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        self.salts = odd(walks * (1 + reach // 64)).reshape(walks, -1)
        self.kept: list[list[dict[int, np.uint64]]] = []
        for _ in range(walks):
            places = [rng.choice(reach, min(sample, reach), replace=False) for _ in range(samples)]
            self.kept.append([dict(zip(p.tolist(), odd(len(p)))) for p in places])
        self.marks = odd(walks * samples)

    def keys(self, symbols: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """Each sample's keys of the windows of symbols that begin at starts; symbols end with a 0 more than the last window."""
        end = starts + self.size
        for w, samples in enumerate(self.kept):
            at = starts.copy()
            sums = [np.zeros(len(starts), dtype=np.uint64) for _ in samples]
            for j in range(max(max(s) for s in samples) + 1):
                if j % 64 == 0:
                    bits = _mix(symbols ^ self.salts[w, j // 64])
                seen = bits[at]
                if any(j in s for s in samples):
                    here = np.where(at < end, seen, np.uint64(0))
                    for total, s in zip(sums, samples):
                        if j in s:
                            total += here * s[j]
                at += ((seen >> np.uint64(j % 64)) & np.uint64(1)).view(np.int64)
                np.minimum(at, end, out=at)
            for k, total in enumerate(sums):
                yield _mix(total ^ self.marks[w * len(samples) + k])


@lru_cache(maxsize=64)
def repetitions(size: int, max_edits: int, seed: int) -> Walks:
    """Those of the operator: with k edits k times as many walks, each sample keeping fewer places."""
    k = max(1, max_edits)
    return Walks(size, WALKS * k, SAMPLES, max(2, PLACES * size // WORDS // k), seed)


def edits(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """For each row the least edit distance between a's and the first w - most .. w + most of b, w the width of a.

    Only the band of 2 * most + 1 diagonals is filled, which is exact up to most; farther rows come out above it.
    """
    n, w = a.shape
    far, width = most + 1, 2 * most + 1
    # band[k]: the distance between a's first x and b's first x + k - most
    band = [np.full(n, abs(k - most) if k >= most else far) for k in range(width)]
    for x in range(1, w + 1):
        last: list[np.ndarray] = []
        for k in range(width):
            y = x + k - most
            if y < 0 or y > b.shape[1]:
                last.append(np.full(n, far))
                continue
            best = band[k] + (a[:, x - 1] != b[:, y - 1]) if y else np.full(n, x)
            if k + 1 < width:
                best = np.minimum(best, band[k + 1] + 1)
            if k:
                best = np.minimum(best, last[k - 1] + 1)
            last.append(best)
        band = last
    return np.minimum.reduce(band)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class _Symbols:
    """Hashes of words, with those met before kept at hand."""

    def __init__(self):
        self.cache: dict[str, int] = {}

    def __call__(self, words: list[str]) -> list[int]:
        if len(self.cache) > 500_000:
            self.cache.clear()
        c, out = self.cache, []
        for w in words:
            h = c.get(w)
            if h is None:
                h = c[w] = xxhash.xxh64_intdigest(w) | 1
            out.append(h)
        return out


def _passages(words: int, min_words: int):
    """(item_id, size, passage): every passage of every item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for item, text in zip(b["item_id"], b["text"]):
                found = words_of(text)
                size = min(words, len(found))
                if found and size >= min_words:
                    out.extend((item, size, " ".join(found[s : s + size])) for s in range(len(found) - size + 1))
            yield pd.DataFrame(out, columns=["item_id", "size", "passage"])

    return run


def _passage_keys(max_edits: int, seed: int):
    """(key, passage_id, size, passage) of every repetition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = _Symbols()
        for b in batches:
            for size, g in b.groupby("size"):
                symbols = np.array([*(h for p in g["passage"] for h in hashed(p.split(" "))), 0], dtype=np.uint64)
                for key in repetitions(int(size), max_edits, seed).keys(symbols, np.arange(len(g)) * int(size)):
                    yield g.assign(key=key.view(np.int64))

    return run


def _pairs(symbols: np.ndarray) -> np.ndarray:
    """A hash of each two neighbouring symbols."""
    return _mix(symbols[:-1] * np.uint64(_ODD[0]) + symbols[1:] * np.uint64(_ODD[1] | 1))


def _passage_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashed = _Symbols()
    for b in batches:
        keys = [_pairs(np.array(hashed(p.split(" ")), dtype=np.uint64)) for p in b["passage"]]
        yield pd.DataFrame({"key": np.unique(np.concatenate(keys)).view(np.int64) if keys else np.zeros(0, np.int64)})


def _inside(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys have both of their bits in the field, as 0 and 1."""
    word = bits[((key >> np.uint64(6)) & np.uint64(len(bits) - 1)).view(np.int64)]
    return (word >> (key & np.uint64(63))) & (word >> (key >> np.uint64(58))) & np.uint64(1)


def _met(field, pair_field, sizes: list[int], max_edits: int, seed: int):
    """(key, doc_id, at, window) of every window whose key is in the bit field, with max_edits words more than the passage.

    An edit changes at most two of a window's pairs of neighbouring words, so windows of which more than 2 * max_edits
    pairs stand in no passage are left out before they are embedded: none of them can match.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, pair_bits = field.value, pair_field.value
        hashed = _Symbols()
        for b in batches:
            found = [words_of(t) for t in b["text"]]
            # Each text is followed by max_edits zeros, for windows that a deletion left shorter; one more ends them all.
            flat: list[int] = []
            first = []
            for f in found:
                first.append(len(flat))
                flat.extend(hashed(f))
                flat.extend([0] * max_edits)
            symbols = np.array([*flat, 0], dtype=np.uint64)
            strange = np.concatenate([[0], np.cumsum(1 - _inside(pair_bits, _pairs(symbols)).view(np.int64)), [0] * (max_edits + 2)])
            for size in sizes:
                n = np.array([max(0, len(f) - size + 1 + max_edits) if f else 0 for f in found])
                owner = np.repeat(np.arange(len(found)), n)
                starts = np.repeat(np.array(first) - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
                pairs = max(0, size - max_edits - 1)
                near = strange[starts + pairs] - strange[starts] <= 2 * max_edits
                starts, owner = starts[near], owner[near]
                for lo in range(0, len(starts), STEP):
                    s, o = starts[lo : lo + STEP], owner[lo : lo + STEP]
                    for key in repetitions(size, max_edits, seed).keys(symbols, s):
                        hit = np.flatnonzero(_inside(bits, key))
                        if len(hit):
                            at = s[hit] - np.array(first)[o[hit]]
                            windows = [" ".join(found[k][a : a + size + max_edits]) for k, a in zip(o[hit], at)]
                            yield pd.DataFrame({"key": key[hit].view(np.int64), "doc_id": b["doc_id"].to_numpy()[o[hit]], "at": at, "window": windows})

    return run


def _numbered(texts: pd.Series, width: int, number: dict[str, int]) -> np.ndarray:
    """A row of word numbers a text, -1 behind its end; each distinct text is split once."""
    which, distinct = pd.factorize(texts)
    out = np.full((len(distinct), width), -1, dtype=np.int64)
    for k, t in enumerate(distinct):
        got = [number.setdefault(w, len(number)) for w in t.split(" ")]
        out[k, : len(got)] = got
    return out[which]


def _verified(max_edits: int):
    """(doc_id, passage_id, at, edits): collisions whose words are within max_edits edits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.drop_duplicates(["doc_id", "at", "passage_id", "window"])
            number: dict[str, int] = {}
            for size, g in b.groupby("size"):
                e = edits(_numbered(g["passage"], int(size), number), _numbered(g["window"], int(size) + max_edits, number), max_edits)
                good = e <= max_edits
                yield g.loc[good, ["doc_id", "passage_id", "at"]].assign(edits=e[good])

    return run


def _bit_field(keys: DataFrame, n: int) -> np.ndarray:
    """Two bits a key in one of at most 2**MAX_BITS / 64 words. Only the words that hold a bit are brought here."""
    size = 1 << min(MAX_BITS, max(10, (16 * n).bit_length())) - 6
    word = F.shiftrightunsigned("key", 6).bitwiseAND(F.lit(size - 1))
    bits = F.expr("shiftleft(1L, cast(key & 63 as int)) | shiftleft(1L, cast(shiftrightunsigned(key, 58) as int))")
    rows = keys.select(word.alias("w"), bits.alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(size, dtype=np.uint64)
    out[rows["w"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def leaks(
    documents: DataFrame, items: DataFrame, words: int = WORDS, max_edits: int = MAX_EDITS, min_words: int | None = None, seed: int = 11, broadcast_keys: int = BROADCAST_KEYS
) -> DataFrame:
    """(doc_id, item_id, n_windows, least_edits): every document with a window within max_edits of a passage of the item.

    Words are maximal runs of a-z and 0-9 in the lower-cased text. A passage has ``words`` words; an item with fewer is
    one passage as a whole if it has min_words (none given: words), else it can't be a case. n_windows: the places in
    the document where a match begins. A pair with least_edits 0 is always found, as equal windows collide in every
    repetition; of windows one or two edits from a passage, inserted and deleted words included, more than 0.9 are
    found one by one (asserted by the tests over all edited windows; measured 0.97 and 0.99), and a document mostly has
    several. Texts that are
    null, empty or shorter than a window have none. Equal rows of a document or item count once; rows of one doc_id
    with other texts add their places. Null ids are no rows. Empty tables give no rows.
    """
    spark = documents.sparkSession
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    owned = cut_lineage(
        asked.mapInPandas(_passages(words, words if min_words is None else min_words), "item_id bigint, size int, passage string").distinct()
    )
    passages = cut_lineage(owned.select("size", "passage").distinct().withColumn("passage_id", F.monotonically_increasing_id()))
    keys = cut_lineage(passages.mapInPandas(_passage_keys(max_edits, seed), "key bigint, passage_id bigint, size int, passage string").distinct())
    sizes = sorted((r["size"], r["n"]) for r in keys.groupBy("size").agg(F.count("*").alias("n")).collect())  # at most `words` sizes
    n = sum(k for _, k in sizes)
    if not n:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, n_windows bigint, least_edits bigint")
    field = spark.sparkContext.broadcast(_bit_field(keys, n))
    pair_keys = cut_lineage(passages.mapInPandas(_passage_pairs, "key bigint").distinct())
    pair_field = spark.sparkContext.broadcast(_bit_field(pair_keys, pair_keys.count()))
    met = spread(docs).mapInPandas(_met(field, pair_field, [s for s, _ in sizes], max_edits, seed), "key bigint, doc_id bigint, at bigint, window string")
    near = met.join(F.broadcast(keys) if n <= broadcast_keys else keys, "key")
    close = near.mapInPandas(_verified(max_edits), "doc_id bigint, passage_id bigint, at bigint, edits bigint")
    found = close.join(passages.join(owned, ["size", "passage"]).select("passage_id", "item_id"), "passage_id")
    places = found.groupBy("doc_id", "item_id", "at").agg(F.min("edits").alias("edits"))
    return places.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_windows"), F.min("edits").alias("least_edits"))
