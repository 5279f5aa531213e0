"""BM25 in packed blocks against brute force, and what a search writes and shuffles."""

import math
import os
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import bm25, lexical
from lodestone.session import checkpoint_dir


def corpus(chunks, queries, words=60, scopes=1):
    """Chunks of frequent and rare words, many of them alike; queries likewise."""
    r = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{int(x)}" for x in np.minimum(r.zipf(1.3, n), words))
    docs = [(f"c{i:05d}", f"s{i % scopes}", text(r.integers(0, 12)) if i % 7 else "w1 w2") for i in range(chunks)]
    return docs, [(f"q{i:04d}", f"s{i % scopes}", text(r.integers(1, 9))) for i in range(queries)]


def brute(docs, asked, k):
    out = []
    for s in {d[1] for d in docs}:
        own = [(i, Counter(t.split())) for i, x, t in docs if x == s]
        df = Counter(t for _, c in own for t in c)
        mean = sum(sum(c.values()) for _, c in own) / len(own) or 1.0
        for q, x, text in asked:
            if x != s:
                continue
            found = []
            for i, c in own:
                score = 0.0
                for t, m in Counter(text.split()).items():
                    if c[t]:
                        score += m * max(math.log((len(own) - df[t] + 0.5) / (df[t] + 0.5) + 1), 1e-6) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean))
                if (score := math.floor(score * 1e6 + 0.5) / 1e6) > 0:
                    found.append((q, i, score))
            out += sorted(found, key=lambda x: (-x[2], x[1]))[:k]
    return sorted(out)


@pytest.mark.parametrize("scopes", [1, 3])
@pytest.mark.parametrize("sizes", [{}, {"LEAST": 10**9}, {"CHUNKS": 50, "QUERIES": 7, "JOINED": 300, "HELD": 500}, {"DENSE": 2000, "QUERIES": 64, "SHARE": 0.02}])
def test_best_of_blocks(monkeypatch, scopes, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(bm25, name, value)
    docs, asked = corpus(900, 240, scopes=scopes)
    tokens, names = sorted({t for _, _, x in asked for t in x.split()}), sorted({s for _, s, _ in asked})
    terms = [(n, names.index(s) * len(tokens) + tokens.index(t), m) for n, (_, s, x) in enumerate(asked) for t, m in Counter(x.split()).items()]
    pairs = np.unique([p for _, p, _ in terms])
    held = lambda v: SimpleNamespace(value=v)
    batches = []
    for lo in range(0, len(docs), 400):
        part = docs[lo : lo + 400]
        kind = pa.list_(pa.struct([("token", pa.string()), ("w", pa.int32())]))
        cols = [[d[0] for d in part], [d[1] for d in part], [len(d[2].split()) for d in part], [True] * len(part)]
        lists = pa.array([[{"token": t, "w": 1} for t in d[2].split()] for d in part], kind)
        batches.append(pa.record_batch([*map(pa.array, cols), lists], names=["chunk_id", "s", "length", "kept", "terms"]))
    packed = list(bm25.pack(held(bm25.Vocabulary(tokens, names, pairs)), bm25.CHUNKS)(iter(batches)))
    counts = packed.pop().to_pylist()[0]
    df, n, total = (np.zeros(m, np.int64) for m in (len(pairs), len(names), len(names)))
    df[counts["pair"]], n[counts["scope"]], total[counts["scope"]] = counts["df"], counts["n"], counts["total"]
    terms.sort(key=lambda x: x[1])
    pair, of = np.searchsorted(pairs, [p for _, p, _ in terms]), pairs // len(tokens)
    idf = np.maximum(np.log((n[of] - df + 0.5) / (df + 0.5) + 1), 1e-6)
    a = bm25.Asked(np.searchsorted(pair, np.arange(len(pairs) + 1)), np.array([q for q, _, _ in terms], np.int32), idf[pair] * [m for *_, m in terms], df, n, total / n, of, pa.array([q[0] for q in asked]))
    assert bool(bm25._matrices(a)[1]) == ("LEAST" not in sizes)
    got = [tuple(r.values()) for b in bm25.find(held(a), 5)(iter(packed)) for r in b.to_pylist()]
    assert sorted(got) == brute(docs, asked, 5)


def indexed(spark, docs):
    df = spark.createDataFrame(docs, "chunk_id string, scope string, content string").repartition(4)
    return lexical.lazy_index(df, "chunk_id", {"content": F.col("content")}, (), F.col("scope"))


def test_pairs_of_query_and_chunk_are_no_rows(spark):
    docs, asked = corpus(600, 150)
    found = lexical.search(indexed(spark, docs), spark.createDataFrame(asked, "query_id string, scope string, text string"), 4)
    assert sorted((r.query_id, r.chunk_id, r.score) for r in found.collect()) == brute(docs, asked, 4)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()  # sums by query and chunk


def written(spark):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(checkpoint_dir(spark).removeprefix("file:")) for f in files)


@pytest.mark.parametrize("scopes", [1, 40])
def test_search_writes_less_than_the_text(spark, scopes):
    docs, asked = corpus(4000, 200, scopes=scopes)
    docs = [(i, s, f"{t} {t} {t} {t}") for i, s, t in docs]
    before = written(spark)
    found = lexical.search(indexed(spark, docs), spark.createDataFrame(asked, "query_id string, scope string, text string"), 4, where=F.col("chunk_id") > "c02000")
    assert found.count() > 400 and min(r.chunk_id for r in found.collect()) > "c02000"
    assert written(spark) - before < sum(len(t) for *_, t in docs)


def test_upkeep_before_tokens(spark):
    chunks = spark.createDataFrame([("a", "v1", "one"), ("b", "v1", "two"), ("c", "v1", "two three")], "chunk_id string, scope string, content string")
    both = lexical.clone(chunks, "v1", "v2")
    left = lexical.remove(both, spark.createDataFrame([("a",)], "chunk_id string"), "v2")
    version = lexical.upsert(left, spark.createDataFrame([("b", "v2", "four")], chunks.schema))
    assert "Exchange hashpartitioning" not in version._jdf.queryExecution().executedPlan().toString()  # chunks aren't moved
    index = lexical.lazy_index(version, "chunk_id", {"content": F.col("content")}, (), F.col("scope"), scan=False)
    asked = spark.createDataFrame([("q", "v2", "one two three four"), ("p", "v1", "one two three four")], "query_id string, scope string, text string")
    assert sorted((r.query_id, r.chunk_id) for r in lexical.search(index, asked).collect()) == [("p", "a"), ("p", "b"), ("p", "c"), ("q", "b"), ("q", "c")]
