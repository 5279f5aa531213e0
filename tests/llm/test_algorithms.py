"""Packing, Borda ranking and mixing against brute force, their invariants and hard cases."""

import math
import os
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from lodestone.llm import borda, mixture, packing

ITEM = (
    "query_id string, candidate_id string, config_id int, final_score double, file_path string, qualified_name string, symbol_name string, node_kind string, code_tokens int, header_tokens int, "
    "token_count int, packed_at timestamp_ntz, capacity string, context string"
)
CONFIG = "config_id int, max_context_tokens int, reserved_system_tokens int, reserved_query_tokens int, reserved_output_tokens int, safety_margin_tokens int"
DAY = datetime(2025, 1, 1)


def items(spark, n=400, queries=4, seed=1):
    rng = random.Random(seed)
    rows = []
    for q in range(queries):
        for i in range(n):
            size = rng.choice([rng.randrange(0, 120), rng.randrange(60), 1000 if i % 50 == 0 else 7])
            rows.append((f" Q{q}", f"c{i}", q % 3 + 1, rng.choice([None, rng.random()]), f"src/a{i % 5}/f{i % 11}.py", f"m.n{i}", f"n{i % 9}", "class", size - 3, 3, rng.choice([None, size]), DAY, "x", "y"))
    rows += [(*rows[0][:10], 5, DAY + timedelta(1), "x", "y"), ("q0", "nosize", 1, None, None, None, None, None, None, 3, None, DAY, "x", "y"), ("q0", "noconf", 99, 0.1, None, None, None, None, 1, 1, 2, None, "x", "y"), (None, "c", 1, 0.0, "", "", "", "", 1, 1, 1, DAY, "", "")]
    return spark.createDataFrame(rows, ITEM)


def configs(spark):
    return spark.createDataFrame([(1, 300, 50, None, 50, 0), (2, 100, 0, 0, 0, 0), (3, 100, 200, 0, 0, 0), (4, 10, 0, 0, 0, 0)], CONFIG)


@pytest.mark.parametrize("window", [4096, 16])
def test_packing_keeps_everything_and_fits(spark, window):
    got = packing.pack(items(spark), configs(spark), window, 4).collect()
    by, fill = defaultdict(list), Counter()
    for r in got:
        by[r.query_id, r.candidate_id].append(r)
        if r.context is not None and r.piece != "full":
            fill[r.query_id, r.context] += r.tokens
            assert r.contexts == 1
    assert len(by) == 1602
    for (q, c), rs in by.items():
        size, cap = rs[0].size, rs[0].capacity
        pieces = sorted(r.piece for r in rs)
        if size is None or cap is None or (size > cap and cap == 0):
            assert pieces == ["unplaced"]
        elif size > cap:
            assert pieces == (["full", "rest"] if size % cap else ["full"])
            assert sum(r.tokens for r in rs) == size and next(r for r in rs if r.piece == "full").contexts == size // cap
        else:
            assert pieces == ["whole"] and rs[0].tokens == size
    caps = {r.query_id: r.capacity for r in got if r.capacity is not None}
    assert all(v <= caps[q] for (q, _), v in fill.items())
    for q in ("q0", "q1"):
        total, used = sum(v for (x, _), v in fill.items() if x == q), sum(1 for (x, _) in fill if x == q)
        assert used <= 11 / 9 * -(-total // caps[q]) + 8
    assert by["q0", "c0"][0].size == 5


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], ITEM), configs(spark)).count() == 0
    r = packing.packing_report(packing.pack(items(spark, 20, 2), configs(spark))).collect()
    assert {x.query_id for x in r} == {"q0", "q1"} and all(0 <= x.unused_share < 1 for x in r)


def test_a_query_across_partitions_is_packed_as_one(spark):
    n = 3000
    rows = [("q", f"c{i:05d}", 1, 0.0, f"d{i % 97}/f{i}.py", f"m{i}.n", "n", "class", 1, 1, 60 + i % 50, DAY, "", "") for i in range(n)]
    df, conf = spark.createDataFrame(rows, ITEM), configs(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = packing.pack(df, conf, 256, 8).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len({r.context.split("-")[0] for r in got}) > 1
    fill = Counter()
    for r in got:
        fill[r.context] += r.tokens
    assert max(fill.values()) <= 200 and len(got) == n
    assert len(fill) <= 1.1 * math.ceil(sum(fill.values()) / 200) + 10


def test_a_hot_query_leaves_a_bounded_number_of_contexts_open(spark):
    """One query of 200,000 items: each partition tells at most OPEN contexts, and all items are placed well."""
    n = 200_000
    df = spark.range(n).selectExpr(
        "'q' AS query_id", "concat('c', id) AS candidate_id", "1 AS config_id", "0.0D AS final_score", "concat('d', id % 97, '/f.py') AS file_path", "concat('m', id) AS qualified_name", "'n' AS symbol_name",
        "'class' AS node_kind", "1 AS code_tokens", "1 AS header_tokens", "cast(20 + id % 90 AS int) AS token_count", "timestamp_ntz'2025-01-01' AS packed_at",
    )
    got = packing.pack(df, configs(spark))
    r = packing.packing_report(got).first()
    assert r.n_items == n and r.unused_share < 0.05
    v = packing.packing_invariants(got).first()
    assert v.n_items == n and v.n_over == 0 and v.n_unplaced == 0 and v.tokens == v.placed


def test_hilbert_curve_takes_unit_steps():
    side = np.arange(8)
    grid = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert(grid, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


RESULT = "query_id string, chunk_id string, bm25_score double, vector_score double, graph_score double, retrieved_at timestamp_ntz, fused_score double, n bigint, rank int"


def results(spark):
    rng = random.Random(8)
    rows = []
    for q in range(12):
        for c in range(rng.randrange(1, 40)):
            score = lambda scale: rng.choice([None, float("nan"), float("inf"), *[round(rng.random(), 1) * scale] * 6])
            rows.append((f"Q{q} ", f"c{c:02d}", score(1000), score(0.001), score(1), DAY, 1e9, 7, 1))
    rows += [(f"q{q}", "zz", 2000.0, 1.0, 2.0, DAY, 0.0, 7, 1) for q in range(3)]
    rows += [("q0", "zz", 2000.0, 1.0, 2.0, DAY - timedelta(1), 0.0, 7, 1), (None, "c", 1.0, 1.0, 1.0, DAY, 0.0, 7, 1), ("lone", "c", None, None, None, DAY, 0.0, 7, 1)]
    return rows


def brute_borda(rows):
    latest = {}
    for q, c, *s, t, _, _, _ in rows:
        if q is None:
            continue
        k = (q.strip().lower(), c)
        if k not in latest or latest[k][0] < t:
            latest[k] = (t, [x if x is not None and math.isfinite(x) else None for x in s])
    by = defaultdict(dict)
    for (q, c), (_, s) in latest.items():
        by[q][c] = s
    out = {}
    for q, chunks in by.items():
        n, points, ranks = len(chunks), Counter(), defaultdict(list)
        for k in range(3):
            for c, s in chunks.items():
                mine = -math.inf if s[k] is None else s[k]
                others = [-math.inf if o[k] is None else o[k] for o in chunks.values()]
                r = 1 + sum(o > mine for o in others) + (sum(o == mine for o in others) - 1) / 2
                ranks[c].append(r)
                points[c] += n - r
        for place, c in enumerate(sorted(chunks, key=lambda c: (-points[c], c)), 1):
            out[q, c] = (ranks[c], place)
    return out


@pytest.mark.parametrize("hot", [10**6, 10])
def test_borda_matches_brute_force(spark, hot):
    rows = results(spark)
    df = spark.createDataFrame(rows, RESULT)
    ranked = borda.borda(df, hot_rows=hot)
    got = {(r.query_id, r.chunk_id): ([r.bm25_score_rank, r.vector_score_rank, r.graph_score_rank], r.fused_rank) for r in ranked.collect()}
    assert got == brute_borda(rows)
    first = {tuple(r) for r in borda.sound_first(ranked).collect()}
    assert {("q0", "zz"), ("q1", "zz"), ("q2", "zz")} <= first and ("lone", "c") not in first
    assert borda.borda(spark.createDataFrame([], RESULT)).count() == 0


def test_scale_does_not_matter(spark):
    rows = results(spark)
    one = borda.borda(spark.createDataFrame(rows, RESULT)).select("query_id", "chunk_id", "fused_rank")
    big = borda.borda(spark.createDataFrame([(q, c, b and b * 1e6, v, g, *r) for q, c, b, v, g, *r in rows], RESULT)).select("query_id", "chunk_id", "fused_rank")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, big.collect()))


def test_ndcg(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("p", "a", 1)], "query_id string, chunk_id string, fused_rank int")
    judged = spark.createDataFrame([("q", "b", 3), ("q", "a", 1), ("p", "x", 0), ("z", "x", 2)], "query_id string, chunk_id string, grade int")
    want = (1 + 3 / math.log2(3)) / (3 + 1 / math.log2(3))
    assert {r.query_id: r.ndcg for r in borda.ndcg(ranked, judged).collect()} == {"q": round(want, 6), "p": 0.0, "z": 0.0}


def test_temperature_meets_entropy_and_limits():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1, "none": 0.0}
    w, x = mixture.temperature_weights(shares, entropy=1.0)
    assert abs(-sum(v * math.log(v) for v in w.values()) - 1.0) < 1e-9 and 0 < x < 1
    assert mixture.temperature_weights(shares, entropy=9.0)[1] == 0 and mixture.temperature_weights(shares, entropy=0.1)[1] == 1
    w, x = mixture.temperature_weights(shares, limits={"c": 0.2})
    assert abs(w["c"] - 0.2) < 1e-6 and 0 < x < 1
    assert mixture.temperature_weights({}) == ({}, 1.0)


def test_target_weights_meet_target_or_limit():
    w = mixture.target_weights({"a": 0.7, "b": 0.3, "c": 0.0}, {"a": 0.2, "b": 0.7, "c": 0.1}, {"a": 1.4, "b": 0.6})
    assert abs(w["a"][0] - 0.2) < 1e-12 and w["a"][1] == 1.0 and w["c"] == (0.0, None)
    weight, x = w["b"]
    assert abs(weight - 0.6) < 1e-9 and 0 < x < 1 and abs(0.3 ** (1 - x) * 0.7**x - 0.6) < 1e-9
    assert mixture.target_weights({"a": 1.0}, {"a": 1.0}, {"a": 3.0})["a"] == (1.0, 1.0)
    assert mixture.target_weights({"a": 0.5}, {"a": 0.5}, {"a": 0.0})["a"] == (0.0, None)
    w = mixture.target_weights({"a": 0.2, "b": 0.4, "c": 0.4}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.2, "b": 0.4, "c": 1.2}, redistribute=True)
    assert abs(sum(v for v, _ in w.values()) - 1) < 1e-9 and abs(w["b"][0] - 0.4) < 1e-9 and abs(w["c"][0] - 0.4) < 1e-9


def test_long_texts_are_counted_as_they_are():
    if not os.path.exists(mixture.VOCABULARY):
        pytest.skip("no vocabulary")
    enc, was = mixture.encoding(mixture.VOCABULARY), mixture.PIECE
    rng = random.Random(3)
    texts = ["a" * 5000, "ab'll  x\n\n  y_" * 300, "".join(rng.choices("ab1 _'\n\té.", k=6000)), "x " * 2000, "  " * 2000 + "x", "_ " * 2000]
    try:
        mixture.PIECE = 50
        got = [mixture._count(t, enc) for t in texts]
    finally:
        mixture.PIECE = was
    assert got == [len(enc.encode_ordinary(t)) for t in texts]


DOC, TARGET = "doc_id bigint, text string, source string, tokens string, key int", "source string, target_share double, max_repeats int, tokens string"


@pytest.mark.skipif(not os.path.exists(mixture.VOCABULARY), reason="no vocabulary")
@pytest.mark.parametrize("slices", [4096, 3])
def test_mix(spark, slices):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "été", "x_1"], k=rng.randrange(1, 60))), rng.choice(["A", " a", "b", "c ", "other", None]), "", 0) for i in range(600)]
    docs += [(1000, None, "a", "", 0), (1001, "", "b", "", 0), docs[0], (None, "t", "a", "", 0), (1002, "word " * 60_000, "other", "", 0)]
    targets = [("a", 0.5, 2, ""), ("B ", 0.2, 3, ""), ("c", 0.25, 1, ""), ("gone", 0.05, 4, ""), ("c", 0.25, 1, ""), (None, 0.1, 1, "")]
    counts, plan = mixture.planned(spark.createDataFrame(docs, DOC), spark.createDataFrame(targets, TARGET))
    p = {r.source: r for r in plan.collect()}
    tokens = {r.doc_id: (r.source, r.tokens) for r in counts.collect()}
    assert len(tokens) == 603 and tokens[1000][1] == tokens[1001][1] == 0 and tokens[1002][1] == 60_001
    size = sum(t for s, t in tokens.values() if s in ("a", "b", "c"))
    assert p["gone"].short and p["gone"].budget == 0 and set(p) == {"a", "b", "c", "gone"}
    got = mixture.mix(counts, plan, slices=slices, block_tokens=500).collect()
    used, largest, times = Counter(), max(t for s, t in tokens.values() if s in p), defaultdict(set)
    for r in got:
        assert r["pass"] < p[r.source].max_repeats and r["pass"] not in times[r.doc_id] and 0 <= r.position <= 1
        times[r.doc_id].add(r["pass"])
        used[r.source] += r.tokens
    for s, r in p.items():
        assert r.short == (r.tokens * r.max_repeats < r.target_share * size) == (r.exponent is None or r.exponent < 1)
        assert r.budget - largest < used[s] <= r.budget or r.budget == used[s]
    # all documents come once before any comes twice, and passes are permutations of their own
    assert all(seen == set(range(len(seen))) or max(seen) == max(x["pass"] for x in got if x.source == tokens[d][0]) for d, seen in times.items())
    report = {r.source: r for r in mixture.mix_report(mixture.mix(counts, plan, slices=slices), plan).collect()}
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-4
    again = sorted(map(tuple, mixture.mix(counts, plan, slices=slices, block_tokens=500).collect()))
    assert again == sorted(map(tuple, got))
    if slices == 4096:  # in every third of the order each source holds its weight
        order, total = sorted(got, key=lambda r: r.position), sum(used.values())
        for k in range(3):
            part = Counter()
            for r in order[k * len(order) // 3 : (k + 1) * len(order) // 3]:
                part[r.source] += r.tokens
            assert all(abs(part[s] / sum(part.values()) - used[s] / total) < 0.1 for s in used)
    tempered = {r.source: r for r in mixture.tempered_plan(counts, spark.createDataFrame(targets, TARGET)).collect()}
    assert all(r.budget <= r.tokens * r.max_repeats for r in tempered.values()) and len({r.exponent for r in tempered.values()}) == 1
    empty, none = mixture.planned(spark.createDataFrame([], DOC), spark.createDataFrame(targets, TARGET))
    assert mixture.mix(empty, none).count() == 0 and none.where("short").count() == 0


def test_entry_has_these_queries():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"p{n}_found" for n in range(1, 11)} <= names
