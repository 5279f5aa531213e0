"""The general data problems against brute force, with the hard cases of their tables."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import Row

from lodestone.operators import hierarchy as h
from lodestone.operators.orphans import orphan_counts, orphan_references
from lodestone.operators.snapshots import snapshot_changes

LINKS = "entity_id string, parent_id string, name string, status string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def brute(pairs):
    """{id: (root, depth, below, cycle)} by following links."""
    parent = {}
    for i, p in pairs:
        parent[i] = p
    out = {}
    for i in parent:
        way, x = [], i
        while x in parent and x not in way:
            way.append(x)
            x = parent[x]
        circle = way[way.index(x) :] if x in way else []
        out[i] = (None if circle else way[-1], None if circle else len(way) - 1, min(circle) if i in circle else None)
    return out


@pytest.mark.parametrize("bound", [100_000, 1])
def test_hierarchy_matches_links(spark, bound):
    rng = random.Random(3)
    ids = [f"{i:04x}" for i in range(300)]
    pairs = [(x, None if k < 8 else ids[rng.randrange(k)]) for k, x in enumerate(ids)]
    pairs += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("t1", "c2"), ("t2", "t1"), ("self", "self"), ("lost", "nowhere"), ("kid", "lost")]
    chain = [(f"z{i:03d}", f"z{i - 1:03d}" if i else None) for i in range(150)]
    pairs += chain
    df = spark.createDataFrame([(f" {i.upper()} ", p and f"{p} ", i, "clash") for i, p in pairs] + [(pairs[5][0], pairs[5][1], pairs[5][0], "again"), (None, "c1", "n", "x"), (" ", None, "n", "x")], LINKS)
    got = {r.node_id: r for r in h.hierarchy(df, "entity_id", "parent_id", "name", max_component=bound).collect()}
    want = brute(pairs)
    assert got.keys() == want.keys()
    for i, (root, depth, cycle) in want.items():
        assert (got[i].root_id, got[i].depth, got[i].cycle_id) == (root, depth, cycle), i
        if root:
            assert got[i].path == ".".join(got[i].path_ids) and got[i].path_ids[-1] == i
    circles = {r.node_id: r.cycle_id for r in h.cycles(df, "entity_id", "parent_id", max_component=bound).collect()}
    assert circles == {i: c for i, (_, _, c) in want.items() if c}
    assert got["z000"].n_descendants == 149 and got["c1"].n_descendants == 4 and got["t1"].n_descendants == 1
    assert got["lost"].status == "dangling" and got["kid"].status == "rooted" and got["t2"].status == "into_cycle" and got["self"].status == "cycle"


def test_descendants_are_every_row_below(spark):
    df = spark.createDataFrame([("a", None, "a", ""), ("b", "a", "b", ""), ("c", "b", None, "")], LINKS)
    placed = h.hierarchy(df, "entity_id", "parent_id", "name")
    assert rows(h.descendants(placed)) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]
    assert {r.path for r in placed.collect()} == {"a", "a.b", "a.b."}


@pytest.mark.parametrize("bound", [100_000, 1])
def test_all_descendants_have_circles_and_rows_below_them(spark, bound):
    links = {"a": None, "b": "a", "c1": "c2", "c2": "c3", "c3": "c4", "c4": "c1", "t1": "c2", "t2": "t1", "t3": "t1", "u": "c4", "self": "self", "s1": "self", "s2": "s1"}
    want = set()
    for i in links:
        x, n = links[i], 1
        while x and x != i and (x, i) not in {w[:2] for w in want}:
            want.add((x, i, n))
            x, n = links[x], n + 1
    df = spark.createDataFrame([(i, p, i, "") for i, p in links.items()], LINKS)
    placed = h.hierarchy(df, "entity_id", "parent_id", "name", max_component=bound)
    got = rows(h.all_descendants(placed))
    assert got == sorted(want, key=repr)
    assert {("c1", "c4", 1), ("c4", "c1", 3), ("c3", "t2", 3), ("t1", "t3", 1), ("self", "s2", 2)} <= set(got)
    assert {r.node_id: r.n_descendants for r in placed.collect()} == {i: sum(a == i for a, _, _ in got) for i in links}


def test_deep_chains(spark):
    """A walk holds one way down: rows leave as they are met. Circles are found below 50,000 links without any path."""
    n = 3_000
    rows_ = [(f"{i:06d}", f"{i - 1:06d}" if i else None, "x", False) for i in range(n)]
    depths = [r[4] for r in h.walk(rows_, "000000", ".")]
    assert depths == list(range(n))
    frames = list(h._walks(".")(iter([pd.DataFrame([("000000", *r) for r in rows_], columns=["label", "node_id", "parent_id", "name", "dangling"])])))
    assert sum(map(len, frames)) == n and max(f["path_ids"].map(len).sum() for f in frames) <= h.HELD_ENTRIES + n
    chain = spark.range(50_000).selectExpr("lpad(id, 6, '0') AS entity_id", "lpad(if(id = 0, 9, id - 1), 6, '0') AS parent_id", "'x' AS name", "'' AS path")
    assert {r.node_id for r in h.cycles(chain, "entity_id", "parent_id").collect()} == {f"{i:06d}" for i in range(10)}


def test_hierarchy_of_nothing(spark):
    assert h.cycles(spark.createDataFrame([], LINKS), "entity_id", "parent_id").count() == 0
    assert h.hierarchy(spark.createDataFrame([], LINKS), "entity_id", "parent_id", "name").count() == 0


T0 = datetime(2025, 1, 1)
ENT = "entity_id string, repository_id string, qualified_name string, indexed_at timestamp_ntz, deleted_at timestamp_ntz, reference_id string"
REF = "reference_id string, repository_id string, ref_kind string, target_qualified_name string, target_symbol_id string, status string, indexed_at timestamp_ntz"


@pytest.mark.parametrize(("heavy", "cast"), [(10**9, 10**6), (3, 10**6), (3, 1)])
def test_orphans_match_brute_force(spark, heavy, cast):
    rng = random.Random(5)
    ents, refs = [], []
    for i in range(60):
        born = T0 + timedelta(days=rng.randrange(100))
        ents.append((f" E{i % 50} ", "R1", f"n{i % 7} ", born, rng.choice([None, born + timedelta(days=rng.randrange(1, 60))]), "clash"))
    ents += [(None, "r1", "n0", T0, None, ""), ("e99", None, "n1", T0, None, ""), ("e98", "r1", None, T0, None, "")]
    for i in range(400):
        refs.append((f"r{i}", " r1", rng.choice(["call", "CALL "]), rng.choice(["n0", " n1", "n2", "n9", None]), rng.choice([None, " ", "e1", "E2 ", f"e{rng.randrange(60)}"]), rng.choice(["resolved", " Resolved", "external"]), rng.choice([T0 + timedelta(days=rng.randrange(150)), None] if i % 9 == 0 else [T0 + timedelta(days=rng.randrange(150))])))
    refs += refs[:20] + [(None, "r1", "call", "n0", None, "resolved", T0)]
    ids = {}
    for e, r, q, b, d, _ in ents:
        if e:
            k = e.strip().lower()
            x = ids.setdefault(k, [b, [], set()])
            x[0] = min(x[0], b)
            x[1].append(d)
            x[2].add((r and r.lower(), q and q.strip()))
    life = {k: (b, None if None in d else max(d)) for k, (b, d, _) in ids.items()}

    def living(k, t):
        return life[k][0] <= t and (life[k][1] is None or t < life[k][1])

    want = set()
    # names: a life of a name is that of an entity's rows under the name
    named = {}
    for e, r, q, b, d, _ in ents:
        if e and r and q:
            x = named.setdefault((r.lower(), q.strip(), e.strip().lower()), [b, []])
            x[0] = min(x[0], b)
            x[1].append(d)
    for ref, repo, _, q, s, st, t in refs:
        if st.strip().lower() != "resolved" or ref is None:
            continue
        s = s and s.strip().lower() or None
        q = q and q.strip()
        if t is None:
            ok = False
        elif s:
            ok = s in life and living(s, t)
        else:
            ok = any(k[:2] == (repo.strip(), q) and b <= t and (None in d or t < max(d)) for k, (b, d) in named.items())
        if not ok:
            want.add(ref)
    got = orphan_references(spark.createDataFrame(refs, REF), spark.createDataFrame(ents, ENT), heavy, cast)
    assert {r.reference_id for r in got.collect()} == want
    assert sum(r.n_orphans for r in orphan_counts(got).collect()) == len(want)


def test_orphans_of_nothing(spark):
    e, r = spark.createDataFrame([], ENT), spark.createDataFrame([("r", "x", "call", "n", None, "resolved", T0)], REF)
    assert orphan_references(r, e).count() == 1
    assert orphan_references(spark.createDataFrame([], REF), e).count() == 0


SNAP = "repository_id string, snapshot_no int, path string, content_hash string, old_hash string"
DELIVERED = "repository_id string, snapshot_no int"


def test_snapshot_changes_match_sets(spark):
    rng = random.Random(7)
    listings, known = [], []
    for repo in ("a", "b"):
        for no in (1, 2, 4, 7):
            known.append((repo, no))
            if (repo, no) == ("b", 4):
                continue  # delivered, but empty
            for p in range(30):
                if rng.random() < 0.8:
                    listings.append((repo, no, rng.choice(["./d/{}.py", "d\\{}.py", "d/{}.py"]).format(p), rng.choice([None, "AB", "sha256:ab", "cd"]), "clash"))
    listings += [("a", 3, "d/only_undelivered.py", "ab", ""), ("a", None, "x", "ab", ""), (None, 1, "x", "ab", ""), ("a", 1, None, "ab", "")] + listings[:15]
    state = {}
    for r, n, p, x, _ in listings:
        if None in (r, n, p):
            continue
        p = p.replace("\\", "/").removeprefix("./")
        x = x and x.lower().removeprefix("sha256:")
        s = state.setdefault((r, n), {})
        s[p] = max(s.get(p) or "", x or "") or None
    want = set()
    for r in ("a", "b"):
        nos = sorted(n for q, n in known if q == r)
        for a, b in zip(nos, nos[1:]):
            x, y = state.get((r, a), {}), state.get((r, b), {})
            want |= {(r, b, p, "ADDED") for p in y.keys() - x.keys()} | {(r, b, p, "DELETED") for p in x.keys() - y.keys()} | {(r, b, p, "MODIFIED") for p in x.keys() & y.keys() if x[p] != y[p]}
    got = snapshot_changes(spark.createDataFrame(listings, SNAP), spark.createDataFrame(known + known[:2], DELIVERED))
    assert {tuple(r)[:4] for r in got.collect()} == want and got.count() == len(want)
    assert snapshot_changes(spark.createDataFrame([], SNAP), spark.createDataFrame([], DELIVERED)).count() == 0
    assert isinstance(got.first(), Row)
