"""Nearest neighbours of one partition against brute force."""

from types import SimpleNamespace

import numpy as np
import pandas as pd

from lodestone.operators import vector


def test_batches_give_only_what_reaches_the_best_so_far():
    r = np.random.default_rng(1)
    q = vector._units(pd.Series(list(r.integers(-2, 3, (300, 4)).astype(float))))
    x, ids = r.integers(-2, 3, (5000, 4)).astype(float), r.permutation(5000)  # many ties
    batches = [pd.DataFrame({"chunk_id": ids[i : i + 900], "vector": list(x[i : i + 900])}) for i in range(0, 5000, 900)]
    got = pd.concat(vector._best(SimpleNamespace(value=(np.arange(300), q)), 7)(iter(batches)))
    assert len(got) < 300 * 7 * len(batches)
    got = got.sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True]).groupby("query_id").head(7)
    s = np.clip(np.round(q @ vector._units(pd.Series(list(x))).T, 6), -1, 1) + 0.0
    want = [ids[np.lexsort((ids, -s[i]))[:7]] for i in range(300)]
    assert got["chunk_id"].tolist() == np.concatenate(want).tolist()


def test_a_partition_gives_the_k_best_once(monkeypatch):
    for name, value in {"QUERIES": 64, "ROWS": 300, "EXACT": 50, "HELD": 2000}.items():
        monkeypatch.setattr(vector, name, value, raising=False)
    r = np.random.default_rng(2)
    base = vector._units(pd.Series(list(r.standard_normal((40, 64)))))
    x = base[r.integers(0, 40, 3000)] + 1e-7 * r.integers(0, 3, (3000, 64))  # closer than single precision tells apart
    q, ids = vector._units(pd.Series(list(base[r.integers(0, 40, 200)]))), np.array([f"{i:04d}" for i in r.permutation(3000)], dtype=object)
    batches = [pd.DataFrame({"chunk_id": ids[i : i + 700], "vector": list(x[i : i + 700])}) for i in range(0, 3000, 700)]
    got = pd.concat(vector._best(SimpleNamespace(value=(np.arange(200), q)), 7)(iter(batches)))
    assert len(got) == 200 * 7
    s = np.clip(np.round(q @ vector._units(pd.Series(list(x))).T, 6), -1, 1) + 0.0
    assert got["chunk_id"].tolist() == np.concatenate([ids[np.lexsort((ids, -s[i]))[:7]] for i in range(200)]).tolist()
