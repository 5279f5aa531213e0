"""What BM25 does in Python: postings of the asked tokens in packed blocks, and the best chunks of every query in them.

A pass has a vocabulary of asked pairs (scope, token), numbered. Tokens that many queries ask and many chunks have make
nearly all of the work; they are multiplied as matrices in single precision, whose error is bounded, and what may be
among the best is then summed exactly in double precision. All other tokens are joined one posting at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

K1, B = 1.5, 0.75
#: Chunks a matrix, queries a matrix, postings joined at once, numbers in the queries' matrix of a scope, and results held until they are cut to the k best.
CHUNKS, QUERIES, JOINED, DENSE, HELD = 4096, 512, 2_000_000, 16_000_000, 2_000_000
#: A token is multiplied if the share of queries times the share of chunks that have it is above this; below, joining its postings is less work.
SHARE = 0.002
#: Scopes with fewer queries are not worth a matrix.
LEAST = 64


@dataclass(frozen=True)
class Vocabulary:
    """tokens and scopes by number; pairs: scope number * len(tokens) + token number, ascending. A pair's number is its place there."""

    tokens: list[str]
    scopes: list[str]
    pairs: np.ndarray


@dataclass(frozen=True)
class Asked:
    """By pair, ascending by scope: the queries from start[p] to start[p + 1] of (query, weight), its chunks df, its scope. By scope: chunks n, mean length avgdl. By query: its id."""

    start: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    df: np.ndarray
    n: np.ndarray
    avgdl: np.ndarray
    scope_of: np.ndarray
    ids: pa.Array


def _ints(n: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(n, dtype=np.int32)


def pack(vocabulary, block: int = CHUNKS):
    """A function of batches (chunk_id, s, length, kept, terms) that gives rows (block, pair, df, scope, n, total): packed blocks of kept chunks, then the counts of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        token, scope, width = {t: i for i, t in enumerate(v.tokens)}, {s: i for i, s in enumerate(v.scopes)}, max(1, len(v.tokens))
        df, n, total = np.zeros(len(v.pairs), np.int64), np.zeros(len(v.scopes), np.int64), np.zeros(len(v.scopes), np.int64)
        for b in batches:
            sid = np.fromiter((scope.get(s, -1) for s in b["s"].to_pylist()), np.int64, b.num_rows)
            length, kept = b["length"].to_numpy(zero_copy_only=False).astype(np.int64), b["kept"].to_numpy(zero_copy_only=False).astype(bool)
            here = sid >= 0
            n += np.bincount(sid[here], minlength=len(n))
            total += np.bincount(sid[here], length[here], minlength=len(n)).astype(np.int64)
            terms = b["terms"]
            values = terms.flatten()
            coded = values.field("token").dictionary_encode()
            tid = np.fromiter((token.get(t, -1) for t in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)] if len(values) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
            ok = (tid >= 0) & here[row]
            row, tid, w = row[ok], tid[ok], values.field("w").to_numpy(zero_copy_only=False)[ok]
            wanted = sid[row] * width + tid
            pair = np.searchsorted(v.pairs, wanted)
            ok = pair < len(v.pairs)
            ok[ok] = v.pairs[pair[ok]] == wanted[ok]
            key, at = np.unique(row[ok] * len(v.pairs) + pair[ok], return_inverse=True)
            tf = np.bincount(at, w[ok], minlength=len(key)).astype(np.int64)
            row, pair = np.divmod(key, max(1, len(v.pairs)))
            df += np.bincount(pair, minlength=len(df))
            used = np.unique(row[kept[row]])  # chunks without an asked token can't be found
            bounds = np.searchsorted(row, used), np.searchsorted(row, used, "right")
            for lo in range(0, len(used), block):
                rows = used[lo : lo + block]
                first, last = bounds[0][lo : lo + block], bounds[1][lo : lo + block]
                size = last - first
                places = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                offsets = _ints(np.concatenate(([0], np.cumsum(size))))
                lists = {k: pa.ListArray.from_arrays(offsets, _ints(x[places])) for k, x in (("pair", pair), ("tf", tf))}
                packed = pa.record_batch({"chunk_id": b["chunk_id"].take(rows), "sid": _ints(sid[rows]), "length": _ints(length[rows]), **lists})
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, packed.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(packed)
                yield _row(sink.getvalue().to_pybytes())
        seen, some = np.flatnonzero(df), np.flatnonzero(n)
        yield _row(None, seen, df[seen], some, n[some], total[some])

    return run


PACKED = "block binary, pair array<int>, df array<bigint>, scope array<int>, n array<bigint>, total array<bigint>"


def _row(block: bytes | None, *counts: np.ndarray) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    cols = [pa.array([c], pa.list_(k)) for c, k in zip(counts or [None] * 5, kinds, strict=True)]
    return pa.record_batch([pa.array([block], pa.binary()), *cols], names=["block", "pair", "df", "scope", "n", "total"])


class _Best:
    """The k best (score, chunk_id) of every query so far; least has the score that a new one must reach."""

    def __init__(self, queries: int, k: int):
        self.k, self.least, self.tops = k, np.zeros(queries), np.zeros((queries, 0))
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.held, self.limit = 0, max(HELD, 0)

    def add(self, q: np.ndarray, score: np.ndarray, row: np.ndarray, place: np.ndarray, ids: pa.Array) -> None:
        """Chunks of one block, by their row in it; place: the order of their ids."""
        score = np.floor(score * 1e6 + 0.5) / 1e6
        ok = (score > 0) & (score >= self.least[q]) & np.isfinite(score)
        q, score, row = q[ok], score[ok], row[ok]
        if not len(q):
            return
        order = np.lexsort((place[row], -score, q))
        order = order[_first(q[order], self.k)]
        q, score, row = q[order], score[order], row[order]
        self._raise(q, score)
        self.parts.append((q, score, ids.take(pa.array(row))))
        self.held += len(q)
        if self.held > self.limit:
            self.cut()
            self.limit = max(HELD, 2 * self.held)

    def _raise(self, q: np.ndarray, score: np.ndarray) -> None:
        who, at = np.unique(q, return_inverse=True)
        old = self.tops[who]
        if not old.shape[1]:
            self.tops = np.zeros((len(self.least), self.k)) if len(self.least) * self.k <= 50_000_000 else self.tops
            if not self.tops.shape[1]:  # so many are asked for that thresholds cost more than they save
                return
            old = self.tops[who]
        start = np.searchsorted(at, np.arange(len(who)))
        new = np.zeros((len(who), self.k))
        new[at, np.arange(len(at)) - start[at]] = score
        both = np.sort(np.concatenate([old, new], axis=1), axis=1)[:, : -self.k - 1 : -1]
        self.tops[who], self.least[who] = both, both[:, -1]

    def cut(self) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
        if not self.parts:
            return None
        q, score = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        ids = pa.concat_arrays([p[2] for p in self.parts])
        ok = np.flatnonzero(score >= self.least[q])
        q, score, ids = q[ok], score[ok], ids.take(pa.array(ok))
        order = np.lexsort((_places(ids), -score, q))
        order = order[_first(q[order], self.k)]
        self.parts = [(q[order], score[order], ids.take(pa.array(order)))]
        self.held = len(order)
        return self.parts[0]


def _first(q: np.ndarray, k: int) -> np.ndarray:
    """Whether a row is among the first k of its query; q ascends."""
    return np.arange(len(q)) - np.searchsorted(q, q) < k


def _places(ids: pa.Array) -> np.ndarray:
    """The order of ids, nulls first."""
    order = pc.sort_indices(ids, null_placement="at_start").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place


def _matrices(a: Asked) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """column: the matrix column of each pair, -1 for those that are joined; by scope its queries and their matrix."""
    asks = np.diff(a.start)
    column, out = np.full(len(asks), -1, np.int64), {}
    bounds = np.searchsorted(a.scope_of, np.arange(len(a.n) + 1))
    for s, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        who = np.unique(a.query[a.start[lo] : a.start[hi]])
        work = asks[lo:hi].astype(float) * a.df[lo:hi]
        pairs = np.flatnonzero(work > SHARE * len(who) * a.n[s])
        if len(who) < LEAST or not len(pairs):
            continue
        pairs = lo + pairs[np.argsort(-work[pairs], kind="stable")][: DENSE // len(a.ids)]
        column[pairs] = np.arange(len(pairs))
        m = np.zeros((len(who), len(pairs)))
        for c, p in enumerate(pairs):
            at = slice(a.start[p], a.start[p + 1])
            m[np.searchsorted(who, a.query[at]), c] = a.weight[at]
        out[s] = who, m
    return column, out


def _joined(a: Asked, row: np.ndarray, pair: np.ndarray, weight: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, sum): what joined postings give to each query * rows + row, keys ascending."""
    many = a.start[pair + 1] - a.start[pair]
    at = np.repeat(a.start[pair] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    key = a.query[at].astype(np.int64) * rows + np.repeat(row, many)
    order = np.argsort(key, kind="stable")
    key, part = key[order], (np.repeat(weight, many) * a.weight[at])[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(part, first) if len(first) else np.zeros(0)


def _score(a: Asked, column, matrices, best: _Best, ids: pa.Array, sid, row, pair, weight) -> None:
    """One block: postings (row, pair, weight) of rows with the scopes sid, ascending by row."""
    rows, place, joined = len(sid), _places(ids), column[pair] < 0
    key, part = _joined(a, row[joined], pair[joined], weight[joined], rows)
    q, r = np.divmod(key, max(1, rows))
    plain = ~np.isin(sid, list(matrices))[r] if matrices else np.ones(len(key), bool)
    if plain.any():
        best.add(q[plain], part[plain], r[plain], place, ids)
    for s in np.unique(sid).tolist():
        if s not in matrices:
            continue
        who, m = matrices[s]
        own = np.flatnonzero(sid == s)
        local = np.full(rows, -1, np.int64)
        local[own] = np.arange(len(own))
        x = np.zeros((len(own), m.shape[1]))
        mine = ~joined & (local[row] >= 0)
        x[local[row[mine]], column[pair[mine]]] = weight[mine]
        x32 = np.ascontiguousarray(x.T, dtype=np.float32)
        ours = local[r] >= 0
        jq, jr, jv = np.searchsorted(who, q[ours]), local[r[ours]], part[ours]
        starts = np.searchsorted(jq, np.arange(0, len(who) + QUERIES, QUERIES))
        for i, lo in enumerate(range(0, len(who), QUERIES)):
            block = m[lo : lo + QUERIES]
            near = block.astype(np.float32) @ x32
            at = slice(starts[i], starts[i + 1])
            flat = (jq[at] - lo) * len(own) + jr[at]  # ascending
            near.reshape(-1)[flat] += jv[at].astype(np.float32)
            # A sum of c positive products in single precision is off by (c + 3) / 2^24 of itself at most; results are rounded to 6 places.
            off = (m.shape[1] + 8) * 2.0**-23
            least = best.least[who[lo : lo + QUERIES]].copy()
            if len(own) > best.k and len(new := np.flatnonzero(least <= 0)):
                least[new] = np.partition(near[new], len(own) - best.k, axis=1)[:, len(own) - best.k] / (1 + off)
            floor = np.maximum((least - 2e-6) * (1 - 2 * off), 0).astype(np.float32)
            found = np.flatnonzero(near >= np.maximum(floor, np.finfo(np.float32).tiny)[:, None])
            for cut in range(0, len(found), 4_000):
                f = found[cut : cut + 4_000]
                fq, fr = np.divmod(f, len(own))
                exact = np.einsum("ij,ij->i", block[fq], x[fr])
                if len(flat):
                    j = np.minimum(np.searchsorted(flat, f), len(flat) - 1)
                    exact += np.where(flat[j] == f, jv[at][j], 0.0)
                best.add(who[lo + fq], exact, own[fr], place, ids)


def find(asked, k: int):
    """A function of batches (block) that gives (query_id, chunk_id, score): the k best chunks of every query in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = asked.value
        column, matrices = _matrices(a)
        best = _Best(len(a.ids), k)
        for b in batches:
            for packed in b["block"]:
                t = pa.ipc.open_stream(packed.as_buffer()).read_next_batch()
                sid, length = t["sid"].to_numpy().astype(np.int64), t["length"].to_numpy().astype(np.int64)
                offsets = t["pair"].offsets.to_numpy().astype(np.int64)
                pair, tf = t["pair"].values.to_numpy().astype(np.int64), t["tf"].values.to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(sid)), np.diff(offsets))
                weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / a.avgdl[sid[row]]))
                # Rows go together as long as their joined postings are few enough.
                work = np.cumsum(np.where(column[pair] < 0, a.start[pair + 1] - a.start[pair], 0))
                until = np.where(offsets[1:] > 0, work[np.maximum(offsets[1:] - 1, 0)], 0)
                lo = 0
                while lo < len(sid):
                    hi = max(lo + 1, int(np.searchsorted(until, (until[lo - 1] if lo else 0) + JOINED, "right")))
                    p = slice(offsets[lo], offsets[hi])
                    _score(a, column, matrices, best, t["chunk_id"].slice(lo, hi - lo), sid[lo:hi], row[p] - lo, pair[p], weight[p])
                    lo = hi
        if (got := best.cut()) is not None:
            q, score, ids = got
            for lo in range(0, len(q), 50_000):
                part = slice(lo, lo + 50_000)
                yield pa.record_batch([a.ids.take(pa.array(q[part])), ids.slice(lo, 50_000), pa.array(score[part])], names=["query_id", "chunk_id", "score"])

    return run
