"""Cross-polytope hashing against all pairs."""

import numpy as np
import pytest

from latelane.llm import cross_polytope
from latelane.llm.queries import op6_embedding_dedup
from tests.conftest import SF


def brute(rows, threshold=0.9):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    unit = [np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)) if good else None for (_, v), good in zip(rows, ok)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return [(k, links[i], least.get(root(i)), k is not None and least[root(i)] == k) for i, (k, _) in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(k, v, "x", 1, b"u") for k, v in rows], "vec_id long, embedding array<double>, cls string, dim int, unit binary")


def clustered(rng, n, dim):
    rows, at = [], 0
    while len(rows) < n:
        centre = rng.normal(size=dim)
        for _ in range(rng.integers(1, 12)):
            rows.append((at, (centre + rng.normal(size=dim) * rng.uniform(0, 0.5)).tolist()))
            at += 1
    return rows


def test_pairs_and_components(spark):
    rng = np.random.default_rng(4)
    rows = clustered(rng, 500, 64) + [(9000 + i, [float(i % 5), 1.0, -2.0]) for i in range(40)]
    rows += [(7000, None), (7001, []), (7002, [0.0] * 64), (7003, [float("nan")] * 64), (7004, [None] + [1.0] * 63), (7005, [5.0]),
             (7006, [2.0]), (None, rows[3][1]), (7007, rows[3][1]), (7007, rows[3][1]), (7008, (np.array(rows[3][1]) * 1e-100).tolist())]
    got = sorted(map(tuple, cross_polytope.near_duplicates(frame(spark, rows)).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert len(got) == len(want)
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
    assert sum(g == w for g, w in zip(got, want)) >= 0.95 * len(want)
    assert not [(g, w) for g, w in zip(got, want) if g[1] > w[1]]


def test_hot_bucket_is_split(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    rows = [(i, (centre + rng.normal(size=64) * 0.1).tolist()) for i in range(300)] + clustered(rng, 60, 64)[:60]
    rows = [(i, v) for i, (_, v) in enumerate(rows)]
    monkeypatch.setattr(cross_polytope, "BUCKET", 50)
    got = sorted(map(tuple, cross_polytope.near_duplicates(frame(spark, rows)).collect()))
    want = sorted(brute(rows))
    assert [g[1:] for g in got][:300] == [w[1:] for w in want][:300]


@pytest.mark.parametrize("dim, rows", [(64, 50_000), (64, 10**7), (200, 10**5)])
def test_recall_at_the_threshold(dim, rows):
    """Pairs at a cosine of exactly 0.9 in tables dimensioned for many rows."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = 0.9 * x + np.sqrt(1 - 0.81) * z
    k = cross_polytope.joined_hashes(rows, dim)
    a, b = cross_polytope.codes(x, k, 11), cross_polytope.codes(y, k, 11)
    found = ((a == b[:, :, :1]).any(2) | (b == a[:, :, :1]).any(2)).any(1)
    assert found.mean() >= 0.93


def test_query_and_empty(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op6_embedding_dedup(spark, SF).collect())) == sorted(brute(rows))
    assert cross_polytope.near_duplicates(frame(spark, [])).count() == 0


def test_hadamard():
    h = cross_polytope.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8)) and np.allclose(np.abs(h), 8**-0.5)
