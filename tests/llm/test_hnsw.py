import numpy as np
import pyarrow as pa
import pytest

from kilnspan.llm import hnsw

from .helpers import groups

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows):
    ok = []
    for i, e, y in rows:
        if e and y is not None and all(x is not None and np.isfinite(x) for x in e):
            v = np.array(e, np.float32).astype(float)
            if v.any():
                ok.append((i, v / np.linalg.norm(v), y))
    links = [(a, b) for a, v, y in ok for b, w, z in ok if a != b and y == z and len(v) == len(w) and v @ w >= 0.93]
    n = {i: 0 for i, _, _ in rows}
    for a, _ in links:
        n[a] += 1
    root = groups(len(rows), links)
    return [(i, n[i], root[i], root[i] == i) for i in range(len(rows))]


@pytest.mark.parametrize("shard", [8192, 40])
def test_equals_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", shard)
    monkeypatch.setattr(hnsw, "VISITORS", 2 * shard)
    r = np.random.default_rng(4)
    rows = []
    for _ in range(60):
        base = r.normal(0, 1, 24)
        for _ in range(r.integers(1, 6)):
            rows.append((base + r.normal(0, r.choice([0.05, 0.3]), 24)).tolist())
    rows += [rows[0]] * 60 + [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] * 24, [None] * 24, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, e, None if i % 11 == 0 else i % 2 if len(e or ()) == 24 else 1) for i, e in enumerate(rows)]
    df = spark.createDataFrame(rows, SCHEMA)
    if shard == 40:
        df = df.selectExpr("*", "vec_id as a", "label as d", "vec_id as e", "vec_id as n", "vec_id as root").repartition(5)
    got = sorted(map(tuple, hnsw.near_duplicates(df).collect()))
    assert got == slow(rows)


def test_search_finds_close_vectors_among_many():
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (3000, 32))
    x[1500:] = x[:1500] + r.normal(0, 0.1, (1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = hnsw.links_of(hnsw.Graph(x), x, x, 0.93)
    truth = x @ x.T >= 0.93
    hit = sum(truth[i, a].sum() for i, a in enumerate(found))
    assert all(truth[i, a].all() for i, a in enumerate(found)) and hit >= 0.99 * truth.sum()


def test_a_cluster_wider_than_the_beam():
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(0, 1, (1, 16)) + r.normal(0, 0.02, (700, 16)), r.normal(0, 1, (500, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = hnsw.links_of(hnsw.Graph(x), x, x, 0.93)
    truth = x @ x.T >= 0.93
    assert sum(map(len, found)) >= 0.99 * truth.sum()


def test_no_rows(spark):
    assert hnsw.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_audit_does_not_count_a_vector_with_itself():
    class Blind(hnsw.Graph):
        """Finds nothing but the queries themselves."""

        def search(self, q, width, least):
            return [np.flatnonzero(s > 1 - 1e-5) for s in q @ self.x.T]

    r = np.random.default_rng(7)
    x = r.normal(0, 1, (2000, 32))
    x[1000:1269] = x[:269] + r.normal(0, 0.05, (269, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in (x, x[::2].copy()):
        found = hnsw.links_of(Blind(x), x, q, 0.93)
        assert [f.tolist() for f in found] == [np.flatnonzero(t).tolist() for t in q @ x.T >= 0.93]


def test_a_beam_that_finds_no_links_never_passes():
    class Blind(hnsw.Graph):
        def search(self, q, width, least):
            return [np.flatnonzero(s > 1 - 1e-5) for s in q @ self.x.T]

    r = np.random.default_rng(8)
    x = np.repeat(r.normal(0, 1, (400, 16)), 5, 0) + r.normal(0, 0.02, (2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = hnsw.links_of(Blind(x), x, x, 0.93)
    assert sum(map(len, found)) == (x @ x.T >= 0.93).sum()


def test_links_between_shards_count_for_both():
    r = np.random.default_rng(9)
    x = r.normal(0, 1, (30, 8))
    x[20:] = x[:10] + r.normal(0, 0.01, (10, 8))
    part = pa.array([0] * 20 + [1] * 10)
    t = pa.table({"a": pa.array(range(30)), "copies": pa.array([2] * 20 + [3] * 10), "e": pa.array(x.tolist()), "member": pa.array([True] * 20 + [False] * 10), "part": part, "p": pa.array([1] * 30)})
    got = {a: (n, root) for a, n, root in zip(*(c.to_pylist() for c in hnsw._shard(0.99)(t).columns), strict=True)}
    assert got == {i: (3, i) if i < 10 else (0, i) if i < 20 else (2, i - 20) for i in range(30)}
