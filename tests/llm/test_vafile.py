import numpy as np
import pytest

from kilnspan.llm import vafile
from kilnspan.llm.vafile import F


def vectors(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.selectExpr("*", "vec_id as score", "vec_id as rank", "vec_id as query_id", "vec_id as x") if extra else df


def slow(rows, every, k):
    v = {}
    for i, e, _ in rows:
        if i is not None and e and all(x is not None and np.isfinite(x) for x in e):
            v[i] = [int(np.floor(1024 * float(np.float32(x)))) for x in e]
    out = []
    for q in v:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], e, strict=True)), i) for i, e in v.items() if i != q and len(e) == len(v[q]))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("queries", [8192, 3])
def test_equals_brute_force(spark, queries, monkeypatch):
    monkeypatch.setattr(vafile, "QUERIES", queries)
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(0, 1, 6).round(1)], 0) for i in range(400)]
    rows += [(400, None, 0), (401, [], 0), (402, [None] * 6, 0), (403, [float("nan")] * 6, 0), (405, [float("inf")] * 6, 1), (406, [1.0, 2.0], 1), (410, [3.0, -1.0], None), (None, [1.0] * 6, 1)]
    rows += [(500 + i, rows[7][1], 0) for i in range(40)] + [(700, [0.0] * 6, 0)]
    want = slow(rows, 10, 5)
    df = vectors(spark, rows + rows[:20], extra=queries == 3).repartition(3)
    got = sorted(map(tuple, vafile.top_k(df, F.col("vec_id") % 10 == 0, 5).collect()))
    assert got == want


def test_few_and_none(spark):
    assert vafile.top_k(vectors(spark, []), F.lit(True)).collect() == []
    got = vafile.top_k(vectors(spark, [(0, [1.0], 0), (1, [-2.0], 0)]), F.col("vec_id") == 0).collect()
    assert [tuple(x) for x in got] == [(0, 1, 1, -2048 * 1024)]


def test_large_components_take_part(spark):
    big = float(np.float32(3e38))
    rows = [(0, [1.0, 2.0]), (1, [200000.0, 1.0]), (2, [-200000.0, 1.0]), (3, [1.5, 2.5]), (4, [big, -big]), (5, [-big, big]), (10, [150000.0, -3.0]), (6, [0.5] * 2), (7, [1.0, float("inf")])]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], "vec_id long, embedding array<double>, label int").repartition(3)
    ints = {i: [int(np.floor(1024 * x)) if abs(x) < 1e30 else int(x) * 1024 for x in e] for i, e in rows if i != 7}
    want = []
    for q in (0, 10):
        score = lambda i: min(max(sum(a * b for a, b in zip(ints[q], ints[i], strict=True)), vafile.LEAST), vafile.MOST)  # noqa: B023, E731
        want += [(q, r + 1, i, score(i)) for r, i in enumerate(sorted((i for i in ints if i != q), key=lambda i: (-score(i), i))[:10])]
    assert sorted(map(tuple, vafile.top_k(df, F.col("vec_id") % 10 == 0).collect())) == want


def test_many_dimensions_do_not_overflow():
    for d in (1, 2, 3, 512, 513, 4096, 1 << 20):
        assert d * (vafile.largest(d) - 1) ** 2 < 1 << 63


def test_one_id_with_many_vectors(spark):
    r = np.random.default_rng(3)
    rows = [(i % 7, [float(x) for x in r.normal(0, 1, 4).round(1)], 0) for i in range(60)]
    ints = {(i, tuple(int(np.floor(1024 * float(np.float32(x)))) for x in e)) for i, e, _ in rows}
    want = []
    for q in {i for i, _ in ints if i % 5 == 0}:
        found = {(-sum(a * b for a, b in zip(x, y, strict=True)), j) for i, x in ints if i == q for j, y in ints if j != q}
        want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(sorted(found)[:4])]
    got = sorted(map(tuple, vafile.top_k(vectors(spark, rows + rows[:9]), F.col("vec_id") % 5 == 0, 4).collect()))
    assert got == sorted(want)


def test_bounds_hold_and_cells_leave_few_pairs_open():
    r = np.random.default_rng(4)
    x = np.floor(1024 * r.normal(0, 0.2, (5000, 64)))
    grid = vafile.Grid(x.min(0), x.max(0))
    least, most = grid.bounds(x[:50], grid.cells(x))
    true = x[:50] @ x.T
    assert (least <= true).all() and (true <= most).all()
    whole = x.astype(np.int64)
    s = vafile.Search(grid, np.arange(50), x[:50], list(whole[:50]), 10)
    for at in range(0, 5000, 1000):
        s.add(np.arange(at, at + 1000), grid.cells(x[at : at + 1000]), whole[at : at + 1000])
    assert s.read < 50 * 400
    np.fill_diagonal(true, -np.inf)
    assert [set(i.tolist()) for i, _ in s.best] == [set(np.argsort(-t)[:10].tolist()) for t in true]
