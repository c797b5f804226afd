import pytest

from kilnspan.llm import mixing

from .helpers import docs


def level(sizes, weights, most=3):
    """Targets by resharing the excess again and again."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    total = sum(sizes.values())
    while open_:
        rest = total - sum(most * sizes[s] for s in sizes if s not in open_)
        share = {s: rest * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            target.update(share)
            break
        target.update((s, most * sizes[s]) for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 5, "d": 100}, {"a": 0, "b": 0}, {"b": 7, "é": 1, "Z": 0, None: 30}, {"x": 3}, {}, {f"s{i:02}": 12000 + i * 977 % 9000 for i in range(20)}, {f"s{i:02}": (i * i * 7919) % 1000 * 10 ** (i % 4) for i in range(25)}])
def test_targets(spark, sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = level(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    got = mixing.source_targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")).collect()
    assert {r.source: r.target for r in got} == pytest.approx(want)
    assert all(r.source_size == sizes[r.source] for r in got)


def test_mix(spark):
    texts = [None, "", " \n", *[f"w{i} " * (i % 40) for i in range(600)], "x " * 50000]
    df = docs(spark, texts, extra=True, sources=("a", "b", "b", "c", "c", "c", "c", None)).withColumn("lang", mixing.F.lit(None).cast("string"))
    rows = {r.doc_id: r for r in mixing.mix_report(df).collect()}
    assert [rows[i].size for i in range(len(texts))] == [len((t or "").split()) for t in texts]
    assert all(r.taken <= 3 * r.size for r in rows.values())
    again = mixing.mix(df)
    assert again.columns == df.columns
    times = {r.doc_id: r["count"] for r in again.drop("count").groupBy("doc_id").count().collect()}
    assert all(times.get(i, 0) * r.size == r.taken for i, r in rows.items())
    assert mixing.mix_report(df).collect() and {tuple(r) for r in mixing.mix_report(df).collect()} == {tuple(r) for r in rows.values()}


def test_taken_near_target(spark):
    df = docs(spark, ["a b c d e"] * 6000, sources=("a", "b", "b", "b"))
    for r in mixing.mix_report(df).groupBy("source_size", "target").agg(mixing.F.sum("taken").alias("taken")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.06)


def test_no_rows(spark):
    assert mixing.mix_report(docs(spark, [])).collect() == []
