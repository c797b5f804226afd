import random
import re

import numpy as np
import pytest
import xxhash

from kilnspan.llm import simhash
from kilnspan.llm.components import components

from .helpers import docs, groups


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint():
    r = random.Random(1)
    texts = [None, "", " \t\n", "one", "A b\x0bC", "ÀB é x y z w", *[" ".join(r.choices(["a", "Bc", "d", "é", "f"], k=r.randrange(1, 60))) for _ in range(50)], "x y " * 20000]
    for t in texts:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_every_value_has_an_anchor_within_the_radius():
    for bits, generator, length, radius in simhash.PIECES:
        _, errors = simhash._anchor_table(bits, generator, length, radius)
        assert (errors[:, 0] >= 0).all()


def test_links_equal_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {0, (1 << 64) - 1}
    for b in base.tolist():
        for _ in range(8):
            v = b
            for i in r.choice(64, r.integers(0, 7), replace=False):
                v ^= 1 << int(i)
            fps.add(v)
    fps = sorted(fps, key=lambda v: np.array(v, np.uint64).view(np.int64))
    linked = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    signed = [int(np.array(v, np.uint64).view(np.int64)) for v in fps]
    want = {signed[i]: signed[g] for i, g in enumerate(groups(len(fps), linked))}
    for block in (4096, 7):
        simhash.BLOCK = block
        df = spark.createDataFrame([(v,) for v in signed], "fp long")
        got = dict(map(tuple, simhash.link_fingerprints(df).collect()))
        assert {v: got.get(v, v) for v in signed} == want
    simhash.BLOCK = 4096


@pytest.mark.parametrize("extra", [False, True])
def test_groups_equal_brute_force(spark, extra):
    r = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    texts = [None, "", " ", "zero", None]
    for _ in range(12):
        base = r.choices(words, k=r.choice([5, 200, 800]))
        for _ in range(4):
            t = list(base)
            for _ in range(r.randrange(3)):
                t[r.randrange(len(t))] = r.choice(words)
            texts.append(" ".join(t))
    fps = [slow_fingerprint(t) for t in texts]
    root = groups(len(texts), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    df = docs(spark, texts, extra)
    got = sorted(map(tuple, simhash.simhash_groups(df).collect()))
    assert got == [(i, f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, root, strict=True))]
    kept = simhash.keep_one(df.unionByName(df.limit(7)))
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(root))


def test_one_row_of_each_group_stays(spark):
    a, b, c = ("x y z w v u t s " * 9, "other words of quite another text here " * 9, "third one with more words than that to be unlike " * 9)
    rows = [(1, a), (1, b), (2, a), (None, b), (None, c), (None, c), (None, None), (3, ""), (3, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x.doc_id, x.text) for x in simhash.keep_one(df.unionByName(df)).collect()), key=str)
    blank = [x for x in got if not (x[1] or "").strip()]
    assert [x for x in got if x not in blank] == sorted([(1, a), (1, b), (None, c)], key=str) and len(blank) == 1 and blank[0][0] == 3


def test_no_rows(spark):
    assert simhash.simhash_groups(docs(spark, [])).collect() == []


def test_components_of_long_chains(spark):
    n = 300
    edges = [(i, i + 1) for i in range(n) if i % 100 != 99] + [(5, 5)]
    got = {tuple(x) for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, i // 100 * 100) for i in range(n)}
