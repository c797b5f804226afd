import math
import random
from collections import Counter

import pytest

from kilnspan.llm import kneser_ney as kn

from .helpers import docs


def slow_model(texts, order):
    """Probability of a byte after a context, straight from the definition."""
    counts = {order: Counter()}
    for t in texts:
        b = b"\n" * (order - 1) + t.encode()
        for i in range(len(t.encode())):
            counts[order][b[i : i + order]] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts = {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            discounts[k] = [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 0.95) for i in range(3)]
        else:
            discounts[k] = [0.5] * 3

    def p(g):
        if not g:
            return 1 / 256
        c, d = counts[len(g)], discounts[len(g)]
        same = {h: v for h, v in c.items() if h[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        total, cut = sum(same.values()), lambda v: d[min(v, 3) - 1]
        return (c[g] - cut(c[g]) if g in c else 0) / total + sum(map(cut, same.values())) / total * p(g[1:])

    return p


def test_probabilities_equal_the_definition(spark):
    r = random.Random(2)
    texts = ["".join(r.choices("abcé ", weights=[9, 5, 2, 1, 4], k=r.randrange(40))) for _ in range(60)] + ["", "a"]
    p = slow_model(texts, 3)
    tables = kn.model(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string"), 3)
    asked = {tuple(r.choices(b"abc\n zX\xc3", k=3)) for _ in range(300)}
    as_long = lambda g: g[0] << 16 | g[1] << 8 | g[2]
    got = {x.g: x.logp for x in kn.probabilities(spark.createDataFrame([(as_long(g),) for g in asked], "g long"), tables).collect()}
    assert len(got) == len(asked)
    for g in asked:
        assert got[as_long(g)] == pytest.approx(math.log(p(bytes(g))), rel=1e-9)
    assert sum(p(b"ab" + bytes([c])) for c in range(256)) == pytest.approx(1)


def test_scores_and_decisions(spark):
    r = random.Random(3)
    syllables = ["ka", "lo", "mi", "ten", "sur", "ba"]
    good = lambda n: " ".join("".join(r.choices(syllables, k=r.randrange(1, 4))) for _ in range(n))
    texts = [good(r.randrange(20, 90)) for _ in range(300)] + ["".join(r.choices("#$%QXZ7", k=200)) for _ in range(20)] + [None, "", good(4000)]
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(320) if i % 3], "doc_id long, quality int, toxic int")
    d = docs(spark, texts, extra=True)
    rows = {x.doc_id: x for x in kn.quality_report(d, labels).collect()}
    assert len(rows) == len(texts)
    assert sum(rows[i].accepted for i in range(300)) >= 295 and not any(rows[i].accepted for i in range(300, 322)) and rows[322].accepted
    assert rows[300].perplexity > 5 * rows[0].perplexity
    kept = kn.keep_accepted(d, labels)
    assert kept.columns == d.columns
    by = {x.doc_id: x for x in kept.collect()}
    assert set(by) == {i for i in rows if rows[i].accepted} and all(by[i].text == texts[i] for i in by)


def test_parts_give_the_same(spark, monkeypatch):
    texts = [f"the text number {i} of some" for i in range(50)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    a = sorted(kn.quality_report(docs(spark, texts), labels).collect())
    monkeypatch.setattr(kn, "PART", 100)
    monkeypatch.setattr(kn, "SENT", 0)
    b = sorted(kn.quality_report(docs(spark, texts), labels).collect())
    assert [(x.doc_id, x.accepted, round(x.perplexity, 9)) for x in a] == [(x.doc_id, x.accepted, round(x.perplexity, 9)) for x in b]


def test_nothing_trusted_and_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = kn.quality_report(docs(spark, ["a b", None, ""]), labels).collect()
    assert {x.doc_id: x.accepted for x in got} == {0: True, 1: False, 2: False}
    assert kn.quality_report(docs(spark, []), labels).collect() == []


def test_report_equals_brute_force(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcé", k=r.randrange(1, 5)))
    texts = [" ".join(word() for _ in range(r.randrange(1, 12))) for _ in range(60)] + [None, "", "####", "a"]
    langs = [("en", "de", None)[i % 3] for i in range(len(texts))]
    rows = [(i, t, x, x) for i, (t, x) in enumerate(zip(texts, langs, strict=True))] + [(5, texts[5], langs[5], "again"), (None, "a b", "en", "no id")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, z string")
    marks = [(i, int(i % 4 > 0), 0) for i in range(50)] + [(1, 0, 0), (2, 1, 1), (None, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    quality = {}
    for i, q, _ in marks:
        quality[i] = min(q, quality.get(i, 1))
    trusted = {i for i, q in quality.items() if q == 1 and i is not None}
    fold = {x.id for x in spark.range(len(texts)).selectExpr("id", "pmod(xxhash64(id, 'fold'), 5) = 0 as f").where("f").collect()} & trusted
    assert 3 < len(fold) < len(trusted)
    p, cache = slow_model([t or "" for i, t, *_ in rows if i in trusted - fold], kn.ORDER), {}

    def total(t):
        b = b"\n" * (kn.ORDER - 1) + t.encode()
        grams = [b[i : i + kn.ORDER] for i in range(len(t.encode()))]
        for g in grams:
            if g not in cache:
                cache[g] = math.log(p(g))
        return sum(cache[g] for g in grams)

    sums = [(total(t or ""), len((t or "").encode())) for _, t, *_ in rows]
    every = [k for k, row in enumerate(rows) if row[0] in fold and sums[k][1]]
    mean = sum(sums[k][0] for k in every) / sum(sums[k][1] for k in every)
    loss = [-(s + mean * kn.PRIOR) / (n + kn.PRIOR) for s, n in sums]
    top = lambda ks: sorted(loss[k] for k in ks)[math.ceil(kn.QUANTILE * len(ks)) - 1] + kn.SLACK
    limit = {x: top([k for k in every if rows[k][2] == x]) for x in {rows[k][2] for k in every}}
    want = sorted(((row[0], row[2], n, round(math.exp(x), 6), round(math.exp(limit.get(row[2], top(every))), 6), n > 0 and x <= limit.get(row[2], top(every))) for row, (_, n), x in zip(rows, sums, loss, strict=True)), key=str)
    got = sorted(((x.doc_id, x.lang, x.n_bytes, round(x.perplexity, 6), round(x.threshold, 6), x.accepted) for x in kn.quality_report(d, labels).collect()), key=str)
    assert got == want
    kept = sorted(((x.doc_id, x.text, x.z) for x in kn.keep_accepted(d, labels).collect()), key=str)
    assert kept == sorted(((row[0], row[1], row[3]) for row, n, x in zip(rows, sums, loss, strict=True) if n[1] and x <= limit.get(row[2], top(every))), key=str)


def test_ties_at_the_threshold_are_accepted(spark):
    d = docs(spark, ["the same text"] * 40)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert all(x.accepted for x in kn.quality_report(d, labels).collect())
