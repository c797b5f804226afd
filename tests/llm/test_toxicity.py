import math
import random
import zlib

import numpy as np
import pytest

from kilnspan.llm import toxicity

from .helpers import docs

BAD = ["grumbleknave", "snotterwit", "wretchfool"]


def text(r, toxic, n):
    words = ["".join(r.choices("abcdeilmnorst", k=r.randrange(2, 9))) for _ in range(n)]
    for _ in range(2 if toxic else 0):
        w = r.choice(BAD)
        if r.random() < 0.3:  # misspelt
            i = r.randrange(1, len(w) - 1)
            w = w[:i] + r.choice("xz") + w[i + 1 :]
        words[r.randrange(n)] = w
    return " ".join(words)


def test_held_out_accuracy(spark):
    r = random.Random(1)
    toxic = [int(r.random() < 0.3) for _ in range(900)]
    texts = [text(r, y, r.choice([8, 40, 300])) for y in toxic] + [None, "", " \n", "w " * 50000]
    d = docs(spark, texts, extra=True)
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)] + [(0, 1, toxic[0]), (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    rows = sorted(toxicity.toxicity(d.unionByName(d.limit(2)), labels).collect())
    assert len(rows) == len(texts) + 2
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in rows)
    out = [x for x in rows if x.held_out and x.doc_id < 900]
    hit = sum(x.predicted for x in out if toxic[x.doc_id])
    false = sum(x.predicted for x in out if not toxic[x.doc_id])
    assert hit >= 0.85 * sum(toxic[x.doc_id] for x in out) and false <= 0.02 * len(out)
    assert not any(x.predicted for x in rows if x.doc_id in (900, 901, 902))


def test_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs(spark, ["a", None]), labels).collect()
    assert len(got) == 2 and len({x.score for x in got}) == 1
    assert toxicity.toxicity(docs(spark, []), labels).collect() == []


def test_misspelt_words_share_vectors():
    a, b, c = (set(toxicity.subwords([w])[0].tolist()) for w in ("grumbleknave", "grumblekxave", "pleasant"))
    assert len(a & b) > 10 > len(a & c)


def slow_score(text, model):
    """The definition, word by word and window by window."""
    mask = (1 << 64) - 1
    values = []
    for w in text.lower().split():
        w, found = f"<{w}>", []
        for i in range(len(w)):
            h = 0
            for n, c in enumerate(w[i:], 1):
                h = (h + ord(c) + 1) * 0x9E3779B97F4A7C15 & mask
                h ^= h >> 32
                if n in toxicity.GRAMS:
                    found.append(float(model.value[h % toxicity.BUCKETS]))
        values.append(sum(found) / len(found))
    if not values:
        return 1 / (1 + math.exp(-min(model.bias, 0.0)))
    size = min(toxicity.WINDOW, len(values))
    worst = max(sum(values[i : i + size]) / size for i in range(len(values) - size + 1))
    return 1 / (1 + math.exp(-(worst + model.bias)))


def test_scores_equal_the_definition(spark):
    r = random.Random(5)
    model = toxicity.Model(np.random.default_rng(5).normal(0, 2, toxicity.BUCKETS).astype(np.float32), -0.7)
    texts = [None, "", " \t", "a", "É x", "zwei wörter", *[text(r, i % 2, r.randrange(1, 60)) for i in range(40)], "lang " * 20000, "😀😀 İ ß\u00a0q"]
    got = {x.doc_id: x.score for x in toxicity.score_documents(docs(spark, texts, extra=True), model).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx([slow_score(t or "", model) for t in texts], abs=1e-5)


def test_training_steps_down_the_loss():
    """One step's gradient of the average documents' cross entropy, against differences of the loss."""
    r = random.Random(6)
    rows = [(i % 2, text(r, i % 2, 12).split()) for i in range(60)]
    words = sorted({w for _, d in rows for w in d})
    grams, at = toxicity.subwords(words)
    flat = np.array([words.index(w) for _, d in rows for w in d]), np.array([len(d) for _, d in rows])
    sample = toxicity.Sample.of(np.array([y for y, _ in rows]), flat, np.arange(len(words)), (grams, np.diff(np.append(at, len(grams)))))
    loss = lambda m: sum(-math.log(p if y else 1 - p) for (y, d), p in zip(rows, [1 / (1 + math.exp(-(np.mean(m.words(d)) + m.bias))) for _, d in rows], strict=True))
    before, after = toxicity.train(sample, 0), toxicity.train(sample, 5)
    assert loss(after) < 0.9 * loss(before)


def test_the_sample_is_of_documents_and_bounded(spark):
    texts = ["bad " * 10, "good words " * 10, "more good words " * 40] * 20
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    once = {tuple(x) for x in toxicity.labelled_sample(d, labels).collect()}
    many = toxicity.labelled_sample(d.unionByName(d).unionByName(d), labels).collect()
    assert len(many) == len(once) and {tuple(x) for x in many} == once
    few = toxicity.labelled_sample(d, labels, sample=4).collect()
    assert sorted(x.y for x in few) == [0] * 4 + [1] * 4 and {tuple(x) for x in few} <= once
    small = toxicity.labelled_sample(d, labels, volume=100).collect()
    assert sum(x.y for x in small) == 3 and 0 < sum(1 - x.y for x in small) <= 2
