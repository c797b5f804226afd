import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from kilnspan.llm import factors, passages, suffix, suffix_dedup

from .helpers import docs


def test_suffix_array_equals_sorting():
    r = random.Random(0)
    for k in range(400):
        letters = r.choice([1, 2, 3, 200])
        t = [r.randrange(1, letters + 1) for _ in range(r.randrange(0, 80))] + [0]
        assert suffix.suffix_array(np.array(t, np.int16), letters + 1).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("letters", [3, 300, 20_000])
def test_suffix_array_over_small_and_large_alphabets(letters):
    t = [*np.random.default_rng(1).integers(1, letters + 1, 20_000).tolist(), 0]
    assert suffix.suffix_array(np.array(t), letters + 1).tolist() == sorted(range(len(t)), key=lambda i: t[i : i + 400])


def test_the_end_of_a_block_is_no_part_of_a_repeat():
    r = random.Random(16)
    for off in range(64):
        x, pad = r.choices(b"abc", k=400), r.choices(b"gh", k=off)
        # only the second and the third block share 400 bytes; the first one has 399 of them
        blocks = [np.array(b, np.uint8) for b in (pad + x[1:] + [ord("d")], [ord("e")] + x, [ord("f")] + x)]
        assert [s.tolist() for s in suffix.repeated_starts(blocks, 400)] == [[], [1], [1]]


@pytest.mark.parametrize("top", [244, 253, 254, 255])
def test_repeats_of_any_bytes(top):
    r = random.Random(top)
    for _ in range(100):
        blocks = [bytes(r.choices([0, 1, top], k=r.randrange(30))) for _ in range(5)]
        seen = Counter(b[i : i + 6] for b in blocks for i in range(len(b) - 5))
        want = [[i for i in range(len(b) - 5) if seen[b[i : i + 6]] > 1] for b in blocks]
        assert [s.tolist() for s in suffix.repeated_starts([np.frombuffer(b, np.uint8) for b in blocks], 6)] == want


def texts(r, unit, join):
    """Documents of a few shared passages among own words, with runs, nulls, blanks and copies."""
    own = lambda n: [unit(r) for _ in range(n)]
    passages_ = [own(r.randrange(40, 200)) for _ in range(6)]
    out = [None, "", " ", join(own(10)), join(["a"] * 300), join(["a"] * 250), join(["ab", "c"] * 120)]
    for _ in range(40):
        parts = []
        for _ in range(r.randrange(1, 6)):
            if r.random() < 0.5:
                p = r.choice(passages_)
                i = r.randrange(len(p) // 2)
                parts += p[i : i + r.randrange(5, 200)]
            else:
                parts += own(r.randrange(1, 80))
        out.append(join(parts))
    return out + out[5:9]


def slow_bytes(texts_, window):
    bs = [(t or "").encode() for t in texts_]
    seen = {}
    for b in bs:
        for i in range(len(b) - window + 1):
            seen[b[i : i + window]] = seen.get(b[i : i + window], 0) + 1
    out = []
    for b in bs:
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        whole, at = "", 0
        for c in b.decode():
            n = len(c.encode())
            whole += "" if any(gone[at : at + n]) else c
            at += n
        out.append((len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest(), whole))
    return out


def slow_words(texts_, window, anywhere=False):
    """Of windows that also start in an earlier document or, if anywhere, at any other place."""
    ws = [(t or "").encode().split() for t in texts_]
    first, last, times = {}, {}, Counter()
    for d, w in enumerate(ws):
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
            last[tuple(w[i : i + window])] = d
            times[tuple(w[i : i + window])] += 1
    out = []
    for d, w in enumerate(ws):
        gone, shared = [False] * len(w), [False] * len(w)
        for i in range(len(w) - window + 1):
            if times[tuple(w[i : i + window])] > 1 if anywhere else first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
            if first[tuple(w[i : i + window])] < last[tuple(w[i : i + window])]:
                shared[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest(), sum(shared), kept.decode()))
    return out


@pytest.mark.parametrize("group", [4096, 2])
def test_bytes_equal_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(passages, "GROUP", group)
    r = random.Random(11)
    t = texts(r, lambda r: r.choice("abcdefé ü\n"), "".join)
    got = sorted(suffix_dedup.removal_report(docs(spark, t, extra=group == 2), 60).collect())
    assert [tuple(x) for x in got] == [(i, *x) for i, x in enumerate(slow_bytes(t, 60))]


@pytest.mark.parametrize("window", [16, 60])
def test_bytes_of_short_windows_equal_brute_force(spark, window):
    r = random.Random(17)
    t = ["".join(r.choices("ab", k=r.randrange(3 * window))) for _ in range(60)]
    t += [x[r.randrange(4) :] + r.choice("abc") for x in t]
    got = sorted(suffix_dedup.removal_report(docs(spark, t), window).collect())
    assert [tuple(x) for x in got] == [(i, *x) for i, x in enumerate(slow_bytes(t, window))]


@pytest.mark.parametrize("group", [4096, 2])
def test_words_equal_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(passages, "GROUP", group)
    r = random.Random(12)
    t = texts(r, lambda r: r.choice(["a", "b", "ç", "dd", "e,"]) + str(r.randrange(9)), " ".join)
    got = sorted(factors.removal_report(docs(spark, t, extra=group == 2), 20).collect())
    assert [(*x[:5], " ".join(x.text.split())) for x in got] == [(i, *x) for i, x in enumerate(slow_words(t, 20))]
    assert all(x.text == (t[x.doc_id] or "") for x in got if not x.n_removed)


@pytest.mark.parametrize("group", [4096, 2])
def test_word_passages_equal_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(passages, "GROUP", group)
    r = random.Random(13)
    t = texts(r, lambda r: r.choice(["a", "b", "ç", "dd", "e,"]) + str(r.randrange(9)), " ".join)
    got = {x.doc_id: x.text for x in suffix_dedup.remove_passages(docs(spark, t, extra=group == 2), 20).collect()}
    assert [" ".join((got[i] or "").split()) for i in range(len(t))] == [x[4] for x in slow_words(t, 20, anywhere=True)]


def test_short_words_and_other_spacing_hide_no_passage(spark):
    r = random.Random(14)
    own = lambda n: [r.choice("abcdefgh") + str(r.randrange(999)) for _ in range(n)]
    found = []
    for n in (51, 55, 62):  # all under 400 bytes
        p = own(n)
        found += [" ".join(own(30)) + "\n" + " ".join(p) + " " + " ".join(own(20)), " ".join(own(9)) + "  " + "\t".join(p) + "\n\n" + " ".join(own(40))]
    clean = [" ".join(own(200)) + "\n", "one  two\n"]
    got = {x.doc_id: x for x in suffix_dedup.remove_passages(docs(spark, found + clean)).collect()}
    assert [len(got[i].text.split()) for i in range(6)] == [50, 49] * 3
    assert [got[6 + i].text for i in range(2)] == clean and got[0].n_chars == len(got[0].text)


def test_repeated_rows_and_none(spark):
    t = ["x" * 500, "abc " * 200, None]
    df = docs(spark, t)
    got = suffix_dedup.removal_report(df.unionByName(df)).collect()
    assert sorted((x.doc_id, x.n_removed, x.n_spans) for x in got) == sorted([(0, 500, 1), (1, 800, 1), (2, 0, 0)] * 2)
    assert factors.removal_report(docs(spark, [])).collect() == [] == suffix_dedup.removal_report(docs(spark, [])).collect()


def test_stage_keeps_columns_and_whole_characters(spark):
    shared = "é" * 300
    df = docs(spark, ["ä" + shared + "ü", "x" + shared, None, "clean"], extra=True)
    out = suffix_dedup.remove_repeats(df)
    assert out.columns == df.columns
    rows = {x.doc_id: x for x in out.collect()}
    assert rows[2].text is None and rows[3].text == "clean" and rows[3].n_chars == 5
    assert "é" not in rows[0].text + rows[1].text


def test_very_long_text():
    u = np.random.default_rng(0).integers(97, 100, (1 << 24) + 5000, np.uint8)
    h, p, s, e = passages.occurrences(u, passages.BYTES)
    assert (p >= s).all() and (e[:-1] == s[1:]).all() and e[-1] == len(u) - 399
    assert (p - s < 369 + 400).all()


def test_null_ids_and_very_long_texts(spark):
    r = random.Random(15)
    long = " ".join(r.choice("abcdefgh") + str(r.randrange(9999)) for _ in range(60_000))
    part = long[100_000:101_000]
    df = spark.createDataFrame([(None, long), (3, "x " + part), (None, part + " y"), (4, "short")], "doc_id long, text string")
    words = {(x.doc_id, x.n_words): x.n_removed for x in factors.removal_report(df).collect()}
    inner = len(part.split())
    assert words[4, 1] == 0 and words[3, inner + 1] == 0  # the smallest doc_id that there is keeps it
    assert words[None, 60_000] in (inner, inner - 1, inner - 2) and words[None, inner + 1] in (inner, inner - 1, inner - 2)
    gone = {(x.doc_id, x.n_bytes): x.n_removed for x in suffix_dedup.removal_report(df).collect()}
    assert gone[3, 1002] == 1000 and gone[None, len(long)] == 1000 and gone[None, 1002] == 1000 and gone[4, 5] == 0
