"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is its character n-grams, hashed to buckets of vectors; a misspelling shares most of
them. Windows of words are averaged into a softmax of two classes, and a document is as toxic as its worst window, so
that a few words in a long text count. Vectors and softmax are trained together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, lean, row_key, small_batches

#: Buckets of n-gram vectors and their size; n-gram lengths; words averaged in a window.
BUCKETS, SIZE, GRAMS, WINDOW = 1 << 18, 8, (3, 4, 5, 6), 3
#: Most labelled documents of each class that are taken for training, those of smallest hash, and bytes of text after which no more are taken.
SAMPLE, SAMPLE_BYTES = 2000, 8 << 20
EPOCHS, RATE = 40, 0.05
#: n-grams whose errors are spread at once.
SPREAD = 1 << 19
#: Words whose scores a task remembers.
REMEMBERED = 500_000
THRESHOLD = 0.7


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all words' n-grams, and where each word's begin; every word has some, as it is taken between marks."""
    line = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(size)
    word = np.repeat(np.arange(len(words)), size)
    room = np.repeat(ends, size) - np.arange(len(line))
    rows, owners = [], []
    h = np.zeros(len(line), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        ahead = np.zeros(len(line), np.uint64)
        left = max(0, len(line) - n + 1)
        ahead[:left] = line[len(line) - left :]
        h = (h + ahead + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        if n in GRAMS:
            at = np.flatnonzero(room >= n)
            rows.append((h[at] % np.uint64(BUCKETS)).astype(np.int64))
            owners.append(word[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    grams = np.concatenate(rows)[order]
    return grams, np.searchsorted(owner[order], np.arange(len(words)))


@dataclass
class Model:
    """What is left of vectors and softmax for scoring: a number per bucket, and the bias."""

    value: np.ndarray
    bias: float

    def words(self, words: list[str]) -> np.ndarray:
        grams, starts = subwords(words)
        n = np.diff(np.append(starts, len(grams)))
        return np.add.reduceat(self.value[grams], starts) / n if len(words) else np.zeros(0)


def _worst(s: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For documents of words with these scores: the first word and the mean of the worst window."""
    c = np.concatenate([[0.0], np.cumsum(s)])
    at = np.arange(len(s))
    end = np.minimum(at + WINDOW, np.repeat(starts + sizes, sizes))
    begin = np.maximum(end - WINDOW, np.repeat(starts, sizes))
    mean = (c[end] - c[begin]) / (end - begin)
    best = np.maximum.reduceat(mean, starts)
    first = np.minimum.reduceat(np.where(mean == np.repeat(best, sizes), at, len(s)), starts)
    return begin[first], best


def split(text: str | None) -> list[str]:
    return (text or "").lower().split()


@dataclass
class Sample:
    """Labelled documents as numbers: their words by place in a vocabulary, and the vocabulary's n-grams; documents without words are left out."""

    words: np.ndarray
    sizes: np.ndarray
    y: np.ndarray
    grams: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, y: np.ndarray, docs: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, vocabulary: tuple[np.ndarray, np.ndarray]) -> Sample:
        """docs: the documents' word hashes, one after another, and their numbers of words; hashes, ascending, and n-grams of the distinct words likewise."""
        (words, sizes), (grams, counts) = docs, vocabulary
        return cls(np.searchsorted(hashes, words), sizes[sizes > 0], y[sizes > 0], grams, np.cumsum(counts) - counts)


def _flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of binaries, one row after another, and how many each row has; no row becomes an object."""
    size = np.dtype(kind).itemsize
    rows = [c.cast(pa.large_binary()) for c in column.chunks if len(c)]
    ends = [np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1] for c in rows]
    values = [np.frombuffer(c.buffers()[2], np.uint8)[e[0] : e[-1]].view(kind) if e[-1] > e[0] else np.zeros(0, kind) for c, e in zip(rows, ends, strict=True)]
    return np.concatenate(values or [np.zeros(0, kind)]), np.concatenate([np.diff(e) // size for e in ends] or [np.zeros(0, np.int64)])


def train(sample: Sample, epochs: int = EPOCHS, seed: int = 3) -> Model:
    """Joint training by Adam: a few rounds on whole documents' averages, then on each document's worst window."""
    r = np.random.default_rng(seed)
    vectors = r.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
    soft, bias = r.normal(0, 0.1, (SIZE, 2)).astype(np.float32), np.zeros(2, np.float32)
    y, words, sizes, grams, at = sample.y, sample.words, sample.sizes, sample.grams, sample.at
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean()) / len(y)
    starts = np.cumsum(sizes) - sizes
    n = np.diff(np.append(at, len(grams)))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, soft, bias)]
    for epoch in range(1, epochs + 1):
        value = vectors @ (soft[:, 1] - soft[:, 0])
        score = (np.add.reduceat(value[grams], at) / n)[words]
        if epoch <= 5:
            begin, length = starts, sizes
            logit = np.add.reduceat(score, starts) / sizes
        else:
            begin, logit = _worst(score, starts, sizes)
            length = np.minimum(WINDOW, sizes)
        p = 1 / (1 + np.exp(-np.clip(logit + bias[1] - bias[0], -30, 30)))
        error = (p - y) * weight
        # each document's error, spread over its window's words, then over their n-grams
        inside = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
        per_word = np.bincount(words[inside], np.repeat(error / length, length), len(at))
        used = np.flatnonzero(per_word)
        per_gram = np.zeros(BUCKETS)
        for part in np.array_split(used, max(1, n[used].sum() // SPREAD)):
            flat = grams[np.repeat(at[part] - (np.cumsum(n[part]) - n[part]), n[part]) + np.arange(n[part].sum())]
            per_gram += np.bincount(flat, np.repeat(per_word[part] / n[part], n[part]), BUCKETS)
        per_gram = per_gram.astype(np.float32)
        touched = np.flatnonzero(per_gram)
        to_soft = vectors[touched].T @ per_gram[touched]
        grads = [per_gram[:, None] * (soft[:, 1] - soft[:, 0]) + 1e-7 * vectors, np.stack([-to_soft, to_soft], 1), np.array([-error.sum(), error.sum()], np.float32)]
        for param, grad, (m, v) in zip((vectors, soft, bias), grads, state, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param -= RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    return Model(vectors @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """The probability of label 1; a text without words has that of the bias alone, at most a half."""
        docs = [split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        if new := list({w for d in docs for w in d} - self.known.keys()):
            self.known.update(zip(new, self.model.words(new).tolist(), strict=True))
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        logit = np.full(len(docs), min(self.model.bias, 0.0))
        full = np.flatnonzero(sizes)
        if len(full):
            s = np.fromiter((x for d in docs for x in map(self.known.__getitem__, d)), float, sizes.sum())
            logit[full] = _worst(s, (np.cumsum(sizes) - sizes)[full], sizes[full])[1] + self.model.bias
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, volume: int = SAMPLE_BYTES) -> DataFrame:
    """(r, y): the rows to train on, by their keys: of each class the whole documents of smallest hash, at most `sample` of them and none after `volume` bytes.

    The held-out third is left out; a document is toxic if any of its labels says so; a repeated row counts once. doc_ids choose rows and are no input.
    """
    known = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("y")).where("y in (0, 1) and doc_id is not null")
    rows = docs.where("text is not null and doc_id is not null").select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("r"), F.octet_length("text").alias("size"))
    rows = rows.join(known, "doc_id").dropDuplicates(["r"]).withColumn("h", F.xxhash64("doc_id"))
    chosen = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy("h", "doc_id", "r").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    before = F.sum("size").over(W.partitionBy("y").orderBy("h", "doc_id", "r").rowsBetween(W.unboundedPreceding, -1))
    return chosen.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < volume).select("r", "y")


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with label and word hashes for each document, and one with hash and n-grams for each distinct word of a batch."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            docs = [split(t) for t in b.column(1).to_pylist()]
            words = list({w for d in docs for w in d})
            h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)).view(np.int64)
            code = dict(zip(words, h.tolist(), strict=True))
            w = [np.fromiter((code[x] for x in d), np.int64, len(d)).tobytes() for d in docs]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.array(w, pa.binary()), pa.nulls(len(w), pa.int64()), pa.nulls(len(w), pa.binary())], ["y", "w", "h", "g"])
            if words:
                grams, starts = subwords(words)
                g = [x.astype(np.int32).tobytes() for x in np.split(grams, starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(g), pa.int32()), pa.nulls(len(g), pa.binary()), pa.array(h), pa.array(g, pa.binary())], ["y", "w", "h", "g"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, volume: int = SAMPLE_BYTES) -> Model:
    """Train on labelled_sample(). Executors turn its texts into numbers; the driver receives these, of at most 2 * volume bytes of text and two documents more."""
    small_batches(docs.sparkSession)
    chosen = labelled_sample(docs, labels, sample, volume)
    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("r"), "text").join(F.broadcast(chosen), "r").dropDuplicates(["r"])
    made = cut(texts.select("y", "text").mapInArrow(lean(_numbers), "y int, w binary, h long, g binary"), "sample")
    rows = made.where("w is not null").orderBy("y", "w").select("y", "w").toArrow()
    y, texts = rows.column("y").to_numpy().astype(np.int64), _flat(rows.column("w"), np.int64)
    words = made.where("h is not null").dropDuplicates(["h"]).orderBy("h").select("h", "g").toArrow()
    return train(Sample.of(y, texts, words.column("h").to_numpy(), _flat(words.column("g"), np.int32)))


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; only the text is scored. Null and empty texts have a low score."""
    sent = docs.sparkSession.sparkContext.broadcast((model.value, model.bias))  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*sent.value))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                p = scorer(b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit on the labels outside the held-out third and score every document. Without labels of both classes all scores are the labels' share.

    Null, empty and blank texts score as the bias alone does, at most a half. Repeated rows are scored as often as they occur; a null doc_id is not held out.
    Columns but doc_id and text are not read. No rows give no rows.
    """
    return score_documents(docs, fit(docs, labels, sample))
