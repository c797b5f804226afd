"""Byte-level BPE by merge replay over the distinct words of a worker's partitions.

The text is split by the tokenizer's pattern. Words not met before in the Python worker are encoded
together: an index maps each rank to the positions of the pairs that merge into it, the lowest
rank is applied everywhere at once, and only the pairs at the touched neighbours are looked up anew. Every other
occurrence of a word takes its ids from the table of words.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import lean, small_batches

#: Words whose ids a worker remembers; beyond it the table starts anew, which costs time and changes no result.
REMEMBERED = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Pairs(dict):
    """(left id << 32 | right id) -> the id that both merge into, or -1; looked up by their bytes once. An id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.token = ranks, {i: t for t, i in ranks.items()}

    def __missing__(self, key: int) -> int:
        self[key] = r = self.ranks.get(self.token[key >> 32] + self.token[key & 0xFFFFFFFF], -1)
        return r


def replay(words: list[bytes], ranks: dict[bytes, int], pairs: Pairs | None = None) -> list[list[int]]:
    """The ids of each non-empty word."""
    merge = Pairs(ranks) if pairs is None else pairs
    single = [ranks.get(bytes([c])) for c in range(256)]
    token = [single[c] for w in words for c in w]
    size = len(token)
    nxt, prv, first, at = list(range(1, size + 1)), list(range(-1, size - 1)), [], 0
    for w in words:
        first.append(at)
        prv[at] = -1
        at += len(w)
        nxt[at - 1] = -1
    index: dict[int, list[int]] = {}
    for i in range(size):
        if (j := nxt[i]) >= 0 and (r := merge[token[i] << 32 | token[j]]) >= 0:
            index.setdefault(r, []).append(i)
    heap = list(index)
    heapify(heap)
    live = bytearray(b"\1") * size
    while heap:
        r = heappop(heap)
        places = sorted(index.pop(r))  # left to right within a word, as overlapping pairs demand
        for n, i in enumerate(places):
            if not live[i] or (j := nxt[i]) < 0 or merge[token[i] << 32 | token[j]] != r:
                continue
            token[i], live[j] = r, 0
            nxt[i] = k = nxt[j]
            near = [i]
            if k >= 0:
                prv[k] = i
            if (p := prv[i]) >= 0:
                near.append(p)
            sooner = False
            for q in near:
                if (m := nxt[q]) >= 0 and (s := merge[token[q] << 32 | token[m]]) >= 0:
                    if s not in index:
                        index[s] = []
                        heappush(heap, s)
                    index[s].append(q)
                    sooner |= s <= r
            if sooner and n + 1 < len(places):  # the new pair has its turn before the places left
                if r not in index:
                    index[r] = []
                    heappush(heap, r)
                index[r] += places[n + 1 :]
                break
    out = []
    for i in first:
        ids = []
        while i >= 0:
            ids.append(token[i])
            i = nxt[i]
        out.append(ids)
    return out


class Codec:
    """Encodes texts to little-endian unsigned 32-bit ids and back; remembers words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.pairs = Pairs(ranks)
        self.token = self.pairs.token
        self.words: dict[str, bytes] = {}

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        parts = [self.split(t) for t in texts]
        if len(self.words) > REMEMBERED:
            self.words, self.pairs = {}, Pairs(self.ranks)
        if new := list({w for p in parts for w in p} - self.words.keys()):
            ids = replay([w.encode("utf-8", "replace") for w in new], self.ranks, self.pairs)
            self.words.update((w, b"".join(i.to_bytes(4, "little") for i in x)) for w, x in zip(new, ids, strict=True))
        get = self.words.__getitem__
        for p in parts:
            yield b"".join(map(get, p))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=1)
def codec_of(path: str, pattern: str, changed: int) -> Codec:
    """The worker's codec, words included, for all tasks that it runs; a changed rank file makes another."""
    return Codec(load_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, digests: bool = False, decode: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) or, with digests, (doc_id, n_tokens, ids_sha256, decoded_sha256), or, with decode, (doc_id, n_tokens, ids, decoded_sha256), one row per row of docs (doc_id, text).

    path names a rank file that executors have too. ids are little-endian unsigned 32-bit integers. Null and empty texts have no
    ids. The digests are of the ids and of the bytes decoded from them. Repeated rows come out as often as they went in.
    """
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded_sha256 string" if decode else "ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, pattern, os.stat(path).st_mtime_ns)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = [t or "" for t in b.column(1).to_pylist()]
                ids = list(codec.encode(texts))
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                rest = [pa.array([hashlib.sha256(x).hexdigest() for x in ids])] if digests else [pa.array(ids, pa.binary())]
                if digests or decode:
                    rest.append(pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]))
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), n, *rest], [f.split()[0] for f in schema.split(", ")])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)
