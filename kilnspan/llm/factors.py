"""Substring dedup by Relative Lempel-Ziv parsing over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .passages import GONE, SHARED, WORDS, Context, Units, cleaned, kept_pieces, kept_text, repeated_spans

_K = 0x9E3779B97F4A7C15
_K_INVERSE = pow(_K, -1, 1 << 64)


def _powers(k: int, n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(k))
    out[0] = 1
    return np.multiply.accumulate(out)


class Reference:
    """The shard's blocks as one index: for each window the block of the smallest doc_id that has it, and whether several documents do.

    docs and tops: the smallest and largest doc_id that have the block in full.
    """

    def __init__(self, blocks: list[np.ndarray], docs: list[int], tops: list[int], window: int):
        sizes = np.array([len(b) for b in blocks])
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.window = window
        u = np.concatenate(blocks)
        n = len(u)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((u ^ (u >> np.uint64(32))) * _powers(_K, n)[:n], dtype=np.uint64)])
        self.unit = _powers(_K_INVERSE, n)
        block = np.repeat(np.arange(len(blocks)), sizes)
        self.limit = self.ends[block]  # where a place's block ends
        valid = np.flatnonzero(np.arange(n) + window <= self.limit)
        h = self.hash(valid, np.full(len(valid), window))
        doc = np.array(docs)[block[valid]]
        order = np.lexsort((valid, doc, h))
        head = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0])) if len(order) else np.zeros(0, np.int64)
        first = np.repeat(order[head], np.diff(np.append(head, len(order))))
        self.shared = np.zeros(n, bool)
        if len(order):
            self.shared[valid[order]] = np.repeat(np.maximum.reduceat(np.array(tops)[block[valid]][order], head) > doc[order][head], np.diff(np.append(head, len(order))))
        self.source = np.full(n, -1)
        earlier = doc[first] < doc[order]
        self.source[valid[order[earlier]]] = valid[first[earlier]]
        at = np.where(self.source >= 0, np.arange(n), n)
        self.next = np.append(np.minimum.accumulate(at[::-1])[::-1], n) if n else np.array([0])

    def hash(self, i: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[i + length] - self.sums[i]) * self.unit[i]

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and from j on, inside both blocks; at least a window."""
        low = np.full(len(i), self.window)
        high = np.minimum(self.limit[i] - i, self.limit[j] - j)
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high + 1) // 2, low)
            same = self.hash(i, mid) == self.hash(j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def parse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Factors (block, start, length) of at least a window: each block is factored greedily from its first word, all blocks in step."""
        rows: list[tuple[np.ndarray, ...]] = []
        block, at = np.arange(len(self.starts)), self.starts.copy()
        while len(block):
            i = self.next[at]
            on = i < self.ends[block]
            block, i = block[on], i[on]
            if not len(block):
                break
            length = self.extend(i, self.source[i])
            rows.append((block, i, length))
            at = i + length
        return tuple(np.concatenate(x) for x in zip(*rows, strict=True)) if rows else tuple(np.zeros(0, np.int64) for _ in range(3))


def by_factors(shard: list[tuple[Context, int, int]], units: Units) -> Iterator[tuple[int, int, np.ndarray]]:
    """Window starts inside long factors, and those across a factor's end that the index has; and those that a later document has."""
    blocks = [units.array(x.u[i * units.size : (j + units.window - 1) * units.size]) for x, i, j in shard]
    ref = Reference(blocks, [x.m for x, _, _ in shard], [x.top for x, _, _ in shard], units.window)
    mark = np.zeros(len(ref.source) + 1, np.int64)
    block, start, length = ref.parse()
    np.add.at(mark, start, 1)
    np.add.at(mark, start + length - units.window + 1, -1)
    inside = np.cumsum(mark)[:-1] > 0
    for off in range(1, units.window):  # the windows that begin in a factor's last words
        edge = start + length - off
        inside[edge[ref.source[edge] >= 0]] = True
    for k, (x, i, _) in enumerate(shard):
        gone = inside[ref.starts[k] : ref.ends[k]]
        for kind, marked in ((GONE, gone), (SHARED, ref.shared[ref.starts[k] : ref.ends[k]] & ~gone)):
            if len(at := np.flatnonzero(marked)):
                yield x.c, kind, at + i


def removal_report(docs: DataFrame, window: int = WORDS.window) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, n_shared, text) for each row of docs.

    A word goes if a window of words over it also starts in a row with a smaller doc_id; all are judged on the
    input. Null texts have no words, a null doc_id is the largest, and rows with the same doc_id do not remove each other's words.
    kept_sha256 is of the kept words joined by one space; n_shared are the words covered by a window that also starts in a row with
    another doc_id, smaller or larger, so it tells of the documents that keep a repeated passage too. text is what is left of the text, its white space as it was.
    """
    units = Units(8, window, min(WORDS.gram, window))

    def apply(text, runs, shared):
        words = (text or b"").split()
        keep, at = [], 0
        for i, j in runs:
            keep += words[at:i]
            at = j
        keep += words[at:]
        return len(words), len(words) - len(keep), hashlib.sha256(b" ".join(keep)).hexdigest(), sum(j - i for i, j in shared), kept_text(kept_pieces(text or b"", runs, units))

    return cleaned(docs, repeated_spans(docs, units, by_factors, later_only=True), ["doc_id"], apply, "n_words long, n_removed long, kept_sha256 string, n_shared long, text string")


_SPACE, _WORD = "[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w, regexp_extract_all(coalesce(text, ''), '{_SPACE}*{_WORD}+') AS c FROM documents),
x AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT r, doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM x),
f AS (SELECT h, min(doc_id) AS first, max(doc_id) AS last FROM h GROUP BY h),
hit AS (SELECT r, i, i AS o, CASE WHEN doc_id > first THEN i END AS s FROM h JOIN f USING (h) WHERE last > first),
p AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, unnest(c) AS chunk FROM d),
g AS (SELECT r, i, word, chunk, max(s) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone, max(o) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS shared FROM p LEFT JOIN hit USING (r, i)),
t AS (SELECT *, lag(gone, 1, false) OVER (PARTITION BY r ORDER BY i) AS before FROM g),
a AS (SELECT r, count(*) FILTER (gone) AS n, count(*) FILTER (shared) AS s, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept, string_agg(CASE WHEN NOT gone THEN chunk WHEN before THEN '' ELSE left(chunk, length(chunk) - length(word)) END, '' ORDER BY i) AS text FROM t GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, CAST(coalesce(s, 0) AS BIGINT) AS n_shared, coalesce(a.text, '') || regexp_extract(d.text, '{_SPACE}*$') AS text FROM d LEFT JOIN a USING (r)
"""
