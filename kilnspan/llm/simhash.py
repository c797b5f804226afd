"""SimHash near-duplicates by anchor-point covering.

The 64 bits are cut into pieces. Two fingerprints that differ in at most T bits differ in
at most T // len(PIECES) bits of one piece. In each piece the codewords of a covering code
are the anchors: every value has an anchor within the code's radius R, so of two values at
most t apart, both lie within R + t of the nearest anchor of either. A fingerprint goes to every
anchor within R + t, and the members of an anchor are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, lean, row_key, small_batches
from .components import components

#: Generator polynomials of the perfect binary Golay code of length 23 (radius 3) and the Hamming code of length 15 (radius 1).
GOLAY, HAMMING = 0b101011100011, 0b10011
#: (bits, generator, length of the code, radius); bits past the code's length are anchors as they are.
PIECES = ((23, GOLAY, 23, 3), (23, GOLAY, 23, 3), (18, HAMMING, 15, 1))
THRESHOLD = 4
#: About as many anchors has a fingerprint.
ANCHORS = 20
#: Members of an anchor compared by one task at a time. Larger anchors are dealt to finer groups, and what is larger still is cut into blocks, each pair of blocks a task.
BLOCK = 4096
#: Stands for a missing doc_id.
NONE = (1 << 63) - 1
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Bit i is set if it is set in over half of the hashes of the text's shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        found = np.array([h(line, seed)], "<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = len(words) - width + 1
        found = np.fromiter((h(line[i:j], seed) for i, j in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(found), 1 << 14):
        ones += np.unpackbits(found[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found)).view("<u8")[0])


def with_fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, r, fp): one row per row of docs; r is the row's key (id and text), fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width, seed) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(fps)], ["doc_id", "r", "fp"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("r"), "text").mapInArrow(lean(run), "doc_id long, r long, fp long")


@lru_cache
def _anchor_table(bits: int, generator: int, length: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low and of the high 12 bits, and by syndrome the error patterns of weight up to reach (-1 pads)."""
    degree = generator.bit_length() - 1

    def rest(v: int) -> int:
        for i in range(length - 1, degree - 1, -1):
            if v >> i & 1:
                v ^= generator << (i - degree)
        return v

    one = [rest(1 << i) if i < length else 0 for i in range(bits)]
    half = np.zeros((2, 4096), np.int64)
    for side in (0, 1):
        for i in range(min(12, bits - 12 * side)):
            half[side][(np.arange(4096) >> i & 1) == 1] ^= one[12 * side + i]
    by: list[list[int]] = [[] for _ in range(1 << degree)]
    for w in range(reach + 1):
        for at in combinations(range(bits), w):
            s = e = 0
            for i in at:
                s, e = s ^ one[i], e | 1 << i
            by[s].append(e)
    errors = np.full((len(by), max(map(len, by))), -1, np.int64)
    for s, es in enumerate(by):
        errors[s, : len(es)] = es
    return half, errors


def anchors_of(fps: np.ndarray, threshold: int = THRESHOLD, pieces=PIECES) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys (piece and codeword) of every anchor within radius plus threshold of each fingerprint."""
    rows, keys, low = [], [], 0
    for k, (bits, generator, length, radius) in enumerate(pieces):
        v = (fps.view(np.uint64) >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64)
        half, errors = _anchor_table(bits, generator, length, radius + threshold // len(pieces))
        e = errors[half[0][v & 4095] ^ half[1][v >> 12]]
        r, c = np.nonzero(e >= 0)
        rows.append(r)
        keys.append(v[r] ^ e[r, c] | k << 56)
        low += bits
    return np.concatenate(rows), np.concatenate(keys)


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Runs of rows equal in their first columns, from batches sorted by them."""
    held: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        edge = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols[:keys]], axis=0)) + 1
        for i, j in zip([0, *edge[:-1]], edge, strict=False):
            yield [c[i:j] for c in cols]
        held = [c[edge[-1] :] if len(edge) else c for c in cols]
    if held is not None:
        yield held


def _local_links(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Forest edges of the links between the members of an anchor's pair of blocks: fewer than members."""
        for _, i, j, block, fp in _grouped(batches, 3):
            if len(fp) < 2:
                continue
            left, right = fp[block == i[0]].view(np.uint64), fp[block == j[0]].view(np.uint64)
            root: dict[int, int] = {}

            def find(x: int, root=root) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            u, v = [], []
            for at in range(0, len(left), 512):
                part = left[at : at + 512]
                a, b = np.nonzero(np.bitwise_count(part[:, None] ^ right[None, :]) <= threshold)
                for x, y in zip(part[a].tolist(), right[b].tolist(), strict=True):
                    if x != y and (p := find(x)) != (q := find(y)):
                        root[max(p, q)] = min(p, q)
                        u.append(x)
                        v.append(y)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (u, v)], ["u", "v"])

    return run


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(u, v): links of at most threshold bits between the fingerprints fp of the table, of each anchor a forest that joins what its links join."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy()
            for at in range(0, len(fps), 20_000):
                r, k = anchors_of(fps[at : at + 20_000], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fps[at : at + 20_000][r])], ["anchor", "fp"])

    placed = cut(distinct.select("fp").mapInArrow(lean(place), "anchor long, fp long"), "anchors", ANCHORS * distinct.count())
    # at most one row for each codeword of PIECES: 24,576
    sizes = placed.groupBy("anchor").count().where("count > 1").select("anchor", (F.col("count") > BLOCK).alias("large"))
    members = placed.join(F.broadcast(sizes), "anchor")
    usual = members.where("not large").select(F.col("anchor").alias("g"), "fp")
    groups = cut(usual.unionByName(_finer(members.where("large"), threshold)), "groups", placed.count())
    over = groups.groupBy("g").count().where(F.col("count") > BLOCK).select("g", F.ceil(F.col("count") / BLOCK).cast("int").alias("n"))
    n = F.coalesce("n", F.lit(1))
    pairs = (
        groups.join(over, "g", "left")
        .withColumn("block", F.pmod(F.xxhash64("fp"), n).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
        .select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")
    )
    return pairs.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(lean(_local_links(threshold)), "u long, v long")


def _finer(members: DataFrame, threshold: int, pieces=PIECES) -> DataFrame:
    """(g, fp): members of large anchors dealt to finer groups, so that a row's comparisons don't grow with the table.

    The bits outside the anchor's piece are cut into threshold + 2 parts, of which links leave two alike at least. A member goes to a group for
    each two parts, with those that have the same bits there.
    """
    rows, low = None, 0
    for k, (bits, *_) in enumerate(pieces):
        rest = [b for b in range(64) if not low <= b < low + bits]
        cuts = [sum(1 << b for b in rest[x :: threshold + 2]) for x in range(threshold + 2)]
        masks = [int(np.array(x | y, np.uint64).view(np.int64)) for x, y in combinations(cuts, 2)]
        keys = F.array(*[F.xxhash64("anchor", F.lit(m), F.col("fp").bitwiseAND(F.lit(m))) for m in masks])
        rows = keys if rows is None else F.when(F.shiftright("anchor", 56) == k, keys).otherwise(rows)
        low += bits
    return members.select(F.explode(rows).alias("g"), "fp")


def link_fingerprints(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(fp, root): the fingerprints of the table that link with another, directly or through others, and the smallest one reached."""
    return components(links(distinct, threshold)).withColumnRenamed("node", "fp")


def _components(fps: DataFrame, threshold: int) -> DataFrame:
    """(fp, root, least): each fingerprint, the smallest of its component's nodes and the smallest doc_id there; no doc_id is the largest.

    Fingerprints enter the components under their smallest doc_id, so no component's rows need meet to find its own. Where one doc_id is the
    smallest of several fingerprints, the fingerprint goes with it, as they are not one node.
    """
    classes = cut(fps.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NONE))).alias("least")), "classes", fps.count())
    shared = classes.groupBy("least").count().where("count > 1").limit(1).count()
    own = F.struct("least", "fp") if shared else F.col("least")
    node = classes.select("fp", own.alias("node"))
    u, v = (node.select(F.col("fp").alias(x), F.col("node").alias(f"n{x}")) for x in "uv")
    named = links(classes, threshold).join(u, "u").join(v, "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"))
    roots = components(named)
    found = node.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    return cut(found.select("fp", "root", F.col("root.least" if shared else "root").alias("least")), "linked", classes.count())


def simhash_groups(docs: DataFrame, threshold: int = THRESHOLD, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text; other columns are ignored).

    Words are runs of anything but ASCII white space, A-Z lowered; shingles are width words
    (a shorter text: all its words). Null, empty and blank texts have fingerprint zero and link like any
    other. Rows whose fingerprints differ in at most threshold bits link; component_id is the
    smallest doc_id reachable. Rows with a null doc_id get the smallest one of the others (null
    if there is none). Repeated rows come out as often as they went in. No rows give no rows.
    """
    fps = cut(with_fingerprints(docs, width, seed), "fingerprints")
    found = _components(fps, threshold).select("fp", F.nullif(F.col("least"), F.lit(NONE)).alias("component_id"))
    return fps.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each group: that of the smallest doc_id (null is the largest), of unlike texts with one doc_id that of the smallest key, of repeated rows any; columns unchanged."""
    fps = cut(with_fingerprints(docs), "fingerprints")
    rows = fps.join(_components(fps, threshold), "fp").where(F.coalesce("doc_id", F.lit(NONE)) == F.col("least"))
    first = rows.groupBy("root").agg(F.min("r").alias("r")).select("r")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    kept = docs.select(own, row_key(F.col("doc_id"), F.col("text")).alias("r")).join(first, "r")
    # the join has sorted by r already
    return kept.withColumn("n", F.row_number().over(W.partitionBy("r").orderBy("r"))).where("n = 1").select("own.*")
