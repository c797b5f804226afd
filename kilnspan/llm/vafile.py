"""Exact top-k by inner product with vector-approximation files.

Each vector's cells, a byte a component, are written once, beside the exact vectors. A scan of the cells bounds every query's
product with every vector; exact products are made in order of the upper bounds, until the k-th result is certain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, lean

#: Queries sent to every task at once; more are taken in further scans of the cells.
QUERIES = 8192
#: Cells a component; candidates and queries whose bounds are held at once; exact vectors read at once.
CELLS, BLOCK, TILE, READ = 256, 4096, 256, 64
#: Scores past the ends of a long count as these.
LEAST, MOST = -(1 << 63) + 1, (1 << 63) - 1


def largest(d: int) -> int:
    """Vectors of d components, all below this, have products whose sums fit a long."""
    return 1 << (62 - max(1, int(d) - 1).bit_length()) // 2


def whole_components(ids: pa.Array, v: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By dimension: row numbers and floor(scale * component) of the vectors that are whole and finite; those with a component past largest() apart, as Python's integers."""
    lengths = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = v.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero((lengths == d) & known)
        raw = values[starts[rows][:, None] + np.arange(d)]
        finite = np.isfinite(raw).all(1)
        rows, raw = rows[finite], raw[finite]
        with np.errstate(over="ignore"):
            x = np.floor(scale * raw)
        usual = (np.abs(x) < largest(d)).all(1)
        if usual.any():
            yield rows[usual], x[usual].astype(np.int64)
        if not usual.all():
            yield rows[~usual], np.array([[math.floor(scale * Fraction(c)) for c in row] for row in raw[~usual].tolist()], object)


_EXACT = "vec_id long, asked boolean, d int, x array<long>, large array<string>"


def exact_vectors(vectors: DataFrame, is_query: Column, scale: int) -> DataFrame:
    """(vec_id, asked, d, x, large): the vectors in whole numbers, as text where they are past largest(); a repeated row once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                for rows, x in whole_components(b.column(0), b.column(1), scale):
                    n, text = len(rows), x.dtype == object
                    longs = pa.nulls(n, pa.list_(pa.int64())) if text else pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                    texts = pa.array([[str(c) for c in row] for row in x.tolist()], pa.list_(pa.string())) if text else pa.nulls(n, pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)).cast(pa.int64()), b.column(2).take(pa.array(rows)), pa.array(np.full(n, x.shape[1], np.int32)), longs, texts], ["vec_id", "asked", "d", "x", "large"])

    made = vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("asked")).mapInArrow(lean(run), _EXACT)
    twice = cut(vectors.where("vec_id is not null").groupBy("vec_id").count().where("count > 1").select("vec_id"), "twice")
    if not twice.limit(1).count():
        return made
    return made.join(twice, "vec_id", "left_anti").unionByName(made.join(twice, "vec_id", "left_semi").distinct())


def _float(c: int) -> float:
    return float(c) if abs(c) < 1 << 1000 else math.copysign(math.inf, c)


def _matrix(b: pa.RecordBatch, name: str = "x") -> np.ndarray:
    """The rows' vectors, all of one length, as floats, which bounds allow for."""
    x = b.column(b.schema.get_field_index(name))
    if x.null_count:
        return np.array([[_float(int(c)) for c in row] for row in b.column(b.schema.get_field_index("large")).to_pylist()])
    return x.flatten().to_numpy().astype(float).reshape(len(x), -1)


def _alike(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch's rows by length and by how they are written."""
    kind = b.column(b.schema.get_field_index("d")).to_numpy() * 2 + b.column(b.schema.get_field_index("x")).is_null().to_numpy(zero_copy_only=False)
    for k in np.unique(kind):
        yield b.take(pa.array(np.flatnonzero(kind == k)))


class Grid:
    """Cells of equal width between the least and the most of each component."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        with np.errstate(over="ignore"):
            width = (high - low) / CELLS
        self.fits = np.isfinite(width).all()
        self.low, self.width = low, np.where(width > 0, width, 1.0)
        # a component may lie past its cell's edge by what rounding moves it
        self.radius = self.width / 2 + 1e-9 * np.maximum(np.abs(low), np.abs(high)) + 1e-6

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.low) / self.width, 0, CELLS - 1).astype(np.uint8) if self.fits else np.zeros(x.shape, np.uint8)

    def bounds(self, q: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most inner product of each query with each row of cells, with room for rounding."""
        if not self.fits:
            inf = np.full((len(q), len(cells)), np.inf)
            return -inf, inf
        centre = self.low + (cells + 0.5) * self.width
        with np.errstate(over="ignore", invalid="ignore"):
            mid = q @ centre.T
            off = (np.abs(q) @ self.radius)[:, None] + 1e-12 * (np.abs(q) @ np.abs(centre).T) + 1
            return np.nan_to_num(mid - off, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(mid + off, nan=np.inf, posinf=np.inf, neginf=-np.inf)


def better(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best distinct pairs, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    new = np.ones(len(ids), bool)
    new[1:] = (np.diff(ids) != 0) | (np.diff(scores) != 0)
    return ids[new][:k], scores[new][:k]


class Search:
    """The best of a task's candidates for some queries, as blocks of cells and vectors come in."""

    def __init__(self, grid: Grid, ids: np.ndarray, q: np.ndarray, exact: list[np.ndarray], k: int):
        self.grid, self.ids, self.q, self.exact, self.k = grid, ids, q, exact, k
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        self.read = 0

    def add(self, ids: np.ndarray, cells: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(self.ids), TILE):
            _, most = self.grid.bounds(self.q[at : at + TILE], cells)
            for i in range(len(most)):
                self._take(at + i, ids, most[i], x)

    def _take(self, i: int, ids: np.ndarray, most: np.ndarray, x: np.ndarray) -> None:
        """Vectors are read in order of their upper bounds, until the k-th score is above what is left."""
        b_ids, b_scores = self.best[i]
        bar = b_scores[-1] if len(b_scores) == self.k else -np.inf
        near = np.flatnonzero((most >= bar) & (ids != self.ids[i]))
        near = near[np.argsort(-most[near], kind="stable")]
        for at in range(0, len(near), READ):
            if len(b_scores) == self.k and most[near[at]] < b_scores[-1]:
                break
            part = near[at : at + READ]
            self.read += len(part)
            b_ids, b_scores = better(np.append(b_ids, ids[part]), np.append(b_scores, scores_of(x[part], self.exact[i])), self.k)
        self.best[i] = b_ids, b_scores

    def rows(self) -> tuple[np.ndarray, ...]:
        return np.repeat(self.ids, [len(i) for i, _ in self.best]), *(np.concatenate([b[z] for b in self.best]) for z in (0, 1))


def scores_of(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with a query, exactly."""
    if x.dtype != object and q.dtype != object:
        return x @ q
    return np.array([products(row, q.tolist()) for row in x.tolist()], np.int64)


def products(x: list[int], q: list[int]) -> int:
    """The inner product of whole numbers of any size; past a long it is its end."""
    return min(max(sum(a * b for a, b in zip(x, q, strict=True)), LEAST), MOST)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row of vectors (vec_id, embedding) its k best other rows.

    score is the inner product of floor(scale * component), in whole numbers; past the ends of a long (LEAST, MOST) it counts as these. Vectors that are
    null, empty or hold a null or non-finite component take no part, nor do rows without an id; only vectors of one length are compared. Ties go to the
    smaller vec_id. Repeated rows count once. Extra columns are ignored; no rows give no rows.

    Every task scans its cells for all queries of a round, reads exact vectors in order of their upper bounds until its k-th score is certain, and keeps k for
    each query, however many vectors are alike. The driver holds a round's queries and the cells' edges: two numbers a component.
    """
    spark = vectors.sparkSession
    exact = exact_vectors(vectors, is_query, scale)

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for b in _alike(whole):
                x = _matrix(b)
                low, high = found.get(x.shape[1], (np.inf, -np.inf))
                found[x.shape[1]] = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        for d, (low, high) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(low), pa.array(high)], ["d", "at", "low", "high"])

    ends = exact.mapInArrow(lean(extremes), "d int, at int, low double, high double").groupBy("d", "at").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d", "at").toPandas()
    grids = {int(d): Grid(e["low"].to_numpy(), e["high"].to_numpy()) for d, e in ends.groupby("d")}
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _alike(whole):
                x = _matrix(b)
                cells = grids[x.shape[1]].cells(x)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([c.tobytes() for c in cells], pa.binary()), b.column(3), b.column(4)], ["vec_id", "d", "cells", "x", "large"])

    cells = cut(exact.mapInArrow(lean(place), "vec_id long, d int, cells binary, x array<long>, large array<string>"), "cells")
    queries = cut(exact.where("asked").select(F.col("vec_id").alias("query_id"), "d", F.col("x").alias("qx"), F.col("large").alias("qlarge")), "queries")

    def scan(asked: dict[int, tuple[list[int], list[np.ndarray]]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searches = {d: Search(grids[d], np.array(i), np.array([[_float(c) for c in q.tolist()] for q in exact]), exact, k) for d, (i, exact) in sent.value.items()}
            for whole in batches:
                for at in range(0, whole.num_rows, BLOCK):
                    for b in _alike(whole.slice(at, BLOCK)):
                        d = b.column(1)[0].as_py()
                        if d in searches:
                            rows = b.column(2).to_pylist()
                            x = b.column(3).flatten().to_numpy().reshape(len(rows), d) if not b.column(3).null_count else np.array([[int(c) for c in row] for row in b.column(4).to_pylist()], object)
                            searches[d].add(b.column(0).to_numpy(), np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), d), x)
            for s in searches.values():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in s.rows()], ["query_id", "vec_id", "score"])

        return cells.mapInArrow(lean(run), "query_id long, vec_id long, score long")

    # a bounded number of queries at a time; the rest stays in its table until its turn
    rounds, asked, held = [], {}, 0
    for row in queries.toLocalIterator():
        i, q = asked.setdefault(row.d, ([], []))
        i.append(row.query_id)
        q.append(np.array(row.qx) if row.qlarge is None else np.array([int(c) for c in row.qlarge], object))
        held += 1
        if held == QUERIES:
            rounds.append(scan(asked))
            asked, held = {}, 0
    if held or not rounds:
        rounds.append(scan(asked))
    found = rounds[0]
    for more in rounds[1:]:
        found = found.unionByName(more)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v AS q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
