"""Embedding near-duplicates with hierarchical navigable small-world graphs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

#: Vectors of a graph; links of a node above the ground layer (twice as many on it); first beam; share of links that audits must find.
SHARD, LINKS, BEAM, RECALL = 8192, 12, 48, 0.99
#: Queries that an audit compares with the whole shard at once, links to other vectors that it needs, and queries of other shards that share a task with one graph.
AUDIT, ENOUGH, VISITORS = 256, 1000, 16 * SHARD


class Graph:
    """Layers of neighbour lists over unit vectors; nodes join in groups that search the graph in step."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.x = x.astype(np.float32)
        n = len(x)
        r = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - r.random(n)) / np.log(LINKS)).astype(int), 6)
        order = np.argsort(-level, kind="stable")  # the upper layers come first, so the first node enters all searches
        self.entry = order[0]
        top = int(level[order[0]])
        self.layers = [np.full((n, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k in range(top + 1)]
        self.order, self.level = order, level
        at, size = 1, 1
        while at < n:
            self._join(order[at : at + size], order[:at])
            at += size
            size = min(512, 2 * size)

    def _join(self, nodes: np.ndarray, known: np.ndarray) -> None:
        found = np.full((len(nodes), 1), self.entry)
        for k in range(len(self.layers) - 1, -1, -1):
            found, sims = self.beam(self.x[nodes], found, k, BEAM)
            here = self.level[nodes] >= k
            if not here.any():
                continue
            mates = nodes[here]
            own = self.x[mates] @ self.x[mates].T
            np.fill_diagonal(own, -np.inf)
            c = np.concatenate([found[here], np.broadcast_to(mates, (len(mates), len(mates)))], 1)
            s = np.concatenate([sims[here], own], 1)
            width = self.layers[k].shape[1]
            best = np.argsort(-s, axis=1, kind="stable")[:, : 2 * width]
            c, s = np.take_along_axis(c, best, 1), np.take_along_axis(s, best, 1)
            c = np.where(np.isfinite(s), c, -1)
            chosen = self._spread(c, s, width // 2)
            self.layers[k][mates, : width // 2] = chosen
            i, j = np.nonzero(chosen >= 0)
            self._link_back(k, chosen[i, j], mates[i])

    def _spread(self, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, nearest first (-1 pads), those nearer to the row's node than to any chosen before; the nearest of the others fill up."""
        x = self.x[near]
        between = x @ x.transpose(0, 2, 1)
        out, chosen, n = near < 0, np.zeros(near.shape, bool), np.zeros(len(near), int)
        for i in range(near.shape[1]):
            chosen[:, i] = ok = ~out[:, i] & (n < most)
            n += ok
            out |= ok[:, None] & (between[:, :, i] >= sims)
        best = np.argsort(np.where(chosen, 0, np.where(near >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
        found = np.take_along_axis(near, best, 1)
        return np.pad(found, ((0, 0), (0, most - found.shape[1])), constant_values=-1)

    def _link_back(self, k: int, nodes: np.ndarray, others: np.ndarray) -> None:
        """Each node gains its others as neighbours; where that is too many, the spread of the nearest stays."""
        order = np.argsort(nodes, kind="stable")
        nodes, others = nodes[order], others[order]
        own, start, counts = np.unique(nodes, return_index=True, return_counts=True)
        width = self.layers[k].shape[1]
        for at in range(0, len(own), 1024):
            part, n, first = own[at : at + 1024], counts[at : at + 1024], start[at : at + 1024]
            row = self.layers[k][part]
            new = np.full((len(part), int(n.max())), -1, np.int64)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            new[np.repeat(np.arange(len(part)), n), inside] = others[first[0] : first[0] + n.sum()]
            new[(new[:, :, None] == row[:, None, :]).any(2)] = -1
            c = np.concatenate([row, new], 1)
            s = np.einsum("ncd,nd->nc", self.x[c], self.x[part])
            s[c < 0] = -np.inf
            best = np.argsort(-s, axis=1, kind="stable")[:, : 3 * width]
            c, s = np.take_along_axis(c, best, 1), np.take_along_axis(s, best, 1)
            full = (c >= 0).sum(1) > width
            kept = c[:, :width].copy()
            if full.any():
                kept[full] = self._spread(c[full], s[full], width)
            self.layers[k][part] = kept

    def beam(self, q: np.ndarray, start: np.ndarray, k: int, width: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1 pads) and similarities of the best nodes met on layer k, nearest first, from each query's start nodes."""
        m, links = len(q), self.layers[k]
        rows = np.arange(m)[:, None]
        seen = np.zeros((m, len(self.x) + 1), bool)  # the last column takes the pads
        ids = np.full((m, width), -1, np.int64)
        sims = np.full((m, width), -np.inf, np.float32)
        done = np.ones((m, width), bool)

        def add(new: np.ndarray) -> None:
            nonlocal ids, sims, done
            new = np.where(seen[rows, new], -1, new)
            new = np.sort(new, 1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            seen[rows, new] = True
            s = np.einsum("qnd,qd->qn", self.x[new], q)
            s[new < 0] = -np.inf
            c, t, e = np.concatenate([ids, new], 1), np.concatenate([sims, s], 1), np.concatenate([done, new < 0], 1)
            best = np.argsort(-t, axis=1, kind="stable")[:, :width]
            ids, sims, done = (np.take_along_axis(z, best, 1) for z in (c, t, e))

        add(start.astype(np.int64))
        while not done.all():
            pick = np.argsort(done, axis=1, kind="stable")[:, :at_once]
            live = ~np.take_along_axis(done, pick, 1)
            np.put_along_axis(done, pick, True, 1)
            nodes = np.where(live, np.take_along_axis(ids, pick, 1), -1)
            new = links[nodes]
            new[nodes < 0] = -1
            add(new.reshape(m, -1).astype(np.int64))
        return ids, sims

    def search(self, q: np.ndarray, width: int, least: float) -> list[np.ndarray]:
        """Ids at similarity least or more. A beam that holds nothing below it is too narrow, and those queries go again with a wider one."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        todo = np.arange(len(q))
        while len(todo):
            again = []
            step = max(16, min(512, (1 << 24) // (len(self.x) + 1), (1 << 20) // width))
            for at in range(0, len(todo), step):
                part = todo[at : at + step]
                found = np.full((len(part), 1), self.entry)
                for k in range(len(self.layers) - 1, 0, -1):
                    found = self.beam(q[part], found, k, 4)[0]
                ids, sims = self.beam(q[part], found, 0, min(width, len(self.x)))
                for i, a, s in zip(part, ids, sims, strict=True):
                    out[i] = a[s >= least]
                    if len(out[i]) == len(a) < len(self.x):
                        again.append(i)
            todo, width = np.array(again, int), width * 4
        return out


def exact_links(x: np.ndarray, q: np.ndarray, least: float) -> list[np.ndarray]:
    """For each query the members at cosine least or more, by comparing all of them in blocks."""
    return [np.flatnonzero(near) for at in range(0, len(q), AUDIT) for near in q[at : at + AUDIT] @ x.T >= least]


def links_of(graph: Graph, x: np.ndarray, q: np.ndarray, least: float, recall: float = RECALL) -> list[np.ndarray]:
    """For each query the members at cosine least or more, in double precision; the beam widens until an audit of queries finds that share of their links.

    Queries are compared exactly until they have ENOUGH links (the members' own, if q is x, without the match with themselves); they keep
    those, and so do all if the links run out first or no beam narrower than the shard passes.
    """
    margin = least - 1e-5  # float32 may lose a little
    order = np.random.default_rng(11).permutation(len(q))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
    links = done = 0
    while done < len(q) and links < ENOUGH:
        part = order[done : done + AUDIT]
        for i, a in zip(part, exact_links(x, q[part], least), strict=True):
            out[i] = a
            links += len(a) - (q is x)
        done += len(part)
    audited, rest = order[:done], order[done:]
    width = BEAM
    while len(rest) and width < len(x):
        found = graph.search(q[audited].astype(np.float32), width, margin)
        hit = sum(len(np.intersect1d(out[i], a)) - (q is x and i in a) for i, a in zip(audited, found, strict=True))
        if hit >= recall * links:
            for i, a in zip(rest, graph.search(q[rest].astype(np.float32), width, margin), strict=True):
                out[i] = a[x[a] @ q[i] >= least] if len(a) else a
            return out
        width *= 2
    for i, a in zip(rest, exact_links(x, q[rest], least), strict=True):
        out[i] = a
    return out


_FOUND = "a long, n long, root long"


def _shard(least: float):
    def run(t: pa.Table) -> pa.Table:
        """Members and visiting queries of one graph -> for each a of both its links' copies n, and its smallest node in the task's own forest."""
        ids = t.column("a").to_numpy()
        copies = t.column("copies").to_numpy()
        member = t.column("member").to_numpy(zero_copy_only=False)
        x = np.array(t.column("e").to_pylist(), np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        own = np.flatnonzero(member)
        if not len(own):
            return pa.table({"a": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        own = own[np.argsort(ids[own])]
        visit = np.flatnonzero(~member)
        graph, mine = Graph(x[own]), x[own]
        links: list[set[int]] = [set() for _ in ids]
        for i, f in zip(own.tolist(), links_of(graph, mine, mine, least), strict=True):
            links[i] = set(own[f].tolist()) - {i}
        for i in own.tolist():  # a link found from one side holds for both
            for j in links[i]:
                links[j].add(i)
        # a pair of shards meets in one task only: its audit asks for what a search from either side would find
        here = t.column("part").to_numpy() == t.column("p").to_numpy()
        n = [sum(int(copies[j]) for j in js) if h else 0 for js, h in zip(links, here, strict=True)]
        for i, f in zip(visit.tolist(), links_of(graph, mine, x[visit], least, 1 - (1 - RECALL) ** 2), strict=True):
            links[i] = set(own[f].tolist())
            n[i] = int(copies[own[f]].sum())
            for j in links[i]:
                n[j] += int(copies[i])
        root = list(range(len(ids)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i, js in enumerate(links):
            for j in js:
                p, q = find(i), find(j)
                if p != q:
                    lo, hi = (p, q) if ids[p] < ids[q] else (q, p)
                    root[hi] = lo
        # members come to every part of their shard: each reports their visitors' copies, their own part the members' too
        return pa.table({"a": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()), "root": pa.array([int(ids[find(i)]) for i in range(len(ids))], pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Rows link at cosine least or more if their labels are equal and not null and their vectors as long. Null, empty and zero vectors, and those with
    null or non-finite components, link with nothing, nor do rows without an id. Equal vectors are searched once and count as often as they occur (repeated rows too).
    Each label's distinct vectors are dealt to shards of about SHARD; of each two shards of a label the vectors of one query the other, and a link counts for both.
    """
    v = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    sound = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("e", lambda c: c != 0), F.lit(False))
    good = v.where(sound)
    classes = cut(good.groupBy("label", "e").agg(F.min("vec_id").alias("a"), F.count("*").alias("copies")).withColumn("d", F.size("e")), "classes")
    shards = classes.groupBy("label", "d").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"), F.ceil(F.count("*") / VISITORS).cast("int").alias("parts"))
    home = F.pmod(F.xxhash64("a", F.lit(1)), F.col("shards")).cast("int")
    part = F.pmod(F.xxhash64("a", F.lit(2)), F.col("parts")).cast("int")
    dealt = classes.join(shards, ["label", "d"]).withColumn("home", home).withColumn("part", part)
    # members go to every part of their own shard, visitors to their part of the other shards, of each two in one direction that evens out
    asks = F.when((F.col("shard") + F.col("home")) % 2 == 1, F.col("shard") < F.col("home")).otherwise(F.col("shard") > F.col("home"))
    members = dealt.withColumn("shard", F.col("home")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("member", F.lit(True))
    visitors = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).where(asks).withColumn("p", F.col("part")).withColumn("member", F.lit(False))
    columns = ["label", "d", "shard", "p", "a", "copies", "e", "member", "part"]
    grouped = members.select(columns).unionByName(visitors.select(columns))
    found = grouped.groupBy("label", "d", "shard", "p").applyInArrow(_shard(least), _FOUND)
    found = cut(found, "links")
    linked = found.groupBy("a").agg(F.sum("n").alias("n"))
    roots = cut(components(found.where("a <> root").select(F.col("a").alias("u"), F.col("root").alias("v"))), "roots")
    named = classes.join(linked, "a", "left").join(roots.withColumnRenamed("node", "a"), "a", "left").select("label", "e", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "a").alias("component_id"))
    linked = good.join(named, ["label", "e"]).select("vec_id", "n_links", "component_id")
    alone = v.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    own = F.col("component_id")
    return linked.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), own, F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT DISTINCT a AS n, a AS m FROM l UNION SELECT l.b, reach.m FROM reach JOIN l ON reach.n = l.a),
c AS (SELECT n, min(m) AS m FROM reach GROUP BY n),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, coalesce(c.m, vec_id) AS component_id, coalesce(c.m, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN c ON c.n = vec_id LEFT JOIN k ON k.a = vec_id
"""
