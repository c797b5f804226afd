"""Where windows of a fixed number of units (bytes or words) repeat across documents, without comparing all windows.

1. Each window's anchor is the start of its smallest gram hash (leftmost on ties), so equal windows have
   the same anchor at the same place. The windows of one anchor occurrence start at neighbouring
   places; the units they cover are its context. A row per occurrence holds hashes only.
2. Counts by context (partial before the shuffle) settle contexts that occur again whole. Only one of each
   context that shares its anchor with a different one is read from its document.
3. Within the contexts of an anchor, runs of WIDTH window starts whose common units occur once are dropped, and
   a resolver (suffix array or factors) finds the repeated windows in the rest.
   An anchor with more than GROUP contexts is not gathered: its windows are counted by their hash.

Equality rests on 64-bit hashes for whole contexts, and for words on 64-bit word hashes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, lean, partitions, row_key, small_batches

#: Contexts of one anchor that one task may gather.
GROUP = 4096
#: Window starts that share a core.
WIDTH = {1: 64, 8: 12}
#: Bytes of contexts that a resolver takes at once; an anchor's contexts stay together.
CHUNK = 1 << 20
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_POS = 24


@dataclass(frozen=True)
class Units:
    """What a text is made of: size in bytes of a unit in contexts, units in a window, units in a gram."""

    size: int
    window: int
    gram: int

    def of(self, text: bytes) -> np.ndarray:
        return np.frombuffer(text, np.uint8) if self.size == 1 else word_hashes(text.split())


    def array(self, context: bytes) -> np.ndarray:
        """The units of a context."""
        return np.frombuffer(context, np.uint8 if self.size == 1 else np.uint64)


BYTES = Units(1, 400, 32)
WORDS = Units(8, 50, 4)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def kept_pieces(text: bytes, runs: list[list[int]], units: Units) -> list[bytes]:
    """What these runs of its units leave of a text; a run of words goes with the space inside it."""
    if units.size > 1 and runs:
        ends = np.array([m.span() for m in _WORD.finditer(text)])
        runs = [[ends[i][0], ends[j - 1][1]] for i, j in runs]
    at, out = 0, []
    for i, j in runs:
        out.append(text[at:i])
        at = j
    out.append(text[at:])
    return out


def kept_text(pieces: list[bytes]) -> str:
    """The pieces as text; characters of which a part is gone go whole."""
    return "".join(p.decode("utf-8", "ignore") for p in pieces)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram at each place; bytes are taken eight at a time."""
    n = len(units) - gram + 1
    if units.dtype == np.uint8:
        padded = np.concatenate([units, np.zeros(8, np.uint8)])
        units, step, parts = np.ndarray((len(units),), "<u8", padded, strides=(1,)), 8, gram // 8
    else:
        step, parts = 1, gram
    h = units[:n] * _MIX[0]
    h ^= h >> np.uint64(29)
    for j in range(1, parts):
        h += units[step * j : step * j + n]
        h *= _MIX[j % 4]
        h ^= h >> np.uint64(31)
    return h


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    n = len(h)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(ahead[w - 1 : n], back[: n - w + 1])


def occurrences(u: np.ndarray, units: Units) -> tuple[np.ndarray, ...]:
    """Anchor hashes, anchor places, and the first and past-the-last window start of each anchor occurrence."""
    h = gram_hashes(u, units.gram)
    if len(h) >= 1 << _POS:  # places no longer fit beside the hash: rank the pairs
        key = np.empty(len(h), np.uint64)
        key[np.lexsort((np.arange(len(h)), h))] = np.arange(len(h), dtype=np.uint64)
        least = _sliding_min(key, units.window - units.gram + 1)
        place = np.empty(len(h), np.int64)
        place[key.astype(np.int64)] = np.arange(len(h))
        own = place[least.astype(np.int64)]
    else:
        mask = np.uint64((1 << _POS) - 1)
        own = (_sliding_min((h & ~mask) | np.arange(len(h), dtype=np.uint64), units.window - units.gram + 1) & mask).astype(np.int64)
    start = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
    return h[own[start]], own[start], start, np.append(start[1:], len(own))


def _spot(units: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, tail = xxhash.xxh64_intdigest, units.window - 1
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                found: list[tuple[np.ndarray, ...]] = []
                b = whole.slice(at, 512)
                for r, d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    u = units.of((t.as_py() or "").encode())
                    if len(u) < units.window:
                        continue
                    a, p, s, e = occurrences(u, units)
                    raw = memoryview(u).cast("B")
                    c = np.fromiter((digest(raw[i:j]) for i, j in zip((s * units.size).tolist(), ((e + tail) * units.size).tolist(), strict=True)), np.uint64, len(s))
                    found.append((a.view(np.int64), c.view(np.int64), np.full(len(s), r), np.full(len(s), d), s.astype(np.int32), (e - s).astype(np.int32), (p - s).astype(np.int32)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "c", "r", "d", "s", "n", "p"])

    return run


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """Row key r, the compressed text z and, if there are any, docs' columns in one struct `own`: what is shuffled where texts must meet their spans."""
    fields = [T.StructField("r", T.LongType()), T.StructField("z", T.BinaryType())]
    own = [F.struct(*[F.col(f"`{c}`") for c in columns]).alias("own")] if columns else []
    if columns:
        fields.append(T.StructField("own", docs.select(*own).schema["own"].dataType))

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3).compress
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                z = pa.array([None if not t.is_valid else pack(t.as_buffer()) for t in b.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), z, *b.columns[2:]], [f.name for f in fields])

    return docs.select(_key(docs).alias("r"), "text", *own).mapInArrow(lean(run), T.StructType(fields))


def _key(docs: DataFrame):
    return row_key(F.col("doc_id"), F.col("text"))


def unpack(z: bytes | None) -> bytes:
    return b"" if z is None else zstandard.ZstdDecompressor().decompress(z)


def _fetch(units: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                rows: list[tuple] = []
                b = whole.slice(at, 256)
                for z, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    raw = memoryview(units.of(unpack(z))).cast("B")
                    for w in wanted:
                        i, j = w["s"] * units.size, (w["s"] + w["n"] + units.window - 1) * units.size
                        rows.append((w["a"], w["c"], w["m"], w["top"], w["k"], w["n"], w["p"], bytes(raw[i:j])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _FETCHED, strict=True)], ["a", "c", "m", "top", "k", "n", "p", "u"])

    return run


_FETCHED = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


@dataclass
class Context:
    """One distinct context: key, smallest and largest doc_id, occurrences, window starts, the anchor's place in it, and its units."""

    c: int
    m: int
    top: int
    k: int
    n: int
    p: int
    u: bytes


def _survivors(group: list[Context], units: Units) -> Iterator[tuple[Context, int, int]]:
    """Runs of window starts [i, j) of the contexts of one anchor whose cores occur in the group again."""
    size, width = units.size, min(WIDTH[units.size], units.window)  # beyond a window the starts have no unit in common
    classes, seen = [], Counter()
    for x in group:
        for j in range((x.p - x.n + 1) // width, x.p // width + 1):
            lo, hi = max(0, x.p - (j + 1) * width + 1), min(x.n, x.p - j * width + 1)
            if lo < hi:
                core = (j, x.u[(x.p - j * width) * size : (x.p - (j + 1) * width + 1 + units.window) * size])
                classes.append((x, lo, hi, core))
                seen[core] += 1
    runs = sorted(((id(x), lo, hi, x) for x, lo, hi, core in classes if seen[core] > 1), key=lambda r: r[:2])
    held = None
    for _, lo, hi, x in runs:
        if held and held[0] is x and held[2] >= lo:
            held = (x, held[1], hi)
        else:
            if held:
                yield held
            held = (x, lo, hi)
    if held:
        yield held


#: Kinds of spans: of windows that make their words go, and of windows that other documents have too.
GONE, SHARED = 0, 1
Resolver = Callable[[list[tuple[Context, int, int]], Units], Iterator[tuple[int, int, np.ndarray]]]


def _resolve(units: Units, resolver: Resolver):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[Context] = []
        shard: list[tuple[Context, int, int]] = []
        anchor, volume = None, 0

        def spans() -> pa.RecordBatch:
            rows = [(c, kind, *s) for c, kind, starts in resolver(shard, units) for s in runs_of(starts, units.window).tolist()]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], ["c", "kind", "i", "j"])

        for b in batches:
            cols = [x.to_pylist() for x in b.columns]
            for a, *rest in zip(*cols, strict=True):
                if a != anchor:
                    new = list(_survivors(group, units))
                    shard += new
                    volume += sum((j - i + units.window) * units.size for _, i, j in new)
                    group, anchor = [], a
                    if volume >= CHUNK:
                        yield spans()
                        shard, volume = [], 0
                group.append(Context(*rest))
        shard += _survivors(group, units)
        if shard:
            yield spans()

    return run


def runs_of(starts: np.ndarray, window: int) -> np.ndarray:
    """The units [i, j) covered by windows at these ascending starts."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    cuts = np.flatnonzero(np.diff(starts) > window)
    return np.stack([starts[np.append(0, cuts + 1)], starts[np.append(cuts, len(starts) - 1)] + window], 1)


def _windows(units: Units):
    """The hash of every window of the contexts of large anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for b in batches:
            for c, m, top, k, n, u in zip(*(b.column(x).to_pylist() for x in ("c", "m", "top", "k", "n", "u")), strict=True):
                w = np.fromiter((digest(u[i : i + units.window * units.size]) for i in range(0, n * units.size, units.size)), np.uint64, n)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(np.full(n, c)), pa.array(np.full(n, m)), pa.array(np.full(n, top)), pa.array(np.full(n, k)), pa.array(np.arange(n, dtype=np.int32))], ["w", "c", "m", "top", "k", "i"])

    return run


def repeated_spans(docs: DataFrame, units: Units, resolver: Resolver, later_only: bool) -> DataFrame:
    """(r, kind, i, j): the units [i, j) of the row with key r that repeated windows cover; spans of a row may overlap.

    later_only: a window counts as GONE if it also starts in a row with a smaller doc_id (null is the largest), and the first row's are SHARED
    if it starts in a row with a larger one; else a window is GONE if it also starts anywhere else.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select(_key(docs).alias("r"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "text").where(F.octet_length("text") >= units.window)
    occ = cut(keyed.mapInArrow(lean(_spot(units)), "a long, c long, r long, d long, s int, n int, p int").withColumn("o", F.monotonically_increasing_id()), "occurrences")
    contexts = occ.groupBy("c").agg(F.count("*").alias("k"), F.min("d").alias("m"), F.max("d").alias("top"), F.min("o").alias("o"), F.min("a").alias("a"))
    shared = contexts.withColumn("g", F.count("*").over(W.partitionBy("a"))).where("g > 1 or k > 1")
    found = cut(occ.drop("a").join(shared.select("c", "a", "k", "m", "top", "g", F.col("o").alias("first")), "c"), "found", occ.count())
    kind = F.when(F.col("d") > F.col("m"), GONE).when(F.col("top") > F.col("m"), SHARED) if later_only else F.when(F.col("k") > 1, GONE)
    done = found.select("r", kind.alias("kind"), F.col("s").alias("i"), (F.col("s") + F.col("n") + (units.window - 1)).alias("j")).where("kind is not null")
    pending = found.where("g > 1").where("d = m" if later_only else "k = 1").select("c", "r", "s")
    wanted = found.where("o = first and g > 1").groupBy("r").agg(F.collect_list(F.struct("a", "c", "m", "top", "k", "n", "p", "s", "g")).alias("wanted"))
    texts = packed(docs.where(F.octet_length("text") >= units.window))
    fetched = texts.join(wanted, "r").select("z", "wanted").mapInArrow(lean(_fetch(units)), "a long, c long, m long, top long, k long, n int, p int, u binary")
    large = found.where(f"o = first and g > {GROUP}").select("a").distinct()
    fetched = cut(fetched.dropDuplicates(["c"]), "contexts")
    usual = fetched.join(large, "a", "left_anti").repartition(partitions(spark), "a").sortWithinPartitions("a")
    settled = usual.mapInArrow(lean(_resolve(units, resolver)), "c long, kind int, i int, j int")
    windows = fetched.join(large, "a", "left_semi").mapInArrow(lean(_windows(units)), "w long, c long, m long, top long, k long, i int")
    counts = windows.groupBy("w").agg(F.count("*").alias("times"), F.min("m").alias("least"), F.max("top").alias("most"))
    kind = F.when(F.col("m") > F.col("least"), GONE).when(F.col("most") > F.col("least"), SHARED) if later_only else F.when(F.col("times") > 1, GONE)
    again = windows.join(counts, "w").select("c", kind.alias("kind"), "i", (F.col("i") + units.window).alias("j")).where("kind is not null")
    rest = settled.unionByName(again).join(pending, "c").select("r", "kind", (F.col("s") + F.col("i")).alias("i"), (F.col("s") + F.col("j")).alias("j"))
    return done.unionByName(rest)


def cleaned(docs: DataFrame, spans: DataFrame, columns: list[str], apply: Callable, schema: str) -> DataFrame:
    """apply(text or None, merged spans that go, merged spans of any kind) -> values for schema, after the given columns of docs, for each row of docs. Columns may have any names but those of schema."""
    per_row = spans.groupBy("r").agg(F.collect_list(F.struct("kind", "i", "j")).alias("spans"))
    joined = packed(docs, *columns).join(per_row, "r", "left").select("z", "spans", "own")
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    out = T.StructType([joined.schema["own"], *T.StructType.fromDDL(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                made = [apply(None if z is None else unpack(z), merged(s, GONE), merged(s)) for z, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                new = [pa.array([m[x] for m in made], kinds[f[1]]) for x, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([b.column(2), *new], ["own", *(f[0] for f in fields)])

    return joined.mapInArrow(lean(run), out).select("own.*", *[f[0] for f in fields])


def merged(spans: list[dict] | None, kind: int | None = None) -> list[list[int]]:
    """Maximal runs of one kind or of all; touching spans are one."""
    out: list[list[int]] = []
    for x in sorted((s["i"], s["j"]) for s in spans or () if kind is None or s["kind"] == kind):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append(list(x))
    return out
