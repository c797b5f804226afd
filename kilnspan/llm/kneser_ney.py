"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of byte n-grams.

An n-gram is a long: its bytes, the last one lowest. Counts of the trusted texts, contexts, discounts
and probabilities are tables keyed by n-gram and joined by it. Documents are dealt to parts of a bounded
number of bytes; a part asks for each of its distinct n-grams once, the answers are joined from the
model's tables, and the part's texts are scored with them. While the distinct n-grams of all documents are
at most SENT, their answers are sent to every task instead, and no text is shuffled; the scores are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, lean, partitions, small_batches
from .passages import packed, unpack

ORDER = 5
#: Most distinct n-grams (16 bytes each), and most trusted doc_ids, that are broadcast.
SENT, SENT_IDS = 4_000_000, 2_000_000
#: Bytes of text in a part.
PART = 12 << 20
#: Bytes of text whose n-grams are looked up at once.
CHUNK = 1 << 20
#: Share of trusted documents kept from training, one in so many, to set the thresholds.
CALIBRATE = 5
#: Documents worse than this quantile of trusted ones in their language, by this many nats a byte, are rejected.
QUANTILE, SLACK = 0.995, 0.05
#: Bytes of average text that a document's own average is weighed against, so that a short one needs more to be rejected.
PRIOR = 50


def grams(text: bytes, order: int) -> np.ndarray:
    """The n-gram that ends at each byte; the text is preceded by line feeds."""
    u = np.frombuffer(b"\n" * (order - 1) + text, np.uint8)
    g = np.zeros(len(text), np.int64)
    for k in range(order):
        g = g << 8 | u[k : k + len(text)]
    return g


def _distinct(chunks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(chunks), return_counts=True)


def _merge(held: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([held[0], new[0]])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([held[1], new[1]])[order]
    head = np.flatnonzero(np.append(True, np.diff(keys) != 0)) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, c): n-gram counts of the column text, summed by task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        chunk, size = [], 0
        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    chunk.append(grams(t.as_buffer().to_pybytes(), order))
                    size += len(chunk[-1])
                    if size >= 1 << 21:
                        held, chunk, size = _merge(held, _distinct(chunk)), [], 0
                        if len(held[0]) > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["g", "c"])
                            held = (held[0][:0], held[1][:0])
        if chunk:
            held = _merge(held, _distinct(chunk))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["g", "c"])

    small_batches(texts.sparkSession)
    return texts.select("text").mapInArrow(lean(run), "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def model(texts: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """For each length 1..order the tables (g, p) of seen n-grams and (ctx, back) of contexts.

    Counts of the longest are occurrences, of the others the distinct bytes seen before them. Three
    discounts a length, from its counts of counts (all 0.5 where those are too few). p has the shorter n-gram's
    probability interpolated; an unseen byte after a seen context has back times that. Below length 1 all 256 bytes are alike.
    """
    counts = cut(gram_counts(texts, order), "counts")
    by_length = {order: counts}
    for k in range(order - 1, 0, -1):
        by_length[k] = by_length[k + 1].groupBy(F.col("g").bitwiseAND((1 << 8 * k) - 1).alias("g")).agg(F.count("*").alias("c"))
    tables: list[tuple[DataFrame, DataFrame]] = []
    for k in range(1, order + 1):
        t = by_length[k].withColumn("ctx", F.shiftright("g", 8))
        *n, size = t.agg(*[F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)], F.count("*").alias("size")).first()
        d = [0.5] * 3
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            d = [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 0.95) for i in range(3)]
        cut_off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        contexts = t.groupBy("ctx").agg(F.sum("c").cast("double").alias("total"), F.sum(cut_off).alias("mass")).select("ctx", "total", (F.col("mass") / F.col("total")).alias("back"))
        joined = t.withColumn("kept", F.col("c") - cut_off).join(contexts, "ctx").withColumn("low", F.col("g").bitwiseAND((1 << 8 * (k - 1)) - 1))
        if k == 1:
            shorter = F.lit(1 / 256)
        else:
            joined, shorter = joined.join(tables[-1][0].select(F.col("g").alias("low"), F.col("p").alias("q")), "low"), F.col("q")
        tables.append((cut(joined.select("g", (F.col("kept") / F.col("total") + F.col("back") * shorter).alias("p")), "model", size), cut(contexts.select("ctx", "back"), "model", size)))
    return tables


def probabilities(asked: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(g, logp) for distinct n-grams g of the model's length, by joins from the shortest length up."""
    out, p = asked.select("g"), F.lit(1 / 256)
    for k, (seen, contexts) in enumerate(tables, 1):
        out = out.withColumn("x", F.col("g").bitwiseAND((1 << 8 * k) - 1)).withColumn("y", F.shiftright("x", 8))
        out = out.join(seen.select(F.col("g").alias("x"), F.col("p").alias("s")), "x", "left").join(contexts.withColumnRenamed("ctx", "y"), "y", "left")
        out = out.withColumn("p", F.coalesce("s", F.coalesce("back", F.lit(1.0)) * p)).select("g", "p")
        p = F.col("p")
    return out.select("g", F.log("p").alias("logp"))


def _asks(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct n-grams by part, over the texts of a task, and at a table's bound."""
        held: dict[int, np.ndarray] = {}
        chunk: dict[int, list[np.ndarray]] = {}
        size = 0

        def fold() -> None:
            for k, x in chunk.items():
                held[k] = np.unique(np.concatenate([held.get(k, x[0][:0]), *x]))
            chunk.clear()

        for b in batches:
            for k, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                g = grams(unpack(z), order)
                chunk.setdefault(k, []).append(g)
                size += len(g)
                if size >= 1 << 21:
                    fold()
                    size = 0
                    if sum(map(len, held.values())) > 1 << 22:
                        yield from rows()
                        held.clear()

        def rows() -> Iterator[pa.RecordBatch]:
            for k, g in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k, np.int32)), pa.array(g)], ["part", "g"])

        fold()
        yield from rows()

    return run


def _totals(logp: np.ndarray, g: np.ndarray, texts: list[bytes], order: int) -> np.ndarray:
    """Log probability of each text; the distinct n-grams of a CHUNK of bytes are looked up once, in order."""
    out = np.zeros(len(texts))
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= CHUNK:
            size += len(texts[end])
            end += 1
        found, place = np.unique(np.concatenate([grams(t, order) for t in texts[at:end]]), return_inverse=True)
        owner = np.repeat(np.arange(end - at), [len(t) for t in texts[at:end]])
        out[at:end] = np.bincount(owner, logp[np.searchsorted(g, found)][place], end - at)
        at = end
    return out


def _score(order: int):
    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        g, logp = found.column("g").to_numpy(), found.column("logp").to_numpy()
        at = np.argsort(g)
        return _scored(docs, g[at], logp[at], order, docs.column_names[1:])

    return run


def _score_sent(order: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, logp = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                yield from _scored(pa.Table.from_batches([whole.slice(at, 512)]), g, logp, order, whole.schema.names).to_batches()

    return run


def _scored(docs: pa.Table, g: np.ndarray, logp: np.ndarray, order: int, columns: list[str]) -> pa.Table:
    texts = [unpack(z) for z in docs.column("z").to_pylist()]
    return pa.table([*(docs.column(c) for c in columns), pa.array(_totals(logp, g, texts, order)), pa.array([len(t) for t in texts], pa.int64())], [*columns, "sum", "bytes"])


def scored(docs: DataFrame, tables: list[tuple[DataFrame, DataFrame]], order: int = ORDER) -> DataFrame:
    """(z, own, sum, bytes): the packed text, the other columns of docs in a struct, the log probability and the size of the text."""
    spark = docs.sparkSession
    dealt = packed(docs, *[c for c in docs.columns if c != "text"]).select("r", "z", "own")
    out = T.StructType([*dealt.select("z", "own").schema, *T.StructType.fromDDL("sum double, bytes long")])
    whole = dealt.select(F.lit(0).alias("part"), "z").mapInArrow(lean(_asks(order)), "part int, g long")
    known = cut(probabilities(whole.select("g").distinct(), tables), "known")
    if known.count() <= SENT:
        answers = known.toArrow()
        g, logp = answers.column("g").to_numpy(), answers.column("logp").to_numpy()
        at = np.argsort(g)
        return dealt.select("z", "own").mapInArrow(lean(_score_sent(order, spark.sparkContext.broadcast((g[at], logp[at])))), out)
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(-(-volume // PART)), partitions(spark))
    dealt = cut(dealt.select(F.pmod("r", F.lit(parts)).cast("int").alias("part"), "z", "own").repartition(parts, "part"), "dealt")
    asked = dealt.select("part", "z").mapInArrow(lean(_asks(order)), "part int, g long").distinct()
    return dealt.groupBy("part").cogroup(asked.join(known, "g").groupBy("part")).applyInArrow(_score(order), out)


def _ids(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SENT_IDS else df


def _graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(z, own, bytes, loss, limit, ok) for each row of docs; loss and limit in nats a byte."""
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1 and doc_id is not null")
    trusted = cut(trusted.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(CALIBRATE)) == 0).alias("fold")), "trusted", labels.count())
    tables = model(docs.select("doc_id", "text").join(_ids(trusted.where("not fold")), "doc_id", "left_semi").select("text"))
    s = cut(scored(docs, tables), "scored")
    every = s.select(F.col("own.doc_id").alias("doc_id"), F.col("own.lang").alias("lang"), "sum", "bytes").join(trusted.where("fold"), "doc_id", "left_semi").where("bytes > 0")
    mean = every.agg((F.sum("sum") / F.sum("bytes")).alias("m")).first()["m"]
    loss = (-(F.col("sum") + F.lit(mean) * PRIOR) / (F.col("bytes") + PRIOR)).alias("loss")
    every = every.select("lang", loss)
    overall = every.agg(F.percentile_approx("loss", QUANTILE, 100_000).alias("q")).first()["q"]
    # a row for each language of trusted texts; a language without any takes that of all
    by_lang = every.groupBy("lang").agg(F.percentile_approx("loss", QUANTILE, 100_000).alias("top"))
    s = s.select("z", "own", "bytes", loss).join(by_lang, F.col("own.lang").eqNullSafe(F.col("lang")), "left")
    s = s.select("z", "own", "bytes", "loss", (F.coalesce("top", F.lit(overall)) + SLACK).alias("limit"))
    return s.withColumn("ok", F.coalesce((F.col("bytes") > 0) & (F.col("loss") <= F.col("limit")), F.col("bytes") > 0))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, threshold, accepted) for each row of docs.

    Trained on documents whose labels.quality is 1 (the lowest of several labels), but for one in CALIBRATE, which set the thresholds by
    language. perplexity is per byte, smoothed by PRIOR; null and empty texts have that of the average and are rejected; one at the
    threshold is accepted. Repeated rows are trained on and scored as often as they occur. Without trusted
    documents every text with a byte is accepted and threshold is null.
    """
    g = _graded(docs.select("doc_id", "text", "lang"), labels)
    return g.select("own.doc_id", "own.lang", F.col("bytes").alias("n_bytes"), F.exp("loss").alias("perplexity"), F.exp("limit").alias("threshold"), F.col("ok").alias("accepted"))


def keep_accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, with the columns of docs, which may have any names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                yield pa.RecordBatch.from_arrays([pa.array([unpack(z).decode() for z in b.column(0).to_pylist()], pa.string()), b.column(1)], ["text", "own"])

    g = _graded(docs, labels).where("ok").select("z", "own")
    out = T.StructType([T.StructField("text", T.StringType()), g.schema["own"]])
    return g.mapInArrow(lean(run), out).select("text", "own.*").select(*[f"`{c}`" for c in docs.columns])
