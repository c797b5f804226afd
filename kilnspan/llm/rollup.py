"""Token counts in rollups that are kept up by signed changes.

A store holds the summed changes of each batch by source, lang and tokenizer version. Totals are the sum over
all committed batches, so batches may come in any order. A batch's sums are written to a folder of their own; the file that
names that folder under the batch's id is the commit. Only one writer can make it, and sums that no commit names do not count.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commit import exists, names, publish, read_line, remove
from . import bpe
from .common import cut, lean, shared_dir, small_batches

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, docs long, tokens long, empty long"


def changes(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Signed rows from images (source, lang, version, tokens) of rows before and after: only after is an insert, only before a delete, both a revision."""
    sides = [df.select(*KEYS, F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.lit(sign).cast("long").alias("sign")) for df, sign in ((before, -1), (after, 1)) if df is not None]
    return sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])


class TokenRollup:
    """Totals by source, lang and tokenizer version in a folder that all executors see.

    Null keys are keys of their own; null token counts are 0. An empty batch commits and changes nothing. Groups
    whose documents are all deleted are not listed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _marker(self, batch: str) -> str:
        if not re.fullmatch(r"[\w-][\w.-]{0,99}", batch) or batch.endswith(".tmp"):
            raise ValueError(f"not a batch id: {batch!r}")
        return f"{self.path}/commits/{batch}"

    def committed(self, batch: str) -> bool:
        return exists(self.spark, self._marker(batch))

    def apply(self, batch: str, signed: DataFrame) -> bool:
        """Commit a batch of signed rows (KEYS, tokens, sign); False if that batch is committed already. Sums are partial before the shuffle."""
        if self.committed(batch):
            return False
        s = F.col("sign")
        sums = signed.groupBy(*KEYS).agg(F.sum(s).alias("docs"), F.sum(s * F.col("tokens")).alias("tokens"), F.sum(F.when(F.col("tokens") == 0, s).otherwise(0)).alias("empty"))
        made = self._write(sums)
        won = publish(self.spark, self._marker(batch), made)
        if not won:
            remove(self.spark, f"{self.path}/sums/made={made}")
        return won

    def _write(self, sums: DataFrame) -> str:
        made = f"m{uuid.uuid4().hex}"
        sums.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in SCHEMA.split(", ")]).write.parquet(f"{self.path}/sums/made={made}")
        return made

    def _folds(self) -> int:
        return max(map(int, names(self.spark, f"{self.path}/folds")), default=0)

    def _live(self, batches: DataFrame, fold: int) -> DataFrame:
        """The sums that count: those of this fold, if there is one, and of the batches (made) that it does not hold."""
        if fold:
            made = read_line(self.spark, f"{self.path}/folds/{fold}")
            batches = batches.join(self.spark.read.schema("made string").parquet(f"{self.path}/folded/{made}"), "made", "left_anti")
            batches = batches.unionByName(self.spark.createDataFrame([(made,)], "made string"))
        sums = self.spark.read.schema(f"{SCHEMA}, made string").parquet(f"{self.path}/sums").join(batches, "made", "left_semi")
        return sums.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("docs", "tokens", "empty")])

    def _batches(self) -> DataFrame | None:
        return self.spark.read.text(f"{self.path}/commits").select(F.col("value").alias("made")) if names(self.spark, f"{self.path}/commits") else None

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens, empty)."""
        fold, batches = self._folds(), self._batches()
        if batches is None:
            return self.spark.createDataFrame([], SCHEMA)
        return self._live(batches, fold).where("docs <> 0 or tokens <> 0 or empty <> 0")

    def fold(self) -> bool:
        """Sum up all batches committed so far, so that totals need not read them one by one; False if there are none or another writer folds too."""
        fold, batches = self._folds(), self._batches()
        if batches is None:
            return False
        batches = cut(batches, "folded")  # batches committed meanwhile are left for the next fold
        made = self._write(self._live(batches, fold))
        batches.write.parquet(f"{self.path}/folded/{made}")
        won = publish(self.spark, f"{self.path}/folds/{fold + 1}", made)
        if not won:
            remove(self.spark, f"{self.path}/sums/made={made}")
        return won


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


def counted(docs: DataFrame, version: str, path: str, pattern: str) -> DataFrame:
    """(source, lang, version, tokens) per document of docs (source, lang, text), counted by the rank file at path, which executors have too; null texts have no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path, pattern).encode_ordinary
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                n = [len(encode(t)) if t else 0 for t in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["source", "lang", "tokens"])

    small_batches(docs.sparkSession)
    return docs.select("source", "lang", "text").mapInArrow(lean(run), "source string, lang string, tokens long").select("source", "lang", F.lit(version).alias("version"), "tokens")


def maintained_counts(docs: DataFrame, versions: dict[str, str], pattern: str) -> DataFrame:
    """The rollup of all documents after a history of batches; versions: two tokenizers' names and rank files.

    Every document is inserted, counted by the first tokenizer; those without a source are deleted and inserted again; German ones are revised
    to the second tokenizer; the batches are folded; and the deletion is sent again, which changes nothing. Images of earlier counts come from
    the counts kept, not from the texts. Repeated rows count as often as they occur; no documents give no rows.
    """
    spark = docs.sparkSession
    (first, path), (second, other) = versions.items()
    store = TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    images = cut(counted(docs, first, path, pattern), "images")
    none = images.where("source is null")
    store.apply("1-insert", changes(None, images))
    store.apply("2-delete", changes(none, None))
    store.apply("3-again", changes(None, none))
    store.apply("4-revise", changes(images.where("lang = 'de'"), counted(docs.where("lang = 'de'"), second, other, pattern)))
    store.fold()
    store.apply("2-delete", changes(none, None))
    return store.totals()
