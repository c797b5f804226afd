import hashlib
import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from kilnspan.llm import bpe, kneser_ney, mixing, simhash, suffix_dedup
from kilnspan.llm.queries import RANKS

from .helpers import docs


def test_stages_in_order(spark, tmp_path):
    r = random.Random(8)
    word = lambda: "".join(r.choices(["ka", "lo", "mi", "ten", "sur"], k=r.randrange(1, 4)))
    shared = " ".join(word() for _ in range(150))
    texts = [" ".join(word() for _ in range(r.randrange(30, 200))) for _ in range(80)]
    texts += [texts[0], texts[1] + " ka", *(f"{word()} {shared} {word()} {word()}" * 2 for _ in range(3)), "#$%&" * 100, None, ""]
    d = docs(spark, texts)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(70)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    want = kneser_ney.keep_accepted(d, labels)
    names = {x.doc_id for x in want.select("doc_id").collect()}
    assert names and not names & {len(texts) - 1, len(texts) - 2, len(texts) - 3}
    want = mixing.mix(suffix_dedup.remove_passages(simhash.keep_one(want))).collect()
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(RANKS)), special_tokens={})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and sorted((x.doc_id, bytes(x.ids)) for x in got) == sorted((x.doc_id, b"".join(i.to_bytes(4, "little") for i in lib.encode_ordinary(x.text or ""))) for x in want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "source_mix", "tokens"]


def test_the_last_stage_decodes_its_ids(spark):
    texts = [None, "", "a, b", "é ü,ß  x\n", "tail"]
    got = corpus_pipeline.tokens(spark, docs(spark, texts), "").collect()
    assert {x.doc_id: x.decoded_sha256 for x in got} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts)}


def write(spark, tmp_path, rows, schema, labels):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], SCHEMA, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_awkward_rows_and_clashing_columns(spark, tmp_path):
    r = random.Random(4)
    word = lambda: "".join(r.choices(["ka", "lo", "mi", "ten", "sur"], k=r.randrange(1, 4)))
    own = [" ".join(word() for _ in range(r.randrange(60, 90))) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(own)]
    rows += [(None, own[0] + " ka", "en", "s", 1), (None, "lo mi " * 40, None, None, 1), rows[1], rows[2], rows[2], (7, "mi " + own[30], "en", None, 1), (50, None, None, None, None), (None, None, None, None, None), (51, "", "", "", 0)]
    names = ["r", "z", "own", "spans", "fp", "root", "kn_sum", "kn_z", "kn_limit", "mix_source", "mix_n", "mix_size", "sum", "bytes", "loss", "limit", "ok", "size", "target", "copies", "key", "g", "w"]
    wide = [(*x, *[k] * len(names)) for k, x in enumerate(rows)]
    write(spark, tmp_path, wide, SCHEMA + "".join(f", {n} int" for n in names), [(i, 1, 0) for i in range(30)])
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = d.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == before
        d.collect()
        d = corpus_pipeline.cut_and_sweep(lambda d=d: d, "step")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in got} <= {x[0] for x in rows} and got
    kept = simhash.keep_one(kneser_ney.keep_accepted(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect()
    assert sorted(x.doc_id for x in kept if x.doc_id in (1, 2)) == [1, 2] and not [x for x in kept if x.doc_id is None and x.text == own[0] + " ka" and 0 in {y.doc_id for y in kept} and simhash.fingerprint(x.text) == simhash.fingerprint(own[0])]
