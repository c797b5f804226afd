import public_tokenizers as P
import pytest
import tiktoken

from kilnspan.llm import bpe, queries, rollup

from .helpers import docs

IMAGE = "source string, lang string, version string, tokens long"


def store(spark, tmp_path):
    return rollup.TokenRollup(spark, f"file://{tmp_path}/store")


def totals(s):
    return sorted(map(tuple, s.totals().collect()), key=str)


def test_signed_changes_and_replay(spark, tmp_path):
    s = store(spark, tmp_path)
    assert totals(s) == []
    df = lambda rows: spark.createDataFrame(rows, IMAGE)
    assert s.apply("b1", rollup.changes(None, df([("a", "en", "v", 5), ("a", "en", "v", 0), (None, None, "v", 7), ("z", "de", "v", None)])))
    assert s.apply("b2", rollup.changes(df([("a", "en", "v", 5)]), df([("a", "en", "w", 6)])))
    assert not s.apply("b2", rollup.changes(df([("a", "en", "v", 5)]), df([("a", "en", "w", 6)])))
    assert s.apply("b3", rollup.changes(df([(None, None, "v", 7)]), None))
    assert s.apply("b4", rollup.changes(None, df([])))
    assert totals(s) == sorted([("a", "en", "v", 1, 0, 1), ("a", "en", "w", 1, 6, 0), ("z", "de", "v", 1, 0, 1)], key=str)
    assert totals(store(spark, tmp_path)) == totals(s)
    with pytest.raises(ValueError):
        s.apply("../x", rollup.changes(None, df([])))


def test_an_uncommitted_batch_does_not_count(spark, tmp_path):
    s = store(spark, tmp_path)
    spark.createDataFrame([("a", "en", "v", 1, 1, 0)], rollup.SCHEMA).write.parquet(f"file://{tmp_path}/store/sums/made=lost")
    assert totals(s) == []
    assert s.apply("b1", rollup.changes(None, spark.createDataFrame([("z", "de", "v", 2)], IMAGE)))
    assert totals(s) == [("z", "de", "v", 1, 2, 0)]


def test_the_loser_of_a_race_changes_nothing(spark, tmp_path, monkeypatch):
    one = rollup.changes(None, spark.createDataFrame([("a", "en", "v", 5)], IMAGE))
    a, b = store(spark, tmp_path), store(spark, tmp_path)
    with monkeypatch.context() as m:  # b has looked before a commits
        m.setattr(b, "committed", lambda batch: False)
        assert a.apply("b1", one)
        assert not b.apply("b1", one)
    assert totals(a) == [("a", "en", "v", 1, 5, 0)]
    assert sum(x.name.startswith("made=") for x in (tmp_path / "store/sums").iterdir()) == 1


def test_folds_keep_the_totals(spark, tmp_path):
    s = store(spark, tmp_path)
    df = lambda rows: spark.createDataFrame(rows, IMAGE)
    assert not s.fold()
    s.apply("b1", rollup.changes(None, df([("a", "en", "v", 5), (None, None, "v", 1)])))
    s.apply("b2", rollup.changes(df([(None, None, "v", 1)]), None))
    assert s.fold() and totals(s) == [("a", "en", "v", 1, 5, 0)]
    s.apply("b3", rollup.changes(None, df([("a", "en", "v", 0)])))
    assert totals(s) == [("a", "en", "v", 2, 5, 1)]
    assert s.fold() and not s.apply("b1", rollup.changes(None, df([("a", "en", "v", 5)]))) and totals(s) == [("a", "en", "v", 2, 5, 1)]


def test_counts_cover_every_document(spark, tmp_path):
    texts = [None, "", "a, b", "x-y z!", " \n", "w " * 30000, "a, b", "é ü,ß", "tail", "tail"]
    lib = {n: tiktoken.Encoding(n, pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(n)), special_tokens={}) for n in (queries.RANKS, queries.OTHER_RANKS)}
    want = {}
    for i, t in enumerate(texts):
        lang, source = ("en", "de", None)[i % 3], ("a", None, None, "b")[i % 4]
        v = queries.OTHER_RANKS if lang == "de" else queries.RANKS
        n = len(lib[v].encode_ordinary(t or ""))
        k = want.setdefault((source, lang, v), [0, 0, 0])
        want[source, lang, v] = [k[0] + 1, k[1] + n, k[2] + (n == 0)]
    docs(spark, texts, extra=True, sources=("a", None, None, "b")).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op7_token_counts"](spark, str(tmp_path)).collect()
    assert {tuple(r[:3]): list(r[3:]) for r in got} == want and any(k[0] is None for k in want)


def test_no_rows(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES["op7_token_counts"](spark, str(tmp_path)).collect() == []
