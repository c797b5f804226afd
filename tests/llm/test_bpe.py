import hashlib
import random

import public_tokenizers as P
import tiktoken

from kilnspan.llm import bpe

from .helpers import docs

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def test_same_ids_as_the_library(spark):
    r = random.Random(5)
    ranks = bpe.load_ranks(PATH)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " ", "a", "aaaaaaaaaaa", "  \n\n x", "don't we'll 12345 ...!!", "<|endoftext|>", "日本語テキスト é́ 🙂🙂", "x" * 3000, "word " * 20000]
    texts += ["".join(r.choices("abcde thé,.\néß", k=r.randrange(200))) for _ in range(300)]
    df = docs(spark, texts, extra=True)
    df = df.unionByName(df.limit(3))
    rows = bpe.encode_documents(df, PATH, P.PATTERN).collect()
    assert len(rows) == len(texts) + 3
    for x in rows:
        want = lib.encode_ordinary(texts[x.doc_id] or "")
        assert x.n_tokens == len(want)
        assert bytes(x.ids) == b"".join(i.to_bytes(4, "little") for i in want)
    for x in bpe.encode_documents(df, PATH, P.PATTERN, digests=True).collect():
        want = lib.encode_ordinary(texts[x.doc_id] or "")
        assert x.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256((texts[x.doc_id] or "").encode()).hexdigest()


def test_small_vocabularies_with_unordered_merges():
    """Ranks in which a merge can make a pair of a lower rank, against the rule itself."""
    r = random.Random(6)

    def slow(word, ranks):
        parts = [bytes([c]) for c in word]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    for _ in range(300):
        tokens = [b"a", b"b", b"c", *{bytes(r.choices(b"abc", k=r.randrange(2, 6))) for _ in range(12)}]
        order = list(range(len(tokens)))
        r.shuffle(order)
        ranks = dict(zip(tokens, order))
        words = [bytes(r.choices(b"abc", k=r.randrange(1, 14))) for _ in range(12)]
        assert bpe.replay(words, ranks) == [slow(w, ranks) for w in words]


def test_table_of_words_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    c = bpe.Codec(bpe.load_ranks(PATH), P.PATTERN)
    texts = ["one two three", "four five", "one two"]
    for _ in range(2):
        assert [c.decode(x).decode() for t in texts for x in c.encode([t])] == texts


def test_no_rows(spark):
    assert bpe.encode_documents(docs(spark, []), PATH, P.PATTERN).collect() == []
