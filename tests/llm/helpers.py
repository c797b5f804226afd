"""Small tables with the awkward cases, and brute-force versions."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=False, sources=("a", "b", None)):
    """Documents 0.. with these texts."""
    rows = [(i, t, ("en", "de", None)[i % 3], sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # columns whose names the operators use inside
        for c in ("fp", "root", "node", "size", "target", "anchor", "score", "key", "start", "count", "n", "label", "r", "z", "own", "spans", "a", "c", "d", "s", "i", "j", "m", "k", "kn_sum", "kn_z", "kn_limit", "mix_source", "mix_n", "mix_size"):
            df = df.selectExpr("*", f"doc_id as {c}")
    return df


def groups(n, linked):
    """Smallest member reachable for 0..n-1."""
    root = list(range(n))
    done = False
    while not done:
        done = True
        for i, j in linked:
            if root[i] != root[j]:
                root[i] = root[j] = min(root[i], root[j])
                done = False
    return root
