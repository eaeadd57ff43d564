import random

import numpy as np
import pytest

import corpus_pipeline as cp
from dependra.llm import near_copies


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_kept(docs):
    """Smallest ids of the components of five-word shingle sets of similarity 0.8 or more."""
    docs = sorted(docs)
    sets, parent = [grams(t) for _, t in docs], list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [docs[i][0] for i in range(len(docs)) if root(i) == i]


def corpus(seed, groups, each):
    """Texts with copies of similarities around 0.65 to 1."""
    rng, docs = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for k in range(each):
            w = list(base)
            for at in rng.sample(range(200), rng.choice([0, 1, 3, 4, 5, 6, 8]) if k else 0):
                w[at] = f"v{rng.randrange(10**6)}"
            docs.append(" ".join(w))
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("most", [512, 3])
def test_kept_rows_equal_brute_force(spark, most):
    docs = corpus(3, 30, 6) + [(1000, None), (1001, " "), (1002, "a b"), (1003, "A  b")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = near_copies.keep_one(df, **cp.NEAR, most=most)
    assert sorted(r.doc_id for r in got.collect()) == brute_kept([(i, t or "") for i, t in docs])


def test_stage_on_near_copies(spark, tmp_path):
    docs = [(i, t, "en", "s", len(t)) for i, t in corpus(4, 30, 6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "t"))
    got = cp.near_duplicate_stage(spark, spark.read.parquet(str(tmp_path / "t")), "")
    assert sorted(r.doc_id for r in got.collect()) == brute_kept([(r[0], r[1]) for r in docs])


def test_candidates_reach_similarity_08():
    rng, met, n = np.random.default_rng(0), 0, 1500
    for _ in range(n):
        h = np.unique(rng.integers(0, 1 << 63, 180, np.uint64))
        a, b = near_copies.bands(h[:162]), near_copies.bands(h[18:])  # 144 of 180
        met += bool((a == b).any())
    assert met >= 0.995 * n


def test_rows_kept_do_not_depend_on_how_files_are_split(spark, tmp_path):
    """Copies whose ids repeat, read by few and by many tasks."""
    docs = [(i % 40, t, "en", "s", len(t)) for i, t in corpus(5, 20, 6)]
    path = str(tmp_path / "t")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(12).write.parquet(path)
    want = None
    for parallelism in ("1", "9"):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", parallelism)
        try:
            got = cp.near_duplicate_stage(spark, spark.read.parquet(path), "")
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", "5")  # the cluster changes before the result is read
            kept = sorted((r.doc_id, r.text) for r in got.collect())
        finally:
            spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        want = want or [i for i, _ in kept]
        assert [i for i, _ in kept] == want
        sets = [grams(t) for _, t in kept]
        assert all(len(a & b) < 0.8 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
