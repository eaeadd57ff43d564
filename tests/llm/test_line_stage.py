import corpus_pipeline as cp


def test_shared_passages_go_from_short_texts(spark):
    shared = "\n".join(f"this passage {w} stands in several of the documents here" for w in ("alpha", "beta", "gamma"))
    own = {i: " ".join(f"{c}{'xyz'[i]}" for c in "abcdefghijklmnopqrst") for i in range(3)}
    docs = [(i, f"{shared}\n{own[i]}", "en", "s", 0) for i in range(3)]
    assert all(len(shared) > 0.6 * len(d[1]) for d in docs)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.line_stage(spark, df, "").collect()}
    assert got == {0: (docs[0][1], len(docs[0][1])), 1: (own[1], len(own[1])), 2: (own[2], len(own[2]))}
