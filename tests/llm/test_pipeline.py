import pytest

import corpus_pipeline as cp
from dependra.llm import packing
from test_near_copies import brute_kept
from test_text_operators import brute_lines, check_packing


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    d, out = "/root/testdata/sf0.01", {}
    docs = out["documents"] = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, d).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["quality", "toxicity", "line_dedup", "near_duplicates", "packing"]
    for n in ("quality", "toxicity", "line_dedup", "near_duplicates"):
        assert stages[n].columns == stages["documents"].columns


def test_quality_keeps_the_clean(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = stages["documents"].join(labels.where("quality = 1"), "doc_id")
    bad = stages["documents"].join(labels.where("quality = 0"), "doc_id")
    kept = stages["quality"].select("doc_id")
    assert good.join(kept, "doc_id").count() > 0.97 * good.count()
    assert bad.join(kept, "doc_id").count() < 0.1 * bad.count()


def test_lines(stages):
    before = [(r.doc_id, r.text) for r in stages["toxicity"].collect()]
    want = brute_lines(before, cp.COPIES)
    for r in stages["line_dedup"].collect():
        assert r.text == want[r.doc_id] and r.n_chars == len(r.text)


def test_one_of_each_group_stays(stages):
    docs = [(r.doc_id, r.text) for r in stages["line_dedup"].collect()]
    assert sorted(r.doc_id for r in stages["near_duplicates"].collect()) == brute_kept(docs)


def test_packing_covers_what_is_left(stages):
    got = stages["packing"].toPandas()
    check_packing(got, packing.LENGTH)
    assert set(got.doc_id) == {r.doc_id for r in stages["near_duplicates"].select("doc_id").collect()}
    assert (got[got.piece > 0].length == packing.LENGTH).all()


def test_odd_rows_pass(spark, tmp_path):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "text", None, None, 4), (3, "a b c d e f", "en", "s", 11), (3, "a b c d e f", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    for k, docs in enumerate((odd, odd.limit(0))):
        cp.line_stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / str(k)))
        x = cp.near_duplicate_stage(spark, spark.read.parquet(str(tmp_path / str(k))), "/root/testdata/sf0.001")
        assert x.columns == odd.columns and x.where("doc_id = 3").count() == min(1, docs.count())
