import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import duck, same  # noqa: E402

from tablewright.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equal_to_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE) - {"pipeline"}))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline
    from test_operators import components, hits

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    und = docs.where("text is null or not text rlike '\\\\p{L}'")
    assert kept.join(und, "doc_id", "left_semi").count() == 0 and kept.count() >= 0.99 * (docs.count() - und.count())
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    once = corpus_pipeline.near_duplicates(spark, kept, SF)
    assert {r.doc_id for r in once.collect()} == {c for _, c in components(rows).values()}
    clean = corpus_pipeline.decontamination(spark, once, SF)
    want = {r.doc_id for r in once.collect() if not ((h := hits(r.text, items))[1] > 0 and 20 * h[1] >= h[0])}
    assert {r.doc_id for r in clean.collect()} == want and clean.columns == docs.columns
    mixed = corpus_pipeline.mixture(spark, clean, SF)
    ids = sorted(r.doc_id for r in mixed.collect())
    assert set(ids) <= want and mixed.columns == docs.columns
    out = corpus_pipeline.run(spark, SF).collect()
    starts = sorted(d for r in out for d, p in zip(r.doc_ids, r.parts, strict=True) if p == 0)
    assert starts == ids


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_awkward_and_empty_tables(spark, tmp_path, empty):
    import corpus_pipeline
    from test_operators import AWKWARD

    rows = [] if empty else [(i, t, "l" if k % 3 else None, "s" if k % 2 else None, 999, "k", k) for k, (i, t) in enumerate([*AWKWARD, *AWKWARD, (70, "12 34 .."), (71, "long " * 300_000)])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long, key string, row long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, None), (1, ""), (2, "zz zz")] if not empty else [], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k == 0 and not empty:
            assert {r.doc_id for r in docs.collect()} <= {4, 5, 6, 7, 71, None} and docs.count() > 0
        if k == 3 and not empty:
            assert {r.n_tokens for r in docs.collect()} == {999}
    assert (docs.count() == 0) == empty
    again = corpus_pipeline.run(spark, str(tmp_path), str(tmp_path / "run"))
    assert again.count() == docs.count() == corpus_pipeline.run(spark, str(tmp_path), str(tmp_path / "run")).count()
