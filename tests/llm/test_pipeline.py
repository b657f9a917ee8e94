"""The pipeline's stages, each against what its own input says."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from tessella.llm import quality
from test_matches import brute_groups, brute_lines
from test_texts import check_packing


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Inputs and outputs of every stage, written and read again between them."""
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(folder / str(k)))
        after = spark.read.parquet(str(folder / str(k)))
        out.append((docs, after))
        docs = after
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes
        assert 0 < after.count() <= before.count()


def test_quality_stage(stages, spark, sf):
    before, after = stages[0]
    labels = dict(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect())
    rows = sorted(pairs(before))
    x = quality.statistics([t.encode() for _, t in rows])
    model = {}
    for c in (0, 1):
        own = x[[labels.get(i) == c for i, _ in rows]]
        cov = np.cov(own.T, bias=True)
        cov = 0.95 * cov + 0.05 * np.diag(np.diag(cov)) + 1e-4 * np.eye(x.shape[1])
        model[c] = quality.Gaussian(own.mean(axis=0), np.linalg.cholesky(cov), len(own))
    want = {i for (i, _), p in zip(rows, quality.probability(model, x), strict=True) if p >= 0.5}
    assert {i for i, _ in pairs(after)} == want


def test_line_stage(stages):
    before, after = stages[1]
    assert sorted(pairs(after)) == sorted((doc, text) for doc, _, _, text in brute_lines(pairs(before)))
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_copies_stage(stages):
    before, after = stages[2]
    assert sorted(i for i, _ in pairs(after)) == sorted({c for _, _, c in brute_groups(pairs(before))})
    assert set(pairs(after)) <= set(pairs(before))


def test_decontamination_stage(stages, spark, sf):
    before, after = stages[3]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    gone = set(pairs(before)) - set(pairs(after))
    assert {p for p in pairs(before) if any(t in p[1] for t in items)} <= gone
    assert all(any(t[:30] in text or t[-30:] in text or t[len(t) // 2 :][:30] in text for t in items) for _, text in gone)


def test_packing_stage(stages):
    before, after = stages[4]
    check_packing(after.collect(), pairs(before))


def test_run_is_the_stages(stages, spark, sf):
    got, want = corpus_pipeline.run(spark, sf), stages[-1][1]
    columns = ["doc_id", "start", "length", "doc_tokens"]
    total = lambda df: sorted(map(tuple, df.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()))
    assert set(columns) <= set(got.columns) and total(got) == total(want)


def test_stages_of_odd_rows(spark, sf, tmp_path):
    rows = [(1, None, None), (2, "", "en"), (3, "word " * 100_000, None), (4, "the same text in two rows " * 4, "en"), (4, "the same text in two rows " * 4, "en"), (None, "no id at all", None), (5, " \n\t ", "en")]
    schema = "doc_id long, text string, lang string, win int, k string, n_lines int, sid long, label string, n_chars long"
    docs = spark.createDataFrame([(i, t, x, 1, "k", 2, 3, "l", len(t or "")) for i, t, x in rows], schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
        after.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        docs = docs if k == 0 else after  # a small table has too few labels for the classifier to judge by
    assert {r.doc_id for r in docs.collect()} >= {1, 2, None}


def test_stages_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
