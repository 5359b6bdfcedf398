"""The pipeline: stages work on what their predecessors kept, and clean documents come through."""

import corpus_pipeline
import pytest

from clusterlens.llm import decontamination, recompression, simhash
from clusterlens.llm.staging import stage
from hard_documents import CLASHING


@pytest.fixture(scope="module")
def results(spark):
    folder, docs, found = "/root/testdata/sf0.001", None, {}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found["documents"] = docs
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, folder), "test-pipeline")
        found[name] = docs
    return found


def test_columns_and_subsets(results):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "substring_dedup", "decontamination", "packing"]
    before = {r.doc_id for r in results["documents"].collect()}
    for name in names[:-1]:
        assert results[name].columns == results["documents"].columns
        now = {r.doc_id for r in results[name].collect()}
        assert now and now <= before
        before = now
    assert {r.doc_id for r in results["packing"].collect()} == before


def test_decisions_take_effect(spark, results):
    unique = simhash.near_duplicates(results["near_duplicates"])
    assert unique.where("doc_id <> component_id").count() == 0
    assert recompression.removals(results["substring_dedup"]).where("n_removed > 0").count() <= 2
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert decontamination.scan(results["decontamination"], benchmark).where("n_hit > 0").count() == 0
    rows = results["decontamination"].collect()
    assert all(r.n_chars == len(r.text) for r in rows)


def test_run_equals_the_stages(spark, results):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, results["packing"].collect()))


def test_hard_rows_pass_all_stages(spark, hard):
    """Columns of any name come through unchanged."""
    docs = hard
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, "/root/testdata/sf0.001"), "test-pipeline")
        if name != "packing":
            assert docs.columns == hard.columns
            assert {tuple(r)[-len(CLASHING) :] for r in docs.collect()} == {CLASHING}
    assert docs.count() > 0


def test_of_rows_equal_in_id_and_text_one_stays_for_good(spark):
    rows = [(1, "one text of some words", x) for x in ("b", "a", "c", "a")]
    kept = {tuple(simhash.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string, extra string").repartition(n)).collect()) for n in (1, 2, 4)}
    assert len(kept) == 1 and len(next(iter(kept))) == 1
