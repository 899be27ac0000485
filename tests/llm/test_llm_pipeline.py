"""The pipeline's stages one after another, and its rows."""

import corpus_pipeline
from linkloom.llm import lines, quality, simhash
from linkloom.scratch import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs, counts = source, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, written(stage(spark, docs, SF), "stage")
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == source.columns
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert all(b <= a for a, b in zip([source.count(), *counts[:3]], counts[:4]))
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, run.collect())) == sorted(map(str, docs.collect()))


def test_stages_on_odd_rows(spark, docs, no_docs):
    for frame in (docs, no_docs):
        held, left = frame, []
        for _, stage in corpus_pipeline.STAGES:
            held = written(stage(spark, held, SF), "stage")
            left.append({r.doc_id for r in held.select("doc_id").collect()})
        assert all(later <= earlier for earlier, later in zip(left, left[1:]))
        if frame is no_docs:
            assert not any(left)
            continue
        # Equal texts of one document, and of two: one stays, by the stage of lines at the latest.
        assert (10**9 + 3 in left[0]) == (10**9 + 4 in left[0])
        assert not {10**9 + 3, 10**9 + 4} <= left[2]


def test_a_stage_judges_its_own_input(spark, docs):
    """What a stage keeps has nothing left that it would take away."""
    cut = written(lines.drop_repeated_lines(docs.dropDuplicates(["doc_id", "text"])), "cut")
    assert lines.repeated_lines(cut).count() == 0
    one = written(simhash.keep_one(docs), "one")
    groups = simhash.near_duplicates(one).filter("doc_id is not null").dropDuplicates(["doc_id"])
    assert groups.filter("doc_id <> component_id").count() == 0
    assert isinstance(quality.THRESHOLD, float)
