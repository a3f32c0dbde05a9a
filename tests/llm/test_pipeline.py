"""What the stages of the pipeline leave in the shared folder."""

import os

import corpus_pipeline
from vitrine.session import materialize, shared_dir


def test_a_stage_removes_what_the_stage_before_it_has_left(documents, shared, tmp_path):
    def stage(spark, docs, sf_dir):
        return materialize(docs, "made")

    first, second = (corpus_pipeline._staged(n, f"stage {n}", stage) for n in (0, 1))
    held = lambda n: [x for x in os.listdir(shared_dir(shared)) if x.startswith(f"pipeline-stage-{n}-work")]
    docs = documents([(1, "a"), (2, "b")])
    out = first(shared, docs, "x")
    assert len(held(0)) == 1
    assert second(shared, out, "x").count() == 2  # not written: the second stage still reads the first one's table
    assert len(held(0)) == 1
    first(shared, docs, "y").write.parquet(str(tmp_path / "rows"))
    assert len(held(0)) == 2
    read = shared.read.parquet(str(tmp_path / "rows"))
    assert second(shared, read, "z").count() == 2 and len(held(0)) == 2  # another run's
    assert second(shared, read, "y").count() == 2 and len(held(0)) == 1
    assert out.count() == 2
