"""The corpus pipeline against a plain re-computation, and stage by stage."""

import brute
import corpus_pipeline
from llm_fixtures import bench, docs, frame  # noqa: F401


def test_pipeline_matches_brute_force(spark, frame, docs, bench, tmp_path):
    clean = frame.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", "n_chars")
    ids = set()
    rows = [d for d in docs if d[0] is not None and not (d[0] in ids or ids.add(d[0]))]
    clean.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "epoch"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute.pipeline(rows, bench), key=repr)


def test_stages_take_awkward_rows(spark, frame, bench, tmp_path):
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (frame, frame.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            before = docs.columns
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns[:len(before)] == before
            path = f"{tmp_path}/{name}-{len(before)}-{id(docs)}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
