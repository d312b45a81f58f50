"""The pipeline against a plain version of its stages, on a small table."""

import corpus_pipeline
from reviewlake.llm import decontaminate

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def _rows():
    prose = lambda k: " ".join(f"p{k}w{i}" for i in range(60))
    rows = [(i, prose(i), "en", f"s{i % 3}", 1, 0) for i in range(1, 40)]
    rows += [(50 + i, prose(i) + " tail", "en", "s1", 1, 0) for i in range(1, 6)]  # near copies
    rows += [(60, prose(60) + " " + " ".join(f"leak{i}" for i in range(20)), "en", "s1", 1, 0), (61, "too short", "en", "s1", 1, 0)]
    return [*rows, (62, None, None, None, None, 0)]


def test_pipeline(spark, tmp_path):
    spark.createDataFrame(_rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.createDataFrame([(1, " ".join(f"leak{i}" for i in range(20)))], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    assert seen[0] == [*range(1, 40), *range(51, 56), 60] and seen[1] == [*range(1, 40), 60] and seen[2] == [*range(1, 40)]
    assert seen[3] == seen[4] and docs.columns[-2:] == ["shard", "slot"]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == seen[4]
    assert decontaminate.leaks(spark.createDataFrame(_rows(), SCHEMA), bench).count() == 1


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
