"""The whole pipeline on edge cases and on an empty table."""

import corpus_pipeline
from tests.llm.conftest import LONG


def folder(tmp_path, docs, labels):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_run_on_edge_cases(spark, edge, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, None)], "doc_id long, quality int, toxic int")
    rows = corpus_pipeline.run(spark, folder(tmp_path, edge, labels)).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) <= {None, 1, 2, 3, 5, 6} and 6 in found  # 7 equals 1, and 3 equals 2
    assert {r.doc_tokens for r in found[6]} == {max(r.start + r.length for r in found[6])} and found[6][0].doc_tokens > len(LONG.split())
    fills = {}
    for r in rows:
        fills.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in fills.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_run_on_an_empty_table(spark, empty, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert corpus_pipeline.run(spark, folder(tmp_path, empty, labels)).count() == 0
