"""What Python workers hold: batches within `materialize` are short, and nothing of another stage is kept."""

import pyarrow as pa
import pytest

from sonoframe.llm import common

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])


@pytest.mark.parametrize(("own", "most"), [("10000", common.BATCH_ROWS), ("0", common.BATCH_ROWS), ("300", 300)])
def test_batches_are_short_while_a_table_is_written(spark, own, most):
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, own)
    try:
        found = common.materialize(common.map_arrow(spark.range(0, 2500, 1, 1), sizes, "n long"), "sizes")
        got = sorted(r.n for r in found.collect())
        assert sum(got) == 2500 and got[-1] == most and spark.conf.get(KEY) == own
        with pytest.raises(RuntimeError), common.short_batches(spark):
            raise RuntimeError
        assert spark.conf.get(KEY) == own
    finally:
        spark.conf.set(KEY, before)


def test_a_worker_keeps_things_for_one_stage(monkeypatch):
    class Task:
        def __init__(self, stage):
            self.stageId = lambda: stage

    monkeypatch.setattr(common, "_kept", {})
    monkeypatch.setattr(common, "_kept_for", [])
    made = []
    for stage in (1, 1, 2, 1):
        monkeypatch.setattr(common.TaskContext, "get", lambda stage=stage: Task(stage))
        common._begin()
        common.kept("a", lambda: made.append(stage) or stage)
    assert made == [1, 2, 1] and common._kept == {"a": 1}


def test_the_tokenizer_of_packing_goes_with_its_stage(monkeypatch):
    from sonoframe.llm import packing

    monkeypatch.setattr(common, "_kept", {})
    monkeypatch.setattr(packing, "WordIds", lambda path: [path])
    one = packing.encoder("x")
    assert packing.encoder("x") is one and list(common._kept.values()) == [one]
    monkeypatch.setattr(common, "_kept_for", [1])
    common._begin()
    assert not common._kept and packing.encoder("x") is not one
