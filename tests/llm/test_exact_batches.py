"""Exact dedup works on parts of Arrow batches, so that a task's memory is not that of whole batches."""

from types import SimpleNamespace

import pyarrow as pa
from evidencelake.llm import exact_dedup


def test_batches_are_taken_in_parts(monkeypatch):
    monkeypatch.setattr(exact_dedup, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.record_batch({"doc_id": pa.array(range(2000), pa.int64()), "n_chars": pa.array([1] * 2000, pa.int64()), "text": pa.array([b"%d" % (i % 900) for i in range(2000)])})
    for run in (exact_dedup._digests, exact_dedup._combine_locally(SimpleNamespace(value={}))):
        out = list(run(iter([batch])))
        assert max(b.num_rows for b in out) <= 512 and sum(b.num_rows for b in out) == 2000
    assert sum(len(b.column("body").drop_null()) for b in out) == 900
