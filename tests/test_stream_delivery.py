"""Records of a stream are delivered once each, in spite of caps, torn batches and restarts."""

import pytest

from logweave.streaming import stream as X
from logweave.streaming.delivery import Delivery, stream_match_delivery


def _run(spark, tmp_path, cap, handler=None):
    found = X.stream_trace(X.read_text_stream(spark, str(tmp_path / "in")), ["error"])
    q = stream_match_delivery(found, str(tmp_path / "out"), cap, str(tmp_path / "cp"), handler)
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_no_record_is_lost_or_doubled(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("".join(f"error a{i}\n" for i in range(7)) + "ok\n")

    def torn(rows, batch):
        raise RuntimeError("torn")

    with pytest.raises(Exception, match="torn"):
        _run(spark, tmp_path, 3, torn)
    queue = Delivery(spark, str(tmp_path / "out"), 3)
    assert queue.log.version == 0 and queue.deliver(None, 0) == 0
    seen = []
    _run(spark, tmp_path, 3, lambda rows, batch: seen.append((batch, [r.line_text for r in rows.collect()])))
    assert seen == [(0, ["error a0", "error a1", "error a2"])] and queue.waiting() == 4
    (tmp_path / "in" / "b.log").write_text("error b0\nerror b0\n")
    _run(spark, tmp_path, 3)
    assert queue.waiting() == 3
    events = spark.createDataFrame([], queue._schema())
    assert queue.deliver(events, 1) == 0  # a batch that was committed is not delivered again
    assert queue.drain() == 3 and queue.waiting() == 0 and queue.drain() == 0
    assert sorted(r.line_text for r in queue.delivered().collect()) == sorted([f"error a{i}" for i in range(7)] + ["error b0"] * 2)
    assert queue.log.vacuum() > 0  # what the torn batch and the delivered ones have left
    assert queue.delivered().count() == 9


def test_a_batch_without_matches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("ok\n")
    _run(spark, tmp_path, 2)
    queue = Delivery(spark, str(tmp_path / "out"), 2)
    assert queue.drain() == 0 and queue.delivered().count() == 0
