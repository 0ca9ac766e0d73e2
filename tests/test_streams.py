"""Each stream operator over its input cut into several files equals the batch."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatledger import sources, streaming
from chatledger.operators import folds, metrics, scanning, sse
from entrypoints import inputs as I

from conftest import SMALL


def cut(spark, df, order, path, parts=4):
    """Write ``df`` as files that hold consecutive stretches, oldest first, and
    read them as a stream of one file per micro-batch."""
    df = df.withColumn("part_", F.ntile(parts).over(I_window(order))).cache()
    for n in range(1, parts + 1):
        df.where(F.col("part_") == n).drop("part_").coalesce(1).write.mode("append").parquet(str(path))
    schema = df.drop("part_").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def I_window(order):
    from pyspark.sql import Window

    return Window.orderBy(*order)


@pytest.fixture(scope="module")
def log(spark):
    return I.request_log(spark, SMALL).drop("ts").cache()


def same(a, b):
    columns = sorted(b.columns)
    assert sorted(a.columns) == columns
    left, right = (sorted(map(tuple, d.select(columns).collect()), key=repr) for d in (a, b))
    assert left == right and left


def test_rate_limit_stream(spark, log, tmp_path):
    log = log.select("request_id", "ms", "client_id")
    args = ("client_id", "ms", "request_id", 0.0015, 20_000)
    stream = streaming.rate_limit_stream(cut(spark, log, ["ms"], tmp_path / "in"), *args)
    same(streaming.run_available(stream, "t"), folds.rate_limit_audit(log, *args))


def test_cache_stream(spark, log, tmp_path):
    log = log.select("request_id", "ms", "hash", "upstream_error")
    args, stores = ("hash", "ms", "request_id", I.TTL_MS), ~F.col("upstream_error")
    stream = streaming.cache_attribution_stream(cut(spark, log, ["ms"], tmp_path / "in"), *args, stores)
    same(streaming.run_available(stream, "t"), folds.cache_attribution(log, *args, stores))


def test_budget_stream(spark, log, tmp_path):
    log = log.select("request_id", "ms", "session_id", "est_tokens", "actual_tokens")
    args = ("session_id", "ms", "request_id", "est_tokens", "actual_tokens", 5_000, 900)
    stream = streaming.budget_guard_stream(cut(spark, log, ["ms"], tmp_path / "in"), *args)
    same(streaming.run_available(stream, "t"), folds.budget_guard(log, *args))


def test_sse_stream(spark, tmp_path):
    lines = sources.sse_lines(I.sse_text(spark, SMALL))
    lines = lines.unionByName(lines.where("line = 'data: [DONE]'").withColumn("seq", F.col("seq") + 100_000))
    stream = cut(spark, lines, ["seq", "stream_id"], tmp_path / "in")
    same(
        streaming.run_available(streaming.sse_reassemble_stream(stream), "t"), sse.sse_reassemble(lines)
    )


def test_stateless_streams(spark, tmp_path):
    docs = I.planted_documents(spark, SMALL)
    stream = streaming.redact_stream(cut(spark, docs, ["doc_id"], tmp_path / "d"), "text")
    same(streaming.run_available(stream, "t"), scanning.redact_text(docs, "text"))
    outcomes = I.outcome_log(spark, SMALL)
    live = streaming.usage_metrics_stream(cut(spark, outcomes, ["ms"], tmp_path / "o"), ["client_id"])
    got = streaming.run_totals(live, "t", ["client_id"]).withColumn("usd_saved", F.round("usd_saved", 6))
    want = metrics.usage_metrics(outcomes, ["client_id"]).withColumn("usd_saved", F.round("usd_saved", 6))
    same(got, want)


def paused(spark, path, batches, schema, start, pause):
    """The rows a stream emits over batches with a pause on the wall clock between them."""
    import time

    out = []

    def keep(batch, _):
        out.extend(batch.collect())

    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path / "in"))
        if n:
            time.sleep(pause)
        stream = start(spark.readStream.schema(schema).parquet(str(path / "in")))
        streaming.run.use_rocksdb(spark)
        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(path / "state"))
        with streaming.run._only_data_batches(spark):
            query.trigger(availableNow=True).start().awaitTermination()
    return out


def test_rate_limit_stream_counts_the_time_of_requests(spark, tmp_path):
    batches = [[("a", 1000, 1)], [("a", 1001, 2)]]
    args = ("k", "ms", "id", 60_000, 1 / 60_000)
    got = paused(spark, tmp_path, batches, "k string, ms long, id long", lambda s: streaming.rate_limit_stream(s, *args), 2)
    log = spark.createDataFrame([r for b in batches for r in b], "k string, ms long, id long")
    want = folds.rate_limit_audit(log, *args).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_streams_are_kept_by_default():
    import inspect

    from chatledger.streaming.sse import sse_reassemble_stream

    assert inspect.signature(sse_reassemble_stream).parameters["abandon_ms"].default is None
    with pytest.raises(ValueError):
        sse_reassemble_stream(None, abandon_ms=5)


def state_rows(spark, path, variable):
    """Keys that a stateful query holds after its last batch."""
    return spark.read.format("statestore").option("stateVarName", variable).load(str(path / "state")).count()


DAY = 86_400_000
T0 = 19_676 * DAY


def run_batches(spark, path, batches, schema, start, variable):
    """The rows a stream emits, and the number of keys in its state after each batch."""
    out, held = [], []
    for n, rows in enumerate(batches):
        out += paused(spark, path, [rows], schema, start, 0)
        held.append(state_rows(spark, path, variable))
    return out, held


def test_full_buckets_leave_the_state(spark, tmp_path):
    batches = [
        [(f"k{i}", T0 + i, 10 * i + j) for i in range(5) for j in range(4)],
        [("z", T0 + 10 * DAY, 100)],
        [("y", T0 + 10 * DAY + 5, 101), ("k1", T0 + 10 * DAY + 5, 102)],
        [("k1", T0 + 10 * DAY + 6, 103)],
    ]
    args = ("k", "ms", "id", 60, 1 / 20)
    schema = "k string, ms long, id long"
    got, held = run_batches(spark, tmp_path, batches, schema, lambda s: streaming.rate_limit_stream(s, *args), "fold")
    log = spark.createDataFrame([r for b in batches for r in b], schema)
    assert sorted(map(tuple, got)) == sorted(map(tuple, folds.rate_limit_audit(log, *args).collect()))
    assert held[:2] == [5, 6] and held[2] <= 3


def test_expired_entries_leave_the_state(spark, tmp_path):
    batches = [
        [(f"h{i}", T0 + i, i) for i in range(6)] + [("h1", T0 + 900, 50)],
        [("h1", T0 + 5 * DAY, 60), ("h2", T0 + 1200, 61)],
        [("h1", T0 + 5 * DAY + 3, 62)],
        [("h2", T0 + 5 * DAY + 9, 63)],
    ]
    args, schema = ("h", "ms", "id", 1000), "h string, ms long, id long"
    got, held = run_batches(spark, tmp_path, batches, schema, lambda s: streaming.cache_attribution_stream(s, *args), "fold")
    log = spark.createDataFrame([r for b in batches for r in b], schema)
    assert sorted(map(tuple, got)) == sorted(map(tuple, folds.cache_attribution(log, *args).collect()))
    assert held[0] == 6 and held[2] <= 2


def test_idle_sessions_leave_the_state(spark, tmp_path):
    batches = [[(f"s{i}", T0 + i, i, 5, 5) for i in range(4)], [("s0", T0 + 9 * DAY, 10, 5, 5)], [("s0", T0 + 9 * DAY + 1, 11, 5, 5)]]
    schema = "s string, ms long, id long, est long, charge long"
    for idle, left in ((2 * DAY, 1), (None, 4)):
        got, held = run_batches(
            spark, tmp_path / str(idle), batches, schema,
            lambda s: streaming.budget_guard_stream(s, "s", "ms", "id", "est", "charge", 100, 12, idle_ms=idle), "fold",
        )
        assert held == [4, 4, left] and all(r.allowed for r in got)


def test_finished_and_silent_responses_leave_the_state(spark, tmp_path):
    def line(stream, seq, ms, text):
        return (stream, seq, 'data: {"id":"i","choices":[{"delta":{"content":"%s"}}]}' % text, T0 + ms)

    def ended(stream, seq, ms):
        return (stream, seq, "data: [DONE]", T0 + ms)

    batches = [
        [line(1, 1, 0, "HEAD"), line(2, 1, 0, "whole"), ended(2, 2, 1), line(4, 1, 2, "slow")],
        [line(3, 1, 2 * DAY, "x"), ended(2, 3, 3), line(4, 2, 2 * DAY, "er"), ended(4, 3, 2 * DAY)],
        [line(3, 2, 2 * DAY + 1, "y")],
        [ended(3, 3, 4 * DAY), ended(1, 9, 5)],
        [line(5, 1, 4 * DAY + 1, "z")],
    ]
    schema = "stream_id long, seq long, line string, ms long"
    for give_up, want in ((None, {(2, "whole"), (4, "slower"), (3, "xy")}), (1000, {(2, "whole"), (4, "slow"), (3, "xy"), (1, "HEAD")})):
        path = tmp_path / str(give_up)
        got, held = run_batches(
            spark, path, batches, schema, lambda s: streaming.sse_reassemble_stream(s, "ms", abandon_ms=give_up), "finished"
        )
        # A silent stream is given up once time has passed it; one that comes back earlier is not.
        assert {r.stream_id: r.content for r in got if r.finish_reason != "abandoned"}[2] == "whole"
        assert held[-1] == 1 < max(held)
        if give_up is None:
            assert {(r.stream_id, r.content) for r in got} == want
        else:
            assert [(r.stream_id, r.content) for r in got if r.finish_reason == "abandoned"] == [(1, "HEAD")]


def test_totals_of_an_empty_source(spark, tmp_path):
    outcomes = I.outcome_log(spark, SMALL)
    (tmp_path / "none").mkdir()
    empty = spark.readStream.schema(outcomes.schema).parquet(str(tmp_path / "none"))
    live = streaming.usage_metrics_stream(empty, ["client_id"])
    assert streaming.run_totals(live, "t", ["client_id"]).count() == 0


class Calls:
    """A state or handle that counts the messages sent to it."""

    def __init__(self, value=None):
        self.value, self.sent = value, []

    def __getattr__(self, name):
        def call(*args):
            self.sent.append(name)
            if name == "exists":
                return self.value is not None
            if name == "update":
                self.value = args[0]
            return iter(self.value or ()) if name == "get" else None

        return call


def cache_fold(held, ttl_ms=100):
    from chatledger.streaming import folds as streamed

    state = T.StructType([T.StructField("stored_ms", T.LongType())])
    fold = streamed.StreamingFold(
        streamed.StoreTimes(ttl_ms), ["ms", "tie"], ["ms", "can"], ["tie", "ms"], ["stored_ms"], state, lambda s: int(s[0]) + ttl_ms + 1
    )
    fold.handle, fold.state = Calls(), Calls(held)
    return fold


def test_a_fold_sends_no_message_for_a_state_that_stays():
    fold = cache_fold((10,))
    rows = pd.DataFrame({"tie": [2, 1], "ms": [30, 20], "can": [True, True]})
    (out,) = fold.handleInputRows(("k",), iter([rows]), None)
    assert out.values.tolist() == [[1, 20, 10], [2, 30, 10]]
    assert fold.state.sent == ["exists", "get"] and fold.handle.sent == []
    list(fold.handleInputRows(("k",), iter([rows.assign(ms=200)]), None))
    assert fold.state.value == (200,) and fold.handle.sent == ["deleteTimer", "registerTimer"]


def test_a_timer_set_for_a_shorter_time_to_live_drops_nothing():
    class Fired:
        def getExpiryTimeInMs(self):
            return 61

    fold = cache_fold((10,))
    list(fold.handleExpiredTimer(("k",), None, Fired()))
    assert "clear" not in fold.state.sent and fold.handle.sent == ["registerTimer"]
    fold = cache_fold((10,), ttl_ms=50)
    list(fold.handleExpiredTimer(("k",), None, Fired()))
    assert fold.state.sent[-1] == "clear"


def test_a_stream_that_ends_in_its_first_batch_keeps_no_pieces():
    from chatledger.streaming.sse import NAMES, Reassembly

    stream = Reassembly(False, None)
    stream.handle, stream.pieces, stream.finished, stream.newest = (Calls() for _ in range(4))
    lines = pd.DataFrame([[1, True] + [None] * 6, [0, False, "hi", None, "m", None, 3.0, None]], columns=NAMES)
    (out,) = stream.handleInputRows((7,), iter([lines]), None)
    assert out.to_dict("records")[0] | {"stream_id": 7} == {
        "stream_id": 7, "content": "hi", "id": None, "model": "m", "finish": None, "prompt": 3.0, "completion": None
    }
    assert stream.pieces.sent == ["exists"] and stream.finished.sent == ["exists", "update"]
