"""Structured Streaming versions of the operators.

State lives in RocksDB, one small value per key.  A micro-batch hands a key's
new rows to one task, so bound it at the source (``maxFilesPerTrigger``,
``maxOffsetsPerTrigger``); rows are taken in ``(ms, tie)`` order within it and a
row older than the state is processed at the state's time.
"""

from chatledger.streaming.folds import (
    budget_guard_stream,
    cache_attribution_stream,
    rate_limit_stream,
)
from chatledger.streaming.run import run_available, run_totals, use_rocksdb
from chatledger.streaming.sse import sse_reassemble_stream
from chatledger.streaming.stateless import redact_stream, usage_metrics_stream

__all__ = [
    "budget_guard_stream",
    "cache_attribution_stream",
    "rate_limit_stream",
    "redact_stream",
    "run_available",
    "run_totals",
    "sse_reassemble_stream",
    "usage_metrics_stream",
    "use_rocksdb",
]
