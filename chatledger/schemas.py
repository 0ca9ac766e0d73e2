"""Explicit schemas of the data model.  Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

# One chat message as stored inside a parsed request.  ``content`` is the plain
# string, or the JSON text of the part array when ``is_parts`` is true.
MESSAGE = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("tool_call_id", T.StringType()),
        T.StructField("is_parts", T.BooleanType()),
    ]
)

# What ``from_json`` reads from a request body.  Numbers whose text form or
# presence matters for the fingerprint stay strings.
REQUEST_BODY = (
    "model STRING, "
    "messages ARRAY<STRUCT<role: STRING, content: STRING, name: STRING, tool_call_id: STRING>>, "
    "stream STRING, temperature STRING, max_tokens DOUBLE, top_p DOUBLE, "
    "frequency_penalty DOUBLE, presence_penalty DOUBLE, tools STRING, tool_choice STRING"
)

# One secret finding.
FINDING = T.StructType(
    [
        T.StructField("rule_no", T.IntegerType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("rule_name", T.StringType()),
        T.StructField("match_no", T.IntegerType()),
        T.StructField("matched", T.StringType()),
        T.StructField("redacted", T.StringType()),
        T.StructField("entropy", T.DoubleType()),
        T.StructField("pos", T.IntegerType()),
    ]
)

# The response cache: one row per request fingerprint.
RESPONSE_CACHE = T.StructType(
    [
        T.StructField("hash", T.StringType()),
        T.StructField("request_fingerprint", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("response_body", T.StringType()),
        T.StructField("is_stream", T.BooleanType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("last_accessed_at", T.LongType()),
        T.StructField("hit_count", T.LongType()),
        T.StructField("ttl_ms", T.LongType()),
    ]
)

# The audit fact table.
AUDIT_LOG = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("client_ip", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("is_cache_hit", T.BooleanType()),
        T.StructField("cache_tier", T.StringType()),
        T.StructField("secrets_redacted", T.LongType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("latency_ms", T.LongType()),
        T.StructField("status_code", T.IntegerType()),
    ]
)

# One server-sent-event line.
SSE_LINE = T.StructType(
    [
        T.StructField("stream_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("line", T.StringType()),
    ]
)

# The parts of a response chunk that reassembly needs.
SSE_CHUNK = (
    "id STRING, model STRING, "
    "choices ARRAY<STRUCT<delta: STRUCT<content: STRING>, finish_reason: STRING>>, "
    "usage STRUCT<prompt_tokens: BIGINT, completion_tokens: BIGINT>"
)

# The parts of a completed response that replay and usage need.
RESPONSE_BODY = (
    "id STRING, created BIGINT, model STRING, "
    "choices ARRAY<STRUCT<message: STRUCT<role: STRING, content: STRING>, finish_reason: STRING>>, "
    "usage STRUCT<prompt_tokens: BIGINT, completion_tokens: BIGINT>"
)
