"""Server-sent-event lines to complete responses and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatledger.functions.text import STRICT_JSON, estimate, is_json, json_quote, utf16_length
from chatledger.schemas import RESPONSE_BODY, SSE_CHUNK
from chatledger.sources.sse_text import payload

LINES_PER_CHUNK = 4_096


def parse_lines(lines: DataFrame, *kept: str) -> DataFrame:
    """``stream_id, seq, done, id, model, content, finish, prompt, completion``, and ``kept``.

    Absent, empty and zero values are null; an unreadable line is all null.
    """
    data = payload(F.col("line"))
    chunk = F.col("_c")
    choice = F.get(chunk["choices"], F.lit(0))
    empty = F.lit("")
    zero = F.lit(0).cast("bigint")
    return (
        lines.where(F.col("line").startswith("data:"))
        .withColumn("_d", data)
        .withColumn("_c", F.when(is_json(F.col("_d")), F.from_json("_d", SSE_CHUNK, STRICT_JSON)))
        .select(
            "stream_id",
            "seq",
            (F.col("_d") == "[DONE]").alias("done"),
            F.nullif(chunk["id"], empty).alias("id"),
            F.nullif(chunk["model"], empty).alias("model"),
            choice["delta"]["content"].alias("content"),
            F.nullif(choice["finish_reason"], empty).alias("finish"),
            F.nullif(chunk["usage"]["prompt_tokens"], zero).alias("prompt"),
            F.nullif(chunk["usage"]["completion_tokens"], zero).alias("completion"),
            *kept,
        )
    )


LATEST = ("id", "model", "finish", "prompt", "completion")


def _merged(items: Column) -> Column:
    """Join ordered pieces: texts concatenated, last known value of the rest."""

    def latest(name: str) -> Column:
        known = F.filter(F.transform(items, lambda p: p[name]), lambda v: v.isNotNull())
        return F.try_element_at(known, F.lit(-1)).alias(name)

    text = F.array_join(F.transform(items, lambda p: F.coalesce(p["content"], F.lit(""))), "")
    return F.struct(text.alias("content"), *[latest(n) for n in LATEST])


def sse_reassemble(
    lines: DataFrame, prompt_estimates: DataFrame | None = None, lines_per_chunk: int = LINES_PER_CHUNK
) -> DataFrame:
    """One completed response per stream that reached its end marker.

    ``prompt_estimates`` is ``(stream_id, est_tokens)``, used when the stream
    reports no prompt tokens (0 otherwise).  Lines after the first end marker do
    not count.  A long stream is first joined in chunks of ``lines_per_chunk``
    lines, so no task holds more than a chunk's lines or a stream's chunks.
    """
    parsed = parse_lines(lines).withColumn("_chunk", F.floor(F.col("seq") / lines_per_chunk))
    piece = F.struct("seq", "done", "content", *LATEST)
    chunks = (
        parsed.groupBy("stream_id", "_chunk")
        .agg(F.sort_array(F.collect_list(piece)).alias("_p"), F.min(F.when(F.col("done"), F.col("seq"))).alias("_end"))
        .withColumn("_p", F.filter("_p", lambda p: F.col("_end").isNull() | (p["seq"] < F.col("_end"))))
        .select("stream_id", "_chunk", F.col("_end").isNotNull().alias("done"), _merged(F.col("_p")).alias("_m"))
        .select("stream_id", "_chunk", "done", "_m.*")
    )
    part = F.struct("_chunk", "done", "content", *LATEST)
    streams = (
        chunks.groupBy("stream_id")
        .agg(F.sort_array(F.collect_list(part)).alias("_p"), F.min(F.when(F.col("done"), F.col("_chunk"))).alias("_end"))
        .where(F.col("_end").isNotNull())
        .withColumn("_p", F.filter("_p", lambda p: p["_chunk"] <= F.col("_end")))
        .select("stream_id", _merged(F.col("_p")).alias("_m"))
        .select("stream_id", "_m.*")
    )
    if prompt_estimates is None:
        streams = streams.withColumn("est_tokens", F.lit(0).cast("bigint"))
    else:
        streams = streams.join(prompt_estimates.select("stream_id", "est_tokens"), "stream_id", "left")
    return completed(streams)


def completed(streams: DataFrame) -> DataFrame:
    """Fill in the defaults of a reassembled stream."""
    guess = F.greatest(F.lit(1).cast("bigint"), estimate(utf16_length(F.col("content"))))
    return streams.select(
        "stream_id",
        F.col("id").alias("response_id"),
        F.coalesce("model", F.lit("unknown")).alias("model"),
        "content",
        F.coalesce("finish", F.lit("stop")).alias("finish_reason"),
        F.coalesce("prompt", "est_tokens", F.lit(0).cast("bigint")).alias("prompt_tokens"),
        F.coalesce("completion", guess).alias("completion_tokens"),
    )


def sse_replay(responses: DataFrame, stream_id: str = "stream_id", response: str = "response") -> DataFrame:
    """Four lines per response: role, content, finish and the end marker."""
    r = F.col("_r")
    content = F.coalesce(F.get(r["choices"], F.lit(0))["message"]["content"], F.lit(""))

    def nullable(quoted: Column) -> Column:
        return F.coalesce(quoted, F.lit("null"))

    head = F.concat(
        F.lit('data: {"id":'),
        nullable(json_quote(r["id"])),
        F.lit(',"object":"chat.completion.chunk","created":'),
        nullable(r["created"].cast("string")),
        F.lit(',"model":'),
        nullable(json_quote(r["model"])),
        F.lit(',"choices":[{"index":0,"delta":'),
    )
    lines = F.array(
        F.concat(head, F.lit('{"role":"assistant"},"finish_reason":null}]}')),
        F.concat(head, F.lit('{"content":'), json_quote(content), F.lit('},"finish_reason":null}]}')),
        F.concat(head, F.lit('{},"finish_reason":"stop"}]}')),
        F.lit("data: [DONE]"),
    )
    return (
        responses.withColumn("_r", F.from_json(response, RESPONSE_BODY))
        .select(F.col(stream_id).alias("stream_id"), F.posexplode(lines).alias("seq", "line"))
        .withColumn("seq", F.col("seq").cast("bigint"))
    )
