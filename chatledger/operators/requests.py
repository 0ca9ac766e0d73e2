"""Requests: token estimates, fingerprints, duplicates, usage and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatledger.functions import canonical as C
from chatledger.functions.cost import Prices
from chatledger.functions.text import estimate, utf16_length
from chatledger.schemas import RESPONSE_BODY


def estimate_tokens(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Add ``est_tokens`` to parsed requests."""
    return df.withColumn("est_tokens", C.estimated_tokens(F.col(messages)))


def estimate_tokens_by_turn(turns: DataFrame, request_id: str, text: str) -> DataFrame:
    """The same estimate from a table with one row per message."""
    chars = F.sum(F.coalesce(utf16_length(F.col(text)), F.lit(0)).cast("bigint"))
    return turns.groupBy(request_id).agg(
        F.greatest(F.lit(1).cast("bigint"), estimate(chars)).alias("est_tokens")
    )


def _canonical() -> Column:
    names = (
        "model",
        "messages",
        "temperature",
        "temperature_present",
        "max_tokens",
        "top_p",
        "tools",
        "tool_choice",
    )
    return C.canonical_request(*[F.col(n) for n in names])


def canonical_request(df: DataFrame) -> DataFrame:
    """Add ``canonical``, the deterministic JSON text, to parsed requests."""
    return df.withColumn("canonical", _canonical())


def request_fingerprint(df: DataFrame) -> DataFrame:
    """Add ``hash``, the SHA-256 of the canonical text, to parsed requests."""
    return df.withColumn("hash", F.sha2(_canonical(), 256))


def fingerprint_duplicates(
    df: DataFrame, hash_col: str = "hash", ts: str = "ts", tokens: str = "est_tokens"
) -> DataFrame:
    """Fingerprints asked for more than once and the tokens that repeats cost.

    The first request of a group is needed; the others are waste.  Partial
    aggregation leaves one row per fingerprint and task to shuffle.
    """
    return (
        df.groupBy(F.col(hash_col).alias("hash"))
        .agg(
            F.count(F.lit(1)).alias("n_requests"),
            F.min(ts).alias("first_ts"),
            F.max(ts).alias("last_ts"),
            (F.sum(tokens) - F.min(tokens)).alias("wasted_tokens"),
        )
        .where(F.col("n_requests") > 1)
    )


def cost_estimate(
    df: DataFrame,
    prompt_tokens: str = "prompt_tokens",
    completion_tokens: str = "completion_tokens",
    prices: Prices = Prices(),
) -> DataFrame:
    """Add ``cost_usd``."""
    return df.withColumn("cost_usd", prices.usd(F.col(prompt_tokens), F.col(completion_tokens)))


def usage_resolve(
    df: DataFrame, response: str = "response", is_stream: str = "is_stream", est: str = "est_tokens"
) -> DataFrame:
    """Add ``prompt_tokens, completion_tokens`` of a response.

    A reported non-zero number wins.  Otherwise the prompt is the request's
    estimate and the completion a quarter of the characters: of the content for
    a stream (at least 1), of the whole JSON text for a plain response.
    """
    body = F.col("_b")
    content = F.coalesce(F.get(body["choices"], F.lit(0))["message"]["content"], F.lit(""))
    guess = F.when(
        F.col(is_stream), F.greatest(F.lit(1).cast("bigint"), estimate(utf16_length(content)))
    ).otherwise(estimate(utf16_length(F.col(response))))
    return (
        df.withColumn("_b", F.from_json(response, RESPONSE_BODY))
        .withColumn(
            "prompt_tokens",
            F.coalesce(F.nullif(body["usage"]["prompt_tokens"], F.lit(0).cast("bigint")), F.col(est)),
        )
        .withColumn(
            "completion_tokens",
            F.coalesce(F.nullif(body["usage"]["completion_tokens"], F.lit(0).cast("bigint")), guess),
        )
        .drop("_b")
    )


def client_key(forwarded_for: Column, peer: Column) -> Column:
    """Who a request counts against."""
    return F.coalesce(
        F.nullif(forwarded_for, F.lit("")), F.nullif(peer, F.lit("")), F.lit("127.0.0.1")
    )
