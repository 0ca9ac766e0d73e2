"""Raw JSON request bodies to typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatledger.functions.text import STRICT_JSON, is_json, truthy
from chatledger.schemas import REQUEST_BODY

REQUEST_COLUMNS = [
    "invalid_json",
    "model",
    "messages",
    "stream",
    "temperature",
    "temperature_present",
    "max_tokens",
    "top_p",
    "frequency_penalty",
    "presence_penalty",
    "tools",
    "tool_choice",
]


def parse_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Add the typed request columns; ``body`` is dropped.

    A body that is not one JSON value gets ``invalid_json`` and nulls elsewhere; of a
    key that repeats, the last value counts.  Message
    content is a string, or the JSON text of a part array (``is_parts``).
    """
    raw = F.col(body)
    raw = F.when(is_json(raw), raw)
    parsed = df.withColumn(body, raw).withColumn("_bad", F.col(body).isNull())
    raw = F.col(body)
    parsed = parsed.withColumn("_r", F.from_json(raw, REQUEST_BODY, STRICT_JSON))
    messages = F.col("_r.messages")

    # from_json gives a part array as its JSON text, and null for both a null
    # and a missing content.  Only requests with such a message are read again,
    # message by message, to tell the cases apart.
    unclear = F.exists(
        messages, lambda m: m["content"].isNull() | m["content"].startswith("[")
    )
    texts = F.from_json(F.get_json_object(raw, "$.messages"), "array<string>")

    def plain(m):
        return F.struct(
            m["role"], m["content"], m["name"], m["tool_call_id"], F.lit(False).alias("is_parts")
        )

    # Whether the content is an array goes by its own JSON type.  One that has no variant (its
    # objects repeat a key) cannot be a string, so its text must itself be JSON.
    def is_array(content, text):
        kind = F.schema_of_variant(F.from_json(text, "content VARIANT", STRICT_JSON)["content"])
        return content.startswith("[") & F.coalesce(kind.startswith("ARRAY"), is_json(content))

    def clarified(m, text):
        null_content = m["content"].isNull() & F.array_contains(F.json_object_keys(text), "content")
        return F.struct(
            m["role"].alias("role"),
            F.when(null_content, F.lit("null")).otherwise(m["content"]).alias("content"),
            m["name"].alias("name"),
            m["tool_call_id"].alias("tool_call_id"),
            F.coalesce(is_array(m["content"], text), F.lit(False)).alias("is_parts"),
        )

    typed_messages = F.when(unclear, F.zip_with(messages, texts, clarified)).otherwise(
        F.transform(messages, plain)
    )
    present = F.col("_r.temperature").isNotNull() | (
        F.contains(raw, F.lit('"temperature"'))
        & F.array_contains(F.json_object_keys(raw), "temperature")
    )
    kept = [c for c in df.columns if c != body and c not in REQUEST_COLUMNS]
    return parsed.select(
        *kept,
        F.col("_bad").alias("invalid_json"),
        F.col("_r.model").alias("model"),
        typed_messages.alias("messages"),
        truthy(F.col("_r.stream")).alias("stream"),
        F.col("_r.temperature").alias("temperature"),
        F.coalesce(present, F.lit(False)).alias("temperature_present"),
        *[
            F.col(f"_r.{c}").alias(c)
            for c in (
                "max_tokens",
                "top_p",
                "frequency_penalty",
                "presence_penalty",
                "tools",
                "tool_choice",
            )
        ],
    )
