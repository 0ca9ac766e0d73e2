"""Canonical request text and its SHA-256 fingerprint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatledger.functions.text import estimate, json_number, json_quote, trim_all, utf16_length
from chatledger.rules import WHITE_SPACE


def canonical_messages(messages: Column) -> Column:
    """JSON array of ``role, content, name, tool_call_id`` objects.

    Multipart content enters as a string holding its own JSON text; a missing
    role or content leaves the field out.
    """

    messages = F.coalesce(messages, F.array())

    def content_of(m: Column) -> Column:
        return F.when(m["is_parts"], m["content"]).otherwise(trim_all(m["content"]))

    def whole(m: Column) -> Column:
        empty = F.lit("")
        return F.struct(
            m["role"].alias("role"),
            content_of(m).alias("content"),
            F.nullif(m["name"], empty).alias("name"),
            F.nullif(m["tool_call_id"], empty).alias("tool_call_id"),
        )

    def optional(value: Column) -> Column:
        return F.when(F.char_length(value) > 0, json_quote(value)).otherwise(F.lit("null"))

    def one(m: Column) -> Column:
        fields = F.array_compact(
            F.array(
                F.concat(F.lit('"role":'), json_quote(m["role"])),
                F.concat(F.lit('"content":'), json_quote(content_of(m))),
                F.concat(F.lit('"name":'), optional(m["name"])),
                F.concat(F.lit('"tool_call_id":'), optional(m["tool_call_id"])),
            )
        )
        return F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))

    # Where no field is left out, Spark writes all messages at once.
    partial = F.exists(messages, lambda m: m["role"].isNull() | m["content"].isNull())
    single = F.concat(F.lit("["), F.array_join(F.transform(messages, one), ","), F.lit("]"))
    return F.when(partial, single).otherwise(
        F.to_json(F.transform(messages, whole), {"ignoreNullFields": "false"})
    )


def canonical_temperature(temperature: Column, present: Column) -> Column:
    """Two decimals, halves upwards; 0.7 when absent, 0 when an explicit null or empty, 1 and 0
    for true and false, and ``null`` for what is no number."""
    number = F.btrim(temperature, F.lit(WHITE_SPACE))
    value = (
        F.when(number.isin("", "false"), F.lit(0.0))
        .when(number == "true", F.lit(1.0))
        .when(number.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), number.try_cast("double"))
    )
    # Beyond 1e12 a double has no two decimals to round.
    rounded = F.when(F.abs(value) < 1e12, F.floor(value * 100 + 0.5) / 100).otherwise(value)
    return F.when(temperature.isNotNull(), F.coalesce(json_number(rounded), F.lit("null"))).otherwise(
        F.when(present, F.lit("0")).otherwise(F.lit("0.7"))
    )


def canonical_request(
    model: Column,
    messages: Column,
    temperature: Column,
    temperature_present: Column,
    max_tokens: Column,
    top_p: Column,
    tools: Column,
    tool_choice: Column,
) -> Column:
    """The deterministic JSON text a request is identified by."""

    def number(x: Column) -> Column:
        return F.when(x != 0, json_number(x)).otherwise(F.lit("null"))

    def embedded(raw: Column) -> Column:
        return F.when(F.char_length(raw) > 0, json_quote(raw)).otherwise(F.lit("null"))

    # A bare word is a JSON string and keeps its quotes inside the embedded text.
    choice = F.when(tool_choice.rlike(r"^[\[{]"), tool_choice).when(
        F.char_length(tool_choice) > 0, json_quote(tool_choice)
    )
    return F.concat(
        F.lit('{"model":'),
        json_quote(F.coalesce(model, F.lit(""))),
        F.lit(',"messages":'),
        canonical_messages(messages),
        F.lit(',"temperature":'),
        canonical_temperature(temperature, temperature_present),
        F.lit(',"max_tokens":'),
        number(max_tokens),
        F.lit(',"top_p":'),
        number(top_p),
        F.lit(',"tools":'),
        embedded(tools),
        F.lit(',"tool_choice":'),
        embedded(choice),
        F.lit("}"),
    )


def message_chars(messages: Column) -> Column:
    """Characters of text over all messages, parts included."""

    def chars(m: Column) -> Column:
        parts = F.aggregate(
            F.from_json(m["content"], "array<struct<text: string>>"),
            F.lit(0).cast("bigint"),
            lambda acc, p: acc + F.coalesce(utf16_length(p["text"]), F.lit(0)),
        )
        plain = utf16_length(m["content"]).cast("bigint")
        return F.coalesce(F.when(m["is_parts"], parts).otherwise(plain), F.lit(0).cast("bigint"))

    return F.aggregate(
        F.coalesce(messages, F.array()), F.lit(0).cast("bigint"), lambda acc, m: acc + chars(m)
    )


def estimated_tokens(messages: Column) -> Column:
    """About four characters per token, summed first, at least one."""
    return F.greatest(F.lit(1).cast("bigint"), estimate(message_chars(messages)))
