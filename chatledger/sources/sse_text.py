"""Raw server-sent-event text to numbered ``data:`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatledger.functions.text import trim_all


def sse_lines(df: DataFrame, stream_id: str = "stream_id", text: str = "text") -> DataFrame:
    """``(stream_id, seq, line)``; ``seq`` is the line's number in its text.

    Blank and non-``data:`` lines are dropped.  A last line that no newline ends
    counts only if it is the end marker.  Works on batch and streaming frames.
    """
    split = F.split(F.col(text), "\n")
    unended = trim_all(F.element_at("lines_", -1))
    is_end = unended.startswith("data:") & (payload(unended) == "[DONE]")
    ended = F.when(is_end, F.col("lines_")).otherwise(F.slice("lines_", 1, F.size("lines_") - 1))
    return (
        df.select(F.col(stream_id).alias("stream_id"), split.alias("lines_"))
        .select("stream_id", F.posexplode(ended).alias("seq", "line"))
        .select("stream_id", F.col("seq").cast("bigint").alias("seq"), trim_all(F.col("line")).alias("line"))
        .where(F.col("line").startswith("data:"))
    )


def payload(line):
    """What follows ``data:``, without surrounding white space."""
    return trim_all(F.substring(line, F.lit(6), F.char_length(line)))
