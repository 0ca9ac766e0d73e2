"""Counters, rates and samples over a log of request outcomes.

An outcome row has ``outcome`` (rate_limited, invalid_json, secret_blocked,
budget_blocked, hit, miss, upstream_error or unparsed), ``cache_tier``,
``n_findings, prompt_tokens, completion_tokens, latency_ms``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatledger.functions.cost import Prices
from chatledger.operators.running import running_totals, trailing_mean

LATENCY_ROWS = 100


def counter_columns(prices: Prices) -> dict[str, Column]:
    """What one outcome row adds to each counter."""
    outcome = F.col("outcome")
    hit, miss = outcome == "hit", outcome == "miss"
    prompt, completion = F.col("prompt_tokens"), F.col("completion_tokens")

    def one_if(condition: Column) -> Column:
        return F.when(condition, 1).otherwise(0).cast("bigint")

    def tokens_if(condition: Column, tokens: Column) -> Column:
        return F.when(condition, tokens).otherwise(0).cast("bigint")

    return {
        "total_requests": F.lit(1).cast("bigint"),
        "cache_hits_l1": one_if(hit & (F.col("cache_tier") == "L1")),
        "cache_hits_l2": one_if(hit & (F.col("cache_tier") == "L2")),
        "cache_misses": one_if(miss),
        "upstream_errors": one_if(outcome == "upstream_error"),
        "blocked_requests": one_if(outcome.isin("secret_blocked", "budget_blocked")),
        "redacted_secrets": F.coalesce(F.col("n_findings"), F.lit(0)).cast("bigint"),
        "total_prompt_tokens": tokens_if(miss, prompt),
        "total_completion_tokens": tokens_if(miss, completion),
        "tokens_saved": tokens_if(hit, prompt + completion),
        "usd_saved": F.when(hit, prices.usd(prompt, completion)).otherwise(0.0),
    }


def usage_metrics(
    outcomes: DataFrame, by: Sequence[str] = (), prices: Prices = Prices()
) -> DataFrame:
    """The eleven counters, over all rows or per group, in one pass."""
    zero = F.lit(0)
    sums = [F.coalesce(F.sum(c), zero).alias(n) for n, c in counter_columns(prices).items()]
    return outcomes.groupBy(*by).agg(*sums)


def running_counters(
    outcomes: DataFrame,
    keys: Sequence[str],
    ms: str,
    tie: str,
    prices: Prices = Prices(),
    parts: int | None = None,
) -> DataFrame:
    """The counters of each key as they stand after each request."""
    counters = counter_columns(prices)
    narrow = outcomes.select(*keys, ms, tie, *[c.alias(f"add_{n}") for n, c in counters.items()])
    totals = running_totals(narrow, keys, ms, tie, {n: F.col(f"add_{n}") for n in counters}, parts)
    return totals.select(*keys, ms, tie, *counter_columns(prices))


def _usd(amount: Column) -> Column:
    """Four decimals; the noise of summing is cut off first so that halves round alike."""
    return F.round(F.round(amount, 8), 4)


def kpi_rollup(metrics: DataFrame, uptime_s: Column | int) -> DataFrame:
    """Hit rate in percent (0 without requests) and savings of a metrics row."""
    hits = F.col("cache_hits_l1") + F.col("cache_hits_l2")
    rate = F.when(
        F.col("total_requests") > 0, F.round(hits / F.col("total_requests") * 100, 1)
    ).otherwise(F.lit(0.0))
    uptime = uptime_s if isinstance(uptime_s, Column) else F.lit(uptime_s)
    return metrics.select(
        uptime.cast("bigint").alias("uptime_s"),
        "total_requests",
        rate.alias("hit_rate_pct"),
        "cache_hits_l1",
        "cache_hits_l2",
        "cache_misses",
        "tokens_saved",
        _usd(F.col("usd_saved")).alias("usd_saved"),
        "redacted_secrets",
    )


def metric_samples(metrics: DataFrame, prefix: str = "prompts_") -> DataFrame:
    """A metrics row as seven samples ``(name, type, labels, value)``."""

    def sample(name: str, kind: str, value: Column, **labels: str) -> Column:
        tags = ",".join(f'{k}="{v}"' for k, v in labels.items())
        return F.struct(
            F.lit(prefix + name).alias("name"),
            F.lit(kind).alias("type"),
            F.lit(tags).alias("labels"),
            value.cast("double").alias("value"),
        )

    samples = F.array(
        sample("requests_total", "counter", F.col("total_requests")),
        sample("cache_hits_total", "counter", F.col("cache_hits_l1"), tier="L1"),
        sample("cache_hits_total", "counter", F.col("cache_hits_l2"), tier="L2"),
        sample("cache_misses_total", "counter", F.col("cache_misses")),
        sample("tokens_saved_total", "counter", F.col("tokens_saved")),
        sample("cost_saved_usd", "gauge", _usd(F.col("usd_saved"))),
        sample("secrets_redacted_total", "counter", F.col("redacted_secrets")),
    )
    return metrics.select(F.inline(samples))


def rolling_latency(
    outcomes: DataFrame,
    group: str,
    ms: str,
    tie: str,
    rows: int = LATENCY_ROWS,
    parts: int | None = None,
) -> DataFrame:
    """Mean of the last ``rows`` latencies, hits and misses apart, whole milliseconds."""
    answered = outcomes.where(F.col("outcome").isin("hit", "miss")).select(
        group, ms, tie, (F.col("outcome") == "hit").alias("is_hit"), "latency_ms"
    )
    means = trailing_mean(answered, [group, "is_hit"], ms, tie, "latency_ms", rows, "_mean", parts)
    return means.select(
        group, ms, tie, "is_hit", F.floor(F.col("_mean") + 0.5).cast("bigint").alias("avg_latency_ms")
    )


def running_usage(
    df: DataFrame,
    scope: Sequence[str],
    ms: str,
    tie: str,
    tokens: str,
    parts: int | None = None,
) -> DataFrame:
    """Add ``used_before, used_after``: tokens used within the scope around each row."""
    after = running_totals(df, scope, ms, tie, {"used_after": F.col(tokens)}, parts)
    return after.withColumn("used_before", F.col("used_after") - F.coalesce(tokens, F.lit(0)))


def budget_usage(df: DataFrame, scope: Sequence[str], tokens: str, budget: int = 0) -> DataFrame:
    """Tokens used and left per scope; nothing is left below 0, null without a budget."""
    left = F.greatest(F.lit(0).cast("bigint"), budget - F.col("used")) if budget > 0 else F.lit(None)
    return (
        df.groupBy(*scope)
        .agg(F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("used"))
        .withColumn("remaining", left.cast("bigint"))
    )
