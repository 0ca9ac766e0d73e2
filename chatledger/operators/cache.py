"""Lookups in, and maintenance of, the response-cache table.

Every operator returns a frame; publishing a new version of the table is
:func:`chatledger.sources.write_response_cache`.  Joins are equi-joins on
``hash``, unique on the cache side, so a hash that dominates the requests is
split by adaptive skew handling and a small cache is broadcast by its measured
size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from chatledger.functions.cost import Prices


def is_live(now_ms: Column, created_at: Column, ttl_ms: Column) -> Column:
    """An entry lives until its age exceeds its ``ttl_ms``; 0 or less is for ever."""
    return (ttl_ms <= 0) | (now_ms - created_at <= ttl_ms)


def _lookup(requests: DataFrame, cache: DataFrame, hash_col: str, now_ms: str, how: str) -> DataFrame:
    r, c = requests.alias("r"), cache.alias("c")
    on = (F.col(f"r.{hash_col}") == F.col("c.hash")) & is_live(
        F.col(f"r.{now_ms}"), F.col("c.created_at"), F.col("c.ttl_ms")
    )
    return r.join(c, on, how)


def cache_lookup(
    requests: DataFrame,
    cache: DataFrame,
    hash_col: str = "hash",
    now_ms: str = "now_ms",
    columns: tuple[str, ...] = ("response_body", "prompt_tokens", "completion_tokens"),
) -> DataFrame:
    """Each request with ``hit`` and the chosen ``columns`` of its live entry."""
    cache = cache.select("hash", "created_at", "ttl_ms", *columns)
    return _lookup(requests, cache, hash_col, now_ms, "left").select(
        *[F.col(f"r.{c}") for c in requests.columns],
        F.col("c.hash").isNotNull().alias("hit"),
        *[F.col(f"c.{c}").alias(f"cached_{c}") for c in columns],
    )


def cache_lookup_tiered(
    requests: DataFrame,
    hot: DataFrame,
    cold: DataFrame,
    hash_col: str = "hash",
    now_ms: str = "now_ms",
    columns: tuple[str, ...] = ("prompt_tokens", "completion_tokens"),
) -> DataFrame:
    """Look in ``hot``, then in ``cold``: ``tier`` is L1, L2 or null."""
    first = cache_lookup(requests, hot, hash_col, now_ms, columns)
    first = first.select(
        *requests.columns, F.col("hit").alias("_l1"), *[F.col(f"cached_{c}").alias(f"_l1_{c}") for c in columns]
    )
    both = cache_lookup(first, cold, hash_col, now_ms, columns)
    tier = F.when(F.col("_l1"), F.lit("L1")).when(F.col("hit"), F.lit("L2"))
    return both.select(
        *requests.columns,
        tier.alias("tier"),
        *[
            F.when(F.col("_l1"), F.col(f"_l1_{c}")).otherwise(F.col(f"cached_{c}")).alias(f"cached_{c}")
            for c in columns
        ],
    )


def cache_misses(
    requests: DataFrame, cache: DataFrame, hash_col: str = "hash", now_ms: str = "now_ms"
) -> DataFrame:
    """Requests without a live entry."""
    return _lookup(requests, cache.select("hash", "created_at", "ttl_ms"), hash_col, now_ms, "left_anti")


def cache_hits_semi(
    cache: DataFrame, requests: DataFrame, hash_col: str = "hash", now_ms: str = "now_ms"
) -> DataFrame:
    """Entries some request found live.

    An entry only ages, so if any request of a hash found it live its earliest
    one did: requests are first reduced to that one per hash.
    """
    asked = requests.groupBy(F.col(hash_col).alias("_h")).agg(F.min(now_ms).alias("_at"))
    live = is_live(F.col("_at"), F.col("created_at"), F.col("ttl_ms"))
    return cache.join(asked, (F.col("hash") == F.col("_h")) & live, "left_semi")


def cache_upsert(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """Existing and new entries, the newest per hash; new ones start unused.

    A maximum with partial aggregation rather than a ranking window: however
    many versions of one hash arrive, each task passes on a single row.  At
    equal times a new entry replaces the old one.
    """
    fresh = entries.withColumn("last_accessed_at", F.col("created_at")).withColumn(
        "hit_count", F.lit(0).cast("bigint")
    )
    both = cache.withColumn("_new", F.lit(0)).unionByName(
        fresh.select(*cache.columns).withColumn("_new", F.lit(1))
    )
    rest = [c for c in cache.columns if c != "hash"]
    newest = F.max_by(F.struct(*rest), F.struct("created_at", "_new", "response_body"))
    return both.groupBy("hash").agg(newest.alias("_e")).select("hash", *[f"_e.{c}" for c in rest])


def cache_touch(cache: DataFrame, hits: DataFrame, hash_col: str = "hash", ms: str = "now_ms") -> DataFrame:
    """Count a batch of hits into ``hit_count`` and ``last_accessed_at``."""
    batch = hits.groupBy(F.col(hash_col).alias("hash")).agg(
        F.count(F.lit(1)).alias("_n"), F.max(ms).alias("_last")
    )
    return (
        cache.join(batch, "hash", "left")
        .withColumn("hit_count", F.col("hit_count") + F.coalesce("_n", F.lit(0)))
        .withColumn("last_accessed_at", F.coalesce("_last", "last_accessed_at"))
        .select(*cache.columns)
    )


def cache_evict(cache: DataFrame, hashes: DataFrame | None = None, hash_col: str = "hash") -> DataFrame:
    """Drop the listed hashes, or everything when none are given."""
    if hashes is None:
        return cache.where(F.lit(False))
    return cache.join(hashes.select(F.col(hash_col).alias("hash")), "hash", "left_anti")


def cache_prune_expired(
    cache: DataFrame, now_ms: Column | int, dropped: Observation | None = None
) -> DataFrame:
    """Live entries only.  ``dropped`` observes ``n_expired`` while the result is written."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    live = is_live(now, F.col("created_at"), F.col("ttl_ms"))
    if dropped is not None:
        cache = cache.observe(dropped, F.count_if(~live).alias("n_expired"))
    return cache.where(live)


def hot_set_topk(
    log: DataFrame, n: int, hash_col: str = "hash", ms: str = "now_ms", tie: str = "request_id"
) -> DataFrame:
    """The ``n`` most recently used hashes: what an LRU of ``n`` entries ends up with."""
    last = log.groupBy(F.col(hash_col).alias("hash")).agg(
        F.max(F.struct(F.col(ms).alias("ms"), F.col(tie).alias("tie"))).alias("_last")
    )
    return (
        last.orderBy(F.desc("_last.ms"), F.desc("_last.tie"))
        .limit(n)
        .select("hash", F.col("_last.ms").alias("last_used_ms"))
    )


def cache_stats(cache: DataFrame) -> DataFrame:
    """Entries, hits and tokens saved; zeros for an empty cache."""
    zero = F.lit(0).cast("bigint")
    saved = F.col("hit_count") * (F.col("prompt_tokens") + F.col("completion_tokens"))
    return cache.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.coalesce(F.sum("hit_count"), zero).alias("total_hits"),
        F.coalesce(F.sum(saved), zero).alias("tokens_saved"),
    )


def cache_savings(cache: DataFrame, prices: Prices = Prices()) -> DataFrame:
    """:func:`cache_stats` with all saved tokens priced at the prompt rate."""
    return cache_stats(cache).withColumn("usd_saved", prices.usd_at_prompt_rate(F.col("tokens_saved")))
