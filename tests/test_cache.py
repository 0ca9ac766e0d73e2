from __future__ import annotations

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from chatledger import sources
from chatledger.operators import cache
from chatledger.schemas import RESPONSE_CACHE


def entries(spark, *rows):
    """(hash, created_at, ttl_ms, hit_count, body)"""
    full = [(h, "m", "m", body, False, 100, 50, at, at, hits, ttl) for h, at, ttl, hits, body in rows]
    return spark.createDataFrame(full, RESPONSE_CACHE)


def asks(spark, *rows):
    return spark.createDataFrame(list(rows), "request_id long, hash string, now_ms long")


def test_lookup_respects_ttl(spark):
    c = entries(spark, ("a", 0, 100, 0, "A"), ("b", 0, 0, 0, "B"), ("c", 0, -1, 0, "C"))
    r = asks(spark, (1, "a", 100), (2, "a", 101), (3, "b", 10**9), (4, "c", 10**9), (5, "x", 0))
    got = {x.request_id: (x.hit, x.cached_response_body) for x in cache.cache_lookup(r, c).collect()}
    assert got == {1: (True, "A"), 2: (False, None), 3: (True, "B"), 4: (True, "C"), 5: (False, None)}
    assert {x.request_id for x in cache.cache_misses(r, c).collect()} == {2, 5}
    late = asks(spark, (1, "a", 101), (2, "a", 500), (3, "b", 1))
    assert {x.hash for x in cache.cache_hits_semi(c, late).collect()} == {"b"}


def test_tiers(spark):
    hot = entries(spark, ("a", 0, 10, 0, "hot"))
    cold = entries(spark, ("a", 0, 0, 0, "cold"), ("b", 0, 0, 0, "cold"))
    r = asks(spark, (1, "a", 5), (2, "a", 50), (3, "b", 5), (4, "x", 5))
    got = cache.cache_lookup_tiered(r, hot, cold, columns=("response_body",)).collect()
    assert {x.request_id: (x.tier, x.cached_response_body) for x in got} == {
        1: ("L1", "hot"), 2: ("L2", "cold"), 3: ("L2", "cold"), 4: (None, None),
    }


def test_upsert_touch_stats(spark):
    old = entries(spark, ("a", 0, 0, 7, "old"), ("b", 5, 0, 2, "kept"))
    new = entries(spark, ("a", 0, 0, 9, "new"), ("a", -1, 0, 0, "older"), ("c", 1, 0, 3, "c"))
    merged = cache.cache_upsert(old, new)
    got = {r.hash: (r.response_body, r.hit_count) for r in merged.collect()}
    assert got == {"a": ("new", 0), "b": ("kept", 2), "c": ("c", 0)}
    hits = asks(spark, (1, "a", 50), (2, "a", 70), (3, "zz", 1))
    touched = {r.hash: (r.hit_count, r.last_accessed_at) for r in cache.cache_touch(merged, hits).collect()}
    assert touched == {"a": (2, 70), "b": (2, 5), "c": (0, 1)}
    one = entries(spark, ("a", 0, 0, 1, ""))
    assert tuple(cache.cache_stats(one).first()) == (1, 1, 150)
    assert tuple(cache.cache_stats(one.where("false")).first()) == (0, 0, 0)
    assert cache.cache_savings(one).first().usd_saved == pytest.approx(0.15 * 0.005)


def test_evict_and_prune(spark):
    c = entries(spark, ("a", 0, 100, 0, ""), ("b", 0, 0, 0, ""), ("c", 50, 100, 0, ""))
    listed = spark.createDataFrame([("a",)], "hash string")
    assert {r.hash for r in cache.cache_evict(c, listed).collect()} == {"b", "c"}
    assert cache.cache_evict(c).count() == 0
    seen = Observation()
    assert {r.hash for r in cache.cache_prune_expired(c, 101, seen).collect()} == {"b", "c"}
    assert seen.get["n_expired"] == 1


def test_hot_set_is_what_an_lru_keeps(spark):
    log = asks(spark, (1, "a", 1), (2, "b", 2), (3, "a", 3), (4, "c", 4))
    assert [r.hash for r in cache.hot_set_topk(log, 2).collect()] == ["c", "a"]


def test_table_round_trip_needs_no_exchange(spark, tmp_path):
    c = entries(spark, *[(f"h{i}", i, 0, 0, "x") for i in range(50)])
    sources.write_response_cache(c, "cache_rt", str(tmp_path / "t"), buckets=4)
    back = sources.read_response_cache(spark, "cache_rt")
    assert back.count() == 50 and back.schema.names == RESPONSE_CACHE.names
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = back.join(back.select("hash", F.lit(1).alias("x")), "hash")._jdf.queryExecution().executedPlan()
        assert "Exchange hashpartitioning" not in plan.toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_versions_change_in_place(spark, tmp_path):
    path = str(tmp_path / "versions")
    table = sources.VersionedCache(spark, path, buckets=8)
    assert table.version() is None and table.read().count() == 0
    c = entries(spark, *[(f"h{i}", i, 100 if i % 4 == 0 else 0, 1, "x") for i in range(40)])
    assert table.publish(c) == 0
    before = table.read()
    first = dict(table._manifest(0)["folders"])

    # The table that is changed is also what the change is made of.
    newer = table.read().where("hash = 'h3'").withColumn("created_at", F.col("created_at") + 50)
    assert table.upsert(newer) == 1
    second = table._manifest(1)["folders"]
    assert sum(first[b] != second[b] for b in first) == 1
    assert table.read().where("hash = 'h3'").first().created_at == 53
    assert before.where("hash = 'h3'").first().created_at == 3 and before.count() == 40

    table.touch(spark.createDataFrame([("h3", 70), ("h3", 80), ("none", 5)], "hash string, now_ms long"))
    assert tuple(table.read().where("hash = 'h3'").select("hit_count", "last_accessed_at").first()) == (2, 80)
    table.evict(spark.createDataFrame([("h5",), ("none",)], "hash string"))
    assert table.read().count() == 39 and table.read(0).count() == 40
    table.prune(130)
    assert {r.hash for r in c.collect()} - {r.hash for r in table.read().collect()} == {"h5"} | {f"h{i}" for i in range(0, 30, 4)}

    again = sources.VersionedCache(spark, path)
    assert again.buckets == 8 and again.version() == 4
    again.vacuum(keep=1)
    assert again.versions() == [4] and again.read().count() == 31
    again.evict()
    assert again.read().count() == 0 and again.read(4).count() == 31


def test_the_second_of_two_writers_fails(spark, tmp_path):
    path = str(tmp_path / "versions")
    one, two = (sources.VersionedCache(spark, path, buckets=4) for _ in range(2))
    one.publish(entries(spark, ("a", 1, 0, 0, "x")))
    change = one.read().withColumn("created_at", F.lit(9))
    real = two.version

    def stale():
        two.version = real
        one.upsert(entries(spark, ("b", 2, 0, 0, "y")))
        return 0

    two.version = stale
    with pytest.raises(RuntimeError):
        two._publish([0, 1, 2, 3], lambda old: change)
    assert {r.hash for r in one.read().collect()} == {"a", "b"}
