"""Folds against plain Python models on random logs, in one partition and cut into many,
so that keys go on from partition to partition."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from chatledger.operators import folds, metrics, running

PARTS = [pytest.param(1, id="whole"), pytest.param(13, id="cut")]


def make_log(spark, seed, n=400, keys=3, step=2000):
    rng = random.Random(seed)
    ms, rows = 1_704_067_200_000, []
    for i in range(n):
        # Some requests share a millisecond; most belong to one key.
        ms += rng.choice([0, 0, 1, rng.randrange(step), rng.randrange(step * 20)])
        key = 0 if rng.random() < 0.6 else rng.randrange(keys)
        rows.append(
            (i, ms, f"k{key}", f"h{rng.randrange(6)}", rng.choice([1, 3, 8, 20, 64, 200]), rng.randrange(0, 40), rng.random() < 0.2)
        )
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(
        shuffled, "id long, ms long, k string, h string, est long, charge long, error boolean"
    )
    return rows, df.repartition(3, "id")


def bucket_model(rows, rpm, burst, cost):
    capacity, rate = max(1, math.floor(rpm * burst + 0.5)), rpm / 60000
    state, out = {}, {}
    for i, ms, k, *_ in rows:
        tokens, last = state.get(k, (capacity, ms))
        tokens = min(capacity, tokens + (ms - last) * rate)
        if tokens >= cost:
            tokens -= cost
            out[i] = (True, math.floor(tokens), 0)
        else:
            out[i] = (False, 0, math.ceil((cost - tokens) / rate))
        state[k] = (tokens, ms)
    return out


@pytest.mark.parametrize("parts", PARTS)
@pytest.mark.parametrize("rpm, burst, cost", [(60, 1.0, 1), (6, 1.5, 1), (10, 1.0, 3), (1, 1.0, 5)])
def test_rate_limit(spark, parts, rpm, burst, cost):
    rows, df = make_log(spark, 1)
    got = folds.rate_limit_audit(df, "k", "ms", "id", rpm, burst, cost, parts).collect()
    want = bucket_model(rows, rpm, burst, cost)
    assert {r.id: (r.allowed, r.remaining, r.reset_ms) for r in got} == want
    assert all(r.retry_after_s == math.ceil(r.reset_ms / 1000) for r in got)
    if rpm < 60:
        assert not all(allowed for allowed, *_ in want.values())


def test_rate_limit_examples(spark):
    df = spark.createDataFrame([(1, 0, "c"), (2, 0, "c")], "id long, ms long, k string")
    full = folds.rate_limit_audit(df.where("id = 1"), "k", "ms", "id", 60, 1.0).first()
    assert full.allowed and full.remaining == 59
    second = folds.rate_limit_audit(df, "k", "ms", "id", 1, 1.0).where("id = 2").first()
    assert not second.allowed and second.remaining == 0 and second.reset_ms > 0
    with pytest.raises(ValueError):
        folds.rate_limit_audit(df, "k", "ms", "id", 0)


def cache_model(rows, ttl, key=lambda r: r[3]):
    state, out = {}, {}
    for r in rows:
        i, ms, error = r[0], r[1], r[6]
        entry = state.get(key(r))
        if entry and (ttl <= 0 or ms - entry[0] <= ttl):
            out[i] = (True, *entry)
        else:
            out[i] = (False, None, None)
            if not error:
                state[key(r)] = (ms, r[4])
    return out


@pytest.mark.parametrize("parts", PARTS)
@pytest.mark.parametrize("ttl", [0, 1, 5_000, 60_000])
def test_cache_attribution(spark, parts, ttl):
    rows, df = make_log(spark, 2)
    got = folds.cache_attribution(
        df, "h", "ms", "id", ttl, stores=~F.col("error"), payload=["est"], parts=parts
    ).collect()
    assert {r.id: (r.is_hit, r.stored_ms, r.stored_est) for r in got} == cache_model(rows, ttl)


@pytest.mark.parametrize("parts", PARTS)
def test_cache_attribution_with_completion(spark, parts):
    rows, df = make_log(spark, 3)
    got = folds.cache_attribution(
        df, "h", "ms", "id", 60_000, stores=~F.col("error"),
        completed_ms=F.col("ms") + F.col("charge") * 100, parts=parts,
    ).collect()
    answers, want = [], {}
    for i, ms, _, h, _, charge, error in rows:
        done = [a for a in answers if a[0] == h and max(a[1], a[2] + 1) <= ms]
        stored = max((a[1] for a in done), default=None)
        hit = stored is not None and ms - stored <= 60_000
        want[i] = (hit, stored if hit else None)
        if not hit and not error:
            answers.append((h, ms + charge * 100, ms))
    assert {r.id: (r.is_hit, r.stored_ms) for r in got} == want


def budget_model(rows, session, daily, ttl=None):
    state, out = {}, {}
    for i, ms, k, h, est, charge, error in rows:
        s, day, d, cached = state.get(k, (0, None, 0, {}))
        today = ms // 86_400_000
        d = d if day == today else 0
        blocked = "session" if session and s + est > session else "daily" if daily and d + est > daily else None
        out[i] = (blocked is None, blocked, s, d)
        if blocked is None:
            pay = charge
            if ttl is not None:
                stored = cached.get(h)
                hit = stored is not None and (ttl <= 0 or ms - stored <= ttl)
                pay = 0 if hit or error else charge
                if not hit and not error:
                    cached = {**cached, h: ms}
            s, d = s + pay, d + pay
        state[k] = (s, today, d, cached)
    return out


BUDGETS = [(0, 0), (300, 0), (0, 150), (900, 120), (5, 5)]


@pytest.mark.parametrize("parts", PARTS)
@pytest.mark.parametrize("session, daily", BUDGETS)
def test_budget_guard(spark, parts, session, daily):
    rows, df = make_log(spark, 4, step=200_000)
    got = folds.budget_guard(
        df, "k", "ms", "id", "est", "charge", session, daily, parts=parts, slice_ms=3_000_000
    ).collect()
    assert len({r[1] // 86_400_000 for r in rows}) > 1
    assert {
        r.id: (r.allowed, r.blocked_by, r.session_used_before, r.daily_used_before) for r in got
    } == budget_model(rows, session, daily)


@pytest.mark.parametrize("parts", PARTS)
@pytest.mark.parametrize("session, daily, ttl", [(300, 0, 0), (0, 150, 5_000_000), (900, 120, 5_000_000), (150, 400, 0), (5, 5, 0)])
def test_budget_guard_with_cache(spark, parts, session, daily, ttl):
    rows, df = make_log(spark, 5, step=200_000)
    rows = [(*r[:5], r[5] + 1, r[6]) for r in rows]
    df = df.withColumn("charge", F.col("charge") + 1).withColumn("ok", ~F.col("error"))
    got = folds.budget_guard_cached(
        df, "k", "ms", "id", "est", "charge", "h", "ok", ttl, session, daily,
        parts=parts, slice_ms=3_000_000,
    ).collect()
    assert {
        r.id: (r.allowed, r.blocked_by, r.session_used_before, r.daily_used_before) for r in got
    } == budget_model(rows, session, daily, ttl)


def test_pruning_leaves_little_of_a_hopeless_scope(spark):
    """Once a scope is out of budget its later requests do not reach the fold."""
    n = 2_000
    df = spark.range(n).select(
        F.lit("k").alias("k"), (F.col("id") * 1000).alias("ms"), "id",
        F.lit(10).cast("long").alias("est_"), F.lit(10).cast("long").alias("charge_"),
    ).withColumn("day_", folds.day_number(F.col("ms")))
    left = folds._undecided(df, df, "k", "ms", 100, 0, 10_000).count()
    assert 10 <= left < 60


@pytest.mark.parametrize("parts", PARTS)
def test_running_totals_and_usage(spark, parts):
    rows, df = make_log(spark, 6)
    got = metrics.running_usage(df, ["k"], "ms", "id", "charge", parts=parts).collect()
    used, want = {}, {}
    for i, _, k, _, _, charge, _ in rows:
        want[i] = (used.get(k, 0), used.get(k, 0) + charge)
        used[k] = want[i][1]
    assert {r.id: (r.used_before, r.used_after) for r in got} == want


@pytest.mark.parametrize("parts", PARTS)
def test_trailing_mean(spark, parts):
    rows, df = make_log(spark, 7)
    got = running.trailing_mean(df, ["k", "error"], "ms", "id", "charge", 7, "mean", parts).collect()
    seen, want = {}, {}
    for i, _, k, _, _, charge, error in rows:
        values = seen.setdefault((k, error), [])
        values.append(charge)
        want[i] = sum(values[-7:]) / len(values[-7:])
    assert {r.id: r["mean"] for r in got} == pytest.approx(want)
    with pytest.raises(ValueError):
        running.trailing_mean(df, ["k"], "ms", "id", "charge", 0, "mean")


def one_key(spark, n, step=1):
    """A log of one key, half of whose requests share a millisecond with another."""
    ids = F.col("id")
    return spark.range(n).select(
        "id", (F.floor(ids / 2) * 2 * step).alias("ms"), F.lit("k").alias("k"), (ids % 7).alias("charge"), (ids % 5 + 1).alias("est")
    ).repartition(3, "id")


def test_frames_reach_over_many_small_partitions(spark):
    df = one_key(spark, 60).withColumn("x", F.when(F.col("id") % 4 > 0, F.col("charge") / 2))
    got = {r.id: r for r in running.trailing_mean(df, ["k"], "ms", "id", "x", 25, "mean", parts=20).collect()}
    values = [i % 7 / 2 if i % 4 else None for i in range(60)]
    for i in range(60):
        known = [v for v in values[max(0, i - 24) : i + 1] if v is not None]
        assert got[i]["mean"] == (pytest.approx(sum(known) / len(known)) if known else None)


def test_null_keys_and_values_in_running_totals(spark):
    rows = [(1, 1, None, 5), (2, 2, None, None), (3, 3, "a", 2), (4, 4, None, 1), (5, 5, "a", None)]
    df = spark.createDataFrame(rows, "id long, ms long, k string, v long")
    for parts in (1, 5):
        got = running.running_totals(df, ["k"], "ms", "id", {"n": F.col("v"), "x": F.col("v") / 2}, parts)
        assert {r.id: (r.n, r.x) for r in got.collect()} == {1: (5, 2.5), 2: (5, 2.5), 3: (2, 1.0), 4: (6, 3.0), 5: (2, 1.0)}


def test_values_are_carried_forward(spark):
    rows = [(i, i % 2, i if i % 7 == 0 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "t long, k long, v long")
    last, want = {}, {}
    for t, k, v in rows:
        last[k] = v if v is not None else last.get(k)
        want[t] = last[k]
    for parts in (1, 25):
        got = running.carried_forward(df, ["k"], ["t"], "v", "w", parts).collect()
        assert {r.t: r.w for r in got} == want


def test_a_key_with_all_rows_is_spread_evenly(spark):
    """Each pass over sorted rows and each later fold sees no more than an even share."""
    df = one_key(spark, 2000, 50)
    rows = running.in_key_order(df, ["k"], ["ms", "id"], 16)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 2000 / 16
    right, open_ = folds.fold_in_order(
        df.withColumn("can_", F.lit(True)).withColumn("load_", F.lit(None).cast("string")), ["k"], ["ms", "id"],
        folds.cache_step(3000), folds.expired(3000), ["ms", "can_", "load_"], "live_ bigint, entry_ string",
        "stored_ms bigint, payload string", 16,
    )
    assert right.count() + open_.count() == 2000
    assert max(r["count"] for r in open_.groupBy("part_").count().collect()) < 3 * 2000 / 16
    states = folds._states_of_parts(open_, "ms", 3000, "string", 16).collect()
    assert len(states) == 15 and len({r.state_.stored_ms for r in states}) > 10


def test_rate_limit_stretches_between_full_buckets_are_folded_apart(spark):
    # Bursts a minute apart: the bucket is full again before each.
    df = spark.range(3000).select("id", (F.floor(F.col("id") / 20) * 60_000 + F.col("id") % 20).alias("ms"), F.lit("k").alias("k"))
    one = df.withColumn("n_", F.lit(1))
    right, open_ = folds.fold_in_order(
        one, ["k"], ["ms", "id"], folds.bucket_step(60, 0.2, 1), folds.fullness(60, 0.2, 1), ["ms", "n_"],
        "tokens_ double", "tokens double, last_ms bigint", 16,
    )
    # No stretch reaches over a whole partition.
    assert open_ is None
    got = folds.rate_limit_audit(df, "k", "ms", "id", 60, 0.2, 1, 16).collect()
    want = bucket_model([(r.id, r.ms, "k") for r in sorted(got)], 60, 0.2, 1)
    assert {r.id: (r.allowed, r.remaining, r.reset_ms) for r in got} == want


@pytest.mark.parametrize("ttl", [7, 300, 100_000])
def test_cache_of_one_key_over_many_partitions(spark, ttl):
    df = one_key(spark, 900, 3).withColumn("error", F.col("id") % 11 == 3)
    got = folds.cache_attribution(
        df, "k", "ms", "id", ttl, stores=~F.col("error"), payload=["est"], parts=24
    ).collect()
    rows = [(r.id, r.ms, "k", "h", r.est, r.charge, r.error) for r in sorted(got)]
    assert {r.id: (r.is_hit, r.stored_ms, r.stored_est) for r in got} == cache_model(rows, ttl)


def test_requests_without_a_key_never_hit(spark):
    df = spark.createDataFrame([(i, i, None, "s", 3, 2) for i in range(6)], "id long, ms long, h string, s string, est long, charge long")
    for ttl in (0, 1000):
        assert not folds.cache_attribution(df, "h", "ms", "id", ttl).where("is_hit").count()
    done = folds.cache_attribution(df, "h", "ms", "id", 1000, completed_ms=F.col("ms"))
    assert done.count() == 6 and not done.where("is_hit").count()
    for parts in (1, 4):
        ok = df.withColumn("ok", F.lit(True))
        got = folds.budget_guard_cached(ok, "s", "ms", "id", "est", "charge", "h", "ok", 0, 9, 0, parts).collect()
        assert [r.session_used_before for r in sorted(got)] == [0, 2, 4, 6, 8, 8]


def test_budgets_without_limits_fold_nothing(spark):
    _, df = make_log(spark, 4)
    plan = folds.budget_guard(df, "k", "ms", "id", "est", "charge")._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


@pytest.mark.parametrize("parts", PARTS)
def test_empty_log(spark, parts):
    _, df = make_log(spark, 9, n=5)
    none = df.where("id < 0")
    assert folds.rate_limit_audit(none, "k", "ms", "id", parts=parts).count() == 0
    assert folds.cache_attribution(none, "h", "ms", "id", parts=parts).count() == 0
    args = ("k", "ms", "id", "est", "charge", 10, 10)
    assert folds.budget_guard(none, *args, parts=parts).count() == 0


def test_idle_buckets(spark):
    df = spark.createDataFrame([("a", 0), ("a", 100_000), ("b", 400_000)], "k string, ms long")
    rows = folds.idle_buckets(df, "k", "ms", 400_001).collect()
    assert [(r.k, r.idle_ms) for r in rows] == [("a", 300_001)]
    assert folds.idle_buckets(df, "k", "ms", 400_000).count() == 0
