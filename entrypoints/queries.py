"""One entry per operator: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatledger import plans, sources, streaming
from chatledger.operators import cache, folds, metrics, requests, scanning, sse
from entrypoints import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, places))
    return df


# --- scanning ----------------------------------------------------------------


@query
def scan_findings(spark, sf):
    return rounded(scanning.scan_findings(I.planted_documents(spark, sf), "doc_id", "text"), "entropy")


@query
def scan_positions(spark, sf):
    return scanning.scan_positions(I.planted_documents(spark, sf), "doc_id", "text")


@query
def redact_text(spark, sf):
    return scanning.redact_text(I.planted_documents(spark, sf), "text")


@query
def redact_messages(spark, sf):
    parsed = sources.parse_requests(I.chat_requests(spark, sf)).where("NOT invalid_json")
    redacted = scanning.redact_messages(parsed)
    return redacted.select(
        "conv_id", F.size("findings").alias("n_findings"), F.posexplode("messages").alias("pos", "m")
    ).select("conv_id", "n_findings", "pos", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def _scanned_requests(spark, sf):
    parsed = sources.parse_requests(I.chat_requests(spark, sf)).where("NOT invalid_json")
    return scanning.redact_messages(parsed)


@query
def policy_decision(spark, sf):
    modes = F.explode(F.array(*map(F.lit, ("redact", "block", "off")))).alias("mode")
    scanned = _scanned_requests(spark, sf).select("conv_id", "findings", modes)
    decided = scanning.policy_decision(scanned, mode=F.col("mode"))
    return decided.select("conv_id", "mode", "action", "status")


@query
def block_report(spark, sf):
    return scanning.block_report(_scanned_requests(spark, sf), "conv_id")


@query
def entropy_profile(spark, sf):
    tokens = I.planted_documents(spark, sf).select("doc_id", F.explode_outer(F.split("text", " ")).alias("token"))
    profile = scanning.entropy_profile(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token")
    return rounded(profile, "entropy")


@query
def high_entropy_candidates(spark, sf):
    return rounded(
        scanning.high_entropy_candidates(I.planted_documents(spark, sf), "doc_id", "text"), "entropy"
    )


@query
def rules_cross_scan(spark, sf):
    docs = I.spread_table(spark, sf, "documents", "doc_id").select("doc_id", "text")
    found = scanning.scan_findings(docs, "doc_id", "text", rules=I.user_rules(spark))
    return rounded(found, "entropy")


@query
def findings_by_rule(spark, sf):
    found = scanning.scan_findings(I.planted_documents(spark, sf), "doc_id", "text")
    return rounded(scanning.findings_by_rule(found, "doc_id"), "mean_entropy")


@query
def scan_files(spark, sf):
    pages = I.planted(I.table(spark, sf, "pages").select("page_id", "html"), "page_id", "html")
    # Pages as files of many folders; some names begin with a dot or an underscore.
    number = F.col("page_id")
    names = F.get(F.array(*map(F.lit, ("page-", ".env-", "_x-", ".github/page-"))), (number % 4).cast("int"))
    place = F.concat(F.lit("d"), number % 50, F.lit("/"), names, number, F.lit(".txt"))
    folder = sources.write_text_files(pages.select(place.alias("path"), F.col("html").alias("text")), "pages")
    if folder.startswith("file:"):
        # A link back to the root: a scan that followed it would not end.
        os.symlink(folder.removeprefix("file:"), folder.removeprefix("file:") + "/loop")
    found = sources.scan_files(spark, folder)
    page = F.regexp_extract("path", r"-(\d+)\.txt$", 1).cast("bigint")
    return rounded(
        found.select(page.alias("page_id"), "rule_id", "match_no", "matched", "entropy"), "entropy"
    )


# --- requests ----------------------------------------------------------------


@query
def parse_requests(spark, sf):
    return sources.parse_requests(I.chat_requests(spark, sf)).select(
        "conv_id",
        "invalid_json",
        "model",
        F.when(~F.col("invalid_json"), F.size("messages")).alias("n_messages"),
        F.when(
            ~F.col("invalid_json"), F.size(F.filter("messages", lambda m: m["is_parts"]))
        ).alias("n_multipart"),
        "stream",
        "temperature",
        "temperature_present",
        "max_tokens",
        "top_p",
        "tools",
        "tool_choice",
    )


@query
def estimate_tokens(spark, sf):
    return requests.estimate_tokens(_scanned_requests(spark, sf)).select("conv_id", "est_tokens")


@query
def canonical_request(spark, sf):
    return requests.canonical_request(_scanned_requests(spark, sf)).select("conv_id", "canonical")


@query
def request_fingerprint(spark, sf):
    return requests.request_fingerprint(_scanned_requests(spark, sf)).select("conv_id", "hash")


@query
def fingerprint_duplicates(spark, sf):
    return requests.fingerprint_duplicates(I.request_log(spark, sf), ts="ms").withColumnsRenamed(
        {"first_ts": "first_ms", "last_ts": "last_ms"}
    )


@query
def cost_estimate(spark, sf):
    priced = requests.cost_estimate(I.request_log(spark, sf), "est_tokens")
    totals = priced.groupBy("model").agg(F.sum("cost_usd").alias("cost_usd"))
    return rounded(totals, "cost_usd")


@query
def usage_resolve(spark, sf):
    return requests.usage_resolve(I.responses(spark, sf)).select(
        "stream_id", "prompt_tokens", "completion_tokens"
    )


@query
def client_key(spark, sf):
    # Forwarded-for present, empty or absent; peer likewise.
    log = I.table(spark, sf, "events")
    forwarded = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("10.0.0."), F.col("user_id") % 16)).when(
        F.col("user_id") % 3 == 1, F.lit("")
    )
    peer = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("10.1.0."), F.col("user_id") % 8)).otherwise("")
    return (
        log.select(requests.client_key(forwarded, peer).alias("client"))
        .groupBy("client")
        .agg(F.count(F.lit(1)).alias("n_requests"))
    )


# --- cache table -------------------------------------------------------------


def _stored_cache(spark, sf):
    """The cache as the bucketed table that lookups and upserts work on."""
    path = sources.shared_path(spark, "cache")
    name = "cache_" + path[-32:]
    sources.write_response_cache(I.cache_entries(spark, sf), name, path)
    return sources.read_response_cache(spark, name)


@query
def response_cache(spark, sf):
    return _stored_cache(spark, sf)


@query
def cache_lookup(spark, sf):
    return cache.cache_lookup(I.lookups(spark, sf), _stored_cache(spark, sf))


@query
def cache_lookup_tiered(spark, sf):
    entries = _stored_cache(spark, sf)
    hot = entries.where(F.col("prompt_tokens") % 3 == 0)
    return cache.cache_lookup_tiered(I.lookups(spark, sf), hot, entries)


@query
def cache_misses(spark, sf):
    return cache.cache_misses(I.lookups(spark, sf), _stored_cache(spark, sf))


@query
def cache_hits_semi(spark, sf):
    later = I.lookups(spark, sf).withColumn("now_ms", F.col("now_ms") + I.TTL_MS)
    return cache.cache_hits_semi(_stored_cache(spark, sf), later).select("hash", "created_at", "ttl_ms")


def _new_entries(old):
    """Later versions of some entries, and some entries of their own."""
    newer = old.where(F.col("prompt_tokens") % 2 == 0).withColumns(
        {"created_at": F.col("created_at") + 1000, "response_body": F.lit("newer")}
    )
    other = old.withColumns({"hash": F.sha2("hash", 256), "response_body": F.lit("other")})
    return newer.unionByName(other)


@query
def cache_upsert(spark, sf):
    stored = _stored_cache(spark, sf)
    return cache.cache_upsert(stored, _new_entries(stored))


@query
def response_cache_versions(spark, sf):
    """A cache changed in place: entries, upsert, hits, evictions, expiry."""
    entries, log = I.cache_entries(spark, sf), I.request_log(spark, sf)
    stored = sources.VersionedCache(spark, sources.shared_path(spark, "cache-versions"), buckets=16)
    stored.publish(entries)
    stored.upsert(_new_entries(stored.read()))
    stored.touch(I.lookups(spark, sf).where(F.col("request_id") % 3 > 0))
    stored.evict(log.where(F.col("upstream_error") & (F.col("request_id") % 5 == 0)).select("hash"))
    stored.prune(I.last_ms(spark, sf))
    return stored.read()


@query
def cache_touch(spark, sf):
    hits = I.lookups(spark, sf).where(F.col("request_id") % 3 > 0)
    return cache.cache_touch(_stored_cache(spark, sf), hits).select(
        "hash", "hit_count", "last_accessed_at"
    )


@query
def cache_evict(spark, sf):
    listed = I.request_log(spark, sf).where("upstream_error").select("hash")
    return cache.cache_evict(I.cache_entries(spark, sf), listed).select("hash", "model", "created_at")


@query
def cache_prune_expired(spark, sf):
    live = cache.cache_prune_expired(I.cache_entries(spark, sf), I.last_ms(spark, sf))
    return live.select("hash", "created_at", "ttl_ms")


@query
def hot_set_topk(spark, sf):
    return cache.hot_set_topk(I.lookups(spark, sf), 50)


@query
def cache_stats(spark, sf):
    return cache.cache_stats(I.cache_entries(spark, sf))


@query
def cache_savings(spark, sf):
    return rounded(cache.cache_savings(I.cache_entries(spark, sf)), "usd_saved")


# --- folds -------------------------------------------------------------------

ANSWER = ("request_id", "allowed", "remaining", "reset_ms", "retry_after_s")


@query
def rate_limit_audit(spark, sf):
    log = I.request_log(spark, sf).select("request_id", "ms", "client_id")
    return folds.rate_limit_audit(log, "client_id", "ms", "request_id", **I.LIMIT).select(*ANSWER)


@query
def rate_limit_stream(spark, sf):
    log = I.request_log(spark, sf, stream=True).select("request_id", "ms", "client_id")
    answers = streaming.rate_limit_stream(log, "client_id", "ms", "request_id", **I.LIMIT)
    return streaming.run_available(answers.select(*ANSWER), "rate_limit_stream")


@query
def idle_buckets(spark, sf):
    log = I.request_log(spark, sf).select("session_id", "ms")
    return folds.idle_buckets(log, "session_id", "ms", I.last_ms(spark, sf))


@query
def cache_attribution(spark, sf):
    log = I.request_log(spark, sf).select("request_id", "ms", "hash", "upstream_error")
    return folds.cache_attribution(
        log, "hash", "ms", "request_id", I.TTL_MS, stores=~F.col("upstream_error")
    ).select("request_id", "is_hit", "stored_ms")


@query
def cache_attribution_stream(spark, sf):
    log = I.request_log(spark, sf, stream=True).select("request_id", "ms", "hash", "upstream_error")
    hits = streaming.cache_attribution_stream(
        log, "hash", "ms", "request_id", I.TTL_MS, stores=~F.col("upstream_error")
    )
    return streaming.run_available(
        hits.select("request_id", "is_hit", "stored_ms"), "cache_attribution_stream"
    )


BUDGET = ("request_id", "allowed", "blocked_by", "session_used_before", "daily_used_before")


def _budget_log(spark, sf, stream=False):
    return I.request_log(spark, sf, stream).select(
        "request_id", "ms", "session_id", "est_tokens", "actual_tokens"
    )


@query
def budget_guard(spark, sf):
    return folds.budget_guard(
        _budget_log(spark, sf),
        "session_id",
        "ms",
        "request_id",
        "est_tokens",
        "actual_tokens",
        I.SESSION_BUDGET,
        I.DAILY_BUDGET,
    ).select(*BUDGET)


@query
def budget_guard_stream(spark, sf):
    answers = streaming.budget_guard_stream(
        _budget_log(spark, sf, stream=True),
        "session_id",
        "ms",
        "request_id",
        "est_tokens",
        "actual_tokens",
        I.SESSION_BUDGET,
        I.DAILY_BUDGET,
    )
    return streaming.run_available(answers.select(*BUDGET), "budget_guard_stream")


@query
def budget_usage(spark, sf):
    log = I.request_log(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    by_session = metrics.budget_usage(log, ["session_id"], "actual_tokens", I.SESSION_BUDGET)
    by_day = metrics.budget_usage(log, ["day"], "actual_tokens")
    return by_session.select(
        F.lit("session").alias("scope"), F.col("session_id").cast("string").alias("key"), "used", "remaining"
    ).unionByName(by_day.select(F.lit("day").alias("scope"), F.col("day").alias("key"), "used", "remaining"))


# --- metrics -----------------------------------------------------------------


@query
def usage_metrics(spark, sf):
    return rounded(metrics.usage_metrics(I.outcome_log(spark, sf), ["client_id"]), "usd_saved")


@query
def usage_metrics_stream(spark, sf):
    live = streaming.usage_metrics_stream(I.outcome_log(spark, sf, stream=True), ["client_id"])
    return rounded(streaming.run_totals(live, "usage_metrics_stream", ["client_id"]), "usd_saved")


@query
def kpi_rollup(spark, sf):
    totals = metrics.usage_metrics(I.outcome_log(spark, sf))
    return metrics.kpi_rollup(totals, 3600)


@query
def metric_samples(spark, sf):
    return metrics.metric_samples(metrics.usage_metrics(I.outcome_log(spark, sf)))


@query
def rolling_latency(spark, sf):
    return metrics.rolling_latency(I.outcome_log(spark, sf), "client_id", "ms", "request_id")


@query
def running_usage(spark, sf):
    log = I.request_log(spark, sf).select("request_id", "ms", "session_id", "actual_tokens")
    used = metrics.running_usage(log, ["session_id"], "ms", "request_id", "actual_tokens")
    return used.select("request_id", "used_before", "used_after")


@query
def running_counters(spark, sf):
    counters = metrics.running_counters(I.outcome_log(spark, sf), ["client_id"], "ms", "request_id")
    return rounded(counters, "usd_saved")


# --- event streams -----------------------------------------------------------


@query
def sse_lines(spark, sf):
    return sources.sse_lines(I.sse_text(spark, sf))


@query
def sse_reassemble(spark, sf):
    return sse.sse_reassemble(sources.sse_lines(I.sse_text(spark, sf)))


@query
def sse_reassemble_stream(spark, sf):
    lines = sources.sse_lines(I.sse_text(spark, sf, stream=True))
    return streaming.run_available(streaming.sse_reassemble_stream(lines), "sse_reassemble_stream")


@query
def sse_replay(spark, sf):
    return sse.sse_replay(I.responses(spark, sf))


@query
def redact_stream(spark, sf):
    docs = I.planted(I.table_stream(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    return streaming.run_available(streaming.redact_stream(docs, "text"), "redact_stream")


# --- whole log ---------------------------------------------------------------

POLICY = plans.Policy(mode="redact", ttl_ms=I.TTL_MS, **I.LIMIT)


@query
def request_outcomes(spark, sf):
    outcomes = plans.request_outcomes(I.body_log(spark, sf), POLICY)
    return rounded(outcomes, "cost_usd")


@query
def request_outcomes_block(spark, sf):
    policy = plans.Policy(mode="block", ttl_ms=I.TTL_MS, **I.LIMIT)
    return rounded(plans.request_outcomes(I.body_log(spark, sf), policy), "cost_usd")


@query
def request_outcomes_budgets(spark, sf):
    policy = plans.Policy(
        mode="redact",
        ttl_ms=I.TTL_MS,
        session_budget=I.SESSION_BUDGET,
        daily_budget=I.DAILY_BUDGET,
        **I.LIMIT,
    )
    return rounded(plans.request_outcomes(I.body_log(spark, sf), policy), "cost_usd")


@query
def audit_log(spark, sf):
    return plans.audit_log(plans.request_outcomes(I.body_log(spark, sf), POLICY))


@query
def audit_append(spark, sf):
    rows = plans.audit_log(plans.request_outcomes(I.body_log(spark, sf), POLICY))
    path = sources.shared_path(spark, "audit")
    hits = F.col("is_cache_hit")
    sources.append_audit(rows.where(hits), path)
    sources.append_audit(rows.where(~hits), path)
    return sources.read_audit(spark, path)


@query
def audit_append_stream(spark, sf):
    outcome = F.col("outcome")
    outcomes = I.outcome_log(spark, sf, stream=True).withColumns(
        {"is_cache_hit": outcome == "hit", "status": plans.status_of(outcome)}
    )
    path, state = (sources.shared_path(spark, n) for n in ("audit-stream", "audit-stream-state"))
    writer = sources.append_audit_stream(plans.audit_log(outcomes), path, "audit", state)
    writer.trigger(availableNow=True).start().awaitTermination()
    return sources.read_audit(spark, path)


@query
def usage_report(spark, sf):
    outcomes = plans.request_outcomes(I.body_log(spark, sf), POLICY)
    return rounded(plans.usage_report(outcomes, "client_id"), "usd_saved")
