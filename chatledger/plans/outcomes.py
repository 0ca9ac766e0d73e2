"""From a raw request log to outcomes, audit rows and reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatledger.functions.cost import Prices
from chatledger.functions.text import epoch_ms, is_json, utc_day
from chatledger.operators import folds
from chatledger.operators.metrics import usage_metrics
from chatledger.operators.requests import client_key, estimate_tokens, request_fingerprint, usage_resolve
from chatledger.operators.scanning import redact_messages
from chatledger.rules import RULES, Rule
from chatledger.sources.requests import parse_requests
from chatledger.sources.tables import checkpointed


@dataclass(frozen=True)
class Policy:
    """The settings a log is judged by."""

    mode: str = "redact"
    notice: str | None = None
    rules: Sequence[Rule] = RULES
    rpm: float = 60
    burst: float = 1.5
    ttl_ms: int = 86_400_000
    l1: bool = True
    l2: bool = True
    session_budget: int = 0
    daily_budget: int = 0
    prices: Prices = field(default_factory=Prices)


def profile_requests(log: DataFrame, policy: Policy = Policy(), body: str = "body") -> DataFrame:
    """Replace ``body`` by what later steps need: validity, model, token estimate,
    fingerprint and number of findings.

    One narrow pass over the texts; nothing after it carries a body.
    """
    parsed = parse_requests(log, body)
    if policy.mode == "off":
        scanned = parsed.withColumn("n_findings", F.lit(0))
    else:
        scanned = redact_messages(parsed, "messages", policy.notice, policy.rules)
        scanned = scanned.withColumn("n_findings", F.size("findings"))
    scanned = estimate_tokens(scanned)
    if "response" in log.columns:
        # An answer that is not JSON is passed on, but neither counted nor stored.
        broken = ~F.col("is_stream") & ~is_json(F.col("response"))
        scanned = usage_resolve(scanned.withColumn("unparsed", F.coalesce(broken, F.lit(True))))
    else:
        scanned = scanned.withColumn("unparsed", F.lit(False)).withColumn("prompt_tokens", F.col("est_tokens"))
    read = (body, "model", "response", "is_stream", "completion_tokens", "prompt_tokens", "unparsed")
    kept = [c for c in log.columns if c not in read]
    return request_fingerprint(scanned).select(
        *kept, "invalid_json", "model", "stream", "n_findings", "est_tokens", "hash",
        "prompt_tokens", "completion_tokens", "unparsed",
    )


#: What a request is known by to those that went through the rate limit: columns of the log as
#: they are, since Spark does a join on others only after those the log was made by.
PLACE = ("client_id", "ts", "request_id")


def _timed(log: DataFrame) -> DataFrame:
    return log.withColumn("ms", epoch_ms(F.col("ts")))


def _limited(df: DataFrame, policy: Policy) -> DataFrame:
    """Add ``allowed``, the answer of the rate limit."""
    answered = folds.rate_limit_audit(df, "client_id", "ms", "request_id", policy.rpm, policy.burst)
    return answered.drop("remaining", "reset_ms", "retry_after_s")


def _passing(log: DataFrame, policy: Policy) -> DataFrame | None:
    """The places the rate limit lets requests through at, if those are the smaller part of
    the log and a place tells whether its request passes (the same place may occur twice)."""
    limits = checkpointed(_limited(_timed(log.select(*PLACE)), policy), "limits")
    passed = F.count_if("allowed").alias("passed_")
    places = limits.groupBy(*PLACE).agg(F.count("*").alias("asked_"), passed).where("passed_ > 0")
    places = checkpointed(places, "passing")
    known = places.agg(F.sum("passed_"), F.max(F.col("asked_") - F.col("passed_"))).first()
    if 2 * (known[0] or 0) > limits.count() or known[1]:
        return None
    return places.select(*PLACE)


def _rated(log: DataFrame, policy: Policy, body: str) -> DataFrame:
    """The profile of a log with ``allowed``, written; requests over the rate limit may have
    nothing but their model."""
    passing = _passing(log, policy)
    if passing is None:
        profile = checkpointed(profile_requests(_timed(log), policy, body), "profile")
        return checkpointed(_limited(profile, policy), "rated")
    passing = passing.select(*[F.col(c).alias(f"_{c}") for c in PLACE])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PLACE])
    # Where the texts are joined to the log, Spark does these joins before that one.
    let_in = profile_requests(_timed(log.join(passing, same, "left_semi")), policy, body)
    stopped = _timed(log.join(passing, same, "left_anti"))
    kept = [c for c in stopped.columns if c in let_in.columns and c != "model"]
    stopped = parse_requests(stopped, body).select(*kept, "model")
    return checkpointed(
        let_in.withColumn("allowed", F.lit(True)).unionByName(
            stopped.withColumn("allowed", F.lit(False)), allowMissingColumns=True
        ),
        "profile",
    )


def request_outcomes(log: DataFrame, policy: Policy = Policy(), body: str = "body") -> DataFrame:
    """What the gateway would have done with every request of a log.

    ``log``: ``request_id, ts, client_id, session_id, body, completion_tokens,
    latency_ms, upstream_error``.  Checks in order: rate limit (429), JSON (400),
    secrets under ``block`` (403), budget (429), cache (200), upstream.

    Optional columns: ``response, is_stream`` instead of ``completion_tokens`` (a miss is
    charged with the usage its answer reports, else an estimate; a plain answer that is
    not JSON gives the outcome ``unparsed``), ``completed_ms`` (an answer is stored when
    it is done; not with budgets), and ``forwarded_for, peer`` instead of ``client_id``.

    The rate limit is the first check and needs no text: where it stops most requests, only
    those it lets through are profiled, and of the others just the model is read.  What is
    read of the texts is written to the shared folder, and
    so is the narrow result of each fold that several later steps read.  With budgets on, the cache belongs
    to the session; otherwise all requests share it.
    """
    if "client_id" not in log.columns:
        log = log.withColumn("client_id", client_key(F.col("forwarded_for"), F.col("peer")))
    rated = _rated(log, policy, body)
    early = (
        F.when(~F.col("allowed"), F.lit("rate_limited"))
        .when(F.col("invalid_json"), F.lit("invalid_json"))
        .when(F.lit(policy.mode == "block") & (F.col("n_findings") > 0), F.lit("secret_blocked"))
    )
    rated = rated.withColumn("outcome", early).drop("allowed")
    stopped = rated.where(F.col("outcome").isNotNull())
    open_ = rated.where(F.col("outcome").isNull())

    stores = ~F.col("upstream_error") & ~F.col("unparsed")
    payload = ["prompt_tokens", "completion_tokens"]
    cached = policy.l1 or policy.l2
    if policy.session_budget > 0 or policy.daily_budget > 0:
        charge = F.col("prompt_tokens") + F.col("completion_tokens")
        asked = open_.withColumn("_charge", charge).withColumn("_answered", stores)
        scope = ("session_id", "ms", "request_id", "est_tokens", "_charge")
        if cached:
            guarded = folds.budget_guard_cached(
                asked, *scope, "hash", "_answered", policy.ttl_ms, policy.session_budget, policy.daily_budget
            )
        else:
            asked = asked.withColumn("_charge", F.when(stores, charge).otherwise(0))
            guarded = folds.budget_guard(asked, *scope, policy.session_budget, policy.daily_budget)
        guarded = checkpointed(guarded, "guarded")
        over = guarded.where(~F.col("allowed")).withColumn("outcome", F.lit("budget_blocked"))
        stopped = stopped.unionByName(over.select(*stopped.columns))
        open_ = guarded.where("allowed").select(*open_.columns)
        keys = ["session_id", "hash"]
    else:
        keys = ["hash"]
    if cached:
        done = F.col("completed_ms") if "completed_ms" in log.columns and len(keys) == 1 else None
        answered = folds.cache_attribution(
            open_, keys, "ms", "request_id", policy.ttl_ms, stores=stores, completed_ms=done, payload=payload
        )
    else:
        none = [F.lit(None).cast("bigint").alias(f"stored_{c}") for c in payload]
        answered = open_.select("*", F.lit(False).alias("is_hit"), F.lit(None).cast("bigint").alias("stored_ms"), *none)
    hit = F.col("is_hit")
    answered = answered.withColumn(
        "outcome",
        F.when(hit, F.lit("hit"))
        .when(F.col("upstream_error"), F.lit("upstream_error"))
        .when(F.col("unparsed"), F.lit("unparsed"))
        .otherwise(F.lit("miss")),
    )
    everything = answered.unionByName(stopped, allowMissingColumns=True)

    outcome = F.col("outcome")

    def tokens(stored: str, own: str):
        amount = F.when(outcome == "hit", F.col(stored)).when(outcome == "miss", F.col(own))
        return F.coalesce(amount, F.lit(0)).cast("bigint")

    prompt, completion = tokens("stored_prompt_tokens", "prompt_tokens"), tokens(
        "stored_completion_tokens", "completion_tokens"
    )
    # A request stopped by the rate limit or by its JSON was never scanned.
    findings = F.when(outcome.isin("rate_limited", "invalid_json"), 0).otherwise(F.col("n_findings"))
    return everything.select(
        "request_id",
        "ms",
        "client_id",
        "session_id",
        "model",
        "outcome",
        status_of(outcome).alias("status"),
        (outcome == "hit").alias("is_cache_hit"),
        F.when(outcome == "hit", F.lit("L1" if policy.l1 else "L2")).alias("cache_tier"),
        findings.cast("bigint").alias("n_findings"),
        prompt.alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        F.when(outcome == "miss", policy.prices.usd(prompt, completion)).otherwise(0.0).alias("cost_usd"),
        F.col("latency_ms").cast("bigint").alias("latency_ms"),
    )


def status_of(outcome: Column) -> Column:
    """The HTTP status an outcome is answered with."""
    status = (
        F.when(outcome.isin("rate_limited", "budget_blocked"), 429)
        .when(outcome == "invalid_json", 400)
        .when(outcome == "secret_blocked", 403)
        .when(outcome == "upstream_error", 502)
        .otherwise(200)
    )
    return status.cast("int")


def audit_log(outcomes: DataFrame) -> DataFrame:
    """Outcomes as audit rows (see ``schemas.AUDIT_LOG``)."""
    return outcomes.select(
        F.col("ms").alias("timestamp"),
        F.col("client_id").cast("string").alias("client_ip"),
        "model",
        "is_cache_hit",
        "cache_tier",
        F.col("n_findings").alias("secrets_redacted"),
        "prompt_tokens",
        "completion_tokens",
        "latency_ms",
        F.col("status").alias("status_code"),
    )


def usage_report(outcomes: DataFrame, by: str = "client_id", prices: Prices = Prices()) -> DataFrame:
    """The counters per ``client_id``, ``model`` or ``day``, with the hit rate."""
    dated = outcomes.withColumn("day", utc_day(F.col("ms")))
    hits = F.col("cache_hits_l1") + F.col("cache_hits_l2")
    return usage_metrics(dated, [by], prices).withColumn(
        "hit_rate_pct", F.round(hits / F.col("total_requests") * 100, 1)
    )
