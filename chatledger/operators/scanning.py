"""Scanning and redaction over tables.  Everything here is narrow: no shuffle
except where a report counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatledger.functions import scan as S
from chatledger.functions import text as X
from chatledger.rules import RULES, WHITE_SPACE, Rule

#: Rules of one pass over the texts; a larger catalogue takes several.
RULES_PER_PASS = 512


def scan_findings(
    df: DataFrame,
    id_col: str,
    text_col: str,
    rules: Sequence[Rule] | DataFrame = RULES,
    notice: str | None = None,
    error: str | None = None,
) -> DataFrame:
    """One row per match: ``id_col``, rule, match number, value, label, entropy, start.

    ``error`` names a column of why a text could not be read: it is the last one of the result,
    and rows that have one come once, without a finding."""
    rules = rules_from_table(rules) if isinstance(rules, DataFrame) else rules
    if len(rules) > RULES_PER_PASS:
        passes = [rules[i : i + RULES_PER_PASS] for i in range(0, len(rules), RULES_PER_PASS)]
        later = df.where(F.col(error).isNull()) if error else df
        scans = [scan_findings(later if i else df, id_col, text_col, p, notice, error) for i, p in enumerate(passes)]
        return reduce(DataFrame.union, scans)
    kept = [error] if error else []
    # Outer, since a plain explode has the optimizer test the size of the findings by
    # computing them once more, before an exchange that was to spread this work.
    found = F.when(S.may_have_secrets(text_col, rules), S.find_secrets(text_col, rules, notice))
    return (
        df.select(id_col, *kept, F.explode_outer(found).alias("f"))
        .where(F.col("f").isNotNull() | (F.col(error).isNotNull() if error else F.lit(False)))
        .select(
            id_col,
            F.col("f.rule_id"),
            F.col("f.rule_name"),
            F.col("f.match_no"),
            F.col("f.matched"),
            F.col("f.redacted"),
            F.col("f.entropy"),
            F.col("f.pos"),
            *kept,
        )
    )


def scan_positions(
    df: DataFrame, id_col: str, text_col: str, rules: Sequence[Rule] | DataFrame = RULES
) -> DataFrame:
    """Where each finding's full match starts, counted in UTF-16 units from 0."""
    return scan_findings(df, id_col, text_col, rules).select(id_col, "rule_id", "match_no", "pos")


def redact_text(
    df: DataFrame,
    text_col: str,
    notice: str | None = None,
    rules: Sequence[Rule] | DataFrame = RULES,
) -> DataFrame:
    """Replace ``text_col`` by ``has_secrets, n_findings, sanitized``.

    Stateless, so it serves batch and streaming frames alike.
    """
    rules = rules_from_table(rules) if isinstance(rules, DataFrame) else rules
    kept = [c for c in df.columns if c != text_col]
    return df.select(*kept, S.scan(text_col, rules, notice).alias("_s")).select(
        *kept,
        (F.size("_s.findings") > 0).alias("has_secrets"),
        F.size("_s.findings").alias("n_findings"),
        F.col("_s.sanitized").alias("sanitized"),
    )


def redact_messages(
    df: DataFrame,
    messages: str = "messages",
    notice: str | None = None,
    rules: Sequence[Rule] | DataFrame = RULES,
) -> DataFrame:
    """Redact a parsed ``messages`` array in place and add its ``findings``.

    Works inside the row, so a conversation is neither exploded nor regrouped.
    """
    rules = rules_from_table(rules) if isinstance(rules, DataFrame) else rules
    kept = [c for c in df.columns if c != messages]
    scanned = df.withColumn("_s", S.scan_messages(messages, rules, notice))
    return scanned.select(
        *kept,
        F.transform("_s", lambda s: s["message"]).alias(messages),
        F.coalesce(
            F.flatten(F.transform("_s", lambda s: s["findings"])), F.expr(S.NO_FINDINGS)
        ).alias("findings"),
    )


def policy_decision(
    df: DataFrame, findings: str = "findings", mode: str | Column = "redact"
) -> DataFrame:
    """Add ``action`` and ``status`` for a redaction mode: redact, block or off; the
    mode may be a column."""
    if isinstance(mode, str):
        if mode not in ("redact", "block", "off"):
            raise ValueError(f"unknown redaction mode {mode!r}")
        mode = F.lit(mode)
    found = F.size(findings) > 0
    action = F.when(found & (mode != "off"), mode).otherwise(F.lit("pass"))
    return df.withColumn("action", action).withColumn(
        "status", F.when(F.col("action") == "block", F.lit(403)).otherwise(F.lit(200))
    )


def block_report(df: DataFrame, id_col: str, findings: str = "findings") -> DataFrame:
    """Findings of blocked requests with a masked preview, never the value."""
    return (
        df.where(F.size(findings) > 0)
        .select(id_col, F.posexplode(findings).alias("finding_no", "f"))
        .select(
            id_col,
            (F.col("finding_no") + 1).alias("finding_no"),
            F.col("f.rule_id").alias("type"),
            F.col("f.rule_name").alias("description"),
            S.masked(F.col("f.matched")).alias("matched"),
        )
    )


def entropy_profile(df: DataFrame, token_col: str) -> DataFrame:
    """Add ``entropy``, bits per character of ``token_col``."""
    return df.withColumn("entropy", X.entropy(token_col))


def high_entropy_candidates(
    df: DataFrame,
    id_col: str,
    text_col: str,
    min_length: int = 20,
    min_entropy: float = 4.2,
) -> DataFrame:
    """White-space separated tokens that look machine generated."""
    tokens = F.filter(
        F.split(F.col(text_col), f"[{WHITE_SPACE}]+"), lambda t: F.char_length(t) >= min_length // 2
    )
    return (
        df.select(id_col, F.explode_outer(tokens).alias("token"))
        .where(X.is_high_entropy("token", min_length, min_entropy))
        .select(id_col, "token", X.entropy("token").alias("entropy"))
    )


def findings_by_rule(findings: DataFrame, id_col: str) -> DataFrame:
    """Per rule: findings, texts affected, mean entropy.

    Counts per (rule, text) first, so a rule holding most findings is already
    spread over its texts when it is shuffled.
    """
    per_text = findings.groupBy("rule_id", id_col).agg(
        F.count(F.lit(1)).alias("n"), F.sum("entropy").alias("bits")
    )
    return per_text.groupBy("rule_id").agg(
        F.sum("n").alias("n_findings"),
        F.count(F.lit(1)).alias("n_texts"),
        (F.sum("bits") / F.sum("n")).alias("mean_entropy"),
    )


def rules_from_table(table: DataFrame) -> tuple[Rule, ...]:
    """A user rule table as literals for the plan, in ``rule_id`` order.

    Columns: ``rule_id, rule_name, regex, extract_group, min_entropy``.  Rules are
    settings, not data.  As literals they are compiled once per task and need no join.
    """
    return tuple(
        Rule(r["rule_id"], r["rule_name"], r["regex"], r["extract_group"] or 0, r["min_entropy"])
        for r in table.orderBy("rule_id").collect()
    )
