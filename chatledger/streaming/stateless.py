"""Stream operators that need no state of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from chatledger.functions.cost import Prices
from chatledger.operators.metrics import usage_metrics
from chatledger.operators.scanning import redact_text
from chatledger.rules import RULES, Rule


def redact_stream(
    prompts: DataFrame, text_col: str, notice: str | None = None, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """Redact a stream of prompts: the batch projection, unchanged."""
    return redact_text(prompts, text_col, notice, rules)


def usage_metrics_stream(
    outcomes: DataFrame, by: Sequence[str] = (), prices: Prices = Prices()
) -> DataFrame:
    """Live counters per group, for ``update`` or ``complete`` mode."""
    return usage_metrics(outcomes, by, prices)
