"""Prices as column arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column


@dataclass(frozen=True)
class Prices:
    """USD per thousand tokens."""

    prompt: float = 0.005
    completion: float = 0.015

    def usd(self, prompt_tokens: Column, completion_tokens: Column) -> Column:
        return prompt_tokens / 1000 * self.prompt + completion_tokens / 1000 * self.completion

    def usd_at_prompt_rate(self, tokens: Column) -> Column:
        return tokens / 1000 * self.prompt
