"""Prompt-log analytics as Spark operators."""
