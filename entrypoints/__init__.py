"""The registered queries: inputs derived from the given tables, and oracle SQL."""
