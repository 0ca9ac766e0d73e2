"""Whole-log plans composed from the operators."""

from chatledger.plans.outcomes import (
    Policy,
    audit_log,
    profile_requests,
    request_outcomes,
    status_of,
    usage_report,
)

__all__ = ["Policy", "audit_log", "profile_requests", "request_outcomes", "status_of", "usage_report"]
