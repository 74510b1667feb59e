"""Text privacy analytics on Spark: find, redact, restore, decide, and audit."""

from veilframe.plans.client import client_scan, combined_scan, with_client_spans, with_entities
from veilframe.plans.gateway import gateway_scan, leftmost_scan, with_gateway_spans
from veilframe.plans.policy import Policy

__all__ = ["Policy", "client_scan", "combined_scan", "gateway_scan", "leftmost_scan",
           "with_client_spans", "with_entities", "with_gateway_spans"]
