from veilframe.rules.client import CLIENT_RULES, ENTROPY_RULE
from veilframe.rules.entities import ENTITY_RULES, entity_rules
from veilframe.rules.gateway import GATEWAY_RULES, HEALTH_RULES, STANDARD_RULES, gateway_rules
from veilframe.rules.local import (
    COUNTER_STAGES, EXPLAINED_STAGES, LEFTMOST_PERSONAL, LEFTMOST_SECRETS, fallback_rules,
)
from veilframe.rules.model import Rule, java_regex, rules_frame, select_rules

__all__ = [n for n in dir() if not n.startswith("_")]
