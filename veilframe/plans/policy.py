"""The active policy: profile, blocked keywords, and whether high risk blocks."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Fixed values.
DEFAULT_KEYWORDS = ("ProjectManhattan", "SecretCodenameX")


@dataclass(frozen=True)
class Policy:
    profile: str = "BALANCED"
    blocked_keywords: tuple[str, ...] = DEFAULT_KEYWORDS
    block_on_high_risk: bool = True

    def updated(self, **changes) -> "Policy":
        """A changed copy; keywords are made distinct and keep their order."""
        if changes.get("blocked_keywords") is not None:
            changes["blocked_keywords"] = tuple(dict.fromkeys(changes["blocked_keywords"]))
        else:
            changes.pop("blocked_keywords", None)
        return replace(self, **changes)
