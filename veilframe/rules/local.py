"""Rule lists of the sequential and leftmost local sanitisers.

Fixed values: the patterns, their order, types, prefixes and explanations.
"""

from veilframe.rules.client import (
    AADHAAR, CARD, CARD_GATE, CLIENT_RULES, EMAIL, PHONE_GATE, PRIVATE_KEY,
)
from veilframe.rules.gateway import DB_LOGIN_URI, GATEWAY_PHONE, HEALTH_RULES
from veilframe.rules.model import Rule

SHORT_DB_URI = (r"(?:postgres|postgresql|mongodb|mysql)://[a-zA-Z0-9_]+:[^@\s]+@"
                r"[a-zA-Z0-9_.-]+:\d+/[a-zA-Z0-9_.-]+")
SSN = Rule("SSN", r"\d{3}-\d{2}-\d{4}", "word", "word", gate=r"\d{3}-\d{2}-\d{4}", signal="numeric")
PHONE = Rule("PHONE", GATEWAY_PHONE, "edge", "word", gate=PHONE_GATE, signal="numeric")
DB_URI = Rule("DB_CONNECTION_STRING", SHORT_DB_URI, "word", "edge", any_literal=("://",))
LOOSE_SK = Rule("LOOSE_SK_KEY", r"(?i)sk[-_][a-zA-Z0-9_-]{20,}", "word", "edge",
                type="SECRET_KEY", gate=r"(?i)sk[-_][a-zA-Z0-9_-]{20}", signal="long")
AKIA = Rule("AKIA_KEY", r"AKIA[0-9A-Z]{16}", "word", "word", type="SECRET_KEY",
            any_literal=("AKIA",), signal="caps")
BARE_JWT = Rule("BARE_JWT", r"eyJ[a-zA-Z0-9_-]+\.eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+",
                "word", "edge", type="SECRET_KEY", any_literal=("eyJ",))
EMAIL_RULE = Rule("EMAIL", EMAIL, "edge", "word", any_literal=("@",))

# (rule, placeholder prefix, reported type), applied one after the other.
COUNTER_STAGES = (
    (SSN, "SSN", "SSN"),
    (Rule("CREDIT_CARD", CARD, "word", "word", check="luhn_digits", gate=CARD_GATE, signal="numeric"),
     "CARD", "CREDIT_CARD"),
    (Rule("API_KEY", r"(?:sk_live_|sk_proj_|AKIA)[a-zA-Z0-9]{16,32}",
          any_literal=("sk_live_", "sk_proj_", "AKIA")), "SECRET_KEY", "API_KEY"),
    (DB_URI, "DB_CONN", "DB_CONNECTION_STRING"),
    (Rule("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}", "edge", "edge",
          any_literal=("@",)), "EMAIL", "EMAIL"),
    (PHONE, "PHONE", "PHONE"),
    (HEALTH_RULES[0].with_(group=0), "NAME", "PHI_NAME"),
)

# (rule, placeholder prefix, reported type, explanation), applied one after the other.
EXPLAINED_STAGES = (
    (LOOSE_SK, "SECRET_KEY", "SECRET_KEY",
     "OpenAI Secret API Key detected. Exposing live keys risks quota theft, unauthorized "
     "usage, and account compromise."),
    (AKIA, "SECRET_KEY", "AWS_ACCESS_KEY",
     "AWS IAM Access Key detected. Leaking AWS credentials gives full cloud infrastructure "
     "access."),
    (BARE_JWT, "JWT_SECRET", "JWT_TOKEN",
     "JSON Web Token (JWT) detected. Exposing session tokens risks identity hijacking."),
    (DB_URI, "DB_CONN", "DATABASE_URI",
     "Database Connection String detected. Leaking DB URIs exposes production credentials."),
    (SSN, "SSN", "SOCIAL_SECURITY_NUMBER",
     "Social Security Number (SSN) detected. Confidential identity data protected under "
     "GDPR/CCPA."),
    (Rule("CREDIT_CARD", CARD, "word", "word", check="lenient_card", gate=CARD_GATE, signal="numeric"),
     "CARD", "CREDIT_CARD",
     "Credit Card Number (PCI-DSS) detected. Sharing payment card details violates PCI "
     "security standards."),
    (CLIENT_RULES[14].with_(near=()), "CVV", "CARD_CVV",
     "Credit Card Security Code (CVV) detected. Exposing verification codes violates PCI-DSS."),
    (CLIENT_RULES[15].with_(near=()), "EXPIRY", "CARD_EXPIRY",
     "Card Expiration Date detected."),
    (EMAIL_RULE, "EMAIL", "EMAIL_ADDRESS",
     "Email Address detected. Sharing personal contact info risks spam and spear-phishing."),
    (PHONE, "PHONE", "PHONE_NUMBER",
     "Phone Number detected. Personal telephone numbers are classified PII."),
)

LEFTMOST_SECRETS = (LOOSE_SK, AKIA, BARE_JWT, DB_URI)
LEFTMOST_PERSONAL = (
    SSN,
    Rule("CREDIT_CARD", CARD, "word", "word", check="luhn_digits", gate=CARD_GATE, signal="numeric"),
    EMAIL_RULE,
    PHONE,
) + HEALTH_RULES


def _client(rule_id):
    return next(r for r in CLIENT_RULES if r.id == rule_id)


def fallback_rules():
    """The static-label fallback list, applied one after the other in this order."""
    from veilframe.rules.gateway import GATEWAY_RULES

    gateway = {r.id: r for r in GATEWAY_RULES}
    return (
        Rule("PRIVATE_KEY", PRIVATE_KEY, label="[RSA_PRIVATE_KEY_REDACTED]",
             any_literal=("private key-----",), fold_case=True),
        Rule("DATABASE_URI", "(?i)" + DB_LOGIN_URI, label="[DATABASE_URI_REDACTED]",
             any_literal=("://",)),
        _client("AWS_ACCESS_KEY"),
        _client("AWS_SECRET_KEY"),
        gateway["OPENAI_API_KEY"].with_(type=""),
        gateway["ANTHROPIC_API_KEY"].with_(type=""),
        _client("GITHUB_TOKEN"),
        _client("SLACK_WEBHOOK"),
        _client("SLACK_BOT_TOKEN"),
        gateway["GCP_API_KEY"].with_(type=""),
        _client("STRIPE_KEY"),
        gateway["SENDGRID_API_KEY"].with_(type=""),
        _client("TWILIO_API_KEY"),
        _client("GENERIC_SECRET_KEY"),
        _client("PASSWORD_ASSIGNMENT").with_(
            core=r"(?i)(?:password|passwd|pass|pwd)\s*[:=]\s*[\"']([^\"'\s]{6,64})[\"']"),
        _client("HINGLISH_SECRET_JARGON"),
        _client("JWT_BEARER"),
        _client("CREDIT_CARD").with_(check=""),
        _client("CARD_CVV").with_(near=()),
        _client("CARD_EXPIRY").with_(near=()),
        Rule("AADHAAR_CARD", AADHAAR, "word", "word", label="[AADHAAR_NUMBER_REDACTED]",
             gate=AADHAAR, signal="numeric"),
        _client("PAN_CARD"),
        _client("IBAN_NUMBER"),
        _client("SWIFT_BIC"),
        SSN.with_(label="[SSN_REDACTED]"),
        _client("EMAIL"),
        PHONE.with_(label="[PHONE_REDACTED]"),
    )
