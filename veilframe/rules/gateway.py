"""The gateway catalogue: 25 patterns, most typed SECRET_KEY, plus the profile groups.

Fixed values: patterns, types, labels and risks must be exactly these for equal
results. Gates are ours.
"""

from veilframe.rules.client import (
    AADHAAR, CARD, CARD_GATE, EMAIL, IP_GATE, IPV4, PHONE_GATE, PRIVATE_KEY, QUOTED_VALUE_GATE,
)
from veilframe.rules.model import Rule

GATEWAY_PHONE = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
DB_LOGIN_URI = (r"(?:jdbc:)?(?:postgresql|postgres|mysql|mongodb|mongodb\+srv|redis|oracle|mssql)"
                r"://[a-zA-Z0-9_]+:[^@\s]+@[a-zA-Z0-9_.-]+:\d+/[a-zA-Z0-9_.-]+")
SECRET = "SECRET_KEY"

GATEWAY_RULES = (
    Rule("PRIVATE_KEY", PRIVATE_KEY, label="[RSA_PRIVATE_KEY_REDACTED]", risk="CRITICAL",
         confidence=100.0, any_literal=("private key-----",), fold_case=True),
    Rule("DATABASE_URI", "(?i)" + DB_LOGIN_URI, type="DB_CONNECTION_STRING",
         label="[DATABASE_URI_REDACTED]", risk="CRITICAL", confidence=100.0,
         any_literal=("://",)),
    Rule("AWS_ACCESS_KEY", r"(?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}", "word", "word", type=SECRET,
         label="[AWS_ACCESS_KEY_REDACTED]", risk="CRITICAL", confidence=100.0,
         any_literal=("AKIA", "ASIA", "ABIA", "ACCA"), signal="caps"),
    Rule("AWS_SECRET_KEY",
         r"(?i)(?:aws_secret_access_key|Secret Access Key|SecretKey|aws_secret)\s*[:=]\s*"
         r"[\"']?([a-zA-Z0-9/+]{40})[\"']?", type=SECRET,
         label="[AWS_SECRET_KEY_REDACTED]", risk="CRITICAL", confidence=99.8,
         any_literal=("aws_secret", "secret access key", "secretkey"), fold_case=True),
    Rule("OPENAI_API_KEY", r"sk-(?:proj-|admin-)?[a-zA-Z0-9_-]{32,128}", "word", "edge",
         type=SECRET, label="[OPENAI_API_KEY_REDACTED]", risk="CRITICAL", confidence=100.0,
         any_literal=("sk-",), signal="long"),
    Rule("ANTHROPIC_API_KEY", r"sk-ant-api[0-9a-zA-Z_-]{60,128}", "word", "edge",
         type=SECRET, label="[ANTHROPIC_API_KEY_REDACTED]", risk="CRITICAL", confidence=100.0,
         any_literal=("sk-ant-api",), signal="long"),
    Rule("GITHUB_TOKEN", r"(?:ghp|gho|ghu|ghs|ghr|github_pat)_[a-zA-Z0-9_]{36,255}",
         "word", "word", type=SECRET, label="[GITHUB_TOKEN_REDACTED]", risk="CRITICAL",
         confidence=100.0, any_literal=("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), signal="long"),
    Rule("SLACK_WEBHOOK",
         r"https://hooks\.slack\.com/services/T[a-zA-Z0-9_]+/B[a-zA-Z0-9_]+/[a-zA-Z0-9_]+",
         type=SECRET, label="[SLACK_WEBHOOK_REDACTED]", risk="CRITICAL", confidence=99.9,
         any_literal=("https://hooks.slack.com/services/",)),
    Rule("SLACK_BOT_TOKEN", r"xox[baprs]-[a-zA-Z0-9_-]{10,255}", "word", "edge", type=SECRET,
         label="[SLACK_TOKEN_REDACTED]", risk="CRITICAL", confidence=99.9, any_literal=("xox",)),
    Rule("GCP_API_KEY", r"AIza[0-9A-Za-z_-]{35}", "word", "edge", type=SECRET,
         label="[GCP_API_KEY_REDACTED]", risk="CRITICAL", confidence=99.7, any_literal=("AIza",), signal="long"),
    Rule("STRIPE_KEY", r"(?:sk|pk|rk)_(?:test|live)_[0-9a-zA-Z]{24,99}", "word", "word",
         type=SECRET, label="[STRIPE_KEY_REDACTED]", risk="CRITICAL", confidence=99.8,
         any_literal=("k_test_", "k_live_"), signal="long"),
    Rule("SENDGRID_API_KEY", r"SG\.[a-zA-Z0-9_-]{22}\.[a-zA-Z0-9_-]{43}", "word", "edge",
         type=SECRET, label="[SENDGRID_KEY_REDACTED]", risk="CRITICAL", confidence=99.9,
         any_literal=("SG.",), signal="long"),
    Rule("TWILIO_API_KEY", r"(?:AC|SK)[a-f0-9]{32}", "word", "word", type=SECRET,
         label="[TWILIO_KEY_REDACTED]", risk="CRITICAL", confidence=99.5,
         gate=r"[CK][a-f0-9]{32}", signal="long"),
    Rule("PASSWORD_ASSIGNMENT",
         r"(?i)(?:password|passwd|pass|pwd|api_secret|auth_secret)\s*[:=]\s*"
         r"[\"']([^\"'\s]{6,64})[\"']", type=SECRET,
         label="[PASSWORD_REDACTED]", risk="CRITICAL", confidence=99.2,
         any_literal=("pass", "pwd", "api_secret", "auth_secret"), fold_case=True,
         gate=QUOTED_VALUE_GATE),
    Rule("HINGLISH_SECRET_JARGON",
         r"(?i)(?:chabi|chabhi|khufia_code|gupta_key|chupi_key)\s*[:=]\s*"
         r"[\"']?([^\"'\s]{6,64})[\"']?", type=SECRET,
         label="[HINGLISH_SECRET_REDACTED]", risk="CRITICAL", confidence=98.9,
         any_literal=("chabi", "chabhi", "khufia_code", "gupta_key", "chupi_key"),
         fold_case=True),
    Rule("JWT_BEARER", r"(?i)Bearer\s+eyJ[a-zA-Z0-9_\-.=]{20,}", type=SECRET,
         label="[JWT_TOKEN_REDACTED]", risk="CRITICAL", confidence=99.6,
         any_literal=("bearer",), fold_case=True),
    Rule("AADHAAR_CARD", AADHAAR, "word", "word", type=SECRET,
         label="[AADHAAR_NUMBER_REDACTED]", risk="CRITICAL", confidence=98.5, gate=AADHAAR, signal="numeric"),
    Rule("PAN_CARD", r"[A-Z]{5}[0-9]{4}[A-Z]{1}", "word", "word", type=SECRET,
         label="[PAN_CARD_REDACTED]", risk="CRITICAL", confidence=99.1,
         gate=r"[A-Z]{5}[0-9]{4}[A-Z]", signal="caps"),
    Rule("IBAN_NUMBER", r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", "word", "word", type=SECRET,
         label="[IBAN_REDACTED]", risk="HIGH", confidence=98.8,
         gate=r"[A-Z]{2}\d{2}[A-Z0-9]{11}", signal="caps"),
    Rule("SWIFT_BIC", r"[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?", "word", "word", type=SECRET,
         label="[SWIFT_BIC_REDACTED]", risk="MEDIUM", confidence=97.5,
         gate=r"[A-Z]{6}[A-Z0-9]{2}", signal="caps"),
    Rule("EMAIL", EMAIL, "edge", "word", label="[EMAIL_REDACTED]", risk="HIGH",
         confidence=99.4, any_literal=("@",)),
    Rule("SSN", r"\d{3}-\d{2}-\d{4}", "word", "word", label="[SSN_REDACTED]", risk="CRITICAL",
         confidence=99.9, gate=r"\d{3}-\d{2}-\d{4}", signal="numeric"),
    Rule("CREDIT_CARD", CARD, "word", "word", label="[CREDIT_CARD_REDACTED]", risk="CRITICAL",
         confidence=99.8, gate=CARD_GATE, signal="numeric"),
    Rule("PHONE", GATEWAY_PHONE, "edge", "word", label="[PHONE_REDACTED]", risk="MEDIUM",
         confidence=96.5, gate=PHONE_GATE, signal="numeric"),
    Rule("IP_ADDRESS", IPV4, "word", "word", type=SECRET, label="[IP_REDACTED]", risk="LOW",
         confidence=97.8, gate=IP_GATE, signal="numeric"),
)

STANDARD_RULES = (
    Rule("SSN", r"\d{3}-\d{2}-\d{4}", "word", "word", gate=r"\d{3}-\d{2}-\d{4}", signal="numeric"),
    Rule("CREDIT_CARD", CARD, "word", "word", check="luhn", gate=CARD_GATE, signal="numeric"),
    Rule("EMAIL", EMAIL, "edge", "word", any_literal=("@",)),
    Rule("PHONE", GATEWAY_PHONE, "edge", "word", gate=PHONE_GATE, signal="numeric"),
)

HEALTH_RULES = (
    Rule("PATIENT_NAME", r"Patient(?:\s+Name)?[:\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)",
         "word", "word", type="PHI_NAME", any_literal=("Patient",),
         jvm=r"(?<!\w)Patient(?:\s+Name)?[:\s]+([A-Z][a-z]++(?:\s++[A-Z][a-z]++(?!\w))++)"),
    Rule("MEDICAL_RECORD", r"(?i)MRN[-:\s]*\d{6,10}", "word", "word", type="PHI_NAME",
         any_literal=("mrn",), fold_case=True, gate=r"\d{6}"),
)

KNOWLEDGE_TOKEN = r"[\w.\-]{3,}"

STRICT, BALANCED, PERMISSIVE = "STRICT", "BALANCED", "PERMISSIVE"
PERSONAL_RULES = {"EMAIL", "SSN", "CREDIT_CARD", "PHONE"}


def gateway_rules(profile: str = BALANCED, honour_profiles: bool = False):
    """Pattern rules that run under a profile, in detector order.

    In effect only the standard and health groups depend on the profile, since the 25
    patterns always run. ``honour_profiles`` gives the documented meaning: PERMISSIVE
    looks for secrets only and BALANCED lets general names pass.
    """
    if profile not in (STRICT, BALANCED, PERMISSIVE):
        raise ValueError(f"unknown profile: {profile}")
    base = GATEWAY_RULES
    if profile == PERMISSIVE:
        if honour_profiles:
            base = tuple(r for r in base if r.id not in PERSONAL_RULES)
        return base, ()
    health = HEALTH_RULES
    if honour_profiles and profile == BALANCED:
        health = ()
    return base, STANDARD_RULES + health
