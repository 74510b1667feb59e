from veilframe.functions.checksums import (
    VALIDATORS, lenient_card, luhn_valid, luhn_valid_digits, register_validator,
    verhoeff_check_digit, verhoeff_valid,
)
from veilframe.functions.entropy import is_high_entropy, shannon_entropy
from veilframe.functions.labels import (
    count_placeholders, entity_label, entity_name, entity_risk, extract_placeholders,
    ledger_type, mark_placeholders, split_on_placeholders, token_prefix, type_of_model_label,
)
from veilframe.functions.language import (
    guess_language, platform_of, script_language, vendor_of, with_instruction,
)
from veilframe.functions.quality import (
    near_keyword, offsets_hold, payload_bytes, receipt_risk_level, receipt_risk_score,
)

__all__ = [n for n in dir() if not n.startswith("_")]
