from lodestat.functions.dates import (
    CANDIDATE_DATE_FORMATS,
    agreement_rate,
    date_mask,
    parse_date,
    weekday_name,
)
from lodestat.functions.numbers import clip, decimal_comma, parse_number, safe_ratio, sigmoid
from lodestat.functions.text import (
    BOOLEAN_WORDS,
    MISSING_LABEL,
    NULL_SENTINELS,
    as_modality,
    blank_to_null,
    generalize_pattern,
    has_unit,
    is_boolean_word,
    is_null_sentinel,
    normalize_text,
    recode_value,
    trailing_unit,
    variant_table,
)

__all__ = [
    "BOOLEAN_WORDS", "CANDIDATE_DATE_FORMATS", "MISSING_LABEL", "NULL_SENTINELS",
    "agreement_rate", "as_modality", "blank_to_null", "clip", "date_mask", "decimal_comma",
    "generalize_pattern", "has_unit", "is_boolean_word", "is_null_sentinel", "normalize_text",
    "parse_date", "parse_number", "recode_value", "safe_ratio", "sigmoid", "trailing_unit",
    "variant_table", "weekday_name",
]
