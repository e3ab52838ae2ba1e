"""Column helpers: quoting, missing values, lenient casts, guarded ratios."""

from brindle.functions.scalars import (
    NA_TOKENS,
    null_if_na_token,
    null_if_nan,
    presence,
    quote,
    safe_div,
    to_date,
    to_numeric,
    to_timestamp,
)

__all__ = [
    "NA_TOKENS",
    "null_if_na_token",
    "null_if_nan",
    "presence",
    "quote",
    "safe_div",
    "to_date",
    "to_numeric",
    "to_timestamp",
]
