"""Column expressions: every helper returns a ``Column`` built from built-in
functions, so it stays inside whole-stage codegen (no Python UDFs)."""

from raceboard.functions.columns import (
    DEFAULT_CONSTRUCTOR_COLOR,
    NO_CONSTRUCTOR,
    NULL_TOKENS,
    clock_text,
    focus_opacity,
    full_name,
    is_lapped_status,
    normalise_race_date,
    null_if_token,
    text_contrast,
)

__all__ = [
    "DEFAULT_CONSTRUCTOR_COLOR",
    "NO_CONSTRUCTOR",
    "NULL_TOKENS",
    "clock_text",
    "focus_opacity",
    "full_name",
    "is_lapped_status",
    "normalise_race_date",
    "null_if_token",
    "text_contrast",
]
