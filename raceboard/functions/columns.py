"""Scalar column expressions shared by the conformed tables, reports and chart data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the source workload's behaviour) -------------------
# Constructor shown when a driver has no constructor for the period, and its colour.
NO_CONSTRUCTOR = "No Constructor"
DEFAULT_CONSTRUCTOR_COLOR = "#BAB0AC"
# Driver code shown when the driver has none.
MISSING_DRIVER_CODE = "#NA"
# Text colours for labels drawn on a constructor colour, and the brightness cut-off
# (brightness = (299 R + 587 G + 114 B) / 1000; below 125 -> white text).
LIGHT_TEXT = "#FFFFFF"
DARK_TEXT = "#000000"
BRIGHTNESS_CUTOFF = 125
# Status pattern for classified-but-lapped finishers ("+1 Lap", "+2 Laps"); matched
# case-insensitively like the source engine's LIKE.
LAPPED_STATUS_PATTERN = "+% Lap%"
# Opacity of the focused (or every, when focus is 'None') series and of the others.
NO_FOCUS = "None"
FOCUS_OPACITY = 0.75
DIM_OPACITY = 0.25
# Text tokens read as NULL in staging files: the explicit marker plus the usual
# pandas NA spellings.
NULL_TOKENS = (
    "\\N", "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
)
# --------------------------------------------------------------------------------


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_token(c: str | Column) -> Column:
    """NULL when a text cell holds one of the NULL spellings, else the (untrimmed) text."""
    c = _col(c)
    return F.when(c.isin(*NULL_TOKENS), F.lit(None).cast("string")).otherwise(c)


def full_name(first: str | Column, last: str | Column) -> Column:
    """``first || ' ' || last``; NULL when either part is NULL (not concat_ws)."""
    return F.concat(_col(first), F.lit(" "), _col(last))


def normalise_race_date(date: str | Column) -> Column:
    """ISO dates pass through; ``dd/mm/yy`` becomes ``YYYY-mm-dd`` with a 50 pivot.

    Only the two characters at position 7 are read as the year, so ``dd/mm/yyyy``
    input keeps the source's behaviour (``01/01/1998`` -> ``2019-01-01``).
    """
    d = _col(date)
    yy = F.substring(d, 7, 2)
    century = F.when(F.coalesce(yy.try_cast("int"), F.lit(0)) >= 50, F.lit("19")).otherwise(F.lit("20"))
    slashed = F.concat(century, yy, F.lit("-"), F.substring(d, 4, 2), F.lit("-"), F.substring(d, 1, 2))
    return F.when(d.contains("/"), slashed).otherwise(d)


def is_lapped_status(status: str | Column) -> Column:
    """True for '+N Lap(s)' statuses, case-insensitive; NULL for a NULL status."""
    return _col(status).ilike(LAPPED_STATUS_PATTERN)


def text_contrast(color: str | Column, default: str = DEFAULT_CONSTRUCTOR_COLOR) -> Column:
    """Readable text colour on a ``#RRGGBB`` background (NULL background -> default first).

    Integer form of ``(299 r + 587 g + 114 b) / 1000 < 125`` so no float rounding enters.
    """
    hexcode = F.coalesce(_col(color), F.lit(default))

    def channel(pos: int) -> Column:
        return F.conv(F.substring(hexcode, pos, 2), 16, 10).cast("int")

    weighted = channel(2) * 299 + channel(4) * 587 + channel(6) * 114
    return F.when(weighted < BRIGHTNESS_CUTOFF * 1000, F.lit(LIGHT_TEXT)).otherwise(F.lit(DARK_TEXT))


def focus_opacity(driver: str | Column, focus: str | Column) -> Column:
    """0.75 for the focused driver (or everyone when focus is 'None'), else 0.25."""
    f = _col(focus) if isinstance(focus, Column) else F.lit(focus)
    hit = (f == F.lit(NO_FOCUS)) | (_col(driver) == f)
    return F.when(F.coalesce(hit, F.lit(False)), F.lit(FOCUS_OPACITY)).otherwise(F.lit(DIM_OPACITY))


def _int_div(x: Column, d: int) -> Column:
    """Exact integer division of a non-negative bigint by a positive constant."""
    return F.call_function("div", x, F.lit(d))


def clock_text(ms: str | Column) -> Column:
    """Milliseconds rendered as ``M:SS.mmm`` (NULL stays NULL)."""
    m = _col(ms).cast("bigint")
    return F.concat(
        _int_div(m, 60000).cast("string"),
        F.lit(":"),
        F.lpad(_int_div(m % 60000, 1000).cast("string"), 2, "0"),
        F.lit("."),
        F.lpad((m % 1000).cast("string"), 3, "0"),
    )
